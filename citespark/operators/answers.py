"""From ranked chunks to answers: context, providers, events of a stream, logs."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters of a context, what stands between its blocks, the label of a block.
BUDGET, BETWEEN, LABELS = 6000, "\n\n---\n\n", {"de": "QUELLE", "en": "SOURCE"}
NO_ANSWER = {"de": "Die vorliegenden Quellen enthalten dazu keine Antwort.", "en": "The sources at hand hold no answer to this."}
JSON = {"ignoreNullFields": "false"}


def by_lang(lang: Column, texts: dict[str, str]) -> Column:
    """The text of a language; English for others."""
    return F.when(lang == "de", texts["de"]).otherwise(texts["en"])


def stripped(s: Column) -> Column:
    return F.regexp_replace(s, r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def context(ranked: DataFrame, budget: int = BUDGET) -> DataFrame:
    """ranked (item_id, rank, lang, citation, text) -> (item_id, n_blocks, context): blocks in order, up to the first that would
    exceed the budget. What stands between blocks is not counted."""
    block = F.concat(by_lang(F.col("lang"), LABELS), F.lit(": "), F.col("citation"), F.lit("\n"), F.coalesce("text", F.lit("")))
    w = W.partitionBy("item_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    running = ranked.select("item_id", "rank", block.alias("block")).withColumn("total", F.sum(F.length("block")).over(w))
    kept = running.withColumn("block", F.when(F.col("total") <= budget, F.col("block")))  # lengths are not negative: the kept ones are a prefix
    got = kept.groupBy("item_id").agg(F.array_sort(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("rank", "block")))).alias("b"))
    return got.select("item_id", F.size("b").alias("n_blocks"), F.array_join(F.transform("b", lambda x: x["block"]), BETWEEN).alias("context"))


class Provider(Protocol):
    """Makes answers for questions (item_id, question, lang) from ranked chunks (item_id, rank, chunk_id, lang, citation, text)."""

    name: str

    def available(self) -> bool: ...

    def generate(self, questions: DataFrame, ranked: DataFrame) -> DataFrame:
        """(item_id, answer, used: ids of the chunks the answer rests on)"""


class Extractive:
    """The text of the best chunk and its citation; it cannot invent anything."""

    name = "extractive"

    def available(self) -> bool:
        return True

    def generate(self, questions: DataFrame, ranked: DataFrame) -> DataFrame:
        best = ranked.where("rank = 1").select("item_id", F.concat(stripped(F.coalesce("text", F.lit(""))), F.lit("\n\n"), F.col("citation")).alias("_a"), "chunk_id")
        return questions.join(best, "item_id", "left").select(
            "item_id", F.coalesce("_a", by_lang(F.col("lang"), NO_ANSWER)).alias("answer"),
            F.when(F.col("chunk_id").isNotNull(), F.array("chunk_id")).otherwise(F.array().cast("array<string>")).alias("used"))


class Remote:
    """A model behind ``ask(prompt) -> text``; every chunk shown counts as used. Prompts go out from the tasks, one by one."""

    name = "remote"
    RULES = ("Answer from the excerpts alone. State the figure first, then copy the citation of its excerpt. Amounts are gross and monthly. Two sentences at most. "
             "If the excerpts hold no answer, say exactly: ")

    def __init__(self, ask: Callable[[str], str], up: Callable[[], bool]):
        self.ask, self.up = ask, up

    def available(self) -> bool:
        return self.up()

    def generate(self, questions: DataFrame, ranked: DataFrame) -> DataFrame:
        ask, rules, none = self.ask, self.RULES, NO_ANSWER
        shown = ranked.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("used"))
        asked = questions.join(context(ranked), "item_id", "left").join(shown, "item_id", "left")

        def run(batches):
            for pdf in batches:
                said = [ask(f"{rules}{none['de' if x == 'de' else 'en']}\n\n{c or ''}\n\n{q}") for q, x, c in zip(pdf["question"], pdf["lang"], pdf["context"])]
                yield pdf[["item_id"]].assign(answer=said, used=[list(u) if u is not None else [] for u in pdf["used"]])

        return asked.mapInPandas(run, "item_id long, answer string, used array<string>")


def route(providers: list) -> Provider:
    """The first provider that is up, asked for each batch."""
    return next(p for p in providers if p.available())


def event(name: Column | str, data: Column) -> Column:
    """One server-sent event."""
    return F.concat(F.lit("event: "), F.lit(name) if isinstance(name, str) else name, F.lit("\ndata: "), F.to_json(data, JSON), F.lit("\n\n"))


def stream_events(answers: DataFrame, pieces: Column | None = None) -> DataFrame:
    """answers (item_id, trace_id, rule, refusal, reason, as_of, notice, citations, answer, provider) -> (item_id, seq, event).

    A refused question has one event, refusal. Others have meta, with the citations before any text, then a token for each
    piece (default: the whole answer), then done; a null answer ends in error, as what was sent cannot be taken back.
    """
    pieces = F.array("answer") if pieces is None else pieces
    refusal = F.array(event("refusal", F.struct("trace_id", F.col("refusal").alias("answer"), "reason")))
    meta = F.array(event("meta", F.struct("trace_id", "as_of", "notice", "citations")))
    tokens = F.transform(pieces, lambda p: event("token", F.struct(p.alias("text"))))
    end = F.array(event("done", F.struct("trace_id", "provider")))
    failed = F.concat(meta, F.array(event("error", F.struct("trace_id", F.lit("no answer was made").alias("error")))))
    all_ = F.when(F.col("rule").isNotNull(), refusal).when(F.col("answer").isNull(), failed).otherwise(F.concat(meta, tokens, end))
    return answers.select("item_id", F.posexplode(all_).alias("seq", "event"))


def log_line(fields: list[str]) -> Column:
    """One JSON object, for a log with a line for each query."""
    return F.to_json(F.struct(*fields), JSON)


def first_citations(ranked: DataFrame) -> DataFrame:
    """ranked (item_id, rank, short_title, year, section_ref, page) with one row for each citation shown, the best ranked."""
    w = W.partitionBy("item_id", "short_title", "year", "section_ref", "page").orderBy("rank")
    return ranked.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def token_text(lines: DataFrame) -> DataFrame:
    """Lines of newline-delimited JSON (key, pos, line) -> (key, n_pieces, text): the pieces up to the first that says done.
    Lines that are not JSON are passed over."""
    read = F.from_json("line", "response string, done boolean", {"mode": "PERMISSIVE"})
    good = lines.withColumn("j", read).where("j.response is not null or j.done is not null")
    before = F.sum(F.coalesce(F.col("j.done"), F.lit(False)).cast("int")).over(W.partitionBy("key").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    kept = good.withColumn("before", F.coalesce(before, F.lit(0))).where("before = 0")
    got = kept.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("j.response", F.lit("")).alias("t")))).alias("p"))
    return got.select("key", F.size("p").alias("n_pieces"), F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"))
