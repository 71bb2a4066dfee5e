"""Repeated passages by sliding sentence spans: every run of several consecutive sentences is hashed and counted over the
whole corpus; sentences inside a run that occurs earlier, in document order, are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.llm.common import SPACES, WORD, Scratch, documents, free_name, per_row

#: A sentence ends with its full stops or line ends; the pieces put together are the text.
SENTENCE = r"[^.!?\n]*[.!?\n]+|[^.!?\n]+"
RUN, MIN_CHARS = 2, 40


def sentence_list(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({SENTENCE})"), F.lit(0))


def norm(sentence: Column) -> Column:
    """What two sentences must share to be equal: their words, without case and white space."""
    return F.lower(F.translate(sentence, SPACES, ""))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs, all columns kept, with the text shortened, and n_sentences and n_removed.

    Sentences without any character but white space are passed over. Runs of ``run`` sentences (of at least ``min_chars``
    characters) are compared; the first is the one with the smallest id (null last), then the smallest place. Repeated rows
    are documents of their own: all but one lose what they share. Texts of fewer sentences stay whole. A null text stays
    null. No rows give no rows. docs may have any other columns; the counts get a _ where their names are taken.
    """
    scratch = Scratch(docs.sparkSession, "spans")
    n_sentences, n_removed = free_name(docs, "n_sentences"), free_name(docs, "n_removed")
    rows = scratch.put("docs", docs.select(F.monotonically_increasing_id().alias("_uid"), F.struct("*").alias("_row")))
    id_, text_ = F.col("_row").getField(id_col), F.col("_row").getField(text_col)
    listed = rows.select("_uid", id_.alias("_id"), sentence_list(text_).alias("_s"))
    normed = F.filter(F.transform("_s", lambda s, i: F.struct(i.alias("i"), norm(s).alias("s"))), lambda x: x["s"] != "")
    hashed = listed.select("_uid", "_id", F.transform(normed, lambda x: F.struct(
        x["i"].alias("i"), F.length(x["s"]).alias("n"), F.xxhash64(x["s"]).alias("a"), F.xxhash64(F.lit(1), x["s"]).alias("b"))).alias("_h"))
    hashed = hashed.where(F.size("_h") >= run).select("_uid", "_id", "_h", F.explode(F.sequence(F.lit(0), F.size("_h") - run)).alias("k"))
    at = [F.get("_h", F.col("k") + j) for j in range(run)]
    runs = hashed.where(sum(x["n"] for x in at) >= min_chars).select(
        "_uid", "_id", at[0]["i"].alias("start"), at[-1]["i"].alias("stop"), F.xxhash64(*(x["a"] for x in at)).alias("a"), F.xxhash64(*(x["b"] for x in at)).alias("b"))
    runs = scratch.put("runs", runs)
    order = F.struct(F.col("_id").isNull().alias("null"), "_id", "_uid", "start")
    again = runs.groupBy("a", "b").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("a", "b", "first")
    later = runs.join(again.hint("shuffle_merge"), ["a", "b"]).where((F.col("_uid") != F.col("first._uid")) | (F.col("start") != F.col("first.start")))
    gone = later.groupBy("_uid").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("_gone"))
    gone = scratch.put("gone", gone.select("_uid", F.array_distinct(F.flatten(F.transform("_gone", lambda g: F.sequence(g["start"], g["stop"])))).alias("_gone")))
    joined = rows.join(gone.hint("shuffle_merge"), "_uid", "left").select("*", sentence_list(text_).alias("_s"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_s") - 1), "_gone")  # by a hash set; a text with a run has sentences
    kept = F.array_join(F.transform(left, lambda i: F.get("_s", i)), "")
    text = F.when(F.col("_gone").isNull(), text_).otherwise(kept)
    names = [text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns]
    return joined.select(*names, F.size("_s").alias(n_sentences), F.coalesce(F.size("_gone"), F.lit(0)).alias(n_removed))


def sequence_hashes(items, stops, starts, seed: int):
    """64-bit hashes of items[start:stop] (uint64 arrays), from one pass over the items."""
    import numpy as np

    base = (0x9E3779B97F4A7C15 + 2 * seed) & ((1 << 64) - 1) | 1
    def powers(x: int):
        return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(items), x, dtype=np.uint64))), dtype=np.uint64)

    power, inverse = powers(base), powers(pow(base, -1, 1 << 64))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(items * power[:-1], dtype=np.uint64)))
    return (total[stops] - total[starts]) * inverse[starts]


def sentence_runs():
    """text -> (start, stop, a, b): every run of sentences, from each start and up to each end, that is as short as RUN and
    MIN_CHARS let it be. start and stop are places of sentences (the last one counts in), a and b hashes of what it says."""
    import re

    import numpy as np
    import xxhash

    cut, blank, digest = re.compile(SENTENCE), str.maketrans("", "", SPACES), xxhash.xxh3_128_intdigest

    def of(text: str) -> tuple:
        said = [(i, s) for i, s in enumerate(x.translate(blank).lower() for x in cut.findall(text)) if s]
        n = len(said)
        if n < RUN:
            return [], [], [], []
        ends = np.concatenate(([0], np.cumsum([len(s) for _, s in said])))
        every = np.arange(n)
        last = np.maximum(every + RUN, np.searchsorted(ends, ends[:-1] + MIN_CHARS))  # from each start: one past the end
        first = np.minimum(every + 1 - RUN, np.searchsorted(ends, ends[1:] - MIN_CHARS, side="right") - 1)  # up to each end
        forth, back = last <= n, first >= 0
        runs = np.unique(np.concatenate((np.stack((every[forth], last[forth]), 1), np.stack((first[back], every[back] + 1), 1))), axis=0)
        start, stop = runs[:, 0], runs[:, 1]
        at, h = np.array([i for i, _ in said]), [digest(s.encode("utf-8", "surrogatepass")) for _, s in said]
        a = sequence_hashes(np.array([x & ((1 << 64) - 1) for x in h], dtype=np.uint64), stop, start, 0)
        b = sequence_hashes(np.array([x >> 64 for x in h], dtype=np.uint64), stop, start, 1)
        return at[start].tolist(), at[stop - 1].tolist(), a.view(np.int64).tolist(), b.view(np.int64).tolist()

    return of


#: Words of a passage that goes wherever it lies in its sentences; GRAM words are sampled so that each PASSAGE holds a sample.
PASSAGE, GRAM = 25, 12


def word_hashes(text: str):
    """The words (without case) as uint64 hashes of two kinds, and their (start, stop) in the text."""
    import re

    import numpy as np
    import xxhash

    found = [(m.start(), m.end()) for m in re.finditer(WORD, text)]
    low = [text[a:b].lower().encode("utf-8", "surrogatepass") for a, b in found]
    h = [np.fromiter(map(xxhash.xxh64_intdigest, low, repeat(seed)), dtype=np.uint64, count=len(low)) for seed in (0, 1)]
    return h[0], h[1], found


def word_samples():
    """text -> (places, hashes) of runs of GRAM words: in each run of PASSAGE words the one with the smallest hash. Equal
    passages have equal samples."""
    import numpy as np

    def of(text: str) -> tuple:
        h, _, found = word_hashes(text)
        if len(found) < PASSAGE:
            return [], []
        start = np.arange(len(found) - GRAM + 1)
        grams = sequence_hashes(h, start + GRAM, start, 0)
        windows = np.lib.stride_tricks.sliding_window_view(grams, PASSAGE - GRAM + 1)
        at = np.unique(np.argmin(windows, axis=1) + np.arange(len(windows)))
        return at.tolist(), grams[at].view(np.int64).tolist()

    return of


def word_runs(batches: Iterator):
    """(_uid, _id, _text, at: places of samples that lie in other places too) -> (_uid, _id, ARRAYS): every run of PASSAGE
    words that holds one of them. Here start and stop are places of words."""
    import numpy as np

    for pdf in batches:
        out = []
        for text, at in zip(pdf["_text"], pdf["at"]):
            a, b, found = word_hashes(text)
            start = np.unique((np.asarray(at)[:, None] - np.arange(PASSAGE - GRAM + 1)).ravel())
            start = start[(start >= 0) & (start + PASSAGE <= len(found))]
            stop = start + PASSAGE
            out.append((start.tolist(), (stop - 1).tolist(), sequence_hashes(a, stop, start, 0).view(np.int64).tolist(), sequence_hashes(b, stop, start, 1).view(np.int64).tolist()))
        made = pd.DataFrame(out, columns=["start", "stop", "a", "b"], index=pdf.index)
        yield pd.concat([pdf[["_uid", "_id"]], made], axis=1)


ARRAYS = "start array<int>, stop array<int>, a array<bigint>, b array<bigint>"


def said_before(listed: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """listed (_uid, _id, ARRAYS) -> (_uid, <name>: array of (start, stop) of the runs that are not the first of their kind)."""
    runs = listed.select("_uid", "_id", F.explode(F.arrays_zip("start", "stop", "a", "b")).alias("r")).select("_uid", "_id", "r.*")
    order = F.struct(F.col("_id").isNull().alias("null"), "_id", "_uid", "start")
    again = runs.groupBy("a", "b").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("a", "b", "first")
    later = runs.join(again.hint("shuffle_merge"), ["a", "b"]).where((F.col("_uid") != F.col("first._uid")) | (F.col("start") != F.col("first.start")))
    return scratch.put(name, later.groupBy("_uid").agg(F.collect_set(F.struct("start", "stop")).alias(name)))


def per_text(make, rows: DataFrame, text: Column, id_: Column) -> DataFrame:
    """rows (_uid, ...) -> (_uid, _id, ARRAYS) by make()(text)."""
    plain = rows.select("_uid", id_.alias("_id"), text.alias("_text"))
    return plain.mapInPandas(per_row(make, ["_uid", "_id"], "_text", ["start", "stop", "a", "b"]), f"_uid bigint, _id {plain.schema['_id'].dataType.simpleString()}, {ARRAYS}")


def cutter():
    """text, places of sentences and of words (None or empty: none) -> the text without them. With a word goes the white space after it."""
    import re

    cut = re.compile(SENTENCE)

    def of(text: str, sentences, words) -> str:
        gone = bytearray(len(text))
        if sentences is not None and len(sentences):
            places = [m.span() for m in cut.finditer(text)]
            for s in sentences:
                a, b = places[s["start"]][0], places[s["stop"]][1]
                gone[a:b] = b"\1" * (b - a)
        if words is not None and len(words):
            firsts = [m.start() for m in re.finditer(WORD, text)] + [len(text)]
            for w in words:
                a, b = firsts[w["start"]], firsts[w["stop"] + 1]
                gone[a:b] = b"\1" * (b - a)
            for m in re.finditer(b"\1+", bytes(gone)):  # words before and after a gap stay two
                a, b = m.span()
                if 0 < a and b < len(text) and text[a - 1] not in SPACES and text[b] not in SPACES:
                    k = max(text.rfind(c, a, b) for c in SPACES)
                    gone[k] *= k < 0
        return "".join(c for c, g in zip(text, gone) if not g)

    return of


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns kept, with the text without what an earlier text (or an earlier place of it) says too.

    Removed is every passage of RUN whole sentences or more that has MIN_CHARS characters or more without white space,
    however short its sentences are, and every passage of PASSAGE words or more, wherever it lies in its sentences. Both are
    exact: samples only choose the texts and places whose runs of words are compared. Order, nulls and repeated rows are
    as in remove_repeats.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    rows = scratch.put("docs", docs.select(F.monotonically_increasing_id().alias("_uid"), F.struct("*").alias("_row")))
    id_, text_ = F.col("_row").getField(id_col), F.col("_row").getField(text_col)
    listed = scratch.put("runs", per_text(sentence_runs, rows, text_, id_))
    gone = said_before(listed, scratch, "sentences")
    scratch.drop("runs")
    plain = rows.select("_uid", text_.alias("_text"))
    samples = plain.mapInPandas(per_row(word_samples, ["_uid"], "_text", ["at", "h"]), "_uid bigint, at array<int>, h array<bigint>").where(F.size("at") > 0)
    samples = scratch.put("samples", samples)
    each = samples.select("_uid", F.explode(F.arrays_zip("at", "h")).alias("s")).select("_uid", "s.at", "s.h")
    again = each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    found = each.join(again.hint("shuffle_merge"), "h").groupBy("_uid").agg(F.collect_list("at").alias("at"))
    found = scratch.put("found", found)
    scratch.drop("samples")
    both = rows.select("_uid", id_.alias("_id"), text_.alias("_text")).join(found.hint("shuffle_merge"), "_uid")
    listed = scratch.put("windows", both.mapInPandas(word_runs, f"_uid bigint, _id {docs.schema[id_col].dataType.simpleString()}, {ARRAYS}"))
    words = said_before(listed, scratch, "words")
    scratch.drop("windows", "found")
    cut = F.pandas_udf(cut_texts, "string")
    gone = gone.join(words.hint("shuffle_merge"), "_uid", "full")
    joined = rows.join(gone.hint("shuffle_merge"), "_uid", "left")
    text = F.when(F.col("sentences").isNull() & F.col("words").isNull(), text_).otherwise(cut(text_, "sentences", "words"))
    return joined.select(*(text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns))


def cut_texts(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    of = cutter()
    for texts, *gone in batches:
        yield pd.Series([t if t is None or all(g is None for g in gs) else of(t, *gs) for t, *gs in zip(texts, *gone)], dtype=object)


def op10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_sentences, n_removed, kept_sha256) for every row of documents; edge cases as in remove_repeats."""
    done = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", F.col("n_sentences").cast("long").alias("n_sentences"), F.greatest("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                       F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with repeated passages taken out of the text; rows and columns stay. Edge cases as in remove_passages."""
    return remove_passages(docs)


ORACLE = rf"""
WITH s AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SENTENCE}') AS s FROM documents),
e AS (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) AS i FROM s),
n AS (SELECT doc_id, i, lower(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS t FROM e),
w AS (SELECT doc_id, i AS a, lead(i) OVER o AS b, t AS x, lead(t) OVER o AS y
  FROM n WHERE t <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY doc_id, a) AS k FROM w WHERE b IS NOT NULL AND length(x) + length(y) >= {MIN_CHARS}),
g AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM r WHERE k > 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_sentences, coalesce(c.n, 0)::BIGINT AS n_removed, coalesce(c.h, sha256('')) AS kept_sha256
FROM s LEFT JOIN (SELECT e.doc_id, count(g.i) AS n, sha256(coalesce(string_agg(e.t, '' ORDER BY e.i) FILTER (g.i IS NULL), '')) AS h
  FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id) c ON s.doc_id = c.doc_id
"""
