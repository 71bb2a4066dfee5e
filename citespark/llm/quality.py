"""Quality by weak supervision: rules vote good, bad or abstain; expectation-maximisation over the votes estimates how
accurate each rule is; the posterior probability of good decides. Only DataFrame functions touch rows. What the driver
holds is the table of distinct vote patterns (at most 3 to the power of the number of rules) and 6 numbers for each rule.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.llm.common import SPACES, WORD, Scratch, documents

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MARKS = "!?"
RULES = ("length", "word_length", "symbols", "dup_lines", "repeats", "diversity", "letters", "capitals", "marks")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def repeat_words(words: Column) -> Column:
    """How many of the words lie in a window of five words that the array holds twice or more. Exact: equal hashes only
    choose the rows whose windows are compared as strings. O(n log n) for n words."""
    places = F.sequence(F.lit(0), F.size(words) - WINDOW)

    def at(i: Column) -> list[Column]:
        return [F.get(words, i + k) for k in range(WINDOW)]

    hashes = F.transform(places, lambda i: F.xxhash64(*at(i)))
    ordered = F.array_sort(F.transform(places, lambda i: F.struct(F.concat_ws(" ", *at(i)).alias("s"), i.alias("i"))))

    def repeated(o: Column) -> Column:
        same = F.transform(o, lambda x, k: F.when(
            (F.get(o, k - 1)["s"] == x["s"]) | (F.get(o, k + 1)["s"] == x["s"]), x["i"]))
        return F.array_sort(F.filter(same, lambda x: x.isNotNull()))

    def covered(ps: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).cast("long").alias("n"))
        return F.aggregate(ps, start, step, lambda acc: acc["n"])

    exact = let(ordered, lambda o: covered(repeated(o)))
    alike = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).when(alike, exact).otherwise(F.lit(0).cast("long"))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), all counts long; null text has no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_t"), F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(0)).alias("_w"))

    def without(s: str) -> Column:
        return F.length(F.translate("_t", s, ""))

    dups = let(F.filter(F.split("_t", "\n"), lambda line: F.translate(line, SPACES, "") != ""), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return base.select(
        F.col("_id").alias(id_col), F.size("_w").cast("long").alias("n_words"), without(SPACES).cast("long").alias("word_chars"),
        (F.length("_t") - without(SYMBOLS)).cast("long").alias("n_symbols"), dups.cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_w")).alias("n_repeat_words"), F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        F.size(F.filter("_w", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_lettered"),
        F.size(F.filter("_w", lambda w: (F.upper(w) == w) & (F.lower(w) != w))).cast("long").alias("n_capitals"), (F.length("_t") - without(MARKS)).cast("long").alias("n_marks"))


def vote_columns() -> list[Column]:
    """One column for each of RULES: 1 good, -1 bad, 0 abstains. Comparisons of integers only."""
    n, c, s = F.col("n_words"), F.col("word_chars"), F.col("n_symbols")

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return [
        vote(n >= 30, n < 10).alias("length"),
        vote((c >= 3 * n) & (c <= 9 * n), (c < n) | (c > 30 * n)).alias("word_length"),
        vote(20 * s <= n, 5 * s > n).alias("symbols"),
        vote(F.col("n_dup_lines") == 0, 2 * F.col("n_dup_lines") >= n).alias("dup_lines"),
        vote(20 * F.col("n_repeat_words") <= n, 5 * F.col("n_repeat_words") > n).alias("repeats"),
        vote((n < 400) & (2 * F.col("n_distinct") >= n), (n < 400) & (10 * F.col("n_distinct") < n)).alias("diversity"),
        vote(10 * F.col("n_lettered") >= 9 * n, 10 * F.col("n_lettered") < 7 * n).alias("letters"),
        vote(10 * F.col("n_capitals") <= n, 10 * F.col("n_capitals") > 4 * n).alias("capitals"),
        vote(20 * F.col("n_marks") <= n, 4 * F.col("n_marks") > n).alias("marks"),
    ]


VOTES = (-1, 0, 1)
#: Chance of each of VOTES from a good and from a bad row, at the start, and how many rows that belief is worth.
START, BELIEF = ((0.04, 0.26, 0.7), (0.4, 0.2, 0.4)), 10


def fit(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 100, prior: float = 0.85) -> tuple[float, list]:
    """Vote patterns with counts -> (share of good rows, for each rule the log ratio good : bad of each of VOTES).

    What is estimated for a rule is how often it votes each way on good and on bad rows; rules are taken as independent
    within a class. A rule never turns around: a bad vote never speaks for a row, a good vote never against it. No rows:
    the starting values.
    """
    table = [START] * rules
    for _ in range(rounds):
        ratios = log_ratios(table)
        good = total = 0.0
        seen = [[[BELIEF * x for x in START[c]] for c in (0, 1)] for _ in range(rules)]
        for votes, n in patterns:
            p = posterior(votes, prior, ratios)
            good, total = good + n * p, total + n
            for j, v in enumerate(votes):
                seen[j][0][v + 1] += n * p
                seen[j][1][v + 1] += n * (1 - p)
        if not total:
            break
        prior = min(max(good / total, 0.01), 0.99)
        table = [tuple(tuple(x / sum(row) for x in row) for row in pair) for pair in seen]
    return prior, log_ratios(table)


def log_ratios(table: list) -> list[tuple[float, float, float]]:
    out = []
    for good, bad in table:
        low, mid, high = (math.log(g / b) for g, b in zip(good, bad))
        out.append((min(low, 0.0), mid, max(high, 0.0)))
    return out


def posterior(votes, prior: float, ratios: list) -> float:
    logit = math.log(prior / (1 - prior)) + sum(r[v + 1] for v, r in zip(votes, ratios))
    return 1 / (1 + math.exp(-max(min(logit, 500.0), -500.0)))


def weak_supervision(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row for each row of docs: id_col, the counts, quality (posterior), base_failed and kept.

    Null and empty texts have no words and fail. Repeated rows and null ids stay, each judged alone. No rows give no
    rows. Other columns of docs do not matter. The texts are read once: the counts are written to the shared folder.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    counted = features(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    voted = scratch.put("votes", counted.select("*", failed.alias("base_failed"), *vote_columns()))
    # the estimate decides among rows that the base leaves, so those are the rows it is made from
    patterns = [(tuple(r[:-1]), r[-1]) for r in voted.where("not base_failed").groupBy(*RULES).count().orderBy(*RULES).collect()]
    prior, ratios = fit(patterns, len(RULES))
    logit = F.lit(math.log(prior / (1 - prior)))
    for rule, (low, mid, high) in zip(RULES, ratios):
        logit = logit + F.when(F.col(rule) < 0, low).when(F.col(rule) > 0, high).otherwise(mid)
    quality = 1 / (1 + F.exp(-logit))
    return voted.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.alias("quality"), "base_failed", (~F.col("base_failed") & (quality >= threshold)).alias("kept"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents: doc_id, the counts, quality, base_failed, kept; edge cases as in weak_supervision."""
    return weak_supervision(documents(spark, sf_dir))
