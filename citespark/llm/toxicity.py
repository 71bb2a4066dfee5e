"""Toxicity by a classifier with a counterfactual penalty.

A logistic regression over the set of words in a text. Labelled sentences that name a group are paired with the same
sentences under every other name of its kind; labelled sentences that name none are paired with themselves with a name set
in. The fit penalises the squared change of the score within a pair, so that naming a group neither raises nor lowers it.
Fitted on a bounded sample of labelled rows; scored on all.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.llm.common import documents, free_name

WORDS = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 20
#: Names of groups by kind; an exchange stays within a kind and a language.
GROUPS = [
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"], ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["women", "men"], ["woman", "man"], ["gay", "lesbian", "straight", "bisexual", "transgender"], ["black", "white", "asian", "latino"],
    ["immigrants", "refugees", "foreigners", "natives"], ["musulmans", "chrétiens", "juifs"], ["femmes", "hommes"], ["immigrés", "réfugiés", "étrangers"],
    ["muslime", "christen", "juden"], ["frauen", "männer"], ["migranten", "flüchtlinge", "ausländer"], ["musulmanes", "cristianos", "judíos"],
    ["mujeres", "hombres"], ["inmigrantes", "refugiados", "extranjeros"],
]
KIND = {w: g for g in GROUPS for w in g}
NAMES = sorted(KIND)
SENTENCE = re.compile(r"[^.!?\n]+")
#: Pairs that one labelled row gives at most: names set into sentences, in turn, so that all rows together cover all names.
SET_IN = 4


def word_set(text: str) -> set[str]:
    return set(WORDS.findall(text.lower()))


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def counterfactuals(text: str) -> list[tuple[set[str], set[str]]]:
    """Pairs of word sets of sentences that should score alike: one name for another of its kind in every sentence that names
    a group; where the text names none, names set into its first sentences."""
    pairs = []
    sentences = [w for s in SENTENCE.findall(text) if (w := word_set(s))]
    for words in sentences:
        for name in sorted(words & KIND.keys()):
            pairs += [(words, words - {name} | {other}) for other in KIND[name] if other != name]
    if not pairs:
        turn = zlib.crc32(text.encode("utf-8", "surrogatepass"))
        for k, words in enumerate(sentences[:SET_IN]):
            pairs.append((words, words | {NAMES[(turn + k) % len(NAMES)]}))
    return pairs


def sample_features(batches: Iterator):
    """Rows (toxic, text) -> toxic, buckets of the text's words, and for each pair the bucket it gains and the one it loses (-1: none)."""
    for pdf in batches:
        xs, gains, losses = [], [], []
        for text in pdf["text"]:
            text = text if isinstance(text, str) else ""
            pairs = counterfactuals(text)
            xs.append(sorted({bucket(w) for w in word_set(text)}))
            gains.append([next((bucket(w) for w in b - a), -1) for a, b in pairs])
            losses.append([next((bucket(w) for w in a - b), -1) for a, b in pairs])
        yield pd.DataFrame({"toxic": pdf["toxic"].to_numpy(), "x": xs, "gain": gains, "loss": losses})


def fit(y, xs: list, gains: list, losses: list, features: int = 4000, least: float = 6.0, l2: float = 0.02, fairness: float = 5.0, rounds: int = 400) -> tuple[dict[int, float], float]:
    """Labels and bucket lists -> (weight of each bucket, intercept). Equal feature lists of one label count once.

    ``features`` words at most get a weight, those whose difference between the labels is surest: their log ratio of
    frequencies times the root of their count is over ``least``, in 5 rows or more; and all names of groups. ``fairness``
    weighs the mean squared change of the score over all counterfactual pairs. The intercept is the share of label 1, so
    that a text without evidence gets that share.
    """
    import numpy as np

    xs = [np.asarray(x, dtype=np.int32) for x in xs]
    first = {(int(t), x.tobytes()): i for i, (t, x) in enumerate(zip(y, xs))}
    if len({t for t, _ in first}) < 2:
        return {}, math.log(1 / 9)
    y = np.array([t for t, _ in first], dtype=float)
    xs = [xs[i] for i in first.values()]
    gain, loss = (np.concatenate([np.asarray(side[i], dtype=np.int64) for i in first.values()]) for side in (gains, losses))
    row, word = np.repeat(np.arange(len(xs)), [len(x) for x in xs]), np.concatenate(xs)
    pos, neg = (np.bincount(word[y[row] == t], minlength=BUCKETS) for t in (1, 0))
    p, q = (pos + 0.5) / (y.sum() + 1), (neg + 0.5) / (len(y) - y.sum() + 1)
    evidence = np.abs(np.log(p / q)) * np.sqrt(pos + neg) * (pos + neg >= 5)
    names = [bucket(w) for w in NAMES]
    top = [int(b) for b in np.argsort(-evidence)[:features] if evidence[b] > least]
    chosen = {b: i for i, b in enumerate(dict.fromkeys(top + names))}
    column = np.full(BUCKETS + 1, -1)  # the last one is that of bucket -1
    column[list(chosen)] = np.arange(len(chosen))

    def sparse(rows, words):
        at = column[words]
        return rows[at >= 0], at[at >= 0]

    r, c = sparse(row, word)
    ra, ca = sparse(np.arange(len(loss)), loss)
    rb, cb = sparse(np.arange(len(gain)), gain)
    k, n, m = len(chosen), len(y), max(1, len(gain))
    w, b = np.zeros(k), math.log(y.mean() / (1 - y.mean()))
    m1, m2 = np.zeros(k), np.zeros(k)
    for i in range(1, rounds + 1):
        z = np.bincount(r, w[c], n) + b
        err = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        gap = np.bincount(rb, w[cb], m) - np.bincount(ra, w[ca], m)
        g = np.bincount(c, err[r], k) / n + l2 * w / 100
        g += fairness / m * (np.bincount(cb, gap[rb], k) - np.bincount(ca, gap[ra], k))
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        step = 0.1 * (m1 / (1 - 0.9**i)) / (np.sqrt(m2 / (1 - 0.99**i)) + 1e-8)
        w = w - step
    return {bk: float(w[i]) for bk, i in chosen.items()}, float(b)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, fairness: float = 5.0) -> tuple[dict[int, float], float]:
    """Fit on the labelled rows of docs outside the held-out third; of more than sample_rows, those with the smallest hash.

    Rows with a null label or id teach nothing. A doc_id with several labels counts with each. No labels, or one only: an
    intercept of one in ten and no weights.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").distinct()
    known = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("toxic", "text")  # at most sample_rows rows
    sample = rows.mapInPandas(sample_features, "toxic int, x array<int>, gain array<int>, loss array<int>").repartition(1)
    weights = {r.bucket: r.weight for r in sample.mapInPandas(fitted(fairness), "bucket int, weight double").collect()}
    intercept = weights.pop(-1, math.log(1 / 9))
    return weights, intercept


def fitted(fairness: float):
    """The features of the sample, which is bounded, in one task -> (bucket, weight), the intercept as bucket -1."""
    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(int(t), np.asarray(x, dtype=np.int32), g, h) for pdf in batches for t, x, g, h in zip(pdf["toxic"], pdf["x"], pdf["gain"], pdf["loss"])]
        rows.sort(key=lambda r: (r[0], r[1].tobytes()))
        weights, intercept = fit(*([r[i] for r in rows] for i in range(4)), fairness=fairness)
        yield pd.DataFrame({"bucket": [*weights, -1], "weight": [*weights.values(), intercept]})

    return run


def scores(docs: DataFrame, model: tuple[dict[int, float], float], text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a column out: the probability of label 1. Null and empty texts get the score of the intercept."""
    weight, intercept = model

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        memo: dict[str, float] = {}

        def of(word: str) -> float:
            if len(word) > 64:
                return weight.get(bucket(word), 0.0)
            got = memo.get(word)
            if got is None:
                if len(memo) > 500_000:
                    memo.clear()
                got = memo[word] = weight.get(bucket(word), 0.0)
            return got

        found = [intercept + math.fsum(map(of, word_set(t if isinstance(t, str) else ""))) for t in texts]
        return pd.Series([1 / (1 + math.exp(-max(min(z, 500.0), -500.0))) for z in found], dtype=float)

    return docs.withColumn(out, score(F.col(text_col)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of documents; a null doc_id is not held out, as it has no label."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = scores(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    """docs without the rows that score threshold or more; columns and their order stay. Null and empty texts get the share of
    label 1 and stay where that is below the threshold. No rows give no rows."""
    name = free_name(docs, "_score")
    scored = scores(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), out=name)
    return scored.where(F.col(name) < threshold).drop(name)
