"""Ranking a table of questions against a table of chunks: exact cosine, BM25, rank fusion, rerank, section cap, recall."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the ranking: fusion constant, results of one section, BM25 saturation, length weight and floor of idf, the
#: word pattern (over lower-case text; digits are 0 to 9), candidates of a reranked search and least of a plain one.
RRF_K, MAX_PER_SECTION, K1, B, EPSILON = 60, 3, 1.5, 0.75, 0.25
TOKEN = r"[a-zäöüß0-9]+(?:[.,][0-9]+)?"
POOL, LEAST_POOL = 50, 10
#: Question vectors that a task holds at a time.
BATCH = 4096


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(0))


def pool_size(k: int, rerank: bool) -> int:
    return POOL if rerank else max(k, LEAST_POOL)


def top(scored: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The k best chunks of each question. Ties go to the smaller key. A window with a rank limit drops rows before the shuffle."""
    w = W.partitionBy("item_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """queries (item_id, qv), chunks (doc_id, v), unit vectors of one length -> the k best chunks of every question, exact.

    Questions go to the tasks in batches of BATCH, by one matrix product for a batch of chunks; only what may be among the k
    best of a batch leaves it. With more questions than BATCH the chunks are scanned once for each batch.
    """
    import numpy as np
    import pandas as pd

    n = queries.count()
    batches, out = max(1, -(-n // BATCH)), None
    for b in range(batches):
        mine = queries.where(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == b) if batches > 1 else queries
        got = mine.select("item_id", "qv").collect()
        ids, q = np.array([r.item_id for r in got], dtype=np.int64), np.array([r.qv for r in got], dtype=np.float64)

        def run(parts: Iterator[pd.DataFrame], ids=ids, q=q) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                if not len(pdf) or not len(ids):
                    continue
                docs = pdf["doc_id"].to_numpy()
                s = np.round(q @ np.array(pdf["v"].tolist(), dtype=np.float64).T, 6)
                least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(ids), -np.inf)
                i, j = np.nonzero(s >= least[:, None])
                yield pd.DataFrame({"item_id": ids[i], "doc_id": docs[j], "score": s[i, j]})

        found = chunks.select("doc_id", "v").mapInPandas(run, "item_id long, doc_id long, score double")
        out = found if out is None else out.unionByName(found)
    return top(out, k)


def term_table(chunks: DataFrame) -> DataFrame:
    """(doc_id, term, tf, dl)"""
    split = chunks.select("doc_id", tokens(F.col("text")).alias("t")).withColumn("dl", F.size("t"))
    return split.select("doc_id", "dl", F.explode("t").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def bm25(terms: DataFrame, index: dict[str, DataFrame], k: int, allowed: DataFrame | None = None) -> DataFrame:
    """terms (item_id, term), distinct; index as written by index.build -> the k best of ``allowed`` (doc_id; default all).

    A negative idf is EPSILON times the mean idf of all terms. Postings are cut down to the terms asked for before they move.
    """
    wanted = terms.join(index["terms"].select("term", "idf"), "term")
    postings = index["postings"]
    if allowed is not None:
        postings = postings.join(allowed.select("doc_id"), "doc_id", "left_semi")
    hits = postings.join(wanted, "term").join(F.broadcast(index["meta"].select("avgdl")))  # one row
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return top(hits.groupBy("item_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0"), k)


def rrf(*legs: DataFrame, k: int | None = 10, dense: int = 0, lexical: int | None = None) -> DataFrame:
    """Ranked legs -> one ranking by the sum of 1 / (60 + rank). Ties: the earlier leg, the better rank there, the smaller id.

    Rank and score of the legs numbered ``dense`` and ``lexical`` (default: the last) stay as columns; k None keeps all.
    """
    lexical, long = len(legs) - 1 if lexical is None else lexical, None
    for i, leg in enumerate(legs):
        one = leg.select("item_id", "doc_id", "rank", "score", F.lit(i).alias("leg"))
        long = one if long is None else long.unionByName(one)
    kept = [F.max(F.when(F.col("leg") == i, F.col(c))).alias(f"{name}_{c}") for name, i in (("dense", dense), ("lexical", lexical)) for c in ("rank", "score")]
    fused = long.groupBy("item_id", "doc_id").agg(
        F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 12).alias("fused"), F.min(F.struct("leg", "rank")).alias("first"), *kept)
    w = W.partitionBy("item_id").orderBy(F.desc("fused"), "first.leg", "first.rank", "doc_id")
    out = fused.withColumn("rank", F.row_number().over(w))
    return (out if k is None else out.where(F.col("rank") <= k)).drop("first")


def overlap(question: Column, text: Column) -> Column:
    """The offline stand-in of a cross-encoder: the share of the question's different words that the text has."""
    q = F.array_distinct(tokens(question))
    return F.round(F.size(F.array_intersect(q, tokens(text))) / F.greatest(F.size(q), F.lit(1)), 6)


def rerank(pool: DataFrame, questions: DataFrame, chunks: DataFrame, k: int, score=overlap) -> DataFrame:
    """pool (item_id, doc_id, rank) ordered anew by ``score(question, text)``, ties by the rank before, which stays as prior_rank."""
    pairs = pool.withColumnRenamed("rank", "prior_rank").join(questions.select("item_id", F.col("text").alias("_q")), "item_id").join(chunks.select("doc_id", F.col("text").alias("_t")), "doc_id")
    scored = pairs.withColumn("rerank", score(F.col("_q"), F.col("_t"))).drop("_q", "_t")
    w = W.partitionBy("item_id").orderBy(F.desc("rerank"), "prior_rank")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cap_sections(ranked: DataFrame, k: int, section: list[str], most: int = MAX_PER_SECTION) -> DataFrame:
    """At most ``most`` results of one section (nulls are a section), then the first k, numbered anew. To be applied last."""
    few = ranked.withColumn("in_section", F.row_number().over(W.partitionBy("item_id", *section).orderBy("rank"))).where(F.col("in_section") <= most)
    return few.withColumn("place", F.row_number().over(W.partitionBy("item_id").orderBy("rank"))).where(F.col("place") <= k).drop("in_section")


def first_hits(questions: DataFrame, ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """(item_id, r): the best rank of a true chunk; null where none is ranked."""
    hit = ranked.join(truth.select("item_id", "doc_id").distinct(), ["item_id", "doc_id"]).groupBy("item_id").agg(F.min("rank").alias("r"))
    return questions.select("item_id").join(hit, "item_id", "left")


def recall_columns(ks: tuple[int, ...] = (1, 3, 5, 10)) -> list[Column]:
    return [F.round(F.avg(F.coalesce((F.col("r") <= k).cast("double"), F.lit(0.0))), 6).alias(f"recall_{k}") for k in ks]


def recall(questions: DataFrame, ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: share of the questions given with a true chunk among the first k. A question without one counts as missed."""
    return first_hits(questions, ranked, truth).agg(F.count("*").alias("n_questions"), *recall_columns())
