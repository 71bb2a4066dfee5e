"""The given tables as chunks, questions and vectors, and the same in SQL.

documents stand for chunks: validity, tenant and section follow from doc_id. benchmark rows are the questions; a third of
them is asked in German, and the text of the next item stands for a question's translation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.operators import index, lexical, rank

DAY = "2026-07-01"
#: What is set before a question, by item_id % 8.
OPENINGS = {0: "Should I sign? ", 1: "Can you recommend a lawyer? ", 2: "Will my court date move? ", 3: "How does a court decide? ", 4: "Wie verhandle ich? "}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = (2025 + F.col("doc_id") % 2).cast("int")
    law = F.col("doc_id") % 5 == 0
    title = F.when(F.col("doc_id") % 3 == 1, "").when(F.col("doc_id") % 3 == 2, F.concat(F.lit("Part "), F.col("doc_id") % 7))
    return documents(spark, sf_dir).select(
        "doc_id", "text", "lang", F.sha2(F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(":0")), 256).substr(1, 16).alias("chunk_id"),
        F.make_date(year, F.lit(1), F.lit(1)).alias("valid_from"),
        F.when(~law, F.make_date(year, F.lit(12), F.lit(31))).alias("valid_to"), F.when(law, "law").otherwise("kv").alias("source_type"),
        F.when(F.col("doc_id") % 10 == 9, "t9").otherwise("public").alias("tenant_id"), F.col("source").alias("short_title"),
        title.alias("section_title"), F.concat(F.lit("§ "), F.col("doc_id") % 20).alias("section_ref"), (F.col("doc_id") % 7).alias("parent"))


CHUNKS = """chunks AS (SELECT doc_id, text, lang, substr(sha256('doc-' || doc_id || ':0'), 1, 16) AS chunk_id,
  make_date((2025 + doc_id % 2)::INT, 1, 1) AS valid_from, CASE WHEN doc_id % 5 <> 0 THEN make_date((2025 + doc_id % 2)::INT, 12, 31) END AS valid_to,
  CASE WHEN doc_id % 5 = 0 THEN 'law' ELSE 'kv' END AS source_type, CASE WHEN doc_id % 10 = 9 THEN 't9' ELSE 'public' END AS tenant_id,
  source AS short_title, CASE doc_id % 3 WHEN 1 THEN '' WHEN 2 THEN 'Part ' || (doc_id % 7) END AS section_title, '§ ' || (doc_id % 20) AS section_ref, doc_id % 7 AS parent FROM documents),
scoped AS (SELECT * FROM chunks WHERE tenant_id = 'public' AND valid_from <= DATE '2026-07-01' AND (valid_to IS NULL OR valid_to >= DATE '2026-07-01'))"""


def day():
    return F.lit(DAY).cast("date")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, text, question, lang, valid_year, k)"""
    opening = F.lit("")
    for i, s in OPENINGS.items():
        opening = F.when(F.col("item_id") % 8 == i, s).otherwise(opening)
    return questions(spark, sf_dir).select(
        "item_id", "text", F.concat(opening, "text").alias("question"), F.when(F.col("item_id") % 3 == 0, "de").when(F.col("item_id") % 3 == 1, "en").otherwise("fr").alias("lang"),
        (2023 + F.col("item_id") % 9).cast("int").alias("valid_year"), ((F.col("item_id") * 7) % 60).cast("int").alias("k"))


REQUESTS = "requests AS (SELECT item_id, text, CASE item_id % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in OPENINGS.items()) + """ ELSE '' END || text AS question,
  CASE item_id % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'en' ELSE 'fr' END AS lang, (2023 + item_id % 9)::INT AS valid_year, ((item_id * 7) % 60)::INT AS k FROM benchmark)"""


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, text): a look-up table in the place of a translating model, for questions not in German."""
    q = questions(spark, sf_dir)
    n = q.agg((F.max("item_id") + 1).alias("n"))
    next_ = q.join(F.broadcast(n)).select(F.pmod(F.col("item_id") - 1, F.col("n")).alias("item_id"), "text")
    return next_.where("item_id % 3 <> 0")


TRANSLATIONS = "translated AS (SELECT * FROM (SELECT (item_id - 1 + n) % n AS item_id, text FROM benchmark, (SELECT max(item_id) + 1 AS n FROM benchmark)) WHERE item_id % 3 <> 0)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("v"))


def terms(texts: DataFrame) -> DataFrame:
    return texts.select("item_id", F.explode(F.array_distinct(rank.tokens(F.col("text")))).alias("term"))


def index_of(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The index over unstemmed words of all chunks."""
    def make(path: str) -> None:
        docs = documents(spark, sf_dir)
        index.build(rank.term_table(docs.select("doc_id", "text")), path, docs.count())

    return index.once(spark, sf_dir, make)


def compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    table = lexical.word_table(docs)
    asked = questions(spark, sf_dir).select(F.explode(lexical.words(F.lower("text"))).alias("word"))
    every = table.select("word").unionByName(asked)
    return lexical.decompound(every, lexical.parts_vocab(table), lexical.nouns(table))


def stemmed_index_of(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The index over stems and parts of compounds."""
    def make(path: str) -> None:
        docs = documents(spark, sf_dir)
        found = compounds(spark, sf_dir)
        found.write.mode("overwrite").parquet(f"{path}/compounds")
        index.build(lexical.stemmed_postings(docs, spark.read.parquet(f"{path}/compounds")), path, docs.count())

    return index.once(spark, f"{sf_dir} stems", make, ("compounds",))


def bm25_sql(allowed: str, name: str, asked: str = "benchmark", k: int = 10, part: str = "") -> str:
    """CTEs that end in ``name`` (item_id, doc_id, score, rank). part keeps names apart where it is used twice."""
    pattern = rank.TOKEN
    base = rf"""
tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{pattern}') AS t FROM chunks),
tot AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf CROSS JOIN tot GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN {rank.EPSILON} * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),""" if not part else ""
    return rf"""{base}
qt{part} AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '{pattern}')) AS term FROM {asked}),
sc{part} AS (SELECT item_id, doc_id, round(sum(idf * tf * {rank.K1 + 1} / (tf + {rank.K1} * (1 - {rank.B} + {rank.B} * dl / avgdl))), 6) AS score
  FROM tf JOIN idf USING (term) JOIN qt{part} USING (term) CROSS JOIN tot WHERE doc_id IN (SELECT doc_id FROM {allowed}) GROUP BY ALL),
{name} AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM sc{part} WHERE score > 0 QUALIFY rank <= {k})"""


def cosine_sql(allowed: str, name: str, k: int = 10, shift: int = 0) -> str:
    """CTEs that end in ``name``; shift 1: with the vector of the next item, for questions not in German."""
    asked = "benchmark b JOIN embeddings a ON a.vec_id = b.item_id" if not shift else \
        "benchmark b JOIN embeddings a ON a.vec_id = (b.item_id + 1) % (SELECT max(item_id) + 1 FROM benchmark) AND b.item_id % 3 <> 0"
    return f"""
cs_{name} AS (SELECT item_id, doc_id, round(list_dot_product(a.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM {asked}
  CROSS JOIN {allowed} c JOIN embeddings v ON v.vec_id = c.doc_id),
{name} AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM cs_{name} QUALIFY rank <= {k})"""


def rrf_sql(legs: list[str], name: str, k: int | None = 10) -> str:
    """CTEs that end in ``name``; the first leg is the dense one, the last the lexical one."""
    union = " UNION ALL ".join(f"SELECT item_id, doc_id, rank, score, {i} AS leg FROM {leg}" for i, leg in enumerate(legs))
    cols = ", ".join(f"max(CASE WHEN leg = {i} THEN {c} END) AS {n}_{c}" for n, i in (("dense", 0), ("lexical", len(legs) - 1)) for c in ("rank", "score"))
    return f"""
lg_{name} AS ({union}),
fu_{name} AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS fused, min(leg * 1000 + rank) AS f, {cols} FROM lg_{name} GROUP BY ALL),
{name} AS (SELECT item_id, doc_id, fused, dense_rank, dense_score, lexical_rank, lexical_score, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, f, doc_id)::INT AS rank FROM fu_{name}{f' QUALIFY rank <= {k}' if k else ''})"""


def cap_sql(ranked: str, name: str, k: int = 8, most: int = 3) -> str:
    return f"""
sec_{name} AS (SELECT r.*, row_number() OVER (PARTITION BY item_id, parent, section_ref ORDER BY rank) AS in_section FROM {ranked} r JOIN chunks USING (doc_id)),
{name} AS (SELECT * EXCLUDE (in_section), row_number() OVER (PARTITION BY item_id ORDER BY rank)::INT AS place FROM sec_{name} WHERE in_section <= {most} QUALIFY place <= {k})"""
