"""Queries of the retrieval core: scope, coverage, citations, ranking, fusion, rerank, hybrid search, the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.functions import text as T
from citespark.operators import lexical, rank, scope
from citespark.plans import base as P


def in_force_filter(spark, sf_dir):
    return scope.scope(P.chunks(spark, sf_dir), P.day()).select("doc_id", "chunk_id", "valid_from", "valid_to")


def scope_tenant_lang(spark, sf_dir):
    return scope.scope(P.chunks(spark, sf_dir), P.day(), lang="de", source_type="law").select("doc_id", "lang")


def as_of_resolution(spark, sf_dir):
    year = F.when(F.col("item_id") % 3 > 0, (2025 + F.col("item_id") % 2).cast("int"))
    return P.questions(spark, sf_dir).select("item_id", scope.as_of(year, P.day()).alias("as_of"))


def coverage_by_source(spark, sf_dir):
    return scope.coverage(P.chunks(spark, sf_dir))


def coverage_gaps(spark, sf_dir):
    return scope.gaps(scope.coverage(P.chunks(spark, sf_dir)), F.lit("2027-01-01").cast("date")).select("source_type")


def citations_short(spark, sf_dir):
    return P.chunks(spark, sf_dir).select("doc_id", scope.citation(short=True).alias("citation"))


def citations_long(spark, sf_dir):
    return P.chunks(spark, sf_dir).select("doc_id", scope.citation().alias("citation"))


def validate_requests(spark, sf_dir):
    """A request is refused for its question (1 to 2000 characters), its year (2025 to 2030) or its k (1 to 50)."""
    return scope.check_requests(P.requests(spark, sf_dir)).select("item_id", "problem")


def validate_chunks(spark, sf_dir):
    return scope.check_chunks(P.chunks(spark, sf_dir)).groupBy("problem").agg(F.count("*").alias("n"))


def vocab(spark, sf_dir):
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-zÄÖÜäöüß]{4,})"), F.lit(0))
    found = P.chunks(spark, sf_dir).select(F.explode(words).alias("w")).groupBy(F.lower("w").alias("word")).agg(
        F.count("*").alias("n"), F.count_if(F.col("w").rlike("^[A-ZÄÖÜ]")).alias("upper"))
    return found.where("n >= 2").select("word", "n", (2 * F.col("upper") > F.col("n")).alias("noun"))


def nouns(spark, sf_dir):
    return lexical.nouns(lexical.word_table(P.documents(spark, sf_dir)))


def decompound(spark, sf_dir):
    return P.compounds(spark, sf_dir).select("word", F.array_join("parts", "+").alias("parts"))


def analyzed_terms(spark, sf_dir):
    """What the analysis makes of the questions, under both stemmers."""
    return lexical.query_terms(P.questions(spark, sf_dir), P.stemmed_index_of(spark, sf_dir)["compounds"])


def stemmed_bm25(spark, sf_dir):
    built = P.stemmed_index_of(spark, sf_dir)
    asked = lexical.query_terms(P.questions(spark, sf_dir), built["compounds"])
    return rank.bm25(asked, built, 10, scope.scope(P.chunks(spark, sf_dir), P.day()))


def bm25_stats(spark, sf_dir):
    return P.index_of(spark, sf_dir)["terms"].select("term", "df", F.round("idf", 6).alias("idf"))


def index_tables(spark, sf_dir):
    """The index as written and read back: sizes and mean length."""
    built = P.index_of(spark, sf_dir)
    sizes = built["postings"].agg(F.count("*").alias("n_postings"), F.sum("tf").alias("n_tokens"))
    return sizes.join(built["terms"].agg(F.count("*").alias("n_terms"))).join(built["meta"].select("n", F.round("avgdl", 6).alias("avgdl")))


def bm25_topk(spark, sf_dir):
    return rank.bm25(P.terms(P.questions(spark, sf_dir)), P.index_of(spark, sf_dir), 10, scope.scope(P.chunks(spark, sf_dir), P.day()))


def _dense(spark, sf_dir, k: int, chunks: DataFrame, translated: bool = False) -> DataFrame:
    v, q = P.vectors(spark, sf_dir), P.questions(spark, sf_dir).select("item_id")
    at = F.col("item_id")
    if translated:
        n = q.agg((F.max("item_id") + 1).alias("n"))
        q, at = q.where("item_id % 3 <> 0").join(F.broadcast(n)), F.pmod(F.col("item_id") + 1, F.col("n"))
    asked = q.withColumn("vec_id", at).join(v, "vec_id").select("item_id", F.col("v").alias("qv"))
    return rank.cosine(asked, chunks.select(F.col("doc_id").alias("vec_id")).join(v, "vec_id").select(F.col("vec_id").alias("doc_id"), "v"), k)


def cosine_topk(spark, sf_dir):
    return _dense(spark, sf_dir, 10, scope.scope(P.chunks(spark, sf_dir), P.day()))


def cosine_unfiltered(spark, sf_dir):
    return _dense(spark, sf_dir, 5, P.chunks(spark, sf_dir))


def pre_and_post_filter(spark, sf_dir):
    """How many of five results are left if out-of-force chunks go after ranking, and if they go before."""
    allowed = scope.scope(P.chunks(spark, sf_dir), P.day())
    post = cosine_unfiltered(spark, sf_dir).join(allowed.select("doc_id"), "doc_id", "left_semi")
    pre = _dense(spark, sf_dir, 5, allowed)
    counts = [d.groupBy("item_id").agg(F.count("*").alias(n)) for d, n in ((pre, "pre"), (post, "post"))]
    return counts[0].join(counts[1], "item_id", "left").select("item_id", "pre", F.coalesce("post", F.lit(0)).cast("long").alias("post"))


def hybrid_rrf(spark, sf_dir):
    return rank.rrf(cosine_topk(spark, sf_dir), bm25_topk(spark, sf_dir)).select("item_id", "doc_id", "fused", "rank")


def four_legs(spark, sf_dir, k: int, chunks: DataFrame) -> list[DataFrame]:
    """Dense and lexical, each with the question and with its translation, in the order in which ties are broken."""
    built = P.index_of(spark, sf_dir)
    return [_dense(spark, sf_dir, k, chunks), rank.bm25(P.terms(P.translations(spark, sf_dir)), built, k, chunks),
            _dense(spark, sf_dir, k, chunks, translated=True), rank.bm25(P.terms(P.questions(spark, sf_dir)), built, k, chunks)]


def rrf_four_leg(spark, sf_dir):
    return rank.rrf(*four_legs(spark, sf_dir, 10, scope.scope(P.chunks(spark, sf_dir), P.day())), k=None)


def rerank_topk(spark, sf_dir):
    chunks = scope.scope(P.chunks(spark, sf_dir), P.day())
    pool = rank.rrf(*four_legs(spark, sf_dir, rank.pool_size(8, False), chunks), k=rank.pool_size(8, False))
    return rank.rerank(pool, P.questions(spark, sf_dir), P.documents(spark, sf_dir), 10).select("item_id", "doc_id", "rerank", "prior_rank", "rank")


def section_cap(spark, sf_dir):
    full = rank.rrf(cosine_topk(spark, sf_dir), bm25_topk(spark, sf_dir), k=None)
    where = P.chunks(spark, sf_dir).select("doc_id", "parent", "section_ref")
    return rank.cap_sections(full.join(where, "doc_id"), 8, ["parent", "section_ref"]).select("item_id", "doc_id", "place")


def search(spark, sf_dir, k: int = 8, rerank: bool = True) -> DataFrame:
    """Hybrid search: scope, four legs of the pool's size, fusion, rerank, section cap last. Text is joined after ranking only."""
    chunks, n = scope.scope(P.chunks(spark, sf_dir), P.day()), rank.pool_size(k, rerank)
    ranked = rank.rrf(*four_legs(spark, sf_dir, n, chunks), k=n)
    if rerank:
        ranked = rank.rerank(ranked, P.questions(spark, sf_dir), P.documents(spark, sf_dir), n)
    where = P.chunks(spark, sf_dir).select("doc_id", "parent", "section_ref", "chunk_id")
    return rank.cap_sections(ranked.join(where, "doc_id"), k, ["parent", "section_ref"])


def hybrid_search(spark, sf_dir):
    return search(spark, sf_dir).select("item_id", "place", "chunk_id", "dense_score", "lexical_score", F.col("fused").alias("fused_score"), F.col("rerank").alias("rerank_score"))


def hybrid_search_plain(spark, sf_dir):
    return search(spark, sf_dir, 3, rerank=False).select("item_id", "place", "chunk_id", F.col("fused").alias("fused_score"))


def vector_check(spark, sf_dir):
    """Chunks without a vector and vectors without a chunk: an index is whole when both are none."""
    c, v = P.documents(spark, sf_dir).select("doc_id"), P.vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("has"))
    both = c.withColumn("chunk", F.lit(1)).join(v, "doc_id", "full")
    return both.agg(F.count_if(F.col("has").isNull()).alias("chunks_without"), F.count_if(F.col("chunk").isNull()).alias("vectors_without"), F.count_if(F.col("has").isNotNull() & F.col("chunk").isNotNull()).alias("paired"))


def hashed_embedding(spark, sf_dir):
    """Places and values other than zero of the offline embedder's vectors."""
    v = T.hashed_vector(rank.tokens(F.col("text")), 16)
    return P.questions(spark, sf_dir).select("item_id", F.posexplode(v).alias("place", "value")).where("value <> 0").select("item_id", "place", F.round("value", 6).alias("value"))


QUERIES = [in_force_filter, scope_tenant_lang, as_of_resolution, coverage_by_source, coverage_gaps, citations_short, citations_long, validate_requests, validate_chunks, vocab, nouns, decompound,
           analyzed_terms, stemmed_bm25, bm25_stats, index_tables, bm25_topk, cosine_topk, cosine_unfiltered, pre_and_post_filter, hybrid_rrf, rrf_four_leg, rerank_topk, section_cap, hybrid_search,
           hybrid_search_plain, vector_check, hashed_embedding]


def _decompound_sql() -> str:
    links = ", ".join(f"({i}, '{x}')" for i, x in enumerate(lexical.LINKERS))
    return rf"""
wd AS (SELECT unnest(regexp_extract_all(coalesce(text, ''), '{lexical.WORD}')) AS w FROM documents),
wt AS (SELECT lower(w) AS word, count(*) AS n, count(*) FILTER (regexp_matches(w, '^[A-ZÄÖÜ]')) AS up FROM wd WHERE regexp_matches(w, '{lexical.LETTERS}') AND length(w) >= 4 GROUP BY 1),
voc AS (SELECT word FROM wt WHERE n >= 2), nou AS (SELECT word FROM wt WHERE 2 * up > n), lnk(li, l) AS (VALUES {links}),
asked AS (SELECT unnest(regexp_extract_all(lower(text), '{lexical.WORD}')) AS word FROM benchmark),
lw AS (SELECT DISTINCT word FROM (SELECT word FROM wt UNION ALL SELECT word FROM asked) WHERE regexp_matches(word, '{lexical.LETTERS}') AND length(word) >= 11),
c1 AS (SELECT word, cut, li, left(word, cut) AS head, substr(word, cut + 1 + length(l)) AS tail FROM (SELECT word, unnest(range(4, length(word) - 3)) AS cut FROM lw) CROSS JOIN lnk
  WHERE substr(word, cut + 1, length(l)) = l AND length(word) - cut - length(l) >= 4 AND left(word, cut) IN (SELECT word FROM voc)),
two AS (SELECT word, -cut AS a, li AS b, 2 AS c, 0 AS d, 0 AS e, head || '+' || tail AS parts FROM c1 WHERE tail IN (SELECT word FROM voc)),
c2 AS (SELECT word, cut, u.li AS li, head, k, lnk.li AS li2, left(tail, k) AS mid, substr(tail, k + 1 + length(l)) AS last FROM (SELECT *, unnest(range(4, length(tail) - 3)) AS k FROM c1 WHERE length(tail) >= 8) u CROSS JOIN lnk
  WHERE substr(tail, k + 1, length(l)) = l AND length(tail) - k - length(l) >= 4 AND left(tail, k) IN (SELECT word FROM voc)),
three AS (SELECT word, -cut AS a, li AS b, 3 AS c, -k AS d, li2 AS e, head || '+' || mid || '+' || last AS parts FROM c2 WHERE last IN (SELECT word FROM voc)),
best AS (SELECT word, parts FROM (SELECT * FROM two UNION ALL SELECT * FROM three) QUALIFY row_number() OVER (PARTITION BY word ORDER BY a, b, c, d, e) = 1),
ends AS (SELECT word, cut, substr(word, cut + 1) AS parts FROM (SELECT word, unnest(range(4, length(word) - 3)) AS cut FROM lw WHERE word NOT IN (SELECT word FROM best)) WHERE substr(word, cut + 1) IN (SELECT word FROM nou)),
comp AS (SELECT * FROM best UNION ALL SELECT word, parts FROM ends QUALIFY row_number() OVER (PARTITION BY word ORDER BY cut) = 1)"""


def _analyze_sql(name: str, rows: str, key: str, lang: str) -> str:
    stem = {k: f"regexp_replace(form, '^(.{{{T.STEM},}}?)({v})$', '\\1')" for k, v in T.ENDINGS.items()}
    return rf"""
f_{name} AS (SELECT {key}, lang, unnest(list_concat([word], coalesce(string_split(parts, '+'), []))) AS form FROM (SELECT {key}, {lang} AS lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '{lexical.WORD}')) AS word FROM {rows}) LEFT JOIN comp USING (word)),
{name} AS (SELECT {key}, CASE WHEN lang = 'de' THEN {stem['de']} ELSE {stem['en']} END AS term FROM f_{name})"""


def oracle_sql() -> dict[str, str]:
    C, B = P.CHUNKS, P.bm25_sql
    two = f"{C}, {B('scoped', 'lexical')}, {P.cosine_sql('scoped', 'dense')}"

    def four(k: int) -> str:
        return f"{C}, {P.TRANSLATIONS}, {B('scoped', 'lexical', k=k)}, {B('scoped', 'lexical2', 'translated', k, '2')}, {P.cosine_sql('scoped', 'dense', k)}, {P.cosine_sql('scoped', 'dense2', k, 1)}"

    legs = ["dense", "lexical2", "dense2", "lexical"]

    def reranked(pool: str, k: int) -> str:
        return rf"""
rq AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '{rank.TOKEN}')) AS q FROM benchmark),
rt AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{rank.TOKEN}') AS t FROM documents WHERE doc_id IN (SELECT doc_id FROM {pool})),
reranked AS (SELECT p.* EXCLUDE (rank), p.rank AS prior_rank, round(len(list_intersect(q, t))::DOUBLE / greatest(len(q), 1), 6) AS rerank,
  row_number() OVER (PARTITION BY item_id ORDER BY rerank DESC, p.rank)::INT AS rank FROM {pool} p JOIN rq USING (item_id) JOIN rt USING (doc_id) QUALIFY rank <= {k})"""

    stems = f"""{C}, {_decompound_sql()}, {_analyze_sql('st', 'documents', 'doc_id', 'lang')}, {_analyze_sql('qd', 'benchmark', 'item_id', "'de'")}, {_analyze_sql('qe', 'benchmark', 'item_id', "'en'")},
tf AS (SELECT doc_id, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY doc_id) AS dl FROM st GROUP BY doc_id, term),
tot AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM st)::DOUBLE / (SELECT count(*) FROM documents) AS avgdl),
df AS (SELECT term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf CROSS JOIN tot GROUP BY term),
idf AS (SELECT term, CASE WHEN raw < 0 THEN {rank.EPSILON} * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
qt AS (SELECT item_id, term FROM qd UNION SELECT item_id, term FROM qe),
sc AS (SELECT item_id, doc_id, round(sum(idf * tf * {rank.K1 + 1} / (tf + {rank.K1} * (1 - {rank.B} + {rank.B} * dl / avgdl))), 6) AS score FROM tf JOIN idf USING (term) JOIN qt USING (term) CROSS JOIN tot
  WHERE doc_id IN (SELECT doc_id FROM scoped) GROUP BY ALL)"""
    return {
        "in_force_filter": f"WITH {C} SELECT doc_id, chunk_id, valid_from, valid_to FROM scoped",
        "scope_tenant_lang": f"WITH {C} SELECT doc_id, lang FROM scoped WHERE lang = 'de' AND source_type = 'law'",
        "as_of_resolution": "SELECT item_id, CASE WHEN item_id % 3 > 0 THEN make_date((2025 + item_id % 2)::INT, 7, 1) ELSE DATE '2026-07-01' END AS as_of FROM benchmark",
        "coverage_by_source": f"WITH {C} SELECT source_type, min(valid_from) AS earliest, CASE WHEN bool_or(valid_to IS NULL) THEN NULL ELSE max(valid_to) END AS latest, count(*) AS n_chunks FROM chunks GROUP BY source_type",
        "coverage_gaps": f"WITH {C} SELECT source_type FROM chunks GROUP BY 1 HAVING min(valid_from) > DATE '2027-01-01' OR (NOT bool_or(valid_to IS NULL) AND max(valid_to) < DATE '2027-01-01')",
        "citations_short": f"WITH {C} SELECT doc_id, '[' || short_title || CASE WHEN source_type = 'kv' THEN ' ' || year(valid_from) ELSE '' END || ', ' || section_ref || ']' AS citation FROM chunks",
        "citations_long": f"WITH {C} SELECT doc_id, '[' || short_title || CASE WHEN source_type = 'kv' THEN ' ' || year(valid_from) ELSE '' END || CASE WHEN coalesce(section_title, '') = '' THEN '' ELSE ', ' || section_title END || ', ' || section_ref || ']' AS citation FROM chunks",
        "validate_requests": f"WITH {P.REQUESTS} SELECT item_id, CASE WHEN length(question) NOT BETWEEN 1 AND 2000 THEN 'question' WHEN valid_year NOT BETWEEN 2025 AND 2030 THEN 'valid_year' WHEN k NOT BETWEEN 1 AND 50 THEN 'k' END AS problem FROM requests",
        "validate_chunks": rf"WITH {C} SELECT CASE WHEN valid_to < valid_from THEN 'interval' WHEN trim(coalesce(text, ''), E' \t\n\r') = '' THEN 'text' END AS problem, count(*) AS n FROM chunks GROUP BY 1",
        "vocab": "WITH w AS (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÄÖÜäöüß]{4,}')) AS w FROM documents) SELECT lower(w) AS word, count(*) AS n, 2 * count(*) FILTER (regexp_matches(w, '^[A-ZÄÖÜ]')) > count(*) AS noun FROM w GROUP BY 1 HAVING count(*) >= 2",
        "nouns": f"WITH {_decompound_sql()} SELECT word FROM nou",
        "decompound": f"WITH {_decompound_sql()} SELECT word, parts FROM comp",
        "analyzed_terms": f"""WITH {_decompound_sql()}, {_analyze_sql('qd', 'benchmark', 'item_id', "'de'")}, {_analyze_sql('qe', 'benchmark', 'item_id', "'en'")} SELECT item_id, term FROM qd UNION SELECT item_id, term FROM qe""",
        "stemmed_bm25": f"WITH {stems} SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM sc WHERE score > 0 QUALIFY rank <= 10",
        "bm25_stats": f"WITH {C}, {B('scoped', 'lexical')} SELECT term, df, round(idf, 6) AS idf FROM idf",
        "index_tables": f"WITH {C}, {B('scoped', 'lexical')} SELECT (SELECT count(*) FROM tf) AS n_postings, (SELECT sum(tf)::BIGINT FROM tf) AS n_tokens, (SELECT count(*) FROM idf) AS n_terms, n, round(avgdl, 6) AS avgdl FROM tot",
        "bm25_topk": f"WITH {C}, {B('scoped', 'lexical')} SELECT * FROM lexical",
        "cosine_topk": f"WITH {C}, {P.cosine_sql('scoped', 'dense')} SELECT * FROM dense",
        "cosine_unfiltered": f"WITH {C}, {P.cosine_sql('chunks', 'dense', 5)} SELECT * FROM dense",
        "pre_and_post_filter": f"WITH {C}, {P.cosine_sql('scoped', 'pre', 5)}, {P.cosine_sql('chunks', 'every', 5)} SELECT item_id, count(*) AS pre, (SELECT count(*) FROM every e WHERE e.item_id = pre.item_id AND e.doc_id IN (SELECT doc_id FROM scoped)) AS post FROM pre GROUP BY item_id",
        "hybrid_rrf": f"WITH {two}, {P.rrf_sql(['dense', 'lexical'], 'hybrid')} SELECT item_id, doc_id, fused, rank FROM hybrid",
        "rrf_four_leg": f"WITH {four(10)}, {P.rrf_sql(legs, 'hybrid', None)} SELECT * FROM hybrid",
        "rerank_topk": f"WITH {four(10)}, {P.rrf_sql(legs, 'hybrid', 10)}, {reranked('hybrid', 10)} SELECT item_id, doc_id, rerank, prior_rank, rank FROM reranked",
        "section_cap": f"WITH {two}, {P.rrf_sql(['dense', 'lexical'], 'hybrid', None)}, {P.cap_sql('hybrid', 'final')} SELECT item_id, doc_id, place FROM final",
        "hybrid_search": f"WITH {four(50)}, {P.rrf_sql(legs, 'hybrid', 50)}, {reranked('hybrid', 50)}, {P.cap_sql('reranked', 'final')} SELECT item_id, place, chunk_id, dense_score, lexical_score, fused AS fused_score, rerank AS rerank_score FROM final JOIN chunks USING (doc_id)",
        "hybrid_search_plain": f"WITH {four(10)}, {P.rrf_sql(legs, 'hybrid', 10)}, {P.cap_sql('hybrid', 'final', 3)} SELECT item_id, place, chunk_id, fused AS fused_score FROM final JOIN chunks USING (doc_id)",
        "vector_check": "SELECT count(*) FILTER (vec_id IS NULL) AS chunks_without, count(*) FILTER (doc_id IS NULL) AS vectors_without, count(*) FILTER (doc_id IS NOT NULL AND vec_id IS NOT NULL) AS paired FROM documents FULL JOIN embeddings ON doc_id = vec_id",
    }
