"""Queries of the evaluation side. What a question expects is the title, reference and, for every other one, the document of a chunk
that follows from its number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.functions import text as T
from citespark.operators import answers as A
from citespark.operators import evaluation as E
from citespark.operators import rank, scope
from citespark.plans import base as P
from citespark.plans import retrieval as R


def _expected(spark, sf_dir) -> DataFrame:
    """(item_id, text, quote, want_title, want_ref, want_doc, tags): every fourth question quotes its chunk."""
    c = P.chunks(spark, sf_dir).select(F.col("doc_id").alias("target"), F.col("short_title").alias("want_title"), F.col("section_ref").alias("want_ref"), F.coalesce("text", F.lit("")).alias("t"))
    n = c.agg(F.count("*").alias("n"))
    q = P.questions(spark, sf_dir).join(F.broadcast(n)).withColumn("target", F.pmod(F.col("item_id") * 3, F.col("n")))
    tags = F.concat(F.array(F.concat(F.lit("kind"), F.col("item_id") % 3)), F.when(F.col("item_id") % 2 == 0, F.array(F.lit("even"))).otherwise(F.array().cast("array<string>")))
    return q.join(c, "target").select("item_id", "text", "want_title", "want_ref", F.when(F.col("item_id") % 2 == 0, F.col("target")).alias("want_doc"), tags.alias("tags"),
                                      F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("  "), F.upper(F.substring("t", 5, 60)))).otherwise(F.col("text")).alias("quote"))


EXPECTED = """expected AS (SELECT item_id, b.text, short_title AS want_title, section_ref AS want_ref, CASE WHEN item_id % 2 = 0 THEN c.doc_id END AS want_doc,
  list_concat(['kind' || (item_id % 3)], CASE WHEN item_id % 2 = 0 THEN ['even'] ELSE [] END) AS tags, CASE WHEN item_id % 4 = 0 THEN '  ' || upper(substr(coalesce(c.text, ''), 5, 60)) ELSE b.text END AS quote
  FROM benchmark b JOIN chunks c ON c.doc_id = (item_id * 3) % (SELECT count(*) FROM documents)),
hits AS (SELECT item_id, doc_id FROM expected JOIN chunks ON short_title = want_title AND section_ref = want_ref WHERE want_doc IS NULL OR want_doc = doc_id)"""


def truth_hits(spark, sf_dir):
    return E.hits(_expected(spark, sf_dir), P.chunks(spark, sf_dir))


def truth_quotes(spark, sf_dir):
    """Where the truth is real: title, reference, document, validity and the quote all fit."""
    chunks = P.chunks(spark, sf_dir)
    q = _expected(spark, sf_dir)
    return E.quoted(E.hits(q, scope.scope(chunks, P.day())), q, chunks)


def ground_truth(spark, sf_dir):
    return E.containing(P.questions(spark, sf_dir), P.documents(spark, sf_dir), P.index_of(spark, sf_dir))


def temporal_join(spark, sf_dir):
    day = F.make_date((2024 + F.col("item_id") % 4).cast("int"), F.lit(7), F.lit(1))
    q = P.questions(spark, sf_dir).select("item_id", F.lit("public").alias("tenant_id"), day.alias("day"))
    return E.in_force_hits(q, P.chunks(spark, sf_dir)).groupBy("item_id").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def recall_at_k(spark, sf_dir):
    ranked = rank.bm25(P.terms(P.questions(spark, sf_dir)), P.index_of(spark, sf_dir), 10)
    return rank.recall(P.questions(spark, sf_dir), ranked, ground_truth(spark, sf_dir))


def recall_by_tag(spark, sf_dir):
    q = _expected(spark, sf_dir)
    return E.by_tag(rank.first_hits(q, R.bm25_topk(spark, sf_dir), ground_truth(spark, sf_dir)), q.select("item_id", "tags"))


def pool_ceiling(spark, sf_dir):
    return E.ceiling(P.questions(spark, sf_dir), R.rrf_four_leg(spark, sf_dir), ground_truth(spark, sf_dir))


def misses(spark, sf_dir):
    ranked = R.bm25_topk(spark, sf_dir)
    first = rank.first_hits(P.questions(spark, sf_dir), ranked, ground_truth(spark, sf_dir))
    return E.misses(first, ranked, P.chunks(spark, sf_dir)).select("item_id", "r", F.array_join("refs", ",").alias("refs"))


def answer_metrics(spark, sf_dir):
    """Of the three best chunks: the answer says what is expected, its place is cited, the quote stands in one of them."""
    q, chunks = _expected(spark, sf_dir), P.chunks(spark, sf_dir)
    ranked = rank.bm25(P.terms(q), P.index_of(spark, sf_dir), 3, scope.scope(chunks, P.day())).select("item_id", "doc_id", "rank")
    about = ranked.join(chunks.select("doc_id", "chunk_id", "text", "lang", scope.citation(short=True).alias("citation")), "doc_id")
    made = A.Extractive().generate(q.select("item_id", F.lit("en").alias("lang")), about)
    cited = ranked.join(E.hits(q, chunks), ["item_id", "doc_id"], "left_semi").select("item_id").distinct().withColumn("cited", F.lit(True))
    grounded = E.quoted(ranked.select("item_id", "doc_id"), q, chunks).select("item_id").distinct().withColumn("grounded", F.lit(True))
    says = T.states_any(F.col("answer"), F.array(F.substring("text", 1, 20)))
    rows = q.join(made, "item_id").join(cited, "item_id", "left").join(grounded, "item_id", "left").select(says.alias("correct"), F.coalesce("cited", F.lit(False)).alias("cited"), F.coalesce("grounded", F.lit(False)).alias("grounded"))
    return E.answer_scores(rows)


def _statement():
    d = F.col("doc_id")
    n = F.when(d % 3 == 0, F.format_number(d * 37, 0)).when(d % 3 == 1, F.translate(F.format_number(d * 37, 0), ",", ".")).otherwise((d * 37).cast("string"))
    return F.concat(F.lit("From 1.1.2026 on: "), n, F.when(d % 4 == 0, ",50 EUR").otherwise(" EUR, § 12."))


def answer_match(spark, sf_dir):
    d = F.col("doc_id")
    return P.documents(spark, sf_dir).select("doc_id", T.states_amount(_statement(), d * 37).alias("own"), T.states_amount(_statement(), F.lit(12)).alias("twelve"), T.states_amount(_statement(), F.lit(112026)).alias("date"))


def version_twins(spark, sf_dir):
    return E.twins(_pairs(spark, sf_dir))


def _pairs(spark, sf_dir) -> DataFrame:
    q = P.questions(spark, sf_dir)
    said = F.concat(F.lit(" What  holds in case "), F.floor(F.col("item_id") / 2), F.when(F.col("item_id") % 10 == 3, "?").otherwise(""))
    return q.select("item_id", said.alias("question"), (2025 + F.col("item_id") % 2).cast("int").alias("valid_year"), F.when(F.col("item_id") % 14 < 2, 100).otherwise(F.col("item_id")).alias("amount"))


def pair_checks(spark, sf_dir):
    return E.unpaired(_pairs(spark, sf_dir), [2025, 2026]).select("said", F.col("values").cast("long").alias("n_values"))


def stratified_pool(spark, sf_dir):
    chunks, built, terms = P.chunks(spark, sf_dir), P.index_of(spark, sf_dir), P.terms(P.questions(spark, sf_dir))
    pools = [rank.bm25(terms, built, 5, scope.scope(chunks, P.day(), source_type=s)) for s in ("kv", "law")]
    return E.stratified(pools, 5)


def filter_ablation(spark, sf_dir):
    """Recall with and without the scope before ranking, lexical, dense and fused: one plan, a row for each."""
    lexical = rank.bm25(P.terms(P.questions(spark, sf_dir)), P.index_of(spark, sf_dir), 10)
    configs = {"lexical": lexical, "lexical, filtered": R.bm25_topk(spark, sf_dir), "dense, filtered": R.cosine_topk(spark, sf_dir), "hybrid, filtered": R.hybrid_rrf(spark, sf_dir), "stems, filtered": R.stemmed_bm25(spark, sf_dir)}
    return E.suite(P.questions(spark, sf_dir), ground_truth(spark, sf_dir), configs)


def corpus_sizes(spark, sf_dir):
    return E.text_sizes(P.chunks(spark, sf_dir), "source_type")


def distinct_documents(spark, sf_dir):
    return E.documents_of(P.chunks(spark, sf_dir), "source_type", "parent")


QUERIES = [truth_hits, truth_quotes, ground_truth, temporal_join, recall_at_k, recall_by_tag, pool_ceiling, misses, answer_metrics, answer_match, version_twins, pair_checks, stratified_pool, filter_ablation, corpus_sizes,
           distinct_documents]


def oracle_sql() -> dict[str, str]:
    C, B = P.CHUNKS, P.bm25_sql
    norm = lambda x: rf"lower(trim(regexp_replace({x}, '\s+', ' ', 'g')))"
    truth = "truth AS (SELECT item_id, doc_id FROM benchmark b JOIN chunks c ON contains(c.text, b.text))"
    ks = ", ".join(f"round(avg(CASE WHEN r <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_{k}" for k in (1, 3, 5, 10))

    def first(ranked: str, name: str = "f") -> str:
        return f"{name} AS (SELECT b.item_id, min(r.rank) AS r FROM benchmark b LEFT JOIN (SELECT item_id, rank FROM {ranked} JOIN truth USING (item_id, doc_id)) r USING (item_id) GROUP BY 1)"

    R_ = R.oracle_sql()

    def ranked_of(query: str, name: str) -> str:
        return f"{name} AS ({R_[query]})"

    n = "CASE doc_id % 3 WHEN 0 THEN format('{:,}', doc_id * 37) WHEN 1 THEN replace(format('{:,}', doc_id * 37), ',', '.') ELSE (doc_id * 37)::VARCHAR END"
    bare = "s"
    for _ in range(4):
        bare = rf"regexp_replace({bare}, '([0-9])[.,\s]([0-9]{{3}})([^0-9]|$)', '\1\2\3', 'g')"
    match = lambda amount: rf"regexp_matches(x, '(^|[^0-9.,])' || {amount} || '($|[^0-9.,]|[.,]$|[.,][^0-9])')"
    pairs = "pairs AS (SELECT item_id, ' What  holds in case ' || (item_id // 2) || CASE WHEN item_id % 10 = 3 THEN '?' ELSE '' END AS question, (2025 + item_id % 2)::INT AS valid_year, CASE WHEN item_id % 14 < 2 THEN 100 ELSE item_id END AS amount FROM benchmark)"
    suite = {"lexical": "every", "lexical, filtered": "lexical", "dense, filtered": "dense", "hybrid, filtered": "hybrid", "stems, filtered": "stems"}
    strata = ", ".join(f"s{i} AS (SELECT * FROM scoped WHERE source_type = '{s}')" for i, s in enumerate(("kv", "law")))
    return {
        "truth_hits": f"WITH {C}, {EXPECTED} SELECT * FROM hits",
        "truth_quotes": f"WITH {C}, {EXPECTED} SELECT item_id, doc_id FROM hits JOIN scoped c USING (doc_id) JOIN expected e USING (item_id) WHERE contains({norm('''coalesce(c.text, '')''')}, {norm('quote')})",
        "ground_truth": f"WITH {C}, {truth} SELECT * FROM truth",
        "temporal_join": f"WITH {C}, q AS (SELECT item_id, make_date((2024 + item_id % 4)::INT, 7, 1) AS day FROM benchmark) SELECT item_id, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM q JOIN chunks ON tenant_id = 'public' AND valid_from <= day AND (valid_to IS NULL OR day <= valid_to) GROUP BY 1",
        "recall_at_k": f"WITH {C}, {B('chunks', 'lexical')}, {truth}, {first('lexical')} SELECT count(*) AS n_questions, {ks} FROM f",
        "recall_by_tag": f"WITH {C}, {B('scoped', 'lexical')}, {truth}, {EXPECTED}, {first('lexical')}, t AS (SELECT unnest(tags) AS tag, r FROM expected JOIN f USING (item_id)) SELECT tag, count(*) AS n_questions, {ks} FROM t GROUP BY 1",
        "pool_ceiling": f"WITH {C}, {truth}, {ranked_of('rrf_four_leg', 'pool')}, {first('pool')} SELECT count(*) AS n_questions, round(avg((r IS NOT NULL)::INT::DOUBLE), 6) AS ceiling FROM f",
        "misses": f"WITH {C}, {B('scoped', 'lexical')}, {truth}, {first('lexical')}, t AS (SELECT item_id, string_agg(section_ref, ',' ORDER BY rank) AS refs FROM lexical JOIN chunks USING (doc_id) WHERE rank <= 3 GROUP BY 1) SELECT item_id, r, coalesce(refs, '') AS refs FROM f LEFT JOIN t USING (item_id) WHERE r IS NULL OR r > 5",
        "answer_metrics": f"""WITH {C}, {EXPECTED}, {B('scoped', 'lexical', k=3)}, a AS (SELECT item_id, c.text FROM lexical JOIN chunks c USING (doc_id) WHERE rank = 1),
s AS (SELECT coalesce(contains(lower(regexp_replace(coalesce(a.text, 'The sources at hand hold no answer to this.'), '^[ \\t\\n\\r]+', '')), lower(substr(e.text, 1, 20))), false) AS correct,
  EXISTS (SELECT 1 FROM lexical l JOIN hits h USING (item_id, doc_id) WHERE l.item_id = e.item_id) AS cited, EXISTS (SELECT 1 FROM lexical l JOIN chunks c USING (doc_id) WHERE l.item_id = e.item_id AND contains({norm("coalesce(c.text, '')")}, {norm('e.quote')})) AS grounded
  FROM expected e LEFT JOIN a USING (item_id)) SELECT count(*) AS n, count(*) FILTER (correct) AS correct, count(*) FILTER (correct AND cited) AS attributed, count(*) FILTER (cited) AS cited, count(*) FILTER (grounded) AS grounded FROM s""",
        "answer_match": rf"WITH t AS (SELECT doc_id, 'From 1.1.2026 on: ' || {n} || CASE WHEN doc_id % 4 = 0 THEN ',50 EUR' ELSE ' EUR, § 12.' END AS s FROM documents), u AS (SELECT doc_id, {bare} AS x FROM t) SELECT doc_id, {match('(doc_id * 37)')} AS own, {match('12')} AS twelve, {match('112026')} AS date FROM u",
        "version_twins": f"WITH {pairs} SELECT a.item_id, b.item_id AS twin FROM pairs a JOIN pairs b ON {norm('a.question')} = {norm('b.question')} AND a.valid_year <> b.valid_year",
        "pair_checks": f"WITH {pairs}, g AS (SELECT {norm('question')} AS said, list_sort(list(valid_year)) AS y, count(DISTINCT amount) AS n_values FROM pairs GROUP BY 1) SELECT said, n_values FROM g WHERE y <> [2025, 2026] OR n_values <> 2",
        "stratified_pool": f"""WITH {C}, {strata}, {B('s0', 'p0', k=5)}, {B('s1', 'p1', k=5, part='_1')}, e AS (SELECT item_id, doc_id, rank, 0 AS stratum FROM p0 UNION ALL SELECT item_id, doc_id, rank, 1 FROM p1),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY stratum, rank) = 1) SELECT item_id, doc_id, stratum, row_number() OVER (PARTITION BY item_id ORDER BY stratum, rank)::INT AS place FROM f""",
        "filter_ablation": f"WITH {C}, {truth}, {B('chunks', 'every')}, {ranked_of('bm25_topk', 'lexical')}, {ranked_of('cosine_topk', 'dense')}, {ranked_of('hybrid_rrf', 'hybrid')}, {ranked_of('stemmed_bm25', 'stems')}, "
                           + ", ".join(first(t, f"f_{t}") for t in suite.values()) + " " + " UNION ALL ".join(f"SELECT '{name}' AS config, count(*) AS n_questions, {ks} FROM f_{t}" for name, t in suite.items()),
        "corpus_sizes": f"WITH {C} SELECT source_type, count(*) AS n, round(avg(length(coalesce(text, ''))), 4) AS mean_chars FROM chunks GROUP BY 1",
        "distinct_documents": f"WITH {C} SELECT source_type, string_agg(DISTINCT parent::VARCHAR, ',' ORDER BY parent::VARCHAR) AS docs FROM chunks GROUP BY 1",
    }
