"""Queries of the answering side: guard, notices, context, answers, events, logs, the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.operators import answers as A
from citespark.operators import guard, index, rank, scope
from citespark.plans import base as P
from citespark.streaming import serve as S


def guard_classify(spark, sf_dir):
    v = guard.verdict(F.col("question"))
    return P.requests(spark, sf_dir).select("item_id", v.alias("v")).select("item_id", "v.refuse", "v.rule", "v.reason")


def guard_turns(spark, sf_dir):
    """How many turns of conversations each rule would refuse."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select("role", F.coalesce(guard.rule(F.col("text")), F.lit("none")).alias("rule")).groupBy("role", "rule").agg(F.count("*").alias("n"))


def refusal_message(spark, sf_dir):
    return P.requests(spark, sf_dir).where(guard.rule(F.col("question")).isNotNull()).select("item_id", guard.refusal(F.col("lang")).alias("message"))


def refusal_metrics(spark, sf_dir):
    """Questions with an opening that asks for advice are to be refused, others not."""
    r = P.requests(spark, sf_dir).select((F.col("item_id") % 8).isin(0, 1, 2, 4).alias("due"), guard.rule(F.col("question")).isNotNull().alias("refused"))
    return r.agg(F.count_if("due").alias("n_due"), F.count_if(F.col("due") & F.col("refused")).alias("caught"), F.count_if(~F.col("due")).alias("n_answerable"), F.count_if(~F.col("due") & F.col("refused")).alias("false_refusals"))


def _days(spark, sf_dir) -> DataFrame:
    return P.requests(spark, sf_dir).select("item_id", scope.as_of(F.col("valid_year"), P.day()).alias("day"), "lang")


def coverage_notice(spark, sf_dir):
    return scope.notice(scope.coverage(P.chunks(spark, sf_dir)), _days(spark, sf_dir))


def health(spark, sf_dir):
    return scope.health(scope.coverage(P.chunks(spark, sf_dir)), F.lit("2027-03-01").cast("date"))


def _ranked(spark, sf_dir, questions: DataFrame | None = None) -> DataFrame:
    """The three best chunks of each question with what an answer needs; text is joined after ranking."""
    q = P.requests(spark, sf_dir) if questions is None else questions
    chunks = P.chunks(spark, sf_dir)
    found = rank.bm25(P.terms(q.select("item_id", "text")), P.index_of(spark, sf_dir), 3, scope.scope(chunks, P.day()))
    year = F.when(F.col("source_type") == "kv", F.year("valid_from"))
    about = chunks.select("doc_id", "chunk_id", "short_title", "section_ref", "text", year.alias("year"), scope.citation(short=True).alias("citation"))
    return found.join(about, "doc_id").join(q.select("item_id", "lang"), "item_id")


def context_budget(spark, sf_dir):
    return A.context(_ranked(spark, sf_dir)).select("item_id", F.col("n_blocks").cast("long").alias("n_blocks"), F.sha2("context", 256).alias("context"))


def extractive_answer(spark, sf_dir):
    q = P.requests(spark, sf_dir)
    got = A.Extractive().generate(q, _ranked(spark, sf_dir).where("score > 8"))
    return got.select("item_id", F.sha2("answer", 256).alias("answer"), F.size("used").cast("long").alias("n_used"))


def dedupe_citations(spark, sf_dir):
    return A.first_citations(_ranked(spark, sf_dir).withColumn("page", F.lit(None).cast("int"))).select("item_id", "rank", "short_title", "year", "section_ref")


def answer(spark, sf_dir, questions: DataFrame) -> DataFrame:
    """Guard first: refused questions touch no index. Others are searched, answered and cited."""
    q = questions.withColumn("rule", guard.rule(F.col("question")))
    asked, refused = q.where("rule is null"), q.where("rule is not null")
    ranked = _ranked(spark, sf_dir, asked)
    made = A.route([A.Extractive()]).generate(asked, ranked)
    cites = ranked.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "citation"))), lambda x: x["citation"]).alias("citations"))
    done = made.join(cites, "item_id", "left").select("item_id", F.lit(None).cast("string").alias("rule"), "answer", F.coalesce("citations", F.array().cast("array<string>")).alias("citations"))
    return done.unionByName(refused.select("item_id", "rule", guard.refusal(F.col("lang")).alias("answer"), F.array().cast("array<string>").alias("citations")))


def answer_query(spark, sf_dir):
    got = answer(spark, sf_dir, P.requests(spark, sf_dir))
    return got.select("item_id", "rule", F.sha2("answer", 256).alias("answer"), F.array_join("citations", ";").alias("citations"))


def sse_events(spark, sf_dir):
    q = P.requests(spark, sf_dir)
    notices = coverage_notice(spark, sf_dir)
    got = answer(spark, sf_dir, q).join(q.select("item_id", "lang"), "item_id").join(notices, "item_id").join(_days(spark, sf_dir).select("item_id", "day"), "item_id")
    reasons = F.create_map(*(F.lit(x) for pair in guard.REASONS.items() for x in pair))
    ready = got.select("item_id", F.concat(F.lit("t"), F.col("item_id")).alias("trace_id"), "rule", guard.refusal(F.col("lang")).alias("refusal"), F.element_at(reasons, F.col("rule")).alias("reason"),
                       F.col("day").cast("string").alias("as_of"), "notice", "citations", F.sha2("answer", 256).alias("answer"), F.lit("extractive").alias("provider"))
    return A.stream_events(ready)


def json_log(spark, sf_dir):
    got = _ranked(spark, sf_dir).groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("retrieved"))
    q = P.requests(spark, sf_dir).join(got, "item_id").select("item_id", "lang", "valid_year", F.lit(False).alias("rerank"), "retrieved")
    return q.select("item_id", A.log_line(["item_id", "lang", "valid_year", "rerank", "retrieved"]).alias("line"))


def ndjson_tokens(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    good = F.to_json(F.struct(F.col("text").alias("response"), (F.col("turn") % 6 == 5).alias("done")))
    lines = turns.select(F.col("conv_id").alias("key"), F.col("turn").alias("pos"), F.when(F.col("turn") % 4 == 2, "no json {").otherwise(good).alias("line"))
    return A.token_text(lines).select(F.col("key").alias("conv_id"), F.col("n_pieces").cast("long").alias("n_pieces"), F.sha2("text", 256).alias("text"))


def stream_answers(spark, sf_dir):
    """answer_query as a stream: the questions are read as files that arrive, each micro-batch is answered."""
    root = f"{index.folder(spark)}/stream-{uuid.uuid4().hex}"
    P.requests(spark, sf_dir).select("item_id", "text", "question", "lang").write.parquet(f"{root}/in")
    questions = spark.readStream.schema("item_id long, text string, question string, lang string").parquet(f"{root}/in")
    S.serve(questions, lambda batch: answer(spark, sf_dir, batch), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{root}/out")
    return got.select("item_id", "rule", F.sha2("answer", 256).alias("answer"), F.array_join("citations", ";").alias("citations"))


QUERIES = [guard_classify, guard_turns, refusal_message, refusal_metrics, coverage_notice, health, context_budget, extractive_answer, dedupe_citations, answer_query, sse_events, json_log,
           ndjson_tokens, stream_answers]


def _rule_sql(col: str) -> str:
    q = f"trim(lower(coalesce({col}, '')))"

    def hit(phrases):
        return f"regexp_matches({q}, '{guard.pattern(phrases)}')"

    return (f"CASE WHEN {hit(guard.ADVICE)} THEN 'advice' WHEN {hit(guard.RECOMMEND)} THEN 'recommend' WHEN {hit(guard.LITIGATION)} AND {hit(guard.FIRST_PERSON)} THEN 'litigation' "
            f"WHEN {hit(guard.STRATEGY)} THEN 'strategy' END")


def oracle_sql() -> dict[str, str]:
    rule = _rule_sql("question")
    base = f"{P.CHUNKS}, {P.REQUESTS}, ruled AS (SELECT *, {rule} AS rule FROM requests)"
    reason = "CASE rule " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in guard.REASONS.items()) + " END"
    refusal = f"CASE WHEN lang = 'de' THEN '{guard.REFUSALS['de']}' ELSE '{guard.REFUSALS['en']}' END"
    cov = "cov AS (SELECT source_type, min(valid_from) AS earliest, CASE WHEN bool_or(valid_to IS NULL) THEN NULL ELSE max(valid_to) END AS latest, count(*) AS n FROM chunks GROUP BY 1)"
    names = "CASE source_type " + " ".join(f"WHEN '{k}' THEN CASE WHEN lang = 'de' THEN '{de}' ELSE '{en}' END" for k, (de, en) in scope.NAMES.items()) + " END"
    notice = f"""{cov},
days AS (SELECT item_id, make_date(valid_year, 7, 1) AS day, lang FROM requests),
gap AS (SELECT item_id, day, lang, source_type, {names} || CASE WHEN lang = 'de' THEN ': nur ' ELSE ': only ' END || earliest || CASE WHEN lang = 'de' THEN ' bis ' ELSE ' to ' END || coalesce(latest::VARCHAR, '-') AS s
  FROM days CROSS JOIN cov WHERE NOT (earliest <= day AND (latest IS NULL OR day <= latest))),
notices AS (SELECT item_id, CASE WHEN g IS NULL THEN NULL WHEN lang = 'de' THEN 'Hinweis: Zum Stichtag ' || day || ' fehlen Quellen. ' || g || '.' ELSE 'Note: sources are missing on ' || day || '. ' || g || '.' END AS notice
  FROM days LEFT JOIN (SELECT item_id, string_agg(s, '; ' ORDER BY source_type) AS g FROM gap GROUP BY 1) USING (item_id))"""
    cite = "'[' || short_title || CASE WHEN source_type = 'kv' THEN ' ' || year(valid_from) ELSE '' END || ', ' || section_ref || ']'"

    def ranked(asked: str) -> str:
        return f"""{P.bm25_sql('scoped', 'lexical', asked, 3)},
ranked AS (SELECT item_id, rank, score, doc_id, c.chunk_id, short_title, section_ref, CASE WHEN source_type = 'kv' THEN year(valid_from)::INT END AS year, r.lang, {cite} AS citation, coalesce(c.text, '') AS text
  FROM lexical JOIN chunks c USING (doc_id) JOIN requests r USING (item_id))"""

    strip = r"regexp_replace(text, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')"
    nothing = f"CASE WHEN lang = 'de' THEN '{A.NO_ANSWER['de']}' ELSE '{A.NO_ANSWER['en']}' END"
    asked = f"{base}, asked AS (SELECT * FROM ruled WHERE rule IS NULL), {ranked('asked')}"
    made = f"""{asked},
cites AS (SELECT item_id, list(citation ORDER BY rank) AS citations FROM ranked GROUP BY 1),
answers AS (SELECT a.item_id, NULL AS rule, coalesce((SELECT {strip} || E'\\n\\n' || citation FROM ranked k WHERE k.item_id = a.item_id AND rank = 1), {nothing}) AS answer, coalesce(citations, []) AS citations
  FROM asked a LEFT JOIN cites USING (item_id) UNION ALL SELECT item_id, rule, {refusal}, [] FROM ruled WHERE rule IS NOT NULL)"""
    answered = f"WITH {made} SELECT item_id, rule, sha256(answer) AS answer, array_to_string(citations, ';') AS citations FROM answers"
    ev = "'event: {0}' || E'\\ndata: ' || {1}::VARCHAR || E'\\n\\n'"
    return {
        "guard_classify": f"WITH {base} SELECT item_id, rule IS NOT NULL AS refuse, rule, {reason} AS reason FROM ruled",
        "guard_turns": f"SELECT role, coalesce({_rule_sql('text')}, 'none') AS rule, count(*) AS n FROM conversations GROUP BY 1, 2",
        "refusal_message": f"WITH {base} SELECT item_id, {refusal} AS message FROM ruled WHERE rule IS NOT NULL",
        "refusal_metrics": f"WITH {base}, d AS (SELECT item_id % 8 IN (0, 1, 2, 4) AS due, rule IS NOT NULL AS refused FROM ruled) SELECT count(*) FILTER (due) AS n_due, count(*) FILTER (due AND refused) AS caught, "
                           "count(*) FILTER (NOT due) AS n_answerable, count(*) FILTER (NOT due AND refused) AS false_refusals FROM d",
        "coverage_notice": f"WITH {base}, {notice} SELECT item_id, notice FROM notices",
        "health": f"WITH {P.CHUNKS}, {cov}, o AS (SELECT *, earliest <= DATE '2027-03-01' AND (latest IS NULL OR latest >= DATE '2027-03-01') AS ok FROM cov) "
                  "SELECT CASE WHEN bool_and(ok) THEN 'ok' ELSE 'degraded' END AS status, coalesce(string_agg(source_type, ',' ORDER BY source_type) FILTER (NOT ok), '') AS missing, sum(n)::BIGINT AS n_chunks FROM o",
        "context_budget": f"""WITH {base}, {ranked('requests')}, b AS (SELECT item_id, rank, CASE WHEN lang = 'de' THEN 'QUELLE' ELSE 'SOURCE' END || ': ' || citation || E'\\n' || text AS block FROM ranked),
t AS (SELECT *, sum(length(block)) OVER (PARTITION BY item_id ORDER BY rank) AS total FROM b)
SELECT item_id, count(*) FILTER (total <= 6000) AS n_blocks, sha256(coalesce(string_agg(block, E'\\n\\n---\\n\\n' ORDER BY rank) FILTER (total <= 6000), '')) AS context FROM t GROUP BY 1""",
        "extractive_answer": f"WITH {base}, {ranked('requests')}, best AS (SELECT item_id, {strip} || E'\\n\\n' || citation AS a FROM ranked WHERE rank = 1 AND score > 8) "
                             f"SELECT item_id, sha256(coalesce(a, {nothing})) AS answer, (a IS NOT NULL)::BIGINT AS n_used FROM requests LEFT JOIN best USING (item_id)",
        "dedupe_citations": f"WITH {base}, {ranked('requests')} SELECT item_id, rank, short_title, year, section_ref FROM ranked QUALIFY row_number() OVER (PARTITION BY item_id, short_title, year, section_ref ORDER BY rank) = 1",
        "answer_query": answered,
        "stream_answers": answered,
        "sse_events": f"""WITH {made}, {notice}, j AS (SELECT a.*, 't' || a.item_id AS trace_id, lang, day::VARCHAR AS as_of, notice, {reason} AS reason FROM answers a JOIN days USING (item_id) JOIN notices USING (item_id))
SELECT item_id, 0 AS seq, {ev.format('refusal', f"json_object('trace_id', trace_id, 'answer', {refusal}, 'reason', reason)")} AS event FROM j WHERE rule IS NOT NULL
UNION ALL SELECT item_id, 0, {ev.format('meta', "json_object('trace_id', trace_id, 'as_of', as_of, 'notice', notice, 'citations', citations)")} FROM j WHERE rule IS NULL
UNION ALL SELECT item_id, 1, {ev.format('token', "json_object('text', sha256(answer))")} FROM j WHERE rule IS NULL
UNION ALL SELECT item_id, 2, {ev.format('done', "json_object('trace_id', trace_id, 'provider', 'extractive')")} FROM j WHERE rule IS NULL""",
        "json_log": f"WITH {base}, {ranked('requests')}, g AS (SELECT item_id, list(doc_id ORDER BY rank) AS retrieved FROM ranked GROUP BY 1) "
                    "SELECT item_id, json_object('item_id', item_id, 'lang', lang, 'valid_year', valid_year, 'rerank', false, 'retrieved', retrieved)::VARCHAR AS line FROM requests JOIN g USING (item_id)",
        "ndjson_tokens": "WITH t AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2), g AS (SELECT *, coalesce(sum((turn % 6 = 5)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t WHERE turn % 4 <> 2) "
                         "SELECT conv_id, count(*) AS n_pieces, sha256(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS text FROM g WHERE before = 0 GROUP BY 1",
    }
