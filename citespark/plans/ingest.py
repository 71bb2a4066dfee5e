"""Queries of the ingest side. The given texts are dealt out as lines, contents, tables and units, by rules of their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.functions import text as T
from citespark.operators import chunking as C
from citespark.plans import base as P
from citespark.sources import http, manifest

CUT = 300


def _lines(spark, sf_dir) -> DataFrame:
    """(doc, i, t, n): the lines of every text."""
    docs = P.documents(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.split(F.coalesce("text", F.lit("")), "\n").alias("s"))
    return docs.select("doc", F.size("s").alias("n"), F.posexplode("s").alias("i", "t"))


def _group():
    return F.concat(F.lit("of group "), F.char(F.lit(97) + F.col("doc") % 7))


def _toc_lines(spark, sf_dir) -> DataFrame:
    each = _lines(spark, sf_dir).where("i = 0").select("doc", F.explode(F.sequence(F.lit(1), F.floor((F.col("n") - 1) / 7).cast("int") + 1)).alias("k"))
    name = F.concat(F.lit("Article "), F.col("k"), F.lit(" Rule "), F.col("k"), F.lit(" terms"))
    entry = F.array(F.struct((2 * F.col("k")).alias("pos"), name.alias("text")), F.struct((2 * F.col("k") + 1).alias("pos"), F.concat(_group(), F.lit(" ........ "), F.col("k") + 2).alias("text")))
    again = each.where("k = 1").select("doc", F.lit(1_000_000).alias("pos"), F.lit("Art. 1 Other things").alias("text"))
    return each.select("doc", F.explode(entry).alias("e")).select("doc", "e.pos", "e.text").unionByName(again)


def _body_lines(spark, sf_dir) -> DataFrame:
    """(doc, page, pos, text): a heading in two lines before every seventh line, a cross reference before every fifth."""
    k = F.floor(F.col("i") / 7) + 1
    name = F.concat(F.lit("Rule "), k, F.lit(" terms"))
    heading = F.when(k % 2 == 0, F.array(F.concat(F.lit("Art. "), k), name, _group(), F.col("t"))).otherwise(F.array(F.concat(F.lit("Art. "), k, F.lit(" "), name), _group(), F.col("t")))
    found = F.when(F.col("i") % 7 == 0, heading).when(F.col("i") % 5 == 1, F.array(F.lit("Art. 1 III. applies"), F.col("t"))).otherwise(F.array("t"))
    return _lines(spark, sf_dir).select("doc", (3 + F.floor(F.col("i") / 20)).cast("int").alias("page"), "i", F.posexplode(found).alias("j", "text")).select("doc", "page", (4 * F.col("i") + F.col("j")).alias("pos"), "text")


def toc_parse(spark, sf_dir):
    return C.contents(_toc_lines(spark, sf_dir))


def _marked(spark, sf_dir) -> DataFrame:
    return C.headings(_body_lines(spark, sf_dir), toc_parse(spark, sf_dir))


def heading_detect(spark, sf_dir):
    return _marked(spark, sf_dir).where("ref is not null").select("doc", "page", "pos", "ref", "title")


def section_forward_fill(spark, sf_dir):
    return C.sections(_marked(spark, sf_dir)).select("doc", "pos", "section", "ref")


def section_body(spark, sf_dir):
    return C.body(C.sections(_marked(spark, sf_dir))).select("doc", "section", "ref", "title", F.sha2("text", 256).alias("text"))


def toc_antijoin(spark, sf_dir):
    """Sections of the contents that the body lacks when its headings on later pages are lost."""
    return C.missing_sections(toc_parse(spark, sf_dir), _marked(spark, sf_dir).where("ref is not null and page < 4"))


def _tables_at(spark, sf_dir) -> DataFrame:
    return _lines(spark, sf_dir).where("i % 9 = 4 or i = 0").select("doc", F.floor(F.col("i") / 20).alias("page"), (F.col("i") - 0.5).alias("top"), (F.col("i") % 3 + 1).alias("n_rows"))


def page_stream(spark, sf_dir):
    lines = _lines(spark, sf_dir).select("doc", F.floor(F.col("i") / 20).alias("page"), F.col("i").cast("double").alias("top"), F.col("t").alias("text"))
    return C.page_stream(lines, _tables_at(spark, sf_dir).withColumn("top", F.col("top").cast("double"))).select("doc", "page", "kind", "pos", "text")


def caption_lookup(spark, sf_dir):
    return C.captions(page_stream(spark, sf_dir)).select("doc", "pos", "caption")


def body_state(spark, sf_dir):
    i = F.col("i")
    title = F.when((F.col("doc") % 2 == 0) | (i % 12 == 0), " Text ").otherwise("Note")
    items = _lines(spark, sf_dir).select(
        F.col("doc").alias("unit"), i.alias("pos"), F.when(i % 6 < 3, "heading").when(i % 6 == 3, "furniture").otherwise("block").alias("kind"),
        F.when(i % 6 == 0, "titel").when(i % 6 == 1, "g1").when(i % 6 == 2, F.when(F.col("doc") % 3 == 0, "other").otherwise("para")).alias("typ"), F.when(i % 6 == 0, title).otherwise(F.col("t")).alias("text"))
    return C.body_state(items)


def _marked_texts(spark, sf_dir) -> DataFrame:
    """(doc, text): every fourth line numbered, so that blocks start there."""
    line = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t, i: F.when(i % 4 == 0, F.concat(F.lit("("), F.floor(i / 4) + 1, F.lit(") "), t)).otherwise(t))
    return P.documents(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.array_join(line, "\n").alias("text"))


def blocks(spark, sf_dir):
    return C.blocks(_marked_texts(spark, sf_dir), "doc").select("doc", "block", F.sha2("text", 256).alias("text"))


def pack_parts(spark, sf_dir):
    return C.split_text(_marked_texts(spark, sf_dir), "doc", CUT).select("doc", "part", F.length("text").alias("n"), F.sha2("text", 256).alias("text"))


def text_chunks(spark, sf_dir):
    """Parts with the header of their section, an ordinal and an id."""
    about = P.chunks(spark, sf_dir).select(F.col("doc_id").alias("doc"), "short_title", "section_ref", F.coalesce("section_title", F.lit("")).alias("title"), F.year("valid_from").alias("year"))
    made = C.numbered(C.split_text(_marked_texts(spark, sf_dir), "doc", CUT), "part").join(about, "doc")
    text = F.concat(C.kv_header(F.col("short_title"), F.col("year"), F.col("section_ref"), F.col("title")), F.lit("\n"), F.col("text"))
    return made.select("doc", "ordinal", "chunk_id", F.sha2(text, 256).alias("text"))


def _cell(v, lang):
    n = lambda sep: F.when(v >= 1000, F.concat(F.floor(v / 1000).cast("string"), F.lit(sep), F.lpad((v % 1000).cast("string"), 3, "0"))).otherwise(v.cast("string"))
    return F.when(lang == "de", F.concat(n("."), F.lit(" ,-"))).otherwise(F.concat(n(","), F.lit(".00")))


def _grids(spark, sf_dir) -> DataFrame:
    d, lang, v = F.col("doc_id"), F.when(F.col("lang") == "de", "de").otherwise("en"), 900 + F.col("doc_id") % 3000
    header = F.when(d % 11 == 0, F.array(F.lit("List"))).otherwise(F.array(F.lit("Step"), F.lit("from 1.1."), F.when(d % 4 == 0, " ").otherwise("after 2 years")))
    rows = F.when(d % 11 == 0, F.array(F.array(F.lit("x")))).otherwise(F.array(
        F.array(F.lit("r1"), _cell(v, lang), F.lit("0")), F.array(F.when(d % 5 == 0, "").otherwise("r2"), F.lit(" "), _cell(v + 1, lang)), F.array(F.lit("r3"), _cell(v + 2, lang))))
    return P.documents(spark, sf_dir).select(d.alias("key"), lang.alias("lang"), F.concat(F.lit("T "), d % 7).alias("head"), F.when(d % 2 == 0, "As of today:").alias("caption"), header.alias("header"), rows.alias("rows"))


def table_cells(spark, sf_dir):
    return C.cells(C.real_tables(_grids(spark, sf_dir)))


def table_render(spark, sf_dir):
    return C.real_tables(_grids(spark, sf_dir)).select("key", C.rendered(F.col("header"), F.col("rows"), F.col("head"), F.col("caption")).alias("text"))


def tables_without_cells(spark, sf_dir):
    """Tables that gave nothing when the cells of every third one were not understood."""
    return C.tables_without_cells(_grids(spark, sf_dir), table_cells(spark, sf_dir).where("key % 3 <> 0")).select("key")


CELLS = ["1.234,-", "2 420", "1,210.00", "0", " ", "n/a", "960 ,-", "12.345,67"]


def money_parse(spark, sf_dir):
    cell = F.get(F.array(*map(F.lit, CELLS)), (F.col("doc_id") % len(CELLS)).cast("int"))
    n = T.money(cell, F.when(F.col("lang") == "de", "de").otherwise("en"))
    return P.documents(spark, sf_dir).select("doc_id", n.alias("amount"), T.plausible(n).alias("plausible"))


def money_format(spark, sf_dir):
    n = (F.col("doc_id") * 37 + 500).cast("int")
    return P.documents(spark, sf_dir).select("doc_id", T.money_text(n, F.col("lang")).alias("text"))


def norm_text(spark, sf_dir):
    return P.documents(spark, sf_dir).select("doc_id", F.sha2(T.norm(F.coalesce("text", F.lit(""))), 256).alias("norm"), F.sha2(T.digits(F.coalesce("text", F.lit(""))), 256).alias("digits"))


def _units(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    empty = F.array().cast("array<string>")
    return P.documents(spark, sf_dir).select(
        d.alias("unit"), F.when(d % 9 == 1, "§ 0").when(d % 9 > 1, F.concat(F.lit("§ "), d % 20)).alias("section_ref"), F.when(d % 13 == 0, "").otherwise(F.col("text")).alias("text"),
        F.when(d % 4 == 0, empty).when(d % 4 == 1, F.array(F.lit("PART 1"))).otherwise(F.array(F.lit("PART 1"), F.concat(F.lit("Title "), d % 5))).alias("headings"),
        F.when(d % 6 == 1, "").when(d % 6 > 1, F.concat(F.lit("Act "), d % 3)).alias("kurztitel"), F.when(d % 5 > 1, F.concat(F.lit("A"), d % 3)).alias("abkuerzung"), F.concat(F.lit("G"), d % 3).alias("abbrev"))


def law_units(spark, sf_dir):
    return C.law_units(_units(spark, sf_dir)).select("unit", "section_ref", "section_title", "header", F.sha2("text", 256).alias("text"))


def corpus_union(spark, sf_dir):
    """Chunks of agreements and of laws as one corpus."""
    law = C.law_units(_units(spark, sf_dir)).select(F.lit("law").alias("source_type"), F.col("unit").alias("doc_id"))
    kv = P.chunks(spark, sf_dir).where("source_type = 'kv'").select("source_type", "doc_id")
    return kv.unionByName(law).groupBy("source_type").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))


def title_difference(spark, sf_dir):
    titles = P.documents(spark, sf_dir).select(F.col("source").alias("title"), "doc_id")
    return manifest.unexpected(titles, titles.groupBy("title").agg(F.min("doc_id").alias("m")).where("m % 2 = 0"))


def duplicate_ids(spark, sf_dir):
    ids = P.documents(spark, sf_dir).select(F.concat(F.lit("x"), F.col("doc_id") % 150).alias("doc_id"))
    return manifest.duplicates(ids.unionByName(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("x"), "page_id").alias("doc_id"))), "doc_id")


def file_checks(spark, sf_dir):
    """What is a PDF by its first bytes, and on whose first page the expected phrase stands."""
    d, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    content = F.concat(F.when(d % 3 == 0, "%PDF-1.7 ").otherwise("<html>"), text).cast("binary")
    phrase = F.when(d % 4 == 0, "no such phrase 9").otherwise(F.upper(F.substring(T.norm(text), 3, 12)))
    return P.documents(spark, sf_dir).select("doc_id", manifest.is_pdf(content).alias("is_pdf"), manifest.says(text, phrase).alias("says"))


def _answers(spark, sf_dir) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select((F.col("page_id") % 7).alias("law"), F.floor(F.col("page_id") / 50).alias("page"), F.concat(F.lit("§ "), "page_id").alias("ref"), "url", "page_id")
    link = lambda t, u: F.struct(F.lit(t).alias("DataType"), u.alias("Url"))
    urls = F.when(F.col("page_id") % 3 == 0, F.array(link("Html", F.col("url")))).otherwise(F.array(link("Html", F.col("url")), link("Xml", F.concat("url", F.lit(".xml")))))
    hits = pages.groupBy("law", "page").agg(F.array_sort(F.collect_list(F.struct("ref", urls.alias("url")))).alias("h"))
    body = F.when(F.size("h") == 1, F.to_json(F.get("h", F.lit(0)))).otherwise(F.to_json("h"))
    totals = pages.groupBy("law").agg(F.count("*").alias("n"))
    total = F.when(F.col("law") == 5, F.col("n") + 3).when(F.col("law") == 6, F.lit(5000)).otherwise(F.col("n"))
    found = hits.join(totals, "law").select("law", "page", F.concat(F.lit('{"total":'), total, F.lit(',"hits":'), body, F.lit("}")).alias("body"))
    return found.unionByName(spark.range(1).select(F.lit(7).cast("long").alias("law"), F.lit(0).cast("long").alias("page"), F.lit('{"total":0,"hits":[]}').alias("body")))


def paged_answers(spark, sf_dir):
    return manifest.paged(_answers(spark, sf_dir)).select("law", F.col("total").cast("long").alias("total"), F.col("n").cast("long").alias("n"), "status")


def detail_urls(spark, sf_dir):
    units = manifest.paged(_answers(spark, sf_dir)).select("law", F.explode("units").alias("u"))
    return units.select("law", "u.ref", manifest.xml_url(F.col("u.url")).alias("url"))


def retry_outcomes(spark, sf_dir):
    codes = F.array(*map(F.lit, (200, 429, 503, 404, 500, 0)))
    statuses = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: F.get(codes, ((F.col("item_id") * (j + 3) + j * j) % 6).cast("int")))
    return P.questions(spark, sf_dir).select("item_id", http.outcome(statuses).alias("o")).select("item_id", F.col("o.calls").cast("long").alias("calls"), F.col("o.status").cast("long").alias("status"))


def retry_delays(spark, sf_dir):
    n = F.col("id") + 1
    return spark.range(8).select(n.alias("attempt"), F.least(http.BASE * F.pow(F.lit(float(http.GROWTH)), n - 1), F.lit(http.LONGEST)).alias("seconds"))


QUERIES = [toc_parse, heading_detect, section_forward_fill, section_body, toc_antijoin, page_stream, caption_lookup, body_state, blocks, pack_parts, text_chunks, table_cells, table_render, tables_without_cells,
           money_parse, money_format, norm_text, law_units, corpus_union, title_difference, duplicate_ids, file_checks, paged_answers, detail_urls, retry_outcomes, retry_delays]


def oracle_sql() -> dict[str, str]:
    def norm(x: str) -> str:
        return rf"lower(trim(regexp_replace({x}, '\s+', ' ', 'g')))"

    def strip(x: str) -> str:
        return rf"regexp_replace({x}, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')"

    lines = r"ln AS (SELECT doc_id AS doc, unnest(s) AS t, generate_subscripts(s, 1) - 1 AS i, len(s) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), E'\n') AS s FROM documents))"
    group = "'of group ' || chr((97 + doc % 7)::INT)"
    toc = rf"""{lines},
tk AS (SELECT doc, unnest(range(1, (n - 1) // 7 + 2)) AS k FROM ln WHERE i = 0),
tl AS (SELECT doc, 2 * k AS pos, 'Article ' || k || ' Rule ' || k || ' terms' AS text FROM tk UNION ALL SELECT doc, 2 * k + 1, {group} || ' ........ ' || (k + 2) FROM tk UNION ALL SELECT doc, 1000000, 'Art. 1 Other things' FROM tk WHERE k = 1),
tm AS (SELECT *, regexp_extract(text, '{T.SECTION_START}', 1) AS num, regexp_matches(text, '{T.LEADER}') OR regexp_matches(text, '[0-9]+\s*$') AS fin FROM tl),
tn AS (SELECT *, count(*) FILTER (num <> '') OVER (PARTITION BY doc ORDER BY pos) AS entry FROM tm),
tp AS (SELECT *, coalesce(sum(fin::INT) OVER (PARTITION BY doc, entry ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM tn WHERE entry > 0),
tq AS (SELECT doc, entry, max('§ ' || num) FILTER (num <> '') AS ref, string_agg(CASE WHEN num <> '' THEN regexp_replace(text, '{T.SECTION_REST}', '') ELSE text END, ' ' ORDER BY pos) AS s FROM tp WHERE ended = 0 AND (num <> '' OR trim(text) <> '') GROUP BY 1, 2),
tr AS (SELECT doc, entry, ref, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(s, '\s+', ' ', 'g')), '{T.LEADER}', ' ', 'g'), '[\s.]*[0-9]*\s*$', ''), '^[ .]+|[ .]+$', '', 'g') AS title FROM tq),
toc AS (SELECT doc, ref, title FROM tr WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY doc, ref ORDER BY entry) = 1)"""
    marked = rf"""{toc},
bl AS (SELECT doc, (3 + i // 20)::INT AS page, (4 * i + generate_subscripts(a, 1) - 1)::INT AS pos, unnest(a) AS text FROM (SELECT *, CASE WHEN i % 14 = 7 THEN ['Art. ' || (i // 7 + 1), 'Rule ' || (i // 7 + 1) || ' terms', {group}, t] WHEN i % 7 = 0 THEN ['Art. ' || (i // 7 + 1) || ' Rule ' || (i // 7 + 1) || ' terms', {group}, t]
  WHEN i % 5 = 1 THEN ['Art. 1 III. applies', t] ELSE [t] END AS a FROM ln)),
bn AS (SELECT *, '§ ' || nullif(regexp_extract(text, '{T.SECTION_START}', 1), '') AS r FROM bl),
mk AS (SELECT bn.doc, page, pos, text, CASE WHEN toc.title IS NOT NULL AND page > 2 AND NOT regexp_matches(text, '{T.LEADER}') AND starts_with({norm('toc.title')}, left({norm(f"regexp_replace(text, '{T.SECTION_REST}', '')")}, length({norm('toc.title')}))) THEN toc.ref END AS ref, toc.title FROM bn LEFT JOIN toc ON toc.doc = bn.doc AND toc.ref = bn.r)"""
    secs = f"""{marked},
sx AS (SELECT *, count(ref) OVER (PARTITION BY doc ORDER BY pos) AS section FROM mk),
se AS (SELECT s.doc, s.pos, s.section, h.ref, h.title, s.text FROM sx s JOIN sx h ON h.doc = s.doc AND h.section = s.section AND h.ref IS NOT NULL WHERE s.ref IS NULL)"""
    lead = rf"""{secs},
sl AS (SELECT *, length(regexp_replace(text, '\s+', ' ', 'g')) AS short FROM se),
so AS (SELECT *, coalesce(sum(short) OVER (PARTITION BY doc, section ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sl),
sp AS (SELECT *, {norm("string_agg(text, ' ') OVER (PARTITION BY doc, section ORDER BY pos)")} AS so_far, {norm("coalesce(string_agg(text, ' ') OVER (PARTITION BY doc, section ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')")} AS prior FROM so WHERE before <= length(title)),
sr AS (SELECT doc, section, pos, bool_and(starts_with({norm('title')}, so_far) AND prior <> {norm('title')}) OVER (PARTITION BY doc, section ORDER BY pos) AS go FROM sp),
sq AS (SELECT doc, section, max(pos) AS fin FROM sr WHERE go GROUP BY 1, 2)"""
    stream = """pi AS (SELECT doc, i // 20 AS page, i::DOUBLE AS top, 'line' AS kind, t AS text FROM ln UNION ALL SELECT doc, i // 20, i - 0.5, 'table', NULL FROM ln WHERE (i % 9 = 4 OR i = 0) AND i % 3 + 1 >= 2),
ps AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, top, kind)::INT AS pos FROM pi)"""
    mt = r"""mt AS (SELECT doc_id AS doc, list_transform(string_split(coalesce(text, ''), E'\n'), lambda t, i: CASE WHEN (i - 1) % 4 = 0 THEN '(' || ((i - 1) // 4 + 1) || ') ' || t ELSE t END) AS s FROM documents),
ml AS (SELECT doc, unnest(string_split(regexp_replace(array_to_string(s, E'\n'), '\r\n?', E'\n', 'g'), E'\n')) AS line, generate_subscripts(string_split(regexp_replace(array_to_string(s, E'\n'), '\r\n?', E'\n', 'g'), E'\n'), 1) AS pos FROM mt)"""
    blocks_ = rf"""{mt},
mb AS (SELECT *, sum(regexp_matches(line, '{T.BLOCK_START}')::INT) OVER (PARTITION BY doc ORDER BY pos) AS n FROM ml),
mg AS (SELECT doc, n, {strip("string_agg(line, E'\n' ORDER BY pos)")} AS text FROM mb GROUP BY 1, 2),
blocks AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY n)::INT AS block, text FROM mg WHERE text <> '')"""
    packed = rf"""{blocks_},
bb AS (SELECT doc, list(text ORDER BY block) AS b FROM blocks GROUP BY 1),
st AS (WITH RECURSIVE w(doc, b, i, rest, cur, out) AS (SELECT doc, b, 1, b[1], '', []::VARCHAR[] FROM bb UNION ALL
  SELECT doc, b, CASE WHEN long THEN i ELSE i + 1 END, CASE WHEN long THEN {strip('substr(rest, cut + 1)')} ELSE b[i + 1] END,
    CASE WHEN long THEN '' WHEN cur = '' THEN rest WHEN length(cur) + 1 + length(rest) <= {CUT} THEN cur || E'\n' || rest ELSE rest END,
    CASE WHEN long THEN list_concat(out, CASE WHEN cur = '' THEN [] ELSE [cur] END, [{strip('left(rest, cut)')}]) WHEN cur = '' OR length(cur) + 1 + length(rest) <= {CUT} THEN out ELSE list_append(out, cur) END
  FROM (SELECT *, length(rest) > {CUT} AS long, CASE WHEN length(regexp_extract(left(rest, {CUT}), '(?s)^(.*)\. ', 1)) > {CUT // 2} THEN length(regexp_extract(left(rest, {CUT}), '(?s)^(.*)\. ', 1)) + 1 ELSE {CUT} END AS cut FROM w) WHERE rest IS NOT NULL)
  SELECT doc, CASE WHEN cur = '' THEN out ELSE list_append(out, cur) END AS out FROM w WHERE rest IS NULL),
parts AS (SELECT doc, generate_subscripts(out, 1)::INT - 1 AS part, unnest(out) AS text FROM st)"""
    cell = "CASE WHEN lang = 'de' THEN {0} || ' ,-' ELSE {1} || '.00' END"

    def money(v: str) -> str:
        n = lambda sep: f"(CASE WHEN {v} >= 1000 THEN ({v} // 1000) || '{sep}' || lpad(({v} % 1000)::VARCHAR, 3, '0') ELSE ({v})::VARCHAR END)"
        return cell.format(n("."), n(","))

    grids = f"""gr AS (SELECT doc_id AS key, lang, 'T ' || (doc_id % 7) AS head, CASE WHEN doc_id % 2 = 0 THEN 'As of today:' END AS caption,
  CASE WHEN doc_id % 11 = 0 THEN ['List'] ELSE ['Step', 'from 1.1.', CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE 'after 2 years' END] END AS header,
  CASE WHEN doc_id % 11 = 0 THEN [['x']] ELSE [['r1', {money('v')}, '0'], [CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'r2' END, ' ', {money('(v + 1)')}], ['r3', {money('(v + 2)')}]] END AS rows
  FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN 'de' ELSE 'en' END AS lang, 900 + doc_id % 3000 AS v FROM documents)),
real AS (SELECT * FROM gr WHERE len(header) >= 2 AND len(rows) >= 1)"""

    def parsed(c: str) -> str:
        s = rf"trim(regexp_replace(trim(coalesce({c}, '')), '[,.]\s*-\s*$', ''))"
        n = rf"CASE WHEN lang = 'de' THEN split_part(regexp_replace({s}, '[ .]', '', 'g'), ',', 1) ELSE split_part(regexp_replace({s}, '[ ,]', '', 'g'), '.', 1) END"
        return f"nullif(CASE WHEN regexp_matches({n}, '^[0-9]{{1,9}}$') THEN try_cast({n} AS INT) END, 0)"

    def shown(n: str) -> str:
        return f"CASE WHEN lang = 'de' THEN replace(format('{{:,}}', {n}), ',', '.') ELSE format('{{:,}}', {n}) END"

    found = f"""{grids},
rw AS (SELECT key, lang, head, caption, header, generate_subscripts(rows, 1) - 1 AS row, unnest(rows) AS c FROM real),
cl AS (SELECT *, generate_subscripts(header, 1) - 1 AS col, unnest(header) AS h FROM rw WHERE trim(c[1]) <> ''),
ce AS (SELECT key, row::INT AS row, col::INT AS col, {parsed('c[col + 1]')} AS amount, lang, head, caption, h, c FROM cl WHERE col >= 1 AND col < len(c) AND trim(h) <> ''),
cells AS (SELECT key, row, col, amount, head || E'\\n' || CASE WHEN caption IS NULL THEN '' ELSE caption || E'\\n' END || trim(h) || ' / ' || trim(c[1]) || ': ' || {shown('amount')} || CASE WHEN lang = 'de' THEN ' {C.UNITS['de']}' ELSE ' {C.UNITS['en']}' END AS text FROM ce WHERE amount IS NOT NULL)"""
    units = """un AS (SELECT doc_id AS unit, CASE WHEN doc_id % 9 = 1 THEN '§ 0' WHEN doc_id % 9 > 1 THEN '§ ' || (doc_id % 20) END AS section_ref, CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END AS text,
  CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'PART 1' ELSE 'Title ' || (doc_id % 5) END AS section_title, CASE WHEN doc_id % 6 > 1 THEN 'Act ' || (doc_id % 3) ELSE 'G' || (doc_id % 3) END AS short,
  CASE WHEN doc_id % 5 > 1 THEN 'A' || (doc_id % 3) ELSE 'G' || (doc_id % 3) END AS abb FROM documents),
lu AS (SELECT unit, section_ref, section_title, short || ' (' || abb || '), ' || section_ref || coalesce(' ' || section_title, '') AS header, text FROM un WHERE section_ref <> '§ 0' AND coalesce(text, '') <> '')"""
    raw = "[" + ", ".join(f"'{c}'" for c in CELLS) + "][doc_id % 8 + 1]"
    pages = """pg AS (SELECT page_id, page_id % 7 AS law, '§ ' || page_id AS ref, url FROM pages)"""
    return {
        "toc_parse": f"WITH {toc} SELECT doc, ref, title FROM toc",
        "heading_detect": f"WITH {marked} SELECT doc, page, pos, ref, title FROM mk WHERE ref IS NOT NULL",
        "section_forward_fill": f"WITH {secs} SELECT doc, pos, section, ref FROM se",
        "section_body": rf"WITH {lead} SELECT doc, section, ref, title, sha256({strip(f'''coalesce(string_agg(text, E'{chr(92)}n' ORDER BY pos) FILTER (fin IS NULL OR pos > fin), '')''')}) AS text FROM se LEFT JOIN sq USING (doc, section) GROUP BY doc, section, ref, title",
        "toc_antijoin": f"WITH {marked} SELECT doc, ref, title FROM toc WHERE NOT EXISTS (SELECT 1 FROM mk WHERE mk.doc = toc.doc AND mk.ref = toc.ref AND page < 4)",
        "page_stream": f"WITH {lines}, {stream} SELECT doc, page, kind, pos, text FROM ps",
        "caption_lookup": f"WITH {lines}, {stream}, c AS (SELECT *, last_value(CASE WHEN kind = 'line' THEN text END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS caption FROM ps) SELECT doc, pos, caption FROM c WHERE kind = 'table'",
        "body_state": f"""WITH {lines}, it AS (SELECT doc AS unit, i::INT AS pos, CASE WHEN i % 6 < 3 THEN 'heading' WHEN i % 6 = 3 THEN 'furniture' ELSE 'block' END AS kind, CASE i % 6 WHEN 0 THEN 'titel' WHEN 1 THEN 'g1' WHEN 2 THEN CASE WHEN doc % 3 = 0 THEN 'other' ELSE 'para' END END AS typ,
  CASE WHEN i % 6 = 0 THEN CASE WHEN doc % 2 = 0 OR i % 12 = 0 THEN ' Text ' ELSE 'Note' END ELSE t END AS text FROM ln),
s AS (SELECT *, last_value(CASE WHEN typ = 'titel' THEN lower(trim(text)) = 'text' END IGNORE NULLS) OVER (PARTITION BY unit ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM it WHERE kind <> 'furniture')
SELECT unit, pos, kind = 'heading' AS is_heading, text FROM s WHERE open AND (kind = 'block' OR typ IN ('g1', 'para')) AND text <> ''""",
        "blocks": f"WITH {blocks_} SELECT doc, block, sha256(text) AS text FROM blocks",
        "pack_parts": f"WITH {packed} SELECT doc, part, length(text)::INT AS n, sha256(text) AS text FROM parts",
        "text_chunks": f"WITH {P.CHUNKS}, {packed} SELECT doc, part AS ordinal, substr(sha256(doc || ':' || part), 1, 16) AS chunk_id, sha256(short_title || ' ' || year(valid_from) || ', ' || section_ref || ' ' || coalesce(section_title, '') || E'\\n' || parts.text) AS text FROM parts JOIN chunks ON doc = doc_id",
        "table_cells": f"WITH {found} SELECT key, row, col, amount, text FROM cells",
        "table_render": f"WITH {grids} SELECT key, head || E'\\n' || CASE WHEN caption IS NULL THEN '' ELSE caption || E'\\n' END || array_to_string(header, ' | ') || E'\\n' || array_to_string(list_transform(rows, lambda r: array_to_string(list_transform(r, lambda c: CASE WHEN c = '' THEN '-' ELSE c END), ' | ')), E'\\n') AS text FROM real",
        "tables_without_cells": f"WITH {found} SELECT key FROM real WHERE key NOT IN (SELECT key FROM cells WHERE key % 3 <> 0)",
        "money_parse": f"SELECT doc_id, amount, amount BETWEEN {T.LEAST_AMOUNT} AND {T.MOST_AMOUNT} AS plausible FROM (SELECT doc_id, {parsed(raw)} AS amount FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN 'de' ELSE 'en' END AS lang FROM documents))",
        "money_format": f"SELECT doc_id, {shown('doc_id * 37 + 500')} AS text FROM documents",
        "norm_text": f"SELECT doc_id, sha256({norm('''coalesce(text, '')''')}) AS norm, sha256(regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g')) AS digits FROM documents",
        "law_units": f"WITH {units} SELECT unit, section_ref, section_title, header, sha256(text) AS text FROM lu",
        "corpus_union": f"WITH {P.CHUNKS}, {units}, u AS (SELECT source_type, doc_id FROM chunks WHERE source_type = 'kv' UNION ALL SELECT 'law', unit FROM lu) SELECT source_type, count(*) AS n, min(doc_id) AS least, max(doc_id) AS most FROM u GROUP BY 1",
        "title_difference": "SELECT source AS title FROM documents EXCEPT SELECT source FROM documents GROUP BY source HAVING min(doc_id) % 2 = 0",
        "duplicate_ids": "SELECT doc_id, count(*) AS n FROM (SELECT 'x' || (doc_id % 150) AS doc_id FROM documents UNION ALL SELECT 'x' || page_id FROM pages) GROUP BY 1 HAVING count(*) > 1",
        "file_checks": f"SELECT doc_id, doc_id % 3 = 0 AS is_pdf, contains({norm('t')}, lower(CASE WHEN doc_id % 4 = 0 THEN 'no such phrase 9' ELSE upper(substr({norm('t')}, 3, 12)) END)) AS says FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
        "paged_answers": f"WITH {pages}, c AS (SELECT law, count(*) AS n FROM pg GROUP BY 1 UNION ALL SELECT 7, 0), t AS (SELECT law, n, CASE law WHEN 5 THEN n + 3 WHEN 6 THEN 5000 ELSE n END AS total FROM c) "
                         "SELECT law, total, n, CASE WHEN total = 0 THEN 'empty' WHEN total > 2000 THEN 'too many' WHEN n < total THEN 'incomplete' ELSE 'ok' END AS status FROM t",
        "detail_urls": f"WITH {pages} SELECT law, ref, CASE WHEN page_id % 3 <> 0 THEN url || '.xml' END AS url FROM pg",
        "retry_outcomes": "WITH s AS (SELECT item_id, list_transform(range(0, 4), lambda j: [200, 429, 503, 404, 500, 0][(item_id * (j + 3) + j * j) % 6 + 1]) AS s FROM benchmark), c AS (SELECT item_id, s, list_position(list_transform(s, lambda x: x IN (200, 404)), true) AS p FROM s) "
                          "SELECT item_id, coalesce(nullif(p, 0), 4)::BIGINT AS calls, s[coalesce(nullif(p, 0), 4)]::BIGINT AS status FROM c",
        "retry_delays": "SELECT n AS attempt, least(1.5::DOUBLE * 2::DOUBLE ** (n - 1), 20::DOUBLE) AS seconds FROM range(1, 9) t(n)",
    }
