"""From lines and tables of documents to chunks: contents, sections, captions, blocks, packed parts, cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citespark.functions import text as T

#: Characters of a part; pages of front matter, where no section starts; units of an amount.
LIMIT, FRONT = 1250, 2
UNITS = {"de": "EUR brutto pro Monat", "en": "EUR gross per month"}
#: Python's strip and Spark's trim differ: these are the characters that go at both ends.
ENDS = r"^[ \t\n\r]+|[ \t\n\r]+$"


def in_order(key: str, *order: str):
    return W.partitionBy(key).orderBy(*order)


def contents(lines: DataFrame) -> DataFrame:
    """Lines of the first pages (doc, pos, text) -> (doc, ref, title): an entry may run over several lines and ends at a dotted
    leader or a number at the end of a line; the first entry of a reference counts; entries without a title are left out."""
    start, end = T.canonical_ref(F.col("text")), F.col("text").rlike(T.LEADER) | F.col("text").rlike(r"[0-9]+\s*$")
    marked = lines.withColumn("ref", start).withColumn("end", end.cast("int")).withColumn("entry", F.count("ref").over(in_order("doc", "pos")))
    inside = in_order("doc", "entry", "pos")
    inside = W.partitionBy("doc", "entry").orderBy("pos")
    open_ = marked.withColumn("ended", F.coalesce(F.sum("end").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where("entry > 0 and ended = 0")
    rest = F.when(F.col("ref").isNotNull(), F.regexp_replace("text", T.SECTION_REST, "")).otherwise(F.col("text"))
    said = open_.where("ref is not null or trim(text) <> ''").groupBy("doc", "entry").agg(F.max("ref").alias("ref"), F.array_sort(F.collect_list(F.struct("pos", rest.alias("t")))).alias("p"))
    titled = said.select("doc", "entry", "ref", T.toc_title(F.array_join(F.transform("p", lambda x: x["t"]), " ")).alias("title")).where("title is not null")
    return titled.groupBy("doc", "ref").agg(F.min_by("title", "entry").alias("title"))


def headings(lines: DataFrame, toc: DataFrame) -> DataFrame:
    """Lines (doc, page, pos, text) with ref and title where the line is a heading: it names a section of the contents, is not
    front matter, has no leader, and goes on with the section's title (or with nothing); else null."""
    named = lines.withColumn("_ref", T.canonical_ref(F.col("text"))).join(toc.select("doc", F.col("ref").alias("_ref"), F.col("title").alias("_title")), ["doc", "_ref"], "left")
    rest, title = T.norm(F.regexp_replace("text", T.SECTION_REST, "")), T.norm(F.col("_title"))
    is_heading = F.col("_title").isNotNull() & (F.col("page") > FRONT) & ~F.col("text").rlike(T.LEADER) & F.startswith(title, F.substring(rest, F.lit(1), F.length(title)))
    return named.withColumn("ref", F.when(is_heading, F.col("_ref"))).withColumn("title", F.when(is_heading, F.col("_title"))).drop("_ref", "_title")


def sections(marked: DataFrame) -> DataFrame:
    """Lines with headings marked (doc, page, pos, text, ref, title) -> body lines with the section they lie in, numbered within
    the document; lines before the first heading and the headings themselves are left out."""
    w = in_order("doc", "pos")
    filled = marked.withColumn("section", F.count("ref").over(w)).withColumn("is_heading", F.col("ref").isNotNull())
    for c in ("ref", "title"):
        filled = filled.withColumn(c, F.last(c, ignorenulls=True).over(w))
    return filled.where("section > 0 and not is_heading").drop("is_heading")


def body(lines: DataFrame) -> DataFrame:
    """Section lines (doc, section, ref, title, pos, text) -> (doc, section, ref, title, text): the first lines that only go on
    with the heading's title are left out."""
    w = W.partitionBy("doc", "section").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    before = T.norm(F.array_join(F.collect_list("text").over(w.rowsBetween(W.unboundedPreceding, -1)), " "))
    so_far = T.norm(F.array_join(F.collect_list("text").over(w), " "))
    title = T.norm(F.col("title"))
    # only lines that lie in a prefix of the title are put together, so the arrays stay short
    short = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    near = lines.withColumn("_before", F.coalesce(F.sum(short).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    head = near.where(F.col("_before") <= F.length("title")).withColumn("_part", F.startswith(title, so_far) & (before != title))
    lead = head.withColumn("_lead", F.bool_and("_part").over(w)).where("_lead").groupBy("doc", "section").agg(F.max("pos").alias("_end"))
    kept = lines.join(lead, ["doc", "section"], "left").withColumn("text", F.when(F.col("_end").isNull() | (F.col("pos") > F.col("_end")), F.col("text")))
    got = kept.groupBy("doc", "section", "ref", "title").agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("pos", "text")))).alias("l"))
    return got.select("doc", "section", "ref", "title", F.regexp_replace(F.array_join(F.transform("l", lambda x: x["text"]), "\n"), ENDS, "").alias("text"))


def missing_sections(toc: DataFrame, found: DataFrame) -> DataFrame:
    """Sections that the contents name and the body lacks. Must be empty before an index is built."""
    return toc.join(found.select("doc", "ref").distinct(), ["doc", "ref"], "left_anti")


def captions(items: DataFrame) -> DataFrame:
    """Items of a page stream (doc, pos, kind, text) -> tables with the line before them, null where there is none."""
    w = in_order("doc", "pos").rowsBetween(W.unboundedPreceding, -1)
    return items.withColumn("caption", F.last(F.when(F.col("kind") == "line", F.col("text")), ignorenulls=True).over(w)).where("kind = 'table'")


def page_stream(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines (doc, page, top, text) and tables (doc, page, top, n_rows) as one stream in reading order; tables have two rows at least."""
    both = lines.select("doc", "page", "top", F.lit("line").alias("kind"), "text").unionByName(
        tables.where("n_rows >= 2").select("doc", "page", "top", F.lit("table").alias("kind"), F.lit(None).cast("string").alias("text")))
    return both.withColumn("pos", F.row_number().over(in_order("doc", "page", "top", "kind")))


def body_state(items: DataFrame) -> DataFrame:
    """Blocks of a law's markup (unit, pos, kind, typ, text) -> the lines of its body: it opens at a title that says "text" and
    closes at the next title; headings of groups and paragraphs are lines too, furniture never is."""
    marker = F.when(F.col("typ") == "titel", F.lower(F.trim("text")) == "text")
    state = items.where("kind <> 'furniture'").withColumn("open", F.coalesce(F.last(marker, ignorenulls=True).over(in_order("unit", "pos")), F.lit(False)))
    heading = (F.col("kind") == "heading") & (F.startswith("typ", F.lit("g")) | (F.col("typ") == "para"))
    return state.where(F.col("open") & (F.coalesce(heading, F.lit(False)) | (F.col("kind") == "block")) & (F.coalesce("text", F.lit("")) != "")).select(
        "unit", "pos", (F.col("kind") == "heading").alias("is_heading"), "text")


def blocks(texts: DataFrame, key: str) -> DataFrame:
    """(key, text) -> (key, block, text): a block starts at '(1)' or 'IV.' at the start of a line; blank blocks are left out."""
    lines = texts.select(key, F.posexplode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n")).alias("pos", "line"))
    numbered = lines.withColumn("n", F.sum(F.col("line").rlike(T.BLOCK_START).cast("int")).over(in_order(key, "pos")))
    got = numbered.groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    made = got.select(key, "n", F.regexp_replace(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), ENDS, "").alias("text")).where("text <> ''")
    return made.select(key, F.row_number().over(in_order(key, "n")).alias("block"), "text")


def parts(block_list: Column, limit: int = LIMIT) -> Column:
    """Blocks in order -> parts of at most ``limit`` characters: whole blocks are put together; one that is too long is cut after
    the last sentence in its second half, else at the limit. What is gathered before a long block is a part of its own."""
    strip = lambda s: F.regexp_replace(s, ENDS, "")
    state = "struct<out:array<string>,cur:string>"

    def add(acc: Column, piece: Column) -> Column:
        joined = F.concat(acc["cur"], F.lit("\n"), piece)
        room = F.length(joined) <= limit
        return F.struct(F.when((acc["cur"] == "") | room, acc["out"]).otherwise(F.array_append(acc["out"], acc["cur"])).alias("out"),
                        F.when(acc["cur"] == "", piece).when(room, joined).otherwise(piece).alias("cur")).cast(state)

    def shorten(acc: Column, _: Column) -> Column:
        """One cut of the rest, while it is too long."""
        rest = acc["rest"]
        at = F.length(F.regexp_extract(F.substring(rest, 1, limit), r"(?s)^(.*)\. ", 1))
        cut = F.when((at > limit // 2), at + 1).otherwise(F.lit(limit))
        long = F.length(rest) > limit
        return F.when(long, F.struct(F.array_append(acc["heads"], strip(F.substring(rest, F.lit(1), cut))).alias("heads"), strip(F.substring(rest, cut + 1, F.length(rest))).alias("rest"))).otherwise(
            F.struct(acc["heads"].alias("heads"), rest.alias("rest")))

    def step(acc: Column, block: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("heads"), block.alias("rest"))
        cuts = F.aggregate(F.sequence(F.lit(0), F.floor(F.length(block) * 2 / limit).cast("int") + 1), start, shorten)
        long = F.length(block) > limit
        flushed = F.when(acc["cur"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["cur"]))
        after = F.struct(F.concat(flushed, cuts["heads"]).alias("out"), cuts["rest"].alias("cur")).cast(state)
        return F.when(long, after).otherwise(add(acc, block))

    first = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur")).cast(state)
    return F.aggregate(block_list, first, step, lambda acc: F.when(acc["cur"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["cur"])))


def split_text(texts: DataFrame, key: str, limit: int = LIMIT) -> DataFrame:
    """(key, text) -> (key, part, text)"""
    gathered = blocks(texts, key).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]).alias("b"))
    return gathered.select(key, F.posexplode(parts(F.col("b"), limit)).alias("part", "text"))


def numbered(chunks: DataFrame, *order: str) -> DataFrame:
    """chunks with their ordinal in the document, from 0, and the id made from both."""
    found = chunks.withColumn("ordinal", F.row_number().over(in_order("doc", *order)) - 1)
    return found.withColumn("chunk_id", F.substring(F.sha2(F.concat_ws(":", F.col("doc").cast("string"), F.col("ordinal").cast("string")), 256), 1, 16))


def kv_header(short_title: Column, year: Column, ref: Column, title: Column) -> Column:
    return F.concat(short_title, F.lit(" "), year.cast("string"), F.lit(", "), ref, F.lit(" "), title)


def law_header(short: Column, abbreviation: Column, ref: Column, title: Column) -> Column:
    return F.concat(short, F.lit(" ("), abbreviation, F.lit("), "), ref, F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(" "), title)).otherwise(F.lit("")))


def law_units(units: DataFrame) -> DataFrame:
    """Units of a law (unit, section_ref, text, headings, kurztitel, abkuerzung, abbrev) that count: no promulgation header, no repealed
    text; with defaults for what is not given, the last heading as title and the header of their chunks."""
    real = units.where("section_ref is not null and section_ref <> '§ 0' and coalesce(text, '') <> ''")
    title = F.when(F.size("headings") > 0, F.element_at("headings", -1))
    short, abbreviation = F.coalesce(F.nullif("kurztitel", F.lit("")), F.col("abbrev")), F.coalesce(F.nullif("abkuerzung", F.lit("")), F.col("abbrev"))
    return real.select("unit", "section_ref", title.alias("section_title"), law_header(short, abbreviation, F.col("section_ref"), title).alias("header"), "text")


def real_tables(tables: DataFrame) -> DataFrame:
    """A grid of one column is a boxed list, whose text the section has already."""
    return tables.where((F.size("header") >= 2) & (F.size("rows") >= 1))


def rendered(header: Column, rows: Column, head: Column, caption: Column) -> Column:
    """A table as lines, blank cells as a dash."""
    line = lambda cells: F.array_join(F.transform(cells, lambda c: F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(c)), " | ")
    return F.concat_ws("\n", head, F.nullif(F.trim(F.coalesce(caption, F.lit(""))), F.lit("")), F.array_join(header, " | "), F.array_join(F.transform(rows, line), "\n"))


def cells(tables: DataFrame) -> DataFrame:
    """Tables (key, lang, head, caption, header, rows) -> (key, row, col, amount, text) of the cells that state an amount: the row has a
    label, the column a heading, the row reaches to the column."""
    rows = tables.select("key", "lang", "head", "caption", "header", F.posexplode("rows").alias("row", "cells")).withColumn("label", F.trim(F.coalesce(F.get("cells", F.lit(0)), F.lit(""))))
    cols = rows.where("label <> ''").select("*", F.posexplode("header").alias("col", "heading")).where((F.col("col") >= 1) & (F.col("col") < F.size("cells")) & (F.trim("heading") != ""))
    amounts = cols.withColumn("amount", T.checked_money(F.get("cells", F.col("col")), F.col("lang"))).where("amount is not null")
    unit = F.when(F.col("lang") == "de", UNITS["de"]).otherwise(UNITS["en"])
    said = F.concat(F.trim("heading"), F.lit(" / "), F.col("label"), F.lit(": "), T.money_text(F.col("amount"), F.col("lang")), F.lit(" "), unit)
    return amounts.select("key", "row", "col", "amount", F.concat_ws("\n", "head", F.nullif(F.trim(F.coalesce("caption", F.lit(""))), F.lit("")), said).alias("text"))


def tables_without_cells(tables: DataFrame, found: DataFrame) -> DataFrame:
    """Real tables of which no cell was read: the number format was not understood. Must be empty."""
    return real_tables(tables).join(found.select("key").distinct(), "key", "left_anti")
