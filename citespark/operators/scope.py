"""Which chunks may answer: validity on a day, tenant, language, source; coverage of the corpus; citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_force(day: Column) -> Column:
    """Both ends count; no end means still in force."""
    return (day >= F.col("valid_from")) & (F.col("valid_to").isNull() | (day <= F.col("valid_to")))


def scope(chunks: DataFrame, day: Column | None = None, tenant: str = "public", lang: str | None = None, source_type: str | None = None) -> DataFrame:
    """The chunks that may be ranked. Filters come before ranking; those on stored columns reach the scan."""
    out = chunks.where(F.col("tenant_id") == tenant)
    if day is not None:
        out = out.where(in_force(day))
    if lang is not None:
        out = out.where(F.col("lang") == lang)
    if source_type is not None:
        out = out.where(F.col("source_type") == source_type)
    return out


def as_of(valid_year: Column, today: Column) -> Column:
    """The first of July of the year asked for, today without one."""
    return F.coalesce(F.make_date(valid_year, F.lit(7), F.lit(1)), today)


def coverage(chunks: DataFrame) -> DataFrame:
    """First and last day that each source covers (no last day where a chunk is open), and how many chunks it has."""
    latest = F.when(F.bool_or(F.col("valid_to").isNull()), F.lit(None).cast("date")).otherwise(F.max("valid_to"))
    return chunks.groupBy("source_type").agg(F.min("valid_from").alias("earliest"), latest.alias("latest"), F.count("*").alias("n_chunks"))


def gaps(covered: DataFrame, day: Column) -> DataFrame:
    """Sources that do not cover the day."""
    return covered.where(~((F.col("earliest") <= day) & (F.col("latest").isNull() | (day <= F.col("latest")))))


def citation(short: bool = False) -> Column:
    """[title year, section title, ref]: the year for yearly sources only; missing parts are passed over."""
    year = F.when(F.col("source_type") == "kv", F.year("valid_from").cast("string"))
    head = F.concat_ws(" ", "short_title", year)
    parts = [head] + ([] if short else [F.nullif("section_title", F.lit(""))]) + [F.nullif("section_ref", F.lit(""))]
    return F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]"))


#: Bounds of a request.
QUESTION_CHARS, YEARS, RESULTS = (1, 2000), (2025, 2030), (1, 50)


def check_requests(requests: DataFrame) -> DataFrame:
    """requests (question, valid_year, k) with a column problem: the first field out of bounds, or null. Nulls of year and k are defaults."""
    return requests.withColumn("problem", F.when(~F.coalesce(F.length("question").between(*QUESTION_CHARS), F.lit(False)), "question")
                               .when(~F.col("valid_year").between(*YEARS), "valid_year").when(~F.col("k").between(*RESULTS), "k"))


def check_chunks(chunks: DataFrame) -> DataFrame:
    """chunks with a column problem: an interval that ends before it begins, a text without content, or null."""
    return chunks.withColumn("problem", F.when(F.col("valid_to") < F.col("valid_from"), "interval").when(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", " ")) == "", "text"))


def health(covered: DataFrame, day: Column) -> DataFrame:
    """One row: status (degraded if a source does not cover the day), the sources missing, how many chunks there are."""
    open_ = (F.col("earliest") <= day) & (F.col("latest").isNull() | (day <= F.col("latest")))
    missing = F.array_sort(F.collect_list(F.when(~open_, F.col("source_type"))))
    return covered.agg(F.when(F.bool_and(open_), "ok").otherwise("degraded").alias("status"), F.array_join(missing, ",").alias("missing"), F.sum("n_chunks").alias("n_chunks"))


#: Names of the sources in a notice.
NAMES = {"kv": ("Kollektivvertrag", "collective agreement"), "law": ("Gesetze", "statutes")}


def notice(covered: DataFrame, days: DataFrame) -> DataFrame:
    """days (item_id, day, lang) -> (item_id, notice): which sources do not cover the day asked for, in German or English; null if all do.

    covered has a row for each source, so it is joined whole.
    """
    gap = days.join(F.broadcast(covered), ~((F.col("earliest") <= F.col("day")) & (F.col("latest").isNull() | (F.col("day") <= F.col("latest")))), "left")
    name = F.col("source_type")
    for source, (de, en) in NAMES.items():
        name = F.when(F.col("source_type") == source, F.when(F.col("lang") == "de", de).otherwise(en)).otherwise(name)
    until = F.coalesce(F.col("latest").cast("string"), F.lit("-"))
    said = F.when(F.col("lang") == "de", F.concat(name, F.lit(": nur "), F.col("earliest").cast("string"), F.lit(" bis "), until)).otherwise(
        F.concat(name, F.lit(": only "), F.col("earliest").cast("string"), F.lit(" to "), until))
    parts = gap.groupBy("item_id", "day", "lang").agg(F.array_sort(F.collect_list(F.when(F.col("source_type").isNotNull(), F.struct("source_type", said.alias("s"))))).alias("g"))
    list_ = F.array_join(F.transform("g", lambda x: x["s"]), "; ")
    text = F.when(F.col("lang") == "de", F.concat(F.lit("Hinweis: Zum Stichtag "), F.col("day").cast("string"), F.lit(" fehlen Quellen. "), list_, F.lit(".")))
    return parts.select("item_id", F.when(F.size("g") > 0, text.otherwise(F.concat(F.lit("Note: sources are missing on "), F.col("day").cast("string"), F.lit(". "), list_, F.lit(".")))).alias("notice"))
