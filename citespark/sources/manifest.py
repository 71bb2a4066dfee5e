"""Sources: the manifest, checks of fetched files, paged results of an interface, the choice of a document's URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.functions import text as T

CORPUS = "doc_id string, url string, landing_page string, short_title string, source_title string, lang string, valid_from date, valid_to date, expect_on_page_1 string"
EVAL = "doc_id string, url string, title string, lang string, about_year int"
#: How a PDF and an XML file begin, hits that an answer may have.
PDF, XML, MOST_HITS = b"%PDF", "<?xml", 2000


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A JSON manifest {"corpus": [...], "eval_sources": [...]} -> two tables that are never put together. Raises if a doc_id occurs twice."""
    one = spark.read.option("multiLine", True).schema(f"corpus array<struct<{_struct(CORPUS)}>>, eval_sources array<struct<{_struct(EVAL)}>>").json(path)
    corpus, rest = (one.select(F.explode(c).alias("r")).select("r.*") for c in ("corpus", "eval_sources"))
    twice = [r.doc_id for r in duplicates(corpus.select("doc_id").unionByName(rest.select("doc_id")), "doc_id").limit(5).collect()]
    if twice:
        raise ValueError(f"doc_id occurs more than once: {twice}")
    return corpus, rest


def _struct(ddl: str) -> str:
    return ", ".join(part.strip().replace(" ", ":", 1) for part in ddl.split(","))


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def is_pdf(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.lit(PDF)


def is_xml(content: Column) -> Column:
    return F.startswith(content, F.lit(XML))


def says(page: Column, phrase: Column) -> Column:
    """The phrase stands on the page, whatever its white space and case."""
    return F.contains(T.norm(page), F.lower(phrase))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, ok) of the landed files; ok: the file is a PDF. What is not must not be parsed."""
    return spark.read.format("binaryFile").load(folder).select("path", "content", is_pdf(F.col("content")).alias("ok"))


ANSWER = "total int, hits string"
HIT = "struct<ref:string,url:array<struct<DataType:string,Url:string>>>"


def paged(answers: DataFrame) -> DataFrame:
    """Landed pages (law, page, body: JSON with total and hits) -> (law, total, n, status, units).

    A page with one hit holds it without a list around it. No hits and more than MOST_HITS are faults, as are fewer units than the total.
    """
    read = answers.select("law", "page", F.from_json("body", ANSWER).alias("a")).select("law", "page", "a.total", F.trim("a.hits").alias("h"))
    many = F.from_json(F.when(F.startswith("h", F.lit("[")), F.col("h")).otherwise(F.concat(F.lit("["), F.col("h"), F.lit("]"))), f"array<{HIT}>")
    all_ = read.select("law", "page", "total", many.alias("units")).groupBy("law").agg(
        F.max("total").alias("total"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", "units"))), lambda x: x["units"])).alias("units"))
    status = F.when(F.col("total") == 0, "empty").when(F.col("total") > MOST_HITS, "too many").when(F.size("units") < F.col("total"), "incomplete").otherwise("ok")
    return all_.select("law", "total", F.size("units").alias("n"), status.alias("status"), "units")


def xml_url(urls: Column) -> Column:
    """The URL that the row names for its XML; it is never made up."""
    return F.get(F.filter(urls, lambda u: u["DataType"] == "Xml"), F.lit(0))["Url"]


def unexpected(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Observed titles that were not expected. Must be empty."""
    return observed.select("title").distinct().join(expected.select("title"), "title", "left_anti")
