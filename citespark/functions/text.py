"""Scalar functions over text, money and references, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What starts a section, a dotted leader, the range of an amount in whole euros, the mark of a block.
SECTION_START = r"^\s*(?:§|Art\.|Article)\s*(\d+[a-z]?)(?:[^0-9A-Za-z_]|$)"
SECTION_REST = r"^\s*(?:§|Art\.|Article)\s*\d+[a-z]?"
LEADER = r"\.{4,}"
LEAST_AMOUNT, MOST_AMOUNT = 500, 99_999
BLOCK_START = r"^\s*(?:\(\d+[a-z]?\)|[IVX]+\.)\s"
#: Of the light stemmer: endings by language, longest first, and the letters that must stay.
ENDINGS, STEM = {"de": "ern|em|er|en|es|e|s", "en": "ing|ed|es|s"}, 4


def norm(s: Column) -> Column:
    """One blank for white space, none at the ends, lower case."""
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def canonical_ref(line: Column) -> Column:
    """'Art. 4 ...' or 'Article 4 ...' -> '§ 4'; null where the line starts no section."""
    number = F.regexp_extract(line, SECTION_START, 1)
    return F.when(number != "", F.concat(F.lit("§ "), number))


def toc_title(s: Column) -> Column:
    """A title of a table of contents without leaders and page number; null if nothing is left."""
    one = F.regexp_replace(F.trim(F.regexp_replace(s, r"\s+", " ")), LEADER, " ")
    bare = F.regexp_replace(F.regexp_replace(one, r"[\s.]*[0-9]*\s*$", ""), r"^[ .]+|[ .]+$", "")
    return F.nullif(bare, F.lit(""))


def money(cell: Column, lang: Column) -> Column:
    """A money cell in the manner of its language -> whole euros; null for blanks, zero and other text. Not range-checked."""
    s = F.trim(F.translate(F.coalesce(cell, F.lit("")), "\u00a0", " "))
    s = F.trim(F.regexp_replace(s, r"[,.]\s*-\s*$", ""))
    de = F.split_part(F.regexp_replace(s, r"[ .]", ""), F.lit(","), F.lit(1))
    en = F.split_part(F.regexp_replace(s, r"[ ,]", ""), F.lit("."), F.lit(1))
    n = F.when(lang == "de", de).otherwise(en)
    return F.nullif(F.when(n.rlike(r"^[0-9]{1,9}$"), n.cast("int")), F.lit(0))


def plausible(amount: Column) -> Column:
    return amount.between(LEAST_AMOUNT, MOST_AMOUNT)


def checked_money(cell: Column, lang: Column) -> Column:
    """money, but an amount out of range ends the query: it is a fault of extraction, not a salary."""
    n = money(cell, lang)
    return F.when(n.isNull() | plausible(n), n).otherwise(F.raise_error(F.concat(F.lit("implausible amount in cell "), cell)).cast("int"))


def money_text(amount: Column, lang: Column) -> Column:
    """4476 -> '4.476' (de) or '4,476'."""
    en = F.format_number(amount, 0)
    return F.when(lang == "de", F.translate(en, ",", ".")).otherwise(en)


def without_thousands(s: Column) -> Column:
    """Separators between digits go where exactly three digits follow."""
    return F.regexp_replace(s, r"(?<=[0-9])[.,\s](?=[0-9]{3}(?![0-9]))", "")


def states_amount(text: Column, amount: Column) -> Column:
    """The amount stands in the text as a number, not as part of another one or of a date."""
    return F.regexp_like(without_thousands(text), F.concat(F.lit(r"(?<![0-9.,])"), amount.cast("string"), F.lit(r"(?![0-9.,]?[0-9])")))


def states_any(text: Column, phrases: Column) -> Column:
    return F.exists(phrases, lambda p: F.contains(F.lower(text), F.lower(p)))


def stem(term: Column, lang: str) -> Column:
    """The light stemmer: one ending goes where STEM letters stay. (The usual stemmers are not at hand offline.)"""
    return F.regexp_replace(term, rf"^(.{{{STEM},}}?)(?:{ENDINGS[lang]})$", "$1")


def unit(v: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(x.cast("double")))


def hashed_vector(terms: Column, dim: int = 64) -> Column:
    """The offline embedder: terms are counted in ``dim`` hashed places with a hashed sign, then brought to length one."""
    places = F.transform(terms, lambda t: F.struct(F.pmod(F.crc32(t), F.lit(dim)).alias("i"), F.when(F.pmod(F.crc32(F.concat(F.lit("#"), t)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    return unit(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(places, lambda p: p["i"] == i), F.lit(0.0), lambda s, p: s + p["s"])))


def trace_id() -> Column:
    """Twelve random hex digits; differs from run to run."""
    return F.substring(F.translate(F.uuid(), "-", ""), 1, 12)


def tenths(x: Column) -> Column:
    return F.round(x, 1)
