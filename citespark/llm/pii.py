"""Surrogates for personal data: every entity gets a keyed replacement of its own type and format.

One pattern finds the entities. Forms of an entity that differ in case, or for numbers in what stands between the digits, are
one entity (coreference); the surrogate takes over the case or the separators of each place. Digits become digits, letters
become letters of the same script, punctuation and the last label of a domain stay; card numbers keep a valid check digit.
Names are found after a form of address, which stays; each name has one surrogate whatever stands before it, also where it
stands alone in the same text; it keeps the script, and a given name ends as the form of address has it. Surrogates of the whole corpus
are compared: none is shared by two entities and none is itself an entity. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.llm.common import Scratch, documents, free_name
from citespark.llm.quality import let

SHE = "Mrs|Ms|Miss|Madam|Frau|Mme|Madame|Mademoiselle|Mlle|Sra|Señora|Señorita|Госпожа|Κυρία"
HE = "Mr|Sir|Herrn|Herr|Monsieur|Sr|Señor|Господин|Κύριος"
TITLES = f"{SHE}|{HE}|Dr|Doctor|Docteur|Prof|Professor"
FORM = rf"(?:(?:{TITLES})\.? ){{1,3}}"
#: One name (O'Brien, Jean-Pierre; not the 's after it), and what may stand before it.
PART = rf"(?!(?:{TITLES})(?!\p{{L}}))\p{{Lu}}(?:[\p{{L}}\p{{M}}]|['\u2019]\p{{Lu}}|-\p{{L}}){{1,40}}"
BEFORE = r"(?:(?:\p{Lu}\.|von|van|de|der|den|la|le|du|di|da|del) ){0,3}"
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,8}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "token": r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|sk-[0-9A-Za-z_-]{20,200}|gh[pousr]_[0-9A-Za-z]{36})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "phone": "|".join((
        r"(?<!\d)\+?\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\d)",
        r"(?<![\d+])\+(?=(?:[ .()/-]{0,2}\d){8,15}(?![ .-]?\d))\d{1,4}(?:[ .-]?\(\d{1,4}\))?(?:[ ./-]?\d{1,12}){1,6}(?!\d)",
        r"(?<![\d)])\(\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,5}(?!\d)",
        r"(?<![\d.+-])(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])",
        r"(?<!\d)0\d(?:[ .-]\d{2}){4}(?!\d)",
        r"(?<![\d.,])0\d{1,4}[ /-]\d{5,8}(?!\d)")),
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{4}[ -]){3}\d{4}(?!\d)|(?<!\d)\d{4}[ -]\d{6}[ -]\d{5}(?!\d)|(?<!\d)\d{12,19}(?!\d)",
    "name": rf"(?<!\p{{L}}){FORM}{BEFORE}{PART}(?: {BEFORE}{PART}){{0,3}}",
}
ENTITY = "|".join(KINDS.values())
LATIN, GREEK, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщыэюя"
#: Fourteen syllables of each script, for names.
SYLLABLES = {"latin": "ba de fi go lu ma ne ri so tu va le mi no".split(), "greek": "βα δε φι γο λυ μα νε ρι σο τυ βι λε μι νο".split(),
             "cyrillic": "ба де фи го лу ма не ри со ту ва ле ми но".split()}
ENDS = {"name": {"latin": "n", "greek": "ν", "cyrillic": "н"}, "name_f": {"latin": "ra", "greek": "ρα", "cyrillic": "ра"}, "name_m": {"latin": "ro", "greek": "ρος", "cyrillic": "р"}}


def kind_of(entity: Column) -> Column:
    out = F.lit("card")
    for kind in reversed(KINDS):
        out = F.when(entity.rlike(f"^(?:{KINDS[kind]})$"), kind).otherwise(out)
    return out


def titled(entity: Column) -> Column:
    return entity.rlike(f"^{FORM}")


def name_parts(entity: Column) -> Column:
    """The names after the form of address; no other entity has any."""
    rest = F.regexp_replace(entity, f"^{FORM}", "")
    return F.when(titled(entity), F.regexp_extract_all(rest, F.lit(f"({PART})"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def numeric(entity: Column) -> Column:
    """A card, phone or other number, whose separators do not matter."""
    return ~entity.rlike(r"\p{L}") & ~entity.rlike(f"^(?:{KINDS['ip']})$")


def canon(entity: Column) -> Column:
    """What forms of one entity share: digits of a number, letters and digits of an account, else the text in lower case."""
    plain = F.when(numeric(entity), F.regexp_replace(entity, r"\D", "")).otherwise(F.lower(entity))
    return F.when(entity.rlike(f"^(?:{KINDS['iban']})$"), F.lower(F.translate(entity, " ", ""))).otherwise(plain)


def accepted(entity: Column) -> Column:
    """A bare run of 12 to 19 digits is a card only with a right check digit; whatever else the pattern finds is an entity."""
    return ~entity.rlike(r"^\d{12,19}$") | F.call_function("luhn_check", F.regexp_replace(entity, r"\D", "0"))


def spaced(new: Column, old: Column) -> Column:
    """The characters of new, with what old has between its letters and digits."""
    def place(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(old, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
        return F.when(c.rlike(r"[\p{L}\p{N}]"), F.substring(new, before + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(old, ""), place), "")


def surrogate(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    """The keyed surrogate (lower case) of a canonical entity."""
    seed = F.sha2(F.concat_ws("\x00", F.lit(key), kind, entity, attempt.cast("string")).cast("binary"), 512)

    def made(h: Column) -> Column:
        def byte(i: Column) -> Column:
            return F.conv(F.substring(h, F.pmod(i * 2, F.lit(126)).cast("int") + 1, F.lit(3)), 16, 10).cast("int")

        def pick(letters: str, i: Column) -> Column:
            return F.substring(F.lit(letters), F.pmod(byte(i), F.lit(len(letters))) + 1, F.lit(1))

        def letter(c: Column, i: Column) -> Column:
            return (F.when(c.rlike(r"^\d$"), pick("0123456789", i)).when(c.rlike(r"^\p{IsGreek}$"), pick(GREEK, i))
                    .when(c.rlike(r"^\p{IsCyrillic}$"), pick(CYRILLIC, i)).when(c.rlike(r"^\p{L}$"), pick(LATIN, i)).otherwise(c))

        def chars(s: Column) -> Column:
            return F.array_join(F.transform(F.split(s, ""), letter), "")

        tail = F.regexp_extract(entity, r"(\.[^.@]*)$", 1)
        email = F.concat(chars(F.substring(entity, F.lit(1), F.length(entity) - F.length(tail))), tail)
        secret = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.substring(h, F.pmod(i, F.lit(128)).cast("int") + 1, F.lit(1))), "")
        ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(byte(i * 2), F.lit(254)) + 1).cast("string")), ".")
        front = F.when(kind == "token", F.regexp_extract(entity, r"^(akia|sk-|gh[pousr]_)", 1)).when(
            kind == "iban", F.substring(entity, F.lit(1), F.lit(2))).otherwise(F.substring(entity, F.lit(1), F.lit(1)))  # a phone's country or leading zero stays
        kept = F.concat(front, chars(F.substring(entity, F.length(front) + 1, F.length(entity))))
        body = chars(F.substring(entity, F.lit(1), F.length(entity) - 1))
        digits = F.split(F.reverse(body), "")
        twice = F.transform(digits, lambda c, i: c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
        luhn = F.aggregate(twice, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
        card = F.concat(body, F.pmod(F.lit(10) - F.pmod(luhn, F.lit(10)), F.lit(10)).cast("string"))

        def named(script: str) -> Column:
            sounds = F.array(*map(F.lit, SYLLABLES[script]))
            stem = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3) + attempt), lambda i: F.get(sounds, F.pmod(byte(i), F.size(sounds)))), "")
            return F.concat(stem, F.when(kind == "name_f", ENDS["name_f"][script]).when(kind == "name_m", ENDS["name_m"][script]).otherwise(ENDS["name"][script]))

        name = F.when(entity.rlike(r"^\p{IsGreek}"), named("greek")).when(entity.rlike(r"^\p{IsCyrillic}"), named("cyrillic")).otherwise(named("latin"))
        return (F.when(kind == "email", email).when(kind == "secret", secret).when(kind == "ip", ip).when(kind.isin("phone", "token", "iban"), kept)
                .when(kind == "ssn", chars(entity)).when(kind == "card", card).otherwise(name))

    return let(seed, made)


def same_case(new: Column, old: Column) -> Column:
    """new (lower case) in the case of old, place by place; where old is all upper case, so is new."""
    each = F.array_join(F.transform(F.split(new, ""), lambda c, i: F.when(
        F.substring(old, i + 1, F.lit(1)) != F.lower(F.substring(old, i + 1, F.lit(1))), F.upper(c)).otherwise(c)), "")
    return F.when(old == F.lower(old), new).when(old == F.upper(old), F.upper(new)).otherwise(each)


def assign(entities: DataFrame, scratch: Scratch, key: str, rounds: int = 30) -> DataFrame:
    """Distinct (kind, entity) -> (entity, new): surrogates that differ from each other and from all entities."""
    now = scratch.put("try0", entities.select("kind", "entity", F.lit(0).alias("attempt"), surrogate(F.col("kind"), F.col("entity"), F.lit(0), key).alias("new")))
    for i in range(1, rounds + 1):
        shared = now.groupBy("new").agg(F.min("entity").alias("owner"), F.count("*").alias("n")).where("n > 1").select(F.col("new").alias("clash"), "owner")
        own = now.select(F.col("entity").alias("clash")).join(now.select(F.col("new").alias("clash")), "clash", "left_semi").withColumn("owner", F.lit(None).cast("string"))
        clash = shared.unionByName(own).groupBy("clash").agg(F.when(F.count("*") == F.count("owner"), F.min("owner")).alias("owner"))
        clash = scratch.put(f"clash{i}", clash)
        if clash.isEmpty():
            return now.select("entity", "new")
        marked = now.join(clash, now["new"] == clash["clash"], "left")
        again = F.col("clash").isNotNull() & ~F.col("entity").eqNullSafe(F.col("owner"))
        moved = marked.select("kind", "entity", (F.col("attempt") + again.cast("int")).alias("attempt"))
        now = scratch.put(f"try{i}", moved.select("*", surrogate(F.col("kind"), F.col("entity"), F.col("attempt"), key).alias("new")))
    raise RuntimeError(f"surrogates still clash after {rounds} rounds")


def replace_entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs, all columns kept, with the entities of the text replaced, and n_entities (places replaced).

    A null text stays null and an empty one empty. Repeated rows get equal texts. No rows give no rows. docs may have any
    other columns; the count gets a _ where its name is taken. The key decides the surrogates: the same in every run with one key.
    """
    scratch, count = Scratch(docs.sparkSession, "pii"), free_name(docs, "n_entities")
    whole = F.coalesce(F.col(text_col), F.lit(""))
    found = F.regexp_extract_all(whole, F.lit(ENTITY), F.lit(0))
    rows = docs.select(F.monotonically_increasing_id().alias("_uid"), F.struct("*").alias("_row"), F.col(text_col).alias("_text"), found.alias("_found"))
    rows = rows.withColumn("_names", F.array_distinct(F.flatten(F.transform("_found", name_parts))))
    # a text with names is read again, for the places that hold one of its names alone
    bare = F.array_join(F.array_sort(F.array_union("_names", F.transform("_names", F.upper)), lambda a, b: F.length(b) - F.length(a)), "|")
    again = F.concat(F.lit(ENTITY + r"|(?<!\p{L})(?:"), bare, F.lit(r")(?![\p{L}\p{M}])"))
    rows = rows.withColumn("_again", F.when(F.size("_names") > 0, again))
    rows = rows.withColumn("_all", F.when(F.col("_again").isNull(), F.col("_found")).otherwise(F.regexp_extract_all("_text", "_again", F.lit(0))))
    rows = scratch.put("docs", rows)
    some = rows.where(F.size("_found") > 0)

    def named(e: Column) -> Column:
        parts = name_parts(e)
        given = F.when(e.rlike(f"^(?:{SHE})\\.? "), "name_f").when(e.rlike(f"^(?:{HE})\\.? "), "name_m").otherwise("name")
        return F.transform(parts, lambda p, i: F.struct(F.when((F.size(parts) > 1) & (i < F.size(parts) - 1), given).otherwise("name").alias("kind"), canon(p).alias("entity")))

    keys = F.flatten(F.transform(F.filter("_found", accepted), lambda e: F.when(titled(e), named(e)).otherwise(F.array(F.struct(kind_of(e).alias("kind"), canon(e).alias("entity"))))))
    places = scratch.put("places", some.select("_uid", F.explode(F.array_distinct(keys)).alias("k")).select("_uid", "k.*"))
    given = assign(places.groupBy("entity").agg(F.min("kind").alias("kind")), scratch, key)
    known = places.select("_uid", "entity").distinct().join(given.hint("shuffle_merge"), "entity").groupBy("_uid").agg(F.map_from_entries(F.collect_list(F.struct("entity", "new"))).alias("_new"))
    changed = some.join(known, "_uid", "left")

    def replaced(e: Column) -> Column:
        """A name for each name; what stands before and between them stays."""
        new = F.element_at("_new", canon(e))
        return F.when(new.isNull(), e).when(numeric(e) | e.rlike(f"^(?:{KINDS['iban']})$"), same_case(spaced(new, e), e)).otherwise(same_case(new, e))

    def renamed(e: Column) -> Column:
        return F.concat(F.regexp_extract(e, f"^({FORM})", 1), F.array_join(F.transform(F.split(F.regexp_replace(e, f"^{FORM}", ""), " "), replaced), " "))

    new = F.transform("_all", lambda e: F.when(titled(e), renamed(e)).otherwise(replaced(e)))
    parts = F.when(F.col("_again").isNull(), F.split("_text", ENTITY, -1)).otherwise(F.split(F.col("_text"), F.col("_again"), -1))
    text = F.array_join(F.zip_with(parts, new, lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")

    def columns(t: Column) -> list[Column]:
        return [t.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns]

    same = rows.where(F.size("_found") == 0).select(*columns(F.col("_text")), F.lit(0).alias(count))
    return same.unionByName(changed.select(*columns(text), F.size(F.filter("_all", accepted)).alias(count)))


#: The setting that holds the key. Whoever has the key can redo the mapping, so a deployment sets its own; the default serves tests.
KEY_SETTING, DEFAULT_KEY = "spark.citespark.pii.key", "citespark surrogates"


def key_of(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, DEFAULT_KEY)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_entities, text) for every row of documents; edge cases as in replace_entities."""
    done = replace_entities(documents(spark, sf_dir).select("doc_id", "text"), key_of(spark))
    return done.select("doc_id", F.col("n_entities").cast("long").alias("n_entities"), "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with surrogates in the text; all rows and columns stay. Edge cases as in replace_entities."""
    return replace_entities(docs, key_of(spark)).select(*docs.columns)
