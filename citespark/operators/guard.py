"""Questions that must not be answered: four ordered rules, the first that fits decides. Plain expressions, so that refused rows
are filtered before any index is read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases of each rule. A trailing * stands for any ending.
ADVICE = ["soll ich", "sollte ich", "soll man", "sollte man", "was soll ich", "should i", "should we", "what should i", "muss ich klagen", "muss ich kündigen", "lohnt sich", "lohnt es sich", "is it worth"]
RECOMMEND = ["empfehl*", "raten*", "ratschlag*", "recommend*", "advise", "advice", "welchen anwalt", "which lawyer", "besten anwalt"]
LITIGATION = ["klage*", "verklagen*", "sue*", "suing*", "lawsuit*", "court*", "gericht*"]
FIRST_PERSON = ["ich", "mein*", "mir", "mich", "i", "my", "me", "we", "our"]
STRATEGY = ["verhandl*", "negotiat*", "job angebot", "jobangebot", "job offer", "kündigen oder", "quit or"]
REASONS = {"advice": "asks what to do", "recommend": "asks for a recommendation", "litigation": "asks about an own lawsuit", "strategy": "asks how to negotiate"}
REFUSALS = {
    "de": "Hier gibt es nur Auskunft über den Inhalt der Quellen, keinen persönlichen Rat. Bitte wenden Sie sich an eine Beratungsstelle.",
    "en": "Only what the sources say can be reported here, not personal advice. Please turn to a counselling service.",
}
LETTER = r"[\p{L}\p{N}_]"


def pattern(phrases: list[str]) -> str:
    """One expression for Java and RE2 alike, over lower-case text: whole words, any white space between them."""
    found = "|".join(p.replace("*", LETTER + "*").replace(" ", r"\s+") for p in phrases)
    return rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{found})(?:$|[^\p{{L}}\p{{N}}_])"


def rule(question: Column) -> Column:
    """The first rule that fits, or null."""
    q = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    hit = {name: q.rlike(pattern(phrases)) for name, phrases in (("advice", ADVICE), ("recommend", RECOMMEND), ("litigation", LITIGATION), ("me", FIRST_PERSON), ("strategy", STRATEGY))}
    return (F.when(hit["advice"], "advice").when(hit["recommend"], "recommend").when(hit["litigation"] & hit["me"], "litigation")
            .when(hit["strategy"], "strategy"))


def verdict(question: Column) -> Column:
    """struct<refuse, reason, rule>"""
    r = rule(question)
    reasons = F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair))
    return F.struct(r.isNotNull().alias("refuse"), F.element_at(reasons, r).alias("reason"), r.alias("rule"))


def refusal(lang: Column) -> Column:
    """The text shown, in the language asked in; English for others."""
    return F.when(lang == "de", REFUSALS["de"]).otherwise(REFUSALS["en"])
