"""Single operators on small rows of their own."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from citespark.functions import text as T
from citespark.operators import answers, chunking, evaluation, guard, index, lexical, rank, scope
from citespark.sources import http, manifest, markup
from citespark.streaming import serve


def values(spark, expr, *rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(expr).collect()]


REFUSED = [("Soll ich unterschreiben?", "advice"), ("What should I do now", "advice"), ("Is it worth the trouble?", "advice"), ("Bitte um eine Empfehlung", "recommend"), ("Which lawyer is near", "recommend"),
           ("Kann ich klagen?", "litigation"), ("We go to court", "litigation"), ("Wie verhandle ich", "strategy"), ("A job offer came", "strategy")]
ALLOWED = ["Wie hoch ist das Gehalt?", "How does a court decide", "What is due on Sundays?", "Die Beratung im Gremium", "issue of shares", "Welche Frist gilt?", "", "Kündigungsfrist nach § 20", "mustard and pursuit"]


def test_guard_rules(spark):
    got = values(spark, guard.rule(F.col("q")), *((q,) for q, _ in REFUSED), schema="q string")
    assert got == [r for _, r in REFUSED] and set(got) == {"advice", "recommend", "litigation", "strategy"}
    assert values(spark, guard.rule(F.col("q")), *((q,) for q in ALLOWED), (None,), schema="q string") == [None] * 10
    v = values(spark, guard.verdict(F.col("q")), ("Should I",), schema="q string")[0]
    assert v.refuse and v.reason and values(spark, guard.refusal(F.col("l")), ("de",), ("xx",), (None,), schema="l string") == [guard.REFUSALS["de"], guard.REFUSALS["en"], guard.REFUSALS["en"]]


def test_interval_edges(spark):
    d = dt.date
    rows = [(d(2025, 1, 1), d(2025, 12, 31), x) for x in (d(2024, 12, 31), d(2025, 1, 1), d(2025, 12, 31), d(2026, 1, 1))] + [(d(2025, 1, 1), None, d(2099, 1, 1))]
    assert values(spark, scope.in_force(F.col("day")), *rows, schema="valid_from date, valid_to date, day date") == [False, True, True, False, True]


def test_money(spark):
    cells = [("2 420", "de", 2420), ("1.210,50", "de", 1210), ("960 ,-", "de", 960), ("2,420", "en", 2420), ("1,210.00", "en", 1210), ("1.210", "en", 1), ("1 210", "de", 1210), ("0", "de", None), ("", "en", None), (None, "de", None), ("x1", "de", None)]
    assert values(spark, T.money(F.col("c"), F.col("l")), *(c[:2] for c in cells), schema="c string, l string") == [c[2] for c in cells]
    with pytest.raises(Exception, match="implausible"):
        values(spark, T.checked_money(F.col("c"), F.col("l")), ("12", "de"), schema="c string, l string")
    assert values(spark, T.money_text(F.col("n"), F.col("l")), (4476, "de"), (4476, "en"), (960, "de"), schema="n int, l string") == ["4.476", "4,476", "960"]


def test_answer_match(spark):
    rows = [("ab 1.1.2026 gilt", 12, False), ("EUR 4.476 brutto", 4476, True), ("EUR 4,476", 4476, True), ("4 476", 4476, True), ("§ 12.", 12, True), ("12.5", 12, False), ("112", 12, False), ("1.1.2026", 2026, False)]
    assert values(spark, T.states_amount(F.col("t"), F.col("a")), *(r[:2] for r in rows), schema="t string, a int") == [r[2] for r in rows]


def test_references_and_titles(spark):
    lines = [("§ 15 Something", "§ 15"), ("Art. 4a Else", "§ 4a"), ("  Article 7", "§ 7"), ("see § 15", None), ("§ x", None)]
    assert values(spark, T.canonical_ref(F.col("t")), *((x,) for x, _ in lines), schema="t string") == [r for _, r in lines]
    assert values(spark, T.toc_title(F.col("t")), (" Scope  of work ........ 12",), ("..... 3",), schema="t string") == ["Scope of work", None]


def reference_pack(blocks, limit):
    out, cur = [], ""
    for b in blocks:
        while len(b) > limit:
            at = b.rfind(". ", 0, limit)
            at = at + 1 if at > limit // 2 else limit
            if cur:
                out.append(cur)
            cur = ""
            out.append(b[:at].strip())
            b = b[at:].strip()
        if cur and len(cur) + 1 + len(b) > limit:
            out.append(cur)
            cur = b
        else:
            cur = f"{cur}\n{b}" if cur else b
    return out + [cur] if cur else out


def test_packing_of_blocks(spark):
    import random

    rng = random.Random(1)
    rows = [(["a" * 10, "b" * 9, "c"],), (["a" * 20],), (["a" * 21],), (["Ab. " + "c" * 30],), (["a" * 14 + ". " + "b" * 60],), ([],)]
    rows += [([" ".join("x" * rng.randrange(1, 9) + rng.choice(["", "."]) for _ in range(rng.randrange(1, 20))) for _ in range(rng.randrange(1, 8))],) for _ in range(60)]
    got = values(spark, chunking.parts(F.col("b"), 20), *rows, schema="b array<string>")
    assert got == [reference_pack(b, 20) for b, in rows]
    text = "Lead\n(1) One\nmore\n(2a) Two\n\nIV. Four\n (x) none"
    got = chunking.blocks(spark.createDataFrame([(1, text), (2, None), (3, "  ")], "k long, text string"), "k").orderBy("k", "block").collect()
    assert [(r.k, r.block, r.text) for r in got] == [(1, 1, "Lead"), (1, 2, "(1) One\nmore"), (1, 3, "(2a) Two"), (1, 4, "IV. Four\n (x) none")]


def test_headings_and_cross_references(spark):
    toc = spark.createDataFrame([("d", "§ 15", "Task groups and minimum pay")], "doc string, ref string, title string")
    lines = ["Article 15 Task groups ....... 3", "Art. 15 III. is the same", "Art. 17 [1]).", "Article 15 Task groups and", "minimum pay", "Body text", "§ 15"]
    rows = [("d", 1 if i == 0 else 3, i, t) for i, t in enumerate(lines)]
    marked = chunking.headings(spark.createDataFrame(rows, "doc string, page int, pos int, text string"), toc)
    assert sorted(r.pos for r in marked.where("ref is not null").collect()) == [3, 6]
    body = chunking.body(chunking.sections(marked.where("pos < 6"))).collect()
    assert [(r.ref, r.text) for r in body] == [("§ 15", "minimum pay\nBody text")]
    again = [("d", 3, i, t) for i, t in enumerate(["§ 15", "Task groups", " and  minimum pay", "Task groups", "Body"])]
    marked = chunking.headings(spark.createDataFrame(again, "doc string, page int, pos int, text string"), toc)
    assert [r.text for r in chunking.body(chunking.sections(marked)).collect()] == ["Task groups\nBody"]


def test_cells_of_a_ragged_table(spark):
    schema = "key int, lang string, head string, caption string, header array<string>, rows array<array<string>>"
    tables = spark.createDataFrame([(1, "de", "H", None, ["", "A", " ", "C"], [["r", "1.000", "2.000", ""], ["s", "0"], ["", "900", "900", "900"], ["t", "x", "y", "3 000"]]), (2, "en", "H", "cap", ["only"], [["x"]]), (3, "en", "H", "cap", ["a", "b"], [["x", "-"]])], schema)
    got = chunking.cells(chunking.real_tables(tables)).orderBy("row", "col").collect()
    assert [(r.key, r.row, r.col, r.amount) for r in got] == [(1, 0, 1, 1000), (1, 3, 3, 3000)] and got[0].text == "H\nA / r: 1.000 EUR brutto pro Monat"
    assert [r.key for r in chunking.tables_without_cells(tables, chunking.cells(chunking.real_tables(tables))).collect()] == [3]


def test_compounds(spark):
    words = spark.createDataFrame([(w,) for w in ("normalarbeitszeit", "arbeitszeitgesetz", "mindestgrundgehalt", "kurz", "unbekannteswort", "urlaubsausmaß")], "word string")
    vocab = spark.createDataFrame([(w,) for w in ("normal", "arbeit", "zeit", "arbeitszeit", "gesetz", "urlaub", "ausmaß")], "word string")
    nouns = spark.createDataFrame([("gehalt",), ("wort",)], "word string")
    got = {r.word: r.parts for r in lexical.decompound(words, vocab, nouns).collect()}
    assert got == {"normalarbeitszeit": ["normal", "arbeitszeit"], "arbeitszeitgesetz": ["arbeitszeit", "gesetz"], "mindestgrundgehalt": ["gehalt"], "unbekannteswort": ["wort"], "urlaubsausmaß": ["urlaub", "ausmaß"]}


def test_fusion_ties_and_section_cap(spark):
    leg = lambda *ids: spark.createDataFrame([(1, d, i + 1, 1.0) for i, d in enumerate(ids)], "item_id long, doc_id long, rank int, score double")
    got = rank.rrf(leg(5), leg(4), leg(9, 8), leg(3, 5), k=None).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [5, 4, 9, 3, 8] and (got[0].dense_rank, got[0].lexical_rank, got[1].dense_rank) == (1, 2, None)
    rows = spark.createDataFrame([(1, i, i, "a", None if i > 4 else "x") for i in range(1, 9)], "item_id long, doc_id long, rank int, parent string, section_ref string")
    assert [r.doc_id for r in rank.cap_sections(rows, 5, ["parent", "section_ref"]).orderBy("place").collect()] == [1, 2, 3, 5, 6]


def test_filter_before_ranking(spark):
    """Eight chunks out of force lie nearer than the four in force: filtered after ranking nothing is left, before it all four are."""
    chunks = spark.createDataFrame([(i, [1.0, 0.0] if i < 8 else [0.6, 0.8], i >= 8) for i in range(12)], "doc_id long, v array<double>, ok boolean")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "item_id long, qv array<double>")
    post = rank.cosine(q, chunks, 5).join(chunks.where("ok"), "doc_id", "left_semi")
    assert post.count() == 0 and rank.cosine(q, chunks.where("ok"), 5).count() == 4


def test_cosine_in_batches_is_exact(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.round(rng.standard_normal((300, 8)), 1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, v array<double>").repartition(3)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:40])], "item_id long, qv array<double>")
    monkeypatch.setattr(rank, "BATCH", 16)
    got = {(r.item_id, r["rank"]): r.doc_id for r in rank.cosine(q, rows, 4).collect()}
    s = np.round(x[:40] @ x.T, 6)
    assert got == {(i, k + 1): d for i in range(40) for k, d in enumerate(np.lexsort((np.arange(300), -s[i]))[:4].tolist())}


def test_retry(spark):
    def run(script):
        calls, waits = iter(script), []
        n = 0

        def send():
            nonlocal n
            n += 1
            x = next(calls)
            if x == 0:
                raise OSError("dropped")
            return x, b"ok"

        try:
            return n, http.get(send, wait=waits.append) and n, waits
        except (OSError, http.HttpError) as e:
            return n, type(e).__name__, waits

    assert run([0, 0, 200])[1:] == (3, [1.5, 3.0]) and run([429, 200])[1] == 2 and run([503, 200])[1] == 2
    assert run([404]) == (0, "HttpError", []) or run([404])[1] == "HttpError"
    assert run([0, 0, 0, 0])[1] == "OSError" and run([500] * 4)[1] == "HttpError" and http.delay(9) == 20
    got = values(spark, http.outcome(F.col("s")), ([0, 0, 200, 1],), ([404, 200, 200, 200],), ([500, 500, 500, 500, 200],), schema="s array<int>")
    assert [(r.calls, r.status) for r in got] == [(3, 200), (1, 404), (4, 500)]


XML = """<?xml version="1.0"?><r:doc xmlns:r="urn:x"><r:n><r:kzinhalt><r:absatz>furniture</r:absatz></r:kzinhalt><r:absatz>before</r:absatz><r:ueberschrift typ="titel">Text</r:ueberschrift>
<r:ueberschrift typ="para">Working time</r:ueberschrift><r:absatz>Main <r:i>text</r:i>:<r:listelem><r:symbol>1.</r:symbol>first</r:listelem> tail</r:absatz><r:ueberschrift typ="other">no</r:ueberschrift>
<r:ueberschrift typ="titel">Notes</r:ueberschrift><r:absatz>after</r:absatz></r:n></r:doc>"""


def test_markup(spark):
    units = spark.createDataFrame([(1, XML)], "unit long, xml string")
    got = chunking.body_state(markup.items(units)).orderBy("pos").collect()
    assert [(r.is_heading, r.text) for r in got] == [(True, "Working time"), (False, "Main text: tail"), (False, "1. first")]
    with pytest.raises(Exception, match="not XML"):
        markup.items(spark.createDataFrame([(2, "<html>")], "unit long, xml string")).collect()


def test_manifest_and_files(spark, tmp_path):
    one = {"corpus": [{"doc_id": "a", "url": "u", "valid_from": "2025-01-01"}], "eval_sources": [{"doc_id": "b", "about_year": 2025}]}
    (tmp_path / "m.json").write_text(json.dumps(one))
    corpus, other = manifest.load(spark, str(tmp_path / "m.json"))
    assert [r.doc_id for r in corpus.collect()] == ["a"] and [r.about_year for r in other.collect()] == [2025]
    one["eval_sources"][0]["doc_id"] = "a"
    (tmp_path / "m.json").write_text(json.dumps(one))
    with pytest.raises(ValueError, match="more than once"):
        manifest.load(spark, str(tmp_path / "m.json"))
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "f" / "y.pdf").write_bytes(b"<html>")
    assert sorted(r.ok for r in manifest.files(spark, str(tmp_path / "f")).collect()) == [False, True]


def test_events_and_providers(spark):
    q = spark.createDataFrame([(1, "what", "de"), (2, "what", "en")], "item_id long, question string, lang string")
    ranked = spark.createDataFrame([(1, 1, "c1", "de", "[A, § 1]", " text \n"), (1, 2, "c2", "de", "[B]", "x" * 5990)], "item_id long, rank int, chunk_id string, lang string, citation string, text string")
    got = {r.item_id: r for r in answers.Extractive().generate(q, ranked).collect()}
    assert got[1].answer == "text\n\n[A, § 1]" and got[1].used == ["c1"] and got[2].answer == answers.NO_ANSWER["en"] and got[2].used == []
    assert [(r.n_blocks, r.context) for r in answers.context(ranked).collect()] == [(1, "QUELLE: [A, § 1]\n text \n")]
    down = answers.Remote(lambda prompt: "said", lambda: False)
    assert answers.route([down, answers.Extractive()]).name == "extractive"
    said = {r.item_id: (r.answer, r.used) for r in down.generate(q, ranked).collect()}
    assert said == {1: ("said", ["c1", "c2"]), 2: ("said", [])}
    base = "item_id long, trace_id string, rule string, refusal string, reason string, as_of string, notice string, citations array<string>, answer string, provider string"
    rows = spark.createDataFrame([(1, "t", "advice", "no", "why", None, None, [], None, "p"), (2, "t", None, None, None, "2026-07-01", None, ["[Ä]"], "yes", "p"), (3, "t", None, None, None, "d", None, [], None, "p")], base)
    names = {}
    for r in answers.stream_events(rows).orderBy("item_id", "seq").collect():
        names.setdefault(r.item_id, []).append(r.event.split("\n")[0][7:])
        assert r.event.endswith("\n\n") and json.loads(r.event.split("data: ", 1)[1])
    assert names == {1: ["refusal"], 2: ["meta", "token", "done"], 3: ["meta", "error"]}


def test_coverage_notice_one_day_past(spark):
    cov = spark.createDataFrame([("kv", dt.date(2025, 1, 1), dt.date(2026, 12, 31), 3), ("law", dt.date(2020, 1, 1), None, 2)], "source_type string, earliest date, latest date, n_chunks long")
    days = spark.createDataFrame([(1, dt.date(2026, 12, 31), "de"), (2, dt.date(2027, 1, 1), "de"), (3, dt.date(2027, 1, 1), "en")], "item_id long, day date, lang string")
    got = {r.item_id: r.notice for r in scope.notice(cov, days).collect()}
    assert got[1] is None and "nur 2025-01-01 bis 2026-12-31" in got[2] and "collective agreement: only 2025-01-01 to 2026-12-31" in got[3]
    assert scope.health(cov, F.lit("2027-01-01").cast("date")).first().status == "degraded"


def test_index_replaced_while_read(spark):
    def make(text):
        docs = spark.createDataFrame([(1, text), (2, "other words")], "doc_id long, text string")
        return lambda path: index.build(rank.term_table(docs), path, 2)

    old = index.once(spark, "swap", make("one two"))
    new = index.replace(spark, "swap", make("three"))
    assert {r.term for r in old["terms"].collect()} == {"one", "two", "other", "words"} and {r.term for r in new["terms"].collect()} == {"three", "other", "words"}


def test_stream_runs_batches(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    serve.serve(stream, lambda b: b.selectExpr("id * 2 AS x"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 2, 4, 6, 8]


def test_containing_without_inner_words(spark):
    docs = spark.createDataFrame([(1, "say yes to it"), (2, None), (3, "a b c yes")], "doc_id long, text string")
    built = index.once(spark, "small", lambda path: index.build(rank.term_table(docs), path, 3))
    q = spark.createDataFrame([(1, "yes"), (2, "a b c"), (3, "y yes t"), (4, "zz top of")], "item_id long, text string")
    assert sorted((r.item_id, r.doc_id) for r in evaluation.containing(q, docs, built).collect()) == [(1, 1), (1, 3), (2, 3), (3, 1)]
