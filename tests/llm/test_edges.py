"""Every operator and stage on one awkward table (null and repeated ids, null, empty, blank and very long texts, ties, columns
named like the operators' own) and on no rows; and the pipeline as a whole against brute force, stage by stage."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citespark.llm import bpe, embed, packing, pfp, pii, quality, simhash, spans, toxicity, warc
from citespark.llm.common import Scratch

CLASH = ("id _id _uid _row _text _found _all _again _names _gone _s _h _score score fp n n_ k rank salt count length start stop piece offset sequence_id node component component_id "
         "first bands lang real dk gone own vals value kept quality base_failed n_words n_entities n_removed n_sentences page row digest size payload header").split()
WIDE = "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in CLASH)
RNG = random.Random(11)
NO_BREAK = "y" * 300_000
VERY_LONG = " ".join(f"w{RNG.randrange(10**6)}" for _ in range(40_000))
PLAIN = "Rivers run slowly past the old mill, and nobody in the village minds. The bridge was built a hundred years ago by hand. It still stands today."
ROWS = [(0, PLAIN), (1, None), (2, ""), (3, " \n\t "), (4, PLAIN), (5, VERY_LONG), (6, VERY_LONG + " tail"), (7, NO_BREAK), (7, PLAIN), (7, PLAIN),
        (None, PLAIN), (None, None), (None, "word"), (8, "word"), (9, "\x00 a\x01 b \U0001F600 é")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, *([1] * len(CLASH))) for i, t in ROWS], WIDE).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def ids(rows, name="doc_id"):
    return sorted((r[name] for r in rows), key=lambda x: (x is None, x))


EVERY = sorted((i for i, _ in ROWS), key=lambda x: (x is None, x))


def test_quality(odd, none):
    got = quality.weak_supervision(odd).collect()
    assert ids(got) == EVERY and len({(r.n_words, r.n_repeat_words, r.kept) for r in got if r.doc_id in (0, 4)}) == 1
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[5].n_words == 40_000 and not by[1].kept and not by[3].kept
    assert quality.weak_supervision(none).count() == 0


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(0, 1, 5), (0, 0, 5), (0, None, 5), (None, 1, 5), (77, 1, 5)], "doc_id long, toxic int, text int")
    for known in (labels, labels.where("false")):  # both labels for one text say nothing about a word
        got = toxicity.scores(odd, toxicity.train(odd, known), out="p").collect()
        assert ids(got) == EVERY and all(0 <= r.p <= 1 for r in got)
        assert len({r.p for r in got if not (r.text or "").strip()}) == 1
    assert toxicity.scores(none, toxicity.train(none, labels), out="p").count() == 0


def test_toxicity_stage(spark, odd, none, tmp_path):
    spark.createDataFrame([(0, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.stage(spark, odd, str(tmp_path))
    assert got.columns == odd.columns and ids(got.collect()) == EVERY
    assert toxicity.stage(spark, none, str(tmp_path)).count() == 0


def test_near_duplicates(odd, none):
    got = simhash.simhash_components(odd).collect()
    assert ids(got) == EVERY and all(r.component_id == 1 for r in got if r.fp == 0) and sum(r.fp == 0 for r in got) == 4
    kept = simhash.keep_first(odd)
    rows = kept.collect()
    assert kept.columns == odd.columns
    assert ids(rows) == [0, 1, 5, 7, 8, 9]  # of what is alike the smallest id stays, null is the largest
    assert {r.doc_id: r.text for r in rows}[7] == NO_BREAK and simhash.keep_first(none).count() == 0


def test_packing(odd, none):
    got = packing.pack(odd, packing.make_50k).collect()
    make = packing.make_50k()
    assert sum(r.length for r in got) == sum(len(make(t or "")) + 1 for _, t in ROWS) and max(r.length for r in got) == 2048
    assert ids([r for r in got if r.piece == 0]) == EVERY
    places: dict = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(p), sorted(p)[1:])) and sum(n for _, n in p) <= 2048
    assert packing.pack(none, packing.make_50k).count() == 0


def test_pii(odd, none):
    got = pii.replace_entities(odd, "k")
    assert got.columns == [*odd.columns, "n_entities_"] and Counter((r.doc_id, r.text) for r in got.collect()) == Counter(ROWS)
    assert pii.replace_entities(none, "k").count() == 0


def test_substrings(odd, none):
    got = pfp.remove_repeats(odd).collect()
    assert ids(got) == EVERY
    first = {0: 0, 4: len(PLAIN), 5: 0, 6: len(VERY_LONG), 7: 0, 9: 0}
    for r in got:
        raw = bytes(r.kept)
        assert r.kept_sha256 == hashlib.sha256(raw).hexdigest() and r.n_bytes == r.n_removed + len(raw)
        if r.doc_id in first and r.n_bytes != len(PLAIN.encode()):
            assert r.n_removed >= first[r.doc_id] and r.n_spans == (r.n_removed > 0)
        if r.n_bytes == len(PLAIN.encode()):  # strings of a smaller id go, also from rows with a null id and from repeated rows
            assert r.n_removed == (0 if r.doc_id == 0 else r.n_bytes)
    assert pfp.remove_repeats(none).count() == 0


def test_bpe(odd, none):
    P, T = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = P.path("word_bpe_49k.json")
    lib = T.Tokenizer.from_file(path)
    lib.no_truncation(), lib.no_padding()
    want = Counter()
    for i, t in ROWS:
        e = lib.encode(t or "", add_special_tokens=False).ids
        want[i, len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(lib.decode(e, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.bpe_round_trip(odd, path).collect())) == want and bpe.bpe_round_trip(none, path).count() == 0


def test_vectors(spark):
    vs = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (None, [0.0, 3.0]), (None, [1.0, 0.1]), (3, [0.0, None]), (4, None), (5, [1.0]), (5, [-1.0]), (6, [float("inf"), 1.0])]
    rows = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in vs], "vec_id long, embedding array<double>, v int, h1 int, first int, component_id int")
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embed.near_vectors(rows).select("vec_id", "n_links", "component_id", "kept").collect())
    want = [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, False), (None, 0, None, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (5, 0, 5, True), (6, 0, 6, True)]
    assert got == sorted((str(a), *r) for a, *r in want)
    assert embed.near_vectors(rows.where("false")).count() == 0


def test_archive(spark, odd, none):
    pages = odd.withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.lit(None).cast("string"))
    got = warc.parse(warc.read_archive(*warc.write_archive(pages, Scratch(spark, "t")))).collect()
    assert ids(got, "page_id") == EVERY
    assert Counter(r.payload_digest for r in got) == Counter(hashlib.sha256((t or "").encode()).hexdigest() for _, t in ROWS)
    plain = hashlib.sha256(PLAIN.encode()).hexdigest()
    assert {(r.page_id, r.record_type, r.refers_to) for r in got if r.payload_digest == plain} == {(0, "response", None), *((i, "revisit", 0) for i in (4, 7, None))}


def test_spans(spark, odd, none):
    got = spans.remove_repeats(odd)
    rows = got.collect()
    assert got.columns == [*odd.columns, "n_sentences_", "n_removed_"] and ids(rows) == EVERY
    assert all((r.text == PLAIN) == (r.doc_id == 0) for r in rows if r.n_sentences_ == 3) and Counter(r.text is None for r in rows)[True] == 2
    done = spans.stage(spark, odd, "")
    rows = done.collect()
    assert done.columns == odd.columns and ids(rows) == EVERY and sum(r.text == PLAIN for r in rows) == 1
    assert {r.doc_id: r.text for r in rows}[6].strip() == "tail" and any(r.text == NO_BREAK for r in rows)
    assert spans.stage(spark, none, "").count() == 0


def write_tables(spark, folder):
    """Clean documents, toxic ones, near and exact copies, a passage shared inside sentences, personal data, and odd rows."""
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdfglm" for b in "aeiou" for c in "nrst"]
    say = lambda n: [rng.choice(words) + rng.choice(words) for _ in range(n)]
    docs, labels = [], []
    for i in range(60):
        bad = i % 5 == 0
        docs.append((i, " ".join(say(40) + (["idiot", "scum"] if bad else ["fine", "nice"]) + say(40)) + "."))
        labels.append((i, 1, int(bad)))
    near = docs[1][1].split()
    near[50] = "changed"
    shared = say(70)
    docs += [(100, " ".join(near)), (101, docs[2][1]), (102, " ".join(say(20) + shared + say(20))), (103, " ".join(say(15) + shared + say(15)) + "."),
             (104, "Mrs Anna Bell, anna.bell@mail.example.com, wrote to Mr Bell about " + " ".join(say(30)) + "."), (105, "Ask anna.bell@mail.example.com " + " ".join(say(30)) + "."),
             (106, None), (107, ""), (None, " ".join(say(60)) + "."), (108, " ".join(say(5000)))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return dict(docs), {i for i, _, y in labels if y}, shared


def test_pipeline(spark, tmp_path, monkeypatch):
    docs, toxic, shared = write_tables(spark, tmp_path)
    given: dict = {}

    def seen(name, stage):
        def run(s, rows, sf_dir):
            given[name] = {r.doc_id: r.text for r in rows.collect()}
            assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            return stage(s, rows, sf_dir)
        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [seen(*s) for s in corpus_pipeline.STAGES])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert list(given) == ["toxicity", "simhash_dedup", "substring_dedup", "pii", "packing"] and given["toxicity"] == docs
    # toxicity: the toxic rows go, all others stay
    assert given["simhash_dedup"] == {i: t for i, t in docs.items() if i not in toxic}
    # near-dedup: one row of each component of five-word shingles with Jaccard >= 0.8
    rows = list(given["simhash_dedup"].items())
    sets = [frozenset(tuple((t or "").lower().split()[k:k + 5]) for k in range(max(1, len((t or "").split()) - 4))) for _, t in rows]
    comp = list(range(len(rows)))
    for _ in range(6):
        comp = [min(comp[j] for j in range(len(rows)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in range(len(rows))]
    first: dict = {}
    for (i, _), c in zip(rows, comp):
        first[c] = min(first.get(c, (True, 0)), (i is None, i or 0))
    stay = {None if gone else i for gone, i in first.values()}
    assert given["substring_dedup"] == {i: t for i, t in rows if i in stay} and {100, 101, 107} & stay == set() and {None, 1, 2, 106} <= stay
    # passages: words covered by 25 words that come earlier go, in order of ids; no run of sentences repeats here
    before, want = set(), {}
    for i, t in sorted(given["substring_dedup"].items(), key=lambda x: (x[0] is None, x[0])):
        found = [(m.start(), m.group().lower()) for m in re.finditer(spans.WORD, t or "")]
        runs = [tuple(w for _, w in found[k:k + 25]) for k in range(len(found) - 24)]
        gone = {k + j for k, r in enumerate(runs) if r in before for j in range(25)}
        before |= set(runs)
        ends = [a for a, _ in found[1:]] + [len(t or "")]
        want[i] = t if t is None else "".join(t[a:b] for k, ((a, _), b) in enumerate(zip(found, ends)) if k not in gone)
    assert given["pii"] == want and shared[30] in want[102] and shared[30] not in want[103]
    # personal data: nothing else changes, one entity has one surrogate everywhere
    for i, t in given["packing"].items():
        if i not in (104, 105):
            assert t == want[i]
    a, b = given["packing"][104], given["packing"][105]
    m = re.fullmatch(r"Mrs (\w+) (\w+), (\S+@\S+\.com), wrote to Mr (\w+) about (.*)", a)
    assert m and m[2] == m[4] != "Bell" and m[1] != "Anna" and m[3] != "anna.bell@mail.example.com" and f"Ask {m[3]} " in b and m[5] in want[104]
    # packing: every token of every text is placed once, in as few sequences as the bound allows here
    make = packing.make_50k()
    whole = {i: len(make(t or "")) + 1 for i, t in given["packing"].items()}
    sums: Counter = Counter()
    for r in out:
        sums[r.doc_id] += r.length
    assert sums == whole
    fill: Counter = Counter()
    for r in out:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) == -(-sum(whole.values()) // 2048)
