"""The near-dedup stage of the pipeline: candidates come from SimHash fingerprints."""

import random

import numpy as np

from citespark.llm import simhash


def test_wide_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 40)
    monkeypatch.setattr(simhash, "PIECES", 3)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2, (60, 256), dtype=np.uint8)
    bits, size = [], []
    for i in range(400):
        row = base[rng.integers(60)].copy()
        row[rng.choice(256, rng.integers(0, 60), replace=False)] ^= 1
        bits.append(row)
        size.append(int(rng.choice([1, 4, 5, 80, 90, 100, 125, 126, 5000])))
    bits, size = np.array(bits), np.array(size)
    words = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
    rows = spark.createDataFrame([(i, n, *map(int, w)) for i, (n, w) in enumerate(zip(size.tolist(), words))], "node long, n long, f0 long, f1 long, f2 long, f3 long")
    near = ((bits[:, None] != bits[None]).sum(axis=2) <= simhash.NEAR_BITS) & (5 * np.minimum.outer(size, size) >= 4 * np.maximum.outer(size, size))
    edges = simhash.wide_links(rows.repartition(3)).collect()

    def closure(pairs):
        comp = list(range(400))
        while True:
            old = list(comp)
            for a, b in pairs:
                comp[a] = comp[b] = min(comp[a], comp[b])
            if comp == old:
                return comp

    assert closure([(e.a, e.b) for e in edges]) == closure(np.argwhere(near).tolist())
    assert simhash.wide_links(rows.where("false")).count() == 0


def test_similar_texts_have_near_fingerprints():
    rng, of = random.Random(8), simhash.sketcher()
    for n in (9, 12, 60, 300, 12000):
        for _ in range(20):
            a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            b = a[:n - max(1, n // 10)]
            x, y = set(simhash.shingle_set(" ".join(a)).tolist()), set(simhash.shingle_set(" ".join(b)).tolist())
            assert len(x & y) >= 0.8 * len(x | y)
            bits = sum((int(p) % 2**64 ^ int(q) % 2**64).bit_count() for p, q in zip(of(" ".join(a))[3:], of(" ".join(b))[3:]))
            assert bits <= simhash.NEAR_BITS


def test_stage_goes_by_fingerprints(spark, monkeypatch):
    asked, links = [], simhash.wide_links
    monkeypatch.setattr(simhash, "wide_links", lambda nodes: asked.append(set(nodes.columns)) or links(nodes))
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text), (2, text + " more"), (3, text), (4, "other words stand here alone"), (5, None), (6, "")]
    assert sorted(r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 4, 5]
    assert asked == [{"node", "n", "f0", "f1", "f2", "f3"}]
