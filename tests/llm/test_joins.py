"""The similarity joins against brute force: planted links, hot groups, ties, repeated and null ids, empty tables."""

import numpy as np

from citespark.llm import embed, simhash


def closure(link):
    comp = np.arange(len(link))
    while True:
        new = np.array([comp[row].min() for row in link])
        if (new == comp).all():
            return comp
        comp = new


def test_range_join_finds_all_pairs_within_two_bits(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = {int(f) for f in base}
    for f in base[:20]:  # near copies at one to three bits, and one dense group
        for _ in range(12 if f != base[0] else 200):
            g = int(f)
            for bit in rng.integers(0, 64, rng.integers(1, 4)):
                g ^= 1 << int(bit)
            fps.add(g)
    fps = np.array(sorted(fps), dtype=np.uint64)
    comp = closure(np.bitwise_count(fps[:, None] ^ fps[None]) <= 2)
    rows = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    label = {int(f): i for i, f in enumerate(fps.view(np.int64))}
    near = np.eye(len(fps), dtype=bool)
    for e in simhash.links(rows).collect():
        a, b = label[e.a], label[e.b]
        near[a, b] = near[b, a] = True
    assert (closure(near) == comp).all()


def test_simhash_null_and_repeated_ids_and_clashing_names(spark):
    rows = [(None, "a b c d"), (None, "z y x w"), (3, "a b c d"), (3, "a b c d"), (3, "q r s t u"), (9, None), (None, "")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, fp int, _keep int, component_id int")
    got = [(r.doc_id, r.component_id) for r in simhash.simhash_components(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, 3), (None, None), (3, 3), (3, 3), (3, 3), (9, 9), (None, 9)], key=str)


def check(spark, vs, tile, kind="double"):
    got = {r.vec_id: r for r in embed.near_vectors(spark.createDataFrame([(i, v, 0, 0) for i, v in enumerate(vs)], f"vec_id long, embedding array<{kind}>, n int, rep int"), tile=tile).collect()}
    x = np.array(vs, dtype=np.float32 if kind == "float" else np.float64).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= 0.9
    comp = closure(link | np.eye(len(vs), dtype=bool))
    assert [got[i].n_links for i in range(len(vs))] == (link.sum(1) - 1).tolist()
    assert [got[i].component_id for i in range(len(vs))] == comp.tolist()
    assert all(got[i].kept == (i == comp[i]) for i in range(len(vs)))


def planted(spread):
    rng = np.random.default_rng(5)
    scale = np.exp(-np.arange(64) / spread)
    base = rng.standard_normal((150, 64)) * scale
    vs = list(base)
    for v in base[:40]:  # around the threshold, from well inside to outside
        noise = rng.standard_normal(64) * scale
        noise -= noise @ v / (v @ v) * v
        noise *= np.linalg.norm(v) / np.linalg.norm(noise)
        vs += [v * c + noise * np.sqrt(1 - c * c) for c in (0.95, 0.9001, 0.8999, 0.85)]
    vs += [base[7]] * 120 + [base[8] + rng.standard_normal(64) * scale * 0.02 for _ in range(150)]  # a hot vector, a dense group
    return [v.tolist() for v in vs]


def test_vectors_64_dimensions(spark):
    check(spark, planted(1e9), 8192)


def test_vectors_in_many_pieces(spark):
    check(spark, planted(12), 40, "float")


def test_vectors_ties_null_ids_and_empty(spark):
    e = [1.0, 0.0, 0.0]
    df = spark.createDataFrame([(None, e), (None, [0.0, 1.0, 0.0]), (5, e), (5, e), (6, None)], "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed.near_vectors(df).collect()), key=str)
    assert got == sorted([(None, 2, 5, False), (None, 0, None, False), (5, 2, 5, True), (5, 2, 5, True), (6, 0, 6, True)], key=str)
    assert embed.near_vectors(df.where("false")).count() == 0
