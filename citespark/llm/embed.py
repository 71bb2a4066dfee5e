"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors are turned to the principal axes of a bounded sample and split into blocks of coordinates. Cosine >= c means
squared distance <= 2 - 2c; each block has a share of that budget, in proportion to the spread it carries in the sample, so
at least one block of a linked pair keeps within its share. Every block is range-joined under its share, the union of what
the blocks find is verified by exact cosine in double precision.

Equal vectors are one. Vectors are dealt to slabs of the leading coordinate; slabs further apart than the whole budget are
not compared, a crowded slab is cut, and one task joins two pieces. A task returns how many links each vector gained and a
spanning forest of them, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.llm.common import Scratch, join_groups
from citespark.llm.graph import components

#: Coordinates of a block; rows of a piece; rows that the axes are fitted on; rows compared at a time.
BLOCK, TILE, SAMPLE, STRIPE = 16, 8192, 4096, 512


def unit(rows):
    """Lists of one length -> unit vectors in double precision."""
    import numpy as np

    x = np.array(list(rows), dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit(sample: list, cosine: float, tile: int, count: dict) -> dict:
    """length of vector -> (axes, budget of each block, inner borders of the slabs of the leading coordinate)"""
    import numpy as np

    plan = {}
    for dim, n in count.items():
        rows = [v for v in sample if len(v) == dim]
        x = unit(rows) if rows else np.eye(dim)[:1]
        spread, axes = np.linalg.eigh(x.T @ x / len(x))
        spread, axes = np.maximum(spread[::-1], 0) + 1e-6, axes[:, ::-1].copy()
        shares = np.array([spread[a:a + BLOCK].sum() for a in range(0, dim, BLOCK)])
        slabs = max(1, math.ceil(n / tile))
        plan[dim] = (axes, shares / shares.sum() * (2 - 2 * cosine), np.quantile(x @ axes[:, 0], np.linspace(0, 1, slabs + 1)[1:-1]))
    return plan


def by_dim(pdf: pd.DataFrame):
    return (part for _, part in pdf.groupby(pdf["v"].map(len)))


def slabs(plan: dict):
    """(rep, n, v) -> the same with dim and slab"""
    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in by_dim(pdf):
                dim = len(part["v"].iloc[0])
                lead = unit(part["v"]) @ plan[dim][0][:, 0]
                yield part.assign(dim=dim, slab=np.searchsorted(plan[dim][2], lead, side="right"))

    return run


def pieces(plan: dict, sizes: dict, cosine: float, tile: int) -> dict:
    """(dim, slab) -> (first number of its pieces, how many, last slab within reach)"""
    import numpy as np

    reach, out = math.sqrt(2 - 2 * cosine) + 1e-6, {}
    for dim, (_, _, borders) in plan.items():
        at = 0
        for s in range(len(borders) + 1):
            cut = max(1, math.ceil(sizes.get((dim, s), 0) / tile))
            last = len(borders) if s == len(borders) else int(np.searchsorted(borders, borders[s] + reach, side="right"))
            out[dim, s] = (at, cut, last)
            at += cut
    return out


def deal(where: dict):
    """A row for each pair of pieces (i, j), i <= j, that holds the row's piece; t: its own."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        partners: dict = {}
        for (dim, s), (at, cut, last) in where.items():
            end = sum(where[dim, last][:2])
            for i in range(at, at + cut):
                for j in range(i, end):
                    partners.setdefault((dim, i), set()).add((i, j))
                    partners.setdefault((dim, j), set()).add((i, j))
        for pdf in batches:
            t = [where[d, s][0] + r % where[d, s][1] for d, s, r in zip(pdf["dim"], pdf["slab"], pdf["rep"])]
            for (dim, own), part in pdf.drop(columns="slab").assign(t=t).groupby(["dim", "t"]):
                for i, j in sorted(partners[dim, own]):
                    yield part.assign(i=i, j=j)

    return run


def compare(cosine: float, plan: dict):
    """Two pieces -> (a, b, links): links of a gained (b null), or an edge of the forest (links null)."""
    import numpy as np

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dim, i, j = (int(pdf[c].iloc[0]) for c in ("dim", "i", "j"))
        axes, shares, _ = plan[dim]
        x = unit(pdf["v"])
        y = x @ axes
        order = np.argsort(y[:, 0], kind="stable")
        x, y = x[order], y[order]
        rep, n, t = (pdf[c].to_numpy()[order] for c in ("rep", "n", "t"))
        left, right = np.flatnonzero(t == i), np.flatnonzero(t == j)
        reach = math.sqrt(2 - 2 * cosine) + 1e-6
        blocks = []
        for k, share in enumerate(shares):
            s = y[:, k * BLOCK:(k + 1) * BLOCK].astype(np.float32)
            sq, one = (s * s).sum(axis=1, keepdims=True), np.ones((len(s), 1), np.float32)
            # squared distance by one product; the slack covers single precision
            blocks.append((np.hstack([-2 * s, sq, one]), np.hstack([s, one, sq])[right].T.copy(), np.float32(share + 2e-5)))
        links, label = np.zeros(len(rep), dtype=np.int64), np.arange(len(rep))

        def add(u, w):
            np.add.at(links, u, n[w])
            np.add.at(links, w, n[u])
            nonlocal label
            while len(u):
                lu, lw = label[u], label[w]
                if (lu == lw).all():
                    break
                low = np.minimum(lu, lw)
                for side in (u, w, lu, lw):
                    np.minimum.at(label, side, low)
                label = label[label]

        lead = y[right, 0]
        for a in range(0, len(left), STRIPE):
            rows = left[a:a + STRIPE]
            lo = a if i == j else int(np.searchsorted(lead, y[rows[0], 0] - reach))
            hi = int(np.searchsorted(lead, y[rows[-1], 0] + reach, side="right"))
            if hi <= lo:
                continue
            found = np.zeros((len(rows), hi - lo), dtype=bool)
            for one, other, share in blocks:
                found |= one[rows] @ other[:, lo:hi] <= share
            if i == j:
                found &= rows[:, None] < right[None, lo:hi]
            p, q = np.nonzero(found)
            if 20 * len(p) > found.size:  # many candidates: one product for all of the stripe
                found &= x[rows] @ x[right[lo:hi]].T >= cosine
                p, q = np.nonzero(found)
                add(rows[p], right[lo + q])
                continue
            p, q = rows[p], right[lo + q]
            for k in range(0, len(p), 1 << 16):
                u, w = p[k:k + (1 << 16)], q[k:k + (1 << 16)]
                near = (x[u] * x[w]).sum(axis=1) >= cosine
                add(u[near], w[near])
        has, moved = links > 0, label != np.arange(len(rep))
        gained = pd.DataFrame({"a": rep[has], "b": None, "links": links[has]})
        edges = pd.DataFrame({"a": rep[moved], "b": rep[label[moved]], "links": None})
        return pd.concat([gained.astype(object), edges.astype(object)])

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors of different
    length. Equal rows link with each other. A null id is larger than all others; a component of null ids alone has a null
    component_id, and kept is false there. No rows give no rows. Other columns do not matter. ``tile`` bounds the rows of a
    task (two pieces). The axes are fitted on SAMPLE different vectors; they change the speed only, not the result.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    v = F.col(vec_col) if single else F.col(vec_col).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    top = F.lit((1 << 63) - 1)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(fine, v).alias("v"))
    keyed = rows.select(F.coalesce("id", top).alias("id"), "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    same = F.when(F.min("v") == F.max("v"), F.max("v")).otherwise(F.raise_error(F.lit("two vectors with one hash")))
    groups = keyed.where("v is not null").groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n"), same.alias("v"))
    groups = scratch.put("groups", groups.withColumn("rep", F.monotonically_increasing_id()))
    count = {r.d: r.n for r in groups.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    plan = fit([r.v for r in groups.orderBy("h1", "h2").limit(SAMPLE).select("v").collect()], cosine, tile, count)
    element = "float" if single else "double"
    base = f"rep long, n long, v array<{element}>"
    placed = scratch.put("placed", groups.select("rep", "n", "v").mapInPandas(slabs(plan), f"{base}, dim int, slab int"))
    sizes = {(r.dim, r.slab): r.n for r in placed.groupBy("dim", "slab").agg(F.count("*").alias("n")).collect()}
    dealt = placed.mapInPandas(deal(pieces(plan, sizes, cosine, tile)), f"{base}, dim int, t int, i int, j int")
    found = scratch.put("found", dealt.groupBy("dim", "i", "j").applyInPandas(compare(cosine, plan), "a long, b long, links long"))
    cc = components(found.where("b is not null").select("a", "b"), scratch)
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    known = groups.select("rep", "h1", "h2", "n", "first").join(links, F.col("rep") == links.a, "left").join(cc, F.col("rep") == cc.node, "left")
    known = known.withColumn("component", F.coalesce("component", "rep"))
    least = known.groupBy("component").agg(F.min("first").alias("least"))
    known = scratch.put("known", known.join(least, "component").select("h1", "h2", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "least"))
    linked = join_groups(keyed.where("v is not null").select("id", "h1", "h2"), known, ["h1", "h2"], "n").select("id", "n_links", "least")
    alone = keyed.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("least"))
    null = F.lit(None).cast("long")
    out = linked.unionByName(alone).select(F.when(F.col("id") < top, F.col("id")).alias(id_col), "n_links", F.when(F.col("least") < top, F.col("least")).otherwise(null).alias("component_id"),
                                           ((F.col("id") == F.col("least")) & (F.col("id") < top)).alias("kept"))
    return out


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of embeddings; edge cases as in near_vectors."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
f AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (WITH RECURSIVE c(n, m) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, c.m FROM c JOIN l ON l.a = c.n) SELECT n, min(m) AS m FROM c GROUP BY n),
d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, r.m AS component_id, v.vec_id = r.m AS kept
FROM v JOIN r ON r.n = v.vec_id LEFT JOIN d ON d.a = v.vec_id
"""
