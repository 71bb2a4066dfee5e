"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of 32 two-bit segments. The Manhattan distance between two such
vectors is a lower bound of the Hamming distance between the fingerprints. ``links`` joins the vectors on a grid, keeps
pairs within Manhattan distance 2 and verifies those by exact Hamming distance; it returns a spanning forest, not the pairs.

The stage of the pipeline takes the same steps with 256 bits of five-word shingles, as texts of similarity 0.8 differ in about ten
of 64 bits: counts of two-bit segments, range join (on a grid of sizes: no cell of counts prunes at that distance), Manhattan
bound, exact Hamming distance, components. Within a component the texts' exact Jaccard similarity decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.llm.common import Scratch, documents, join_groups, per_row
from citespark.llm.graph import components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED, WORDS, BITS = 42, 3, 2
LOW = 0x5555555555555555


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprinter():
    """text -> (signed 64-bit fingerprint,)"""
    import numpy as np
    import xxhash

    digest, join = xxhash.xxh64_intdigest, b" ".join

    def of(text: str) -> tuple[int]:
        w = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
        if not w:
            return (0,)
        shingles = [join(w)] if len(w) < WORDS else list(map(join, zip(w, w[1:], w[2:])))
        h = np.fromiter(map(digest, shingles, repeat(SEED)), dtype=np.uint64, count=len(shingles))
        ones = np.zeros(64, dtype=np.int64)
        for i in range(0, len(h), 1 << 15):
            part = h[i:i + (1 << 15)]
            ones += np.add.reduce(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int32)
        packed = np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)
        return (int(packed[0]),)

    return of


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id_col and keep, fp long) for every row; a null text counts as empty and has fingerprint 0."""
    cols = list(dict.fromkeys([id_col, *(keep or [])]))
    df = docs.select(*cols, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*cols).schema) + ", fp bigint"
    return df.mapInPandas(per_row(fingerprinter, cols, "_text", ["fp"]), schema)


def spanning(p, q):
    """Edges as arrays -> arrays (node, smaller node) of a forest with the same components."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([p, q]), return_inverse=True)
    u, w, label = at[:len(p)], at[len(p):], np.arange(len(nodes))
    while True:
        lu, lw = label[u], label[w]
        if (lu == lw).all():
            break
        low = np.minimum(lu, lw)
        for side in (u, w, lu, lw):
            np.minimum.at(label, side, low)
        label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def unary(x):
    """Bits as uint64 -> the counts of their two-bit segments in unary, so that the distance of two counts is that of their bits."""
    import numpy as np

    lo, hi = x & np.uint64(LOW), (x >> np.uint64(1)) & np.uint64(LOW)
    return (hi | lo) | ((hi & lo) << np.uint64(1))


def range_join(batches: Iterator):
    """Rows (cell, visit, fp) sorted by cell, homes before visitors -> edges (a, b): a forest of the pairs found within BITS.

    Every home is compared with the rows that follow it in its cell. Only the cell in work is held, 17 bytes for each of its rows.
    """
    import numpy as np
    import pandas as pd

    def search(cell, visit, fp):
        x = fp.view(np.uint64)
        u = unary(x)
        start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        end = np.repeat(np.append(start[1:], len(cell)), np.diff(np.append(start, len(cell))))
        i, step, p, q, held = np.flatnonzero(~visit), 1, [], [], 0
        while True:
            i = i[end[i] - i > step]
            if not len(i):
                break
            j = i + step
            near = np.bitwise_count(u[i] ^ u[j]) <= BITS  # Manhattan distance of the counts: the lower bound
            a, b = i[near], j[near]
            same = np.bitwise_count(x[a] ^ x[b]) <= BITS
            p.append(fp[a[same]])
            q.append(fp[b[same]])
            held += len(p[-1])
            if held > 1 << 20:
                a, b = spanning(np.concatenate(p), np.concatenate(q))
                p, q, held = [a], [b], len(a)
            step += 1
        a, b = spanning(np.concatenate(p), np.concatenate(q)) if held else (fp[:0], fp[:0])
        return pd.DataFrame({"a": a, "b": b})

    rest = (np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))
    for pdf in batches:
        now = tuple(np.concatenate([r, pdf[c].to_numpy()]) for r, c in zip(rest, ("cell", "visit", "fp")))
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))
        rest = tuple(x[cut:] for x in now)
        if cut:
            yield search(*(x[:cut] for x in now))
    if len(rest[0]):
        yield search(*rest)


def links(fps: DataFrame) -> DataFrame:
    """Different fingerprints (fp) -> edges (a, b) with the same components as all pairs within two bits.

    The counts of 32 two-bit segments, two bits each, make a vector of two halves. Vectors within Manhattan distance 2 have a
    half within distance 1, so the range join runs on a grid of unit cells in each half: a fingerprint lives in its own cell
    and visits the cells one step up (about 12 of 16); of two that are one step apart the lower one visits the upper one.
    """
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lo, hi = F.col("fp").bitwiseAND(F.lit(LOW)), F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(LOW))
    counts = F.shiftleft(lo.bitwiseAND(hi), 1).bitwiseOR(lo.bitwiseXOR(hi))
    halves = fps.repartition(parts, "fp").select(
        "fp", F.explode(F.array(F.struct(F.lit(0).alias("side"), counts.bitwiseAND(F.lit(0xFFFFFFFF)).alias("own")),
                                F.struct(F.lit(1).alias("side"), F.shiftrightunsigned(counts, 32).alias("own")))).alias("h")).select("fp", "h.side", "h.own")
    cells = [F.struct(F.col("own").alias("cell"), F.lit(False).alias("visit"))]
    for i in range(16):
        up = F.shiftright("own", 2 * i).bitwiseAND(F.lit(3)) < 2
        cells.append(F.when(up, F.struct((F.col("own") + F.lit(1 << (2 * i))).alias("cell"), F.lit(True).alias("visit"))))
    dealt = halves.select("fp", "side", F.explode(F.array(*cells)).alias("k")).where("k is not null").select(
        (F.col("side") * F.lit(1 << 40) + F.col("k.cell")).alias("cell"), "k.visit", "fp")
    return dealt.repartition(parts, "cell").sortWithinPartitions("cell", "visit").mapInPandas(range_join, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp long, component_id): the smallest id reachable by links of two or fewer differing bits.

    Null and empty texts and texts of white space have fingerprint zero and link like any other. Repeated rows stay.
    A null id is kept; it gets the smallest id of its component, null if that has none. No rows give no rows.
    Other columns of docs do not matter, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    df = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    fps = scratch.put("fps", fingerprints(df, "_id", "_text"))
    first = scratch.put("first", fps.groupBy("fp").agg(F.min("_id").alias("rep"), F.count("*").alias("n")))
    cc = components(links(first.select("fp")), scratch)
    smallest = (first.join(cc, first.fp == cc.node).groupBy("component").agg(F.min("rep").alias("least")))
    moved = cc.join(smallest, "component").select(F.col("node").alias("fp"), "least")
    all_fps = scratch.put("all", first.join(moved, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"), "n"))
    return join_groups(fps, all_fps, ["fp"], "n").select(F.col("_id").alias(id_col), "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of documents; edge cases as in simhash_components."""
    found = simhash_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Words of a shingle; 64-bit words of a fingerprint, bits that may differ; rounds of comparison with one member; shingles that a task holds of a bucket (twice).
NEAR_WORDS, PRINT, NEAR_BITS, STARS, HELD = 5, 4, 72, 3, 1 << 21
#: Ratio of the sizes of a cell, over 1 / 0.8; pieces that all rows make if sizes are alike; least rows of a piece.
STEP, PIECES, PIECE = 1.26, 24, 1024
PRINTS = [f"f{i}" for i in range(PRINT)]


def shingle_set(text: str):
    """text -> sorted different 64-bit hashes of its shingles of NEAR_WORDS words, or of the whole text if it is shorter."""
    import numpy as np
    import xxhash

    w = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not w:
        return np.empty(0, dtype=np.uint64)
    grams = [b" ".join(w)] if len(w) < NEAR_WORDS else map(b" ".join, zip(*(w[i:] for i in range(NEAR_WORDS))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64))


def sketcher():
    """text -> (k1, k2: 128-bit hash of the shingle set; n: its size; f0 to f3: the set's fingerprint, a bit is 1 if set in over half the hashes)"""
    import numpy as np
    import xxhash

    rng = np.random.default_rng(SEED)
    odd = rng.integers(0, 1 << 63, (2, PRINT - 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mask = rng.integers(0, 1 << 63, PRINT - 1, dtype=np.uint64)

    def of(text: str) -> tuple:
        s = shingle_set(text)
        k = xxhash.xxh3_128_intdigest(s.tobytes())
        ones = np.zeros(64 * PRINT, dtype=np.int64)
        for i in range(0, len(s), 1 << 13):
            part = s[i:i + (1 << 13), None]
            more = (part ^ mask) * odd[0]
            more = (more ^ (more >> np.uint64(32))) * odd[1]
            h = np.concatenate([part, more ^ (more >> np.uint64(29))], axis=1)
            ones += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.int32)
        return signed(k >> 64), signed(k & ((1 << 64) - 1)), len(s), *np.packbits(2 * ones > len(s), bitorder="little").view(np.int64).tolist()

    return of


def wide_join(pdf):
    """Rows (side, n, node, f0 to f3) of one piece, or of two (sides 0 and 1) -> edges (a, b): a forest of the pairs within NEAR_BITS
    whose sizes n allow a Jaccard similarity of 0.8."""
    import numpy as np
    import pandas as pd

    def arrays(rows):
        rows = rows.sort_values("n", kind="stable")
        x = np.ascontiguousarray(rows[PRINTS].to_numpy().T).view(np.uint64)
        return rows["n"].to_numpy(), rows["node"].to_numpy(), x, unary(x)

    two = pdf["side"].nunique() == 2
    if not two and not pdf["within"].iloc[0]:
        return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    sides = sorted((pdf[pdf["side"] == k] for k in (0, 1)), key=len) if two else [pdf, pdf]
    (n, node, x, u), (m, other, y, v) = map(arrays, sides)
    lo, hi = np.searchsorted(5 * m, 4 * n), np.searchsorted(4 * m, 5 * n, side="right")
    if not two:
        lo = np.arange(1, len(n) + 1)
    p, q, held = [], [], 0
    for i in range(len(n)):
        w = slice(lo[i], hi[i])
        d = np.bitwise_count(v[0, w] ^ u[0, i])
        for k in range(1, PRINT):
            d += np.bitwise_count(v[k, w] ^ u[k, i])  # Manhattan distance of the counts: the lower bound
        j = lo[i] + np.flatnonzero(d <= NEAR_BITS)
        if len(j):
            j = j[np.bitwise_count(y[:, j] ^ x[:, i:i + 1]).sum(axis=0, dtype=np.int64) <= NEAR_BITS]
            p.append(np.full(len(j), node[i]))
            q.append(other[j])
            held += len(j)
            if held > 1 << 20:
                a, b = spanning(np.concatenate(p), np.concatenate(q))
                p, q, held = [a], [b], len(a)
    a, b = spanning(np.concatenate(p), np.concatenate(q)) if held else (node[:0], node[:0])
    return pd.DataFrame({"a": a, "b": b})


def wide_links(nodes: DataFrame) -> DataFrame:
    """nodes (node, n, f0 to f3) with different shingle sets, n > 0 -> edges (a, b) with the same components as all pairs within
    NEAR_BITS whose sizes allow a Jaccard similarity of 0.8.

    Sizes of such pairs lie in one cell of ratio STEP or in two that touch. A cell is dealt in pieces by the node's hash, each two
    pieces of one or of touching cells meet in a task, so that none grows with a common size.
    """
    cells = nodes.withColumn("cell", F.floor(F.log("n") / F.log(F.lit(STEP))).cast("int"))
    rows = {r.cell: r.m for r in cells.groupBy("cell").agg(F.count("*").alias("m")).collect()}  # some 60 rows at most
    size = max(PIECE, sum(rows.values()) // PIECES + 1)
    pieces = [-(-rows.get(c, 0) // size) for c in range(-1, max(rows, default=0) + 2)]
    of = lambda step: F.element_at(F.array(*map(F.lit, pieces)), F.col("cell") + (2 + step))
    each = lambda step, f: F.when(of(step) > 0, F.transform(F.sequence(F.lit(0), of(step) - 1), f)).otherwise(F.array())
    spot = lambda c, d, i, j, side: F.struct(c.alias("c"), d.alias("d"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    s, cell = F.col("s"), F.col("cell")
    tasks = F.concat(each(0, lambda t: spot(cell, cell, F.least(s, t), F.greatest(s, t), s > t)),
                     each(1, lambda t: spot(cell, cell + 1, s, t, F.lit(0))), each(-1, lambda t: spot(cell - 1, cell, t, s, F.lit(1))))
    dealt = cells.withColumn("s", F.pmod(F.xxhash64("node"), of(0)).cast("int")).select("n", "node", *PRINTS, F.explode(tasks).alias("t"))
    dealt = dealt.select("t.*", F.expr("t.c = t.d and t.i = t.j").alias("within"), "n", "node", *PRINTS)
    return dealt.groupBy("c", "d", "i", "j").applyInPandas(wide_join, "a long, b long")


def alike(batches: Iterator):
    """Rows (a, b, ta, tb) -> (a, b) of those whose texts have a Jaccard similarity of 0.8 or more."""
    import numpy as np

    for pdf in batches:
        sets: dict = {}
        for t in (*pdf["ta"], *pdf["tb"]):
            if t not in sets:
                sets[t] = shingle_set(t)
        good = []
        for ta, tb in zip(pdf["ta"], pdf["tb"]):
            x, y = sets[ta], sets[tb]
            good.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
        yield pdf.loc[np.array(good, dtype=bool), ["a", "b"]]


def packed_sets(batches: Iterator):
    """(node, text) -> (node, shingles: its set of hashes as bytes)"""
    import pandas as pd

    for pdf in batches:
        yield pd.DataFrame({"node": pdf["node"], "shingles": [shingle_set(t if isinstance(t, str) else "").tobytes() for t in pdf["text"]]})


def connect(pdf):
    """Two pieces of a bucket (node, component, shingles) -> edges (a, b) that join all that links of Jaccard >= 0.8 join.

    Breadth first: a member is compared at once with all that are not in its component yet; those of one component need no edge.
    """
    import numpy as np
    import pandas as pd

    sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
    size = np.array([len(s) for s in sets])
    word = np.unique(np.concatenate(sets), return_inverse=True)[1]
    at = np.cumsum(size) - size
    node, comp = pdf["node"].to_numpy(), np.unique(pdf["component"].to_numpy(), return_inverse=True)[1]
    mark, a, b = np.zeros(word.max() + 1, dtype=bool), [], []
    by = np.argsort(-np.bincount(comp)[comp], kind="stable")  # large components first: few are left to compare them with
    todo = np.ones(len(node), dtype=bool)
    for s in by:
        if not todo[s]:
            continue
        front = np.flatnonzero(todo & (comp == comp[s])).tolist()
        todo[front] = False
        rest = np.flatnonzero(todo)
        flat = None
        while front and len(rest):
            if flat is None:
                flat = np.concatenate([word[at[r]:at[r] + size[r]] for r in rest])
                start = np.cumsum(size[rest]) - size[rest]
            i = front.pop()
            mine = word[at[i]:at[i] + size[i]]
            mark[mine] = True
            both = np.add.reduceat(mark[flat], start, dtype=np.int64)
            mark[mine] = False
            near = rest[9 * both >= 4 * (size[rest] + size[i])]
            if len(near):
                a += [node[i]] * len(near)
                b += node[near].tolist()
                more = np.flatnonzero(todo & np.isin(comp, comp[near]))
                todo[more] = False
                front += more.tolist()
                rest, flat = np.flatnonzero(todo), None
    return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})


def near_links(left: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """left (bucket, node, n, component: node), texts (node, text) of its nodes -> (node, component) of the links of Jaccard >= 0.8.

    In a bucket, members are compared with one of them (in STARS rounds, each with another one); buckets whose members are then
    in several components are searched whole, in pieces of HELD shingles, two pieces in a task, so that no candidate pair is
    passed over. Pairs are never listed but for one for each member and round.
    """
    links_, cc = None, None

    def with_texts(pairs: DataFrame) -> DataFrame:
        for end in ("b", "a"):
            pairs = pairs.join(texts.select(F.col("node").alias(end), F.col("text").alias(f"t{end}")).hint("shuffle_merge"), end)
        return pairs.select("a", "b", "ta", "tb")

    for r in range(STARS + 1):
        if r < STARS:
            size = F.struct(F.xxhash64("node", F.lit(r)).alias("h"), F.col("node"), F.col("n"), F.col("component"))
            other = left.groupBy("bucket").agg(F.min(size).alias("c")).select("bucket", F.col("c.node").alias("a"), F.col("c.n").alias("na"), F.col("c.component").alias("ca"))
            pairs = left.join(other, "bucket").where("component <> ca and 5 * least(n, na) >= 4 * greatest(n, na)")
            pairs = scratch.put(f"pairs{r}", pairs.select("a", F.col("node").alias("b")).distinct())
            found = with_texts(pairs).mapInPandas(alike, "a long, b long")
        else:
            sets = left.select("node").distinct().join(texts.hint("shuffle_merge"), "node").mapInPandas(packed_sets, "node long, shingles binary")
            sets = scratch.put("shingles", sets)
            cuts = left.groupBy("bucket").agg(F.ceil(F.sum("n") / HELD).alias("cut"))
            own = left.join(cuts, "bucket").withColumn("t", F.pmod(F.xxhash64("node"), F.col("cut")))
            dealt = own.select("bucket", "node", "component", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1)).alias("u"))
            dealt = dealt.select("bucket", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), "node", "component")
            found = dealt.join(sets.hint("shuffle_merge"), "node").groupBy("bucket", "i", "j").applyInPandas(connect, "a long, b long")
        found = scratch.put(f"links{r}", found.distinct())
        links_ = found if links_ is None else links_.unionByName(found)
        cc = components(links_, scratch, f"near{r}_")
        if r < STARS:
            now = left.drop("component").join(cc.hint("shuffle_merge"), "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
            mixed = now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
            left = scratch.put(f"left{r}", now.join(mixed, "bucket"))
            if left.isEmpty():
                break
    return cc


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns kept, with one row of each component of near copies: Jaccard similarity of the sets of 5-word
    shingles >= 0.8, and what is reachable by it. The row is the one with the smallest id (null last), then the smallest
    hash of the text; rows that are equal in both count as copies like any other.

    Null and empty texts and texts of white space are copies of each other. No rows give no rows. Candidates are the
    components of fingerprints within NEAR_BITS of 256: of a pair of similarity 0.8 a bit differs with a chance of 0.15 (sets of 4 and 5
    shingles: 0.19), so it is missed with one of under 0.0001 where bits are independent.
    """
    scratch = Scratch(docs.sparkSession, "near")
    # a row is known by its id and its text; ids of rows that a scan hands out anew each time would not do
    plain = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"), F.col(text_col).alias("_text"))
    keep = ["_id", "_h"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.select(*keep).schema)
    sets = plain.mapInPandas(per_row(sketcher, keep, "_text", ["k1", "k2", "n", *PRINTS]), schema + ", k1 bigint, k2 bigint, n bigint" + "".join(f", {f} bigint" for f in PRINTS))
    order = F.struct(F.col("_id").isNull().alias("null"), "_id", "_h")
    one = sets.groupBy("k1", "k2").agg(F.min(order).alias("first"), F.first("n").alias("n"), *(F.first(f).alias(f) for f in PRINTS))
    one = scratch.put("one", one.select(F.monotonically_increasing_id().alias("node"), "first", "n", *PRINTS))
    alike_ = components(wide_links(one.where("n > 0").select("node", "n", *PRINTS)), scratch, "sim")
    left = one.select("node", "n").join(alike_.hint("shuffle_merge"), "node")
    left = scratch.put("buckets", left.select(F.col("component").alias("bucket"), "node", "n", F.col("node").alias("component")))
    # texts travel for the nodes of a bucket only; one shuffle on the keys serves the join and the aggregation
    spot = one.select("node", *row_keys(F.col("first._id"), F.col("first._h"))).join(left.select("node").distinct(), "node", "left_semi")
    texts = plain.select(*row_keys(F.col("_id"), F.col("_h")), "_text").join(spot.hint("shuffle_merge"), ROW)
    texts = scratch.put("texts", texts.groupBy(*ROW).agg(F.first("node").alias("node"), F.first("_text").alias("text")).select("node", "text"))
    cc = near_links(left, texts, scratch)
    groups = one.select("node", "first").join(cc.hint("shuffle_merge"), "node", "left").select("first", F.coalesce("component", "node").alias("component"))
    kept = scratch.put("kept", groups.groupBy("component").agg(F.min("first").alias("first")).select(*row_keys(F.col("first._id"), F.col("first._h"))))
    scratch.only("kept")
    rows = docs.select(*row_keys(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))), F.struct("*").alias("_row"))
    same = rows.join(kept.hint("shuffle_merge"), ROW, "left_semi")
    return same.groupBy(*ROW).agg(F.first("_row").alias("_row")).select("_row.*")


#: Columns that tell rows apart by id and text; none is null, so that they are plain keys of a join.
ROW = ["_none", "_key", "_hash"]


def row_keys(id_: Column, text_hash: Column) -> list[Column]:
    return [c.alias(name) for c, name in zip((id_.isNull(), F.coalesce(id_.cast("string"), F.lit("")), text_hash), ROW)]


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group of near copies, all columns kept; edge cases as in keep_first."""
    return keep_first(docs)
