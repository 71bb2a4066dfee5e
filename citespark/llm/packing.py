"""Best-fit packing with a local search.

The plan works on lengths, not on documents: how many pieces have each length (at most ``capacity`` numbers) is all that
the driver sees. Best fit, longest first, gives groups of equal bins. The search then empties the least filled bins: it
moves documents to bins where they fit, or exchanges one or two of them for a smaller one of a fuller bin, so that the sum
of squared fills grows with every step. Then pieces of one length are numbered and each takes the place of its number.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citespark.llm.common import Scratch, documents

CAPACITY = 2048
Bin = tuple[int, ...]


def token_ids(ranks_path: str, pattern: str, special: dict[str, int]):
    """text -> list of ids"""
    import re

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    cut = re.compile("(" + "|".join(map(re.escape, special)) + ")")

    def of(text: str) -> list[int]:
        out: list[int] = []
        for part in cut.split(text):
            out += [special[part]] if part in special else enc.encode_ordinary(part)
        return out

    return of


def cut_pieces(docs: DataFrame, make_ids, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents -> (_id, piece, start, length, ids_crc32). Only texts of over capacity ids are cut; their first piece may be short.

    A null or empty text is one piece with the closing id 0. Null and repeated ids stay. No rows give no rows.
    """
    import pandas as pd

    df = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        of = make_ids()
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["_id"], pdf["_text"]):
                ids = np.array([*of(text if isinstance(text, str) else ""), 0], dtype="<u4")
                n, start, k = len(ids), 0, 0
                while start < n:
                    stop = min(n, start + ((n - start) % capacity or capacity))
                    rows.append((key, k, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                    start, k = stop, k + 1
            out = pd.DataFrame(rows, columns=["_id", "piece", "start", "length", "ids_crc32"])
            out["_id"] = out["_id"].astype("Int64")
            yield out

    return df.mapInPandas(run, "_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: dict[int, int], capacity: int = CAPACITY) -> Counter:
    """How many pieces have each length -> bins (tuple of lengths) with counts, by best fit, longest first."""
    room: dict[int, Counter] = defaultdict(Counter)  # free room -> bins
    rooms: list[int] = []

    def put(b: Bin, free: int, n: int) -> None:
        if n:
            if not room[free] and (i := bisect_left(rooms, free)) is not None:
                if i == len(rooms) or rooms[i] != free:
                    rooms.insert(i, free)
            room[free][b] += n

    for size in sorted(lengths, reverse=True):
        left = lengths[size]
        while left:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                k, b, have, free = capacity // size, (), left, capacity
            else:
                free = rooms[i]
                b, have = room[free].popitem()
                if not room[free]:
                    rooms.pop(i)
                k = free // size
            whole = min(have, left // k)
            put(b + (size,) * k, free - k * size, whole)
            left -= whole * k
            have -= whole
            if left and have and left < k:
                put(b + (size,) * left, free - left * size, 1)
                left, have = 0, have - 1
            if have and i < len(rooms) + 1 and b:
                put(b, free, have)
    done: Counter = Counter()
    for bins in room.values():
        done.update(bins)
    return done


class Slots:
    """Bins by what they can take: for every length t of a document in a bin (0: none) the bins with it, by free room."""

    def __init__(self, capacity: int):
        import numpy as np

        self.capacity, self.at = capacity, [[] for _ in range(capacity + 1)]
        self.reach = np.full(capacity + 1, -1)  # the largest document that a bin takes in exchange for t

    def _touch(self, b: Bin, change) -> None:
        free = self.capacity - sum(b)
        for t in {0, *b}:
            change(self.at[t], (free, b))
            self.reach[t] = t + self.at[t][-1][0] if self.at[t] else -1

    def add(self, b: Bin) -> None:
        self._touch(b, insort)

    def remove(self, b: Bin) -> None:
        self._touch(b, lambda row, x: row.pop(bisect_left(row, x)))

    def exchange(self, a: Bin) -> tuple[Bin, tuple, int] | None:
        """The exchange that moves most from a: (other bin, what a gives, what it takes back or 0), or None."""
        import numpy as np

        reach = np.maximum.accumulate(self.reach)
        mine, count = sorted(set(a), reverse=True), Counter(a)
        gives = [(x,) for x in mine] + [(x, y) for i, x in enumerate(mine) for y in mine[i:] if x != y or count[x] > 1]
        sizes = np.array([sum(g) for g in gives])
        takes = np.searchsorted(reach, sizes)  # the smallest document that makes room
        gain = np.where(takes < sizes, sizes - takes, 0)
        best = int(gain.argmax())
        if gain[best] <= 0:
            return None
        t = int(takes[best])
        row = self.at[t]
        return row[bisect_left(row, (int(gain[best]),))][1], gives[best], t


def improve(bins: Counter, capacity: int = CAPACITY) -> Counter:
    """Move a document, or exchange one or two for one, between underfull bins while that raises the sum of squared fills; bins
    that get empty go. Ends at a local optimum or at the lower bound, never before; equal bins change in one step."""
    bins = Counter(bins)
    least = -(-sum(sum(b) * n for b, n in bins.items()) // capacity)
    slots, order = Slots(capacity), []

    def put(b: Bin, n: int) -> None:
        if not bins[b] and sum(b) < capacity:
            slots.add(b)
            insort(order, (sum(b), b))
        bins[b] += n
        if not bins[b]:
            del bins[b]
            if sum(b) < capacity:
                slots.remove(b)
                order.pop(bisect_left(order, (sum(b), b)))

    found, bins = bins, Counter()
    for b, n in found.items():
        put(b, n)
    while sum(bins.values()) > least:
        hidden, level, step = [], [], None
        for fill, a in order:  # emptiest first; the other bin is as full or fuller, so that the sum of squares grows
            if level and sum(level[0]) < fill:
                for b in level:
                    slots.remove(b)
                hidden, level = hidden + level, []
            alone = bins[a] == 1
            if alone:
                slots.remove(a)
            step = slots.exchange(a)
            if alone:
                slots.add(a)
            if step:
                break
            level.append(a)
        for b in hidden:
            slots.add(b)
        if not step:
            break
        other, give, take = step
        n = bins[a] // 2 if other == a else min(bins[a], bins[other])
        x, y = Counter(a), Counter(other)
        x.subtract(give)
        y.update(give)
        if take:
            x[take] += 1
            y[take] -= 1
        put(a, -n)
        put(other, -n)
        for c in (x, y):
            new = tuple(sorted((+c).elements(), reverse=True))
            if new:
                put(new, n)
    return bins


def places(bins: Counter) -> dict:
    """Bins with counts -> columns length, rank (first of a run of numbers), sequence (of the first), offset: one entry for each place."""
    rank: Counter = Counter()
    rows, base = [], 0
    for b, n in sorted(bins.items(), reverse=True):
        at = 0
        for size in b:
            rows.append((size, rank[size], base, at))
            rank[size] += n
            at += size
        base += n
    return rows


def pack(docs: DataFrame, make_ids, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", group_rows: int = 100_000) -> DataFrame:
    """One row for each piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of length 1 (the closing id). Repeated rows and null ids are packed each for itself.
    No rows give no rows. Other columns of docs do not matter. Pieces are numbered within (length, salt); there are as
    many salts as keep such a group near ``group_rows`` rows.
    """
    import numpy as np
    import pandas as pd

    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.put("pieces", cut_pieces(docs, make_ids, capacity, id_col, text_col))
    lengths = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = sorted(places(improve(best_fit(lengths, capacity), capacity)))
    size, first, sequence, offset = (np.array(c, dtype=np.int64) for c in (zip(*plan) if plan else ((), (), (), ())))
    key = size << 44 | first

    salts = max(16, max(lengths.values(), default=0) // group_rows)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").count()
    bases = counts.select("length", "salt", (F.sum("count").over(W.partitionBy("length").orderBy("salt")) - F.col("count")).alias("base"))
    ranked = salted.withColumn("k", F.row_number().over(W.partitionBy("length", "salt").orderBy("_id", "piece"))).join(bases, ["length", "salt"])
    numbered = ranked.select("_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("k") - 1).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, r = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            i = np.searchsorted(key, n << 44 | r, side="right") - 1
            pdf["sequence_id"], pdf["offset"] = sequence[i] + r - first[i], offset[i]
            yield pdf.drop(columns="rank")

    placed = numbered.mapInPandas(place, "_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("_id", id_col)


def make_50k():
    import public_tokenizers as P

    return token_ids(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, {"<|endoftext|>": 50256})


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each piece of every row of documents; columns and edge cases as in pack."""
    return pack(documents(spark, sf_dir), make_50k)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs, packed; columns and edge cases as in pack."""
    return pack(docs, make_50k)
