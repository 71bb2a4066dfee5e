"""Repeated 50-byte strings by prefix-free parsing.

Triggers of a rolling hash cut texts into phrases that depend on content only, so copies share phrases. A phrase is kept
with the 49 bytes after it, so that every 50-byte string lies in exactly one such phrase. The dictionary holds each phrase
once, with the smallest document that has it; the parse says where phrases occur. An occurrence in a larger document goes
whole; strings are looked at in the first occurrence only.

The dictionary's suffixes are sorted bucket by bucket: a string belongs to the bucket of its least 24-gram, so equal strings
meet, and a bucket that one document alone has is never sorted. In a bucket, runs of neighbouring strings are stored once;
their suffixes are put in order by their first 50 bytes, neighbours that agree in all 50 are one string, and the smallest
document among them comes from the dictionary. Runs and parse then carry the marks back to places in the corpus.

Because of the 49 bytes the order of what follows a phrase never decides whether two 50-byte strings are equal, so the parse
is not sorted. Phrases are told apart by 128-bit hashes, runs by the hash of their
least gram and one of all their bytes, 64 bits each, strings by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.llm.common import Scratch, documents

#: Bytes of a string, of a gram; mean, least and most bytes of a phrase; bytes worked on at a time; pairs in a bucket; runs of a value before it is split.
LENGTH, GRAM, PHRASE, LEAST, MOST, BUFFER, PAIRS, CROWD = 50, 24, 1024, 256, 8192, 1 << 21, 1 << 21, 4096
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9)
TOP = (1 << 63) - 1


def words_at(raw: bytes, n: int):
    """The n 8-byte words that start at each place of raw."""
    import numpy as np

    return np.ndarray((n,), dtype="<u8", buffer=raw, strides=(1,))


def encoded(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def least_grams(raw: bytes):
    """For each 50-byte string: the least hash of its 24-grams."""
    import numpy as np

    n = len(raw) - GRAM + 1
    h = words_at(raw, n) * np.uint64(FACTORS[0])
    for k in range(8, GRAM, 8):
        h ^= h >> np.uint64(29)
        h += words_at(raw[k:], n)
        h *= np.uint64(FACTORS[k // 8 % 3])
    h ^= h >> np.uint64(32)
    span, size = LENGTH - GRAM + 1, 1
    while size * 2 <= span:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[:len(h) - (span - size)], h[span - size:]).view(np.int64)


def cuts(raw: bytes) -> list[int]:
    """Starts of the phrases of a text of 50 bytes or more."""
    import numpy as np

    h = words_at(raw, len(raw) - 7) * np.uint64(FACTORS[1])
    found, last = [0], len(raw) - LENGTH
    for c in [*np.flatnonzero(h >> np.uint64(54) == 0).tolist(), last + 1]:
        while c - found[-1] > MOST:
            found.append(found[-1] + MOST)
        if c - found[-1] >= LEAST and c <= last:
            found.append(c)
    return found


def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, dk, text) -> where phrases occur: (id, dk, start, n, hi, lo)."""
    names = ["id", "dk", "start", "n", "hi", "lo"]
    for pdf in batches:
        rows = []
        for doc, dk, text in zip(pdf["id"], pdf["dk"], pdf["text"]):
            raw = encoded(text)
            if len(raw) < LENGTH:
                continue
            starts = cuts(raw)
            for a, b in zip(starts, [*starts[1:], len(raw)]):
                phrase = raw[a:b + LENGTH - 1]
                d = hashlib.blake2b(phrase, digest_size=16).digest()
                rows.append((doc, dk, a, len(phrase), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
        yield pd.DataFrame(rows, columns=names)


def own_phrases(pdf: pd.DataFrame):
    """Rows (text, own: phrases) -> buffers of phrases end to end: (bytes, row, start in the row's text, start in the buffer, n), as arrays."""
    import numpy as np

    held, size, parts = [], 0, []

    def out():
        row, start, n = (np.array(x, dtype=np.int64) for x in zip(*held))
        return b"".join(parts), row, start, np.cumsum(n) - n, n

    for row, (text, own) in enumerate(zip(pdf["text"], pdf["own"])):
        raw = encoded(text)
        for o in own:
            held.append((row, o["start"], o["n"]))
            parts.append(raw[o["start"]:o["start"] + o["n"]])
            size += o["n"]
            if size > BUFFER:
                yield out()
                held, size, parts = [], 0, []
    if held:
        yield out()


def runs_of(raw: bytes, at, n):
    """Runs of strings with one least gram, none over the border of a phrase: (value, phrase number, place in the buffer, strings)."""
    import numpy as np

    g = least_grams(raw)
    phrase = np.repeat(np.arange(len(at)), n - LENGTH + 1)
    place = np.arange(len(phrase)) - np.repeat(np.cumsum(n - LENGTH + 1) - (n - LENGTH + 1) - at, n - LENGTH + 1)
    value = g[place]
    first = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (phrase[1:] != phrase[:-1])]))
    return value[first], phrase[first], place[first], np.diff(np.append(first, len(value)))


def planes(x) -> bytes:
    """Eight-byte numbers as all their first bytes, then all second ones and so on, which compresses."""
    import numpy as np

    return x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def numbers(raw: bytes):
    import numpy as np

    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def sketch(buckets: int):
    """Rows (uid, text, own) -> packed pairs of a value and a document: for each bucket (bucket, values, uids); for values that
    are shared already here, bucket -1 with all their pairs, and one pair that says so (uid -1) for the bucket."""
    import numpy as np

    def pack(value, uid):
        b = ((value.view(np.uint64) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        b, value, uid = b[order], value[order], uid[order]
        first = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.empty(0, np.int64)
        return [(int(b[s]), planes(value[s:e]), planes(uid[s:e])) for s, e in zip(first, np.append(first[1:], len(b)))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vals, uids, held = [], [], 0

        def flush():
            value, uid = np.concatenate(vals), np.concatenate(uids)
            order = np.lexsort((uid, value))
            value, uid = value[order], uid[order]
            new = np.append(True, (value[1:] != value[:-1]) | (uid[1:] != uid[:-1]))
            value, uid = value[new], uid[new]
            start = np.append(True, value[1:] != value[:-1])
            one = start & np.append(start[1:], True)
            rows = pack(value[one], uid[one]) + pack(value[start & ~one], np.full((start & ~one).sum(), -1))
            if (~one).any():
                rows.append((-1, planes(value[~one]), planes(uid[~one])))
            return pd.DataFrame(rows, columns=["bucket", "vals", "uids"])

        for pdf in batches:
            ids = pdf["uid"].to_numpy()
            for raw, row, _, at, n in own_phrases(pdf):
                value, phrase, _, _ = runs_of(raw, at, n)
                vals.append(value)
                uids.append(ids[row[phrase]])
                held += len(value)
                if held > PAIRS:
                    yield flush()
                    vals, uids, held = [], [], 0
        if held:
            yield flush()

    return run


def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Packed pairs sorted by bucket -> (uid, value) for values that two documents have. One bucket is held at a time."""
    import numpy as np

    def meet(parts):
        value = np.concatenate([numbers(v) for v, _ in parts])
        uid = np.concatenate([numbers(u) for _, u in parts])
        order = np.argsort(value, kind="stable")
        value, uid = value[order], uid[order]
        same = value[1:] == value[:-1]
        several = np.append(same, False) | np.append(False, same)  # pairs of one value come from different flushes, so from different documents or repeated rows
        on = several & (uid >= 0)
        return pd.DataFrame({"uid": uid[on], "value": value[on]})

    now, parts = None, []
    for pdf in batches:
        for bucket, vals, uids in zip(pdf["bucket"], pdf["vals"], pdf["uids"]):
            if bucket == -1:
                yield pd.DataFrame({"uid": numbers(uids), "value": numbers(vals)})
                continue
            if bucket != now and parts:
                yield meet(parts)
                parts = []
            now = bucket
            parts.append((vals, uids))
    if parts:
        yield meet(parts)


def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(uid, id, text, own, vals) -> runs with a value out of vals: (value, a, uid, id, off, n, bytes)."""
    import numpy as np
    import xxhash

    names = ["value", "a", "uid", "id", "off", "n", "bytes"]
    for pdf in batches:
        ids, uids = pdf["id"].to_numpy(), pdf["uid"].to_numpy()
        want = [np.sort(np.asarray(v, dtype=np.int64)) for v in pdf["vals"]]
        for raw, row, start, at, n in own_phrases(pdf):
            value, phrase, place, size = runs_of(raw, at, n)
            on = np.zeros(len(value), dtype=bool)
            edge = np.flatnonzero(np.append(True, row[phrase][1:] != row[phrase][:-1]))
            for s, e in zip(edge, np.append(edge[1:], len(value))):
                w = want[row[phrase[s]]]
                on[s:e] = w[np.minimum(np.searchsorted(w, value[s:e]), len(w) - 1)] == value[s:e]
            value, phrase, place, size = value[on], phrase[on], place[on], size[on]
            parts = [raw[p:p + k + LENGTH - 1] for p, k in zip(place.tolist(), size.tolist())]
            a = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), dtype=np.uint64, count=len(parts)).view(np.int64)
            r = row[phrase]
            yield pd.DataFrame(dict(zip(names, (value, a, uids[r], ids[r], start[phrase] + place - at[phrase], size, parts))))


def older(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs (value, salt, a, first, at, bytes) sorted by value and salt -> (value, a, x, y): strings x to y of a run, counted from its
    start, also lie in a run with a smaller first document. The strings of each (value, salt) are put in the order of their bytes."""
    import numpy as np

    def order(rows: pd.DataFrame):
        size = rows["bytes"].map(len).to_numpy(dtype=np.int64)
        n = size - LENGTH + 1
        raw = np.frombuffer(b"".join(rows["bytes"]) + bytes(8), np.uint8)
        at = np.cumsum(size) - size
        run = np.repeat(np.arange(len(rows)), n)
        inner = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        place = at[run] + inner
        big = words_at(raw.tobytes(), len(raw) - 7)
        cols = [big[place + k].byteswap() for k in (0, 8, 16, 24, 32, 40, 42)]  # 50 bytes; byte order is string order
        kind = rows["group"].to_numpy()[run]
        s = np.lexsort((*cols[::-1], kind))
        equal = kind[s][1:] == kind[s][:-1]
        for c in cols:
            equal &= c[s][1:] == c[s][:-1]
        head = np.flatnonzero(np.append(True, ~equal))
        first = rows["first"].to_numpy()[run]
        least = np.minimum.reduceat(first[s], head)
        old = np.empty(len(s), dtype=bool)
        old[s] = first[s] > np.repeat(least, np.diff(np.append(head, len(s))))
        begin = old & ~np.append(False, old[:-1] & (run[1:] == run[:-1]))
        stop = old & ~np.append(old[1:] & (run[1:] == run[:-1]), False)
        r, x, y = run[begin], inner[begin], inner[stop]
        offset = rows["at"].to_numpy()[r]
        return pd.DataFrame({"value": rows["value"].to_numpy()[r], "a": rows["a"].to_numpy()[r], "x": x + offset, "y": y + offset})

    rest = None
    for pdf in batches:
        rows = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        new = ((rows["value"] != rows["value"].shift()) | (rows["salt"] != rows["salt"].shift())).to_numpy()
        rows["group"] = np.cumsum(new)
        last = int(np.flatnonzero(new)[-1]) if len(rows) else 0
        rest, rows = rows.iloc[last:].drop(columns="group"), rows.iloc[:last]
        several = rows["group"].duplicated(keep=False).to_numpy()
        if several.any():
            yield order(rows[several].reset_index(drop=True))
    if rest is not None and len(rest) > 1:
        yield order(rest.assign(group=0).reset_index(drop=True))


def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, text, gone: covered ranges) -> what is left and the digest columns."""
    for pdf in batches:
        rows = []
        for doc, text, gone in zip(pdf["id"], pdf["text"], pdf["gone"]):
            raw = encoded(text)
            at, left, spans, last = 0, [], 0, -1
            for a, b in sorted((g["a"], g["b"]) for g in gone) if gone is not None else ():
                if a > last:
                    spans += 1
                    left.append(raw[at:a])
                at = last = max(last, b)
            left.append(raw[at:])
            kept = b"".join(left)
            rows.append((doc, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
        out = pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        out["id"] = out["id"].astype("Int64")
        yield out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, kept binary) for every row.

    A byte goes if a 50-byte string over it also starts in a document with a smaller id. Null and short texts lose nothing.
    Rows with one id are judged each against smaller ids only. A null id is larger than all others. No rows give no rows.
    Other columns of docs do not matter. Texts are read three times and never written; a text is held whole by one task.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pfp")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("real"), F.coalesce(F.col(id_col).cast("long"), F.lit(TOP)).alias("id"),
                       F.xxhash64(F.coalesce(text, F.lit(""))).alias("dk"), text.alias("text"))
    long_enough = rows.where(F.octet_length("text") >= LENGTH).select("id", "dk", "text")
    occ = scratch.put("parse", long_enough.mapInPandas(parse, "id long, dk long, start int, n int, hi long, lo long"))
    book = occ.groupBy("hi", "lo").agg(F.min("id").alias("first"))
    occ = scratch.put("placed", occ.join(book.hint("shuffle_merge"), ["hi", "lo"]).select("id", "dk", "start", "n", (F.col("id") > F.col("first")).alias("old")))
    scratch.drop("parse")
    spot = F.struct("start", "n")
    own = occ.where("not old").groupBy("id", "dk").agg(F.sort_array(F.collect_set(spot)).alias("own"))
    own = scratch.put("own", own.withColumn("uid", F.monotonically_increasing_id()))
    total = own.agg(F.sum(F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + x["n"]))).first()[0] or 0
    buckets = max(parts, total // (10 * PAIRS) + 1)
    texts = long_enough.join(own.hint("shuffle_merge"), ["id", "dk"])
    pairs = texts.select("uid", "text", "own").mapInPandas(sketch(buckets), "bucket long, vals binary, uids binary")
    deal = F.when(F.col("bucket") < 0, -1 - F.abs(F.xxhash64("vals") % 1024)).otherwise(F.col("bucket"))
    both = pairs.select(deal.alias("deal"), "bucket", "vals", "uids").repartition(parts, "deal").sortWithinPartitions("bucket")
    both = scratch.put("shared", both.select("bucket", "vals", "uids").mapInPandas(shared, "uid long, value long"))
    vals = both.groupBy("uid").agg(F.collect_set("value").alias("vals"))
    wanted = own.join(vals.hint("shuffle_merge"), "uid")
    texts = long_enough.join(wanted.hint("shuffle_merge"), ["id", "dk"])  # a repeated row repeats its runs, which does no harm
    runs = texts.select("uid", "id", "text", "own", "vals").mapInPandas(segments, "value long, a long, uid long, id long, off int, n int, bytes binary")
    runs = scratch.put("runs", runs)
    scratch.drop("shared")
    # equal runs are one; only the strings of values with different runs are put in order
    kinds = scratch.put("kinds", runs.groupBy("value", "a").agg(F.min("id").alias("first"), F.first("bytes").alias("bytes")))
    sizes = kinds.groupBy("value").agg(F.count("*").alias("k"), F.min("first").alias("lo"), F.max("first").alias("hi")).where("k > 1 and lo < hi").select("value", "k")
    mixed = kinds.join(sizes.hint("shuffle_merge"), "value")
    whole = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("salt"), F.col("bytes").alias("bytes")))
    each = F.transform(F.sequence(F.lit(0), F.length("bytes") - LENGTH), lambda i: F.struct(
        i.alias("at"), F.pmod(F.xxhash64(F.substring("bytes", i + 1, F.lit(LENGTH))), F.ceil(F.col("k") / CROWD)).alias("salt"), F.substring("bytes", i + 1, F.lit(LENGTH)).alias("bytes")))
    mixed = mixed.select("value", "a", "first", F.explode(F.when(F.col("k") <= CROWD, whole).otherwise(each)).alias("s")).select("value", "s.salt", "a", "first", "s.at", "s.bytes")
    found = mixed.repartition(parts, "value", "salt").sortWithinPartitions("value", "salt").mapInPandas(older, "value long, a long, x int, y int")
    part = found.groupBy("value", "a").agg(F.collect_list(F.struct("x", "y")).alias("part"))
    marks = scratch.put("marks", kinds.select("value", "a", "first").join(part, ["value", "a"], "left"))
    scratch.drop("kinds")
    gone = runs.select("value", "a", "uid", "id", "off", "n").join(marks.hint("shuffle_merge"), ["value", "a"])
    span = lambda x, y: F.struct((F.col("off") + x).alias("a"), (F.col("off") + y + LENGTH).alias("b"))
    gone = gone.select("uid", F.when(F.col("id") > F.col("first"), F.array(span(F.lit(0), F.col("n") - 1))).otherwise(F.transform("part", lambda p: span(p["x"], p["y"]))).alias("g")).where("g is not null")
    inside = gone.groupBy("uid").agg(F.flatten(F.collect_list("g")).alias("g")).join(own.select("uid", "id", "dk").hint("shuffle_merge"), "uid").select("id", "dk", "g")
    copies = occ.where("old").select("id", "dk", F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b"))).alias("g"))
    ranges = inside.unionByName(copies).groupBy("id", "dk").agg(F.flatten(F.collect_list("g")).alias("gone"))
    ranges = scratch.put("ranges", ranges)
    scratch.drop("runs", "marks")
    done = rows.join(ranges.hint("shuffle_merge"), ["id", "dk"], "left").select(F.col("real").alias("id"), "text", "gone").mapInPandas(
        cut_out, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done.withColumnRenamed("id", id_col)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of documents; edge cases as in remove_repeats."""
    return remove_repeats(documents(spark, sf_dir)).drop("kept")
