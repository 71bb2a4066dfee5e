"""BPE by backtracking: longest tokens found by an Aho-Corasick automaton, taken back where a pair of neighbours could not
stand side by side after the merges; linear in the length of a word. Decoding reads an offset table of all tokens.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.llm.common import documents, per_row

CACHE = 200_000


class Encoder:
    """Encoder for a tokenizers file with a BPE model and word ends. encode(text) gives ids, decode(ids) text."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        lib = Tokenizer.from_file(path)
        self.normalizer, self.pre = lib.normalizer, lib.pre_tokenizer
        model = spec["model"]
        end, vocab = model["end_of_word_suffix"] or "", model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = added
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

        def own(token: str) -> str:  # a letter that ends a word is a letter of its own
            if end and token.endswith(end):
                return token[:-len(end) - 1] + self.last(token[-len(end) - 1])
            return token

        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = {a + b for a, b in merges}
        base = [t for t, _ in sorted(vocab.items(), key=lambda x: x[1]) if t not in made and t not in added]
        self.text, self.ids = [], []
        rank: dict[str, int] = {}
        for t in base:
            rank[own(t)] = len(self.text)
            self.text.append(own(t))
            self.ids.append(vocab[t])
        self.left, self.right, self.pair = list(range(len(base))), list(range(len(base))), {}
        for a, b in merges:
            x, y = rank[own(a)], rank[own(b)]
            t = own(a + b)
            if t not in rank:
                rank[t] = len(self.text)
                self.text.append(t)
                self.ids.append(vocab[a + b])
                self.left.append(x)
                self.right.append(y)
            self.pair.setdefault((x, y), rank[t])
        self.size = [len(t) for t in self.text]
        self.prefix = [next((rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in rank), -1) for t in self.text]
        # over reversed words, the longest token that ends at a place is the longest one that starts there
        self.automaton = ahocorasick.Automaton()
        for t, r in rank.items():
            self.automaton.add_word(t[::-1], r)
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        # offset table
        table = {i: t.encode() for t, i in [*vocab.items(), *added.items()]}
        self.offset, parts, at = [0], [], 0
        for i in range(max(table) + 1):
            parts.append(table.get(i, b""))
            at += len(parts[-1])
            self.offset.append(at)
        self.blob = b"".join(parts)

    @staticmethod
    def last(letter: str) -> str:
        return chr(0x100000 + ord(letter))

    def compatible(self, a: int, b: int) -> bool:
        """Can token a be followed by token b once all merges are done? Undoes the younger merge step by step."""
        key = (a, b)
        known = self.fits.get(key)
        if known is not None:
            return known
        limit, good = len(self.text), None
        while good is None:
            joined = self.pair.get((a, b))
            if joined is not None and joined < limit:
                good = False
            elif a > b:
                limit, a = a, self.right[a]
                if a == limit:
                    limit, b = b + 1, self.left[b]
                    good = True if b + 1 == limit else None
            else:
                limit, b = b + 1, self.left[b]
                if b + 1 == limit:
                    limit, a = a, self.right[a]
                    good = True if a == limit else None
        if len(self.fits) >= CACHE:
            self.fits.clear()
        self.fits[key] = good
        return good

    def word(self, word: str) -> list[int]:
        """One pre-token -> ids."""
        w = word[:-1] + self.last(word[-1])
        n = len(w)
        longest = [-1] * n
        for at, r in self.automaton.iter(w[::-1]):
            start = n - 1 - at
            if longest[start] < 0 or self.size[r] > self.size[longest[start]]:
                longest[start] = r
        open_ = bytearray(b"\x01") * (n + 1)
        size, fits = self.size, self.fits
        out, pos, token = [], 0, longest[0]
        while pos < n:
            stop = pos + size[token]
            good = open_[stop]
            if good and out:
                good = fits.get((out[-1], token))
                if good is None:
                    good = self.compatible(out[-1], token)
            if good:
                out.append(token)
                pos = stop
                token = longest[pos] if pos < n else -1
            elif self.prefix[token] >= 0:
                token = self.prefix[token]
            else:
                open_[pos] = 0
                token = out.pop()
                pos -= size[token]
        return [self.ids[r] for r in out]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for w, _ in self.pre.pre_tokenize_str(self.normalizer.normalize_str(part)):
                    out.extend(self.word(w))
        return out

    def decode(self, ids: list[int]) -> bytes:
        o, blob = self.offset, self.blob
        return b" ".join([blob[o[i]:o[i + 1]] for i in ids])


#: Words of printable ASCII without an apostrophe and of accented Latin letters in one code point each: normalizing only
#: puts them in lower case, and PLAIN gives their pre-tokens, but for the spelling of bytes.
SIMPLE = re.compile("[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")

#: White space of the pre-tokenizer that surely parts words: no rule or token reaches across it.
BREAKS = re.compile("[ \n\t\r]+")


@functools.lru_cache(maxsize=2)
def digester(path: str):
    """text -> (n_tokens, ids_sha256, decoded_sha256). Made once in a worker process; its caches outlive a task, with a bound."""
    enc = Encoder(path)
    names = {i: str(i).encode() for i in enc.ids}
    spelled = {c: enc.pre.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}  # letters of bytes
    cache: dict[str, tuple[int, bytes, bytes]] = {}
    words: dict[str, tuple[int, bytes, bytes]] = {}
    cut = enc.cut.search if enc.cut else lambda c: None

    def store(table: dict, key: str, got: tuple) -> tuple:
        if len(key) <= 64:
            if len(table) >= CACHE:
                table.clear()
            table[key] = got
        return got

    def word(w: str) -> tuple[int, bytes, bytes]:
        ids = enc.word(w if w.isascii() else w.translate(spelled))
        return store(words, w, (len(ids), b" ".join([names[i] for i in ids]), enc.decode(ids)))

    def chunk(c: str) -> tuple[int, bytes, bytes]:
        if SIMPLE.fullmatch(c) and not cut(c):
            got = [words.get(w) or word(w) for w in PLAIN.findall(c.lower())]
            found = got[0] if len(got) == 1 else (sum([g[0] for g in got]), b" ".join([g[1] for g in got]), b" ".join([g[2] for g in got]))
        else:
            ids = enc.encode(c)
            found = (len(ids), " ".join(map(str, ids)).encode(), enc.decode(ids))
        return store(cache, c, found)

    def of(text: str) -> tuple:
        got = [cache.get(c) or chunk(c) for c in BREAKS.split(text) if c]
        got = [g for g in got if g[0]]
        ids, back = hashlib.sha256(b" ".join([g[1] for g in got])), hashlib.sha256(b" ".join([g[2] for g in got]))
        return sum([g[0] for g in got]), ids.hexdigest(), back.hexdigest()

    return of


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) for every row of docs; a null text is empty and has no tokens.

    Repeated rows and null ids stay. No rows give no rows. Other columns of docs do not matter, whatever their names.
    """
    df = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = f"_id {df.schema['_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    run = per_row(lambda: digester(path), ["_id"], "_text", ["n_tokens", "ids_sha256", "decoded_sha256"])
    return df.mapInPandas(run, schema).withColumnRenamed("_id", id_col)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of documents; edge cases as in bpe_round_trip."""
    import public_tokenizers

    return bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
