"""Byte-level BPE: encoding by a priority queue of merge ranks over a doubly linked symbol list, and decoding.

A text is cut at the strings of added tokens, then into pretokens by the vocabulary's public pattern. Each pretoken's
bytes form a doubly linked list; a heap holds (rank, position) of every mergeable neighbour pair. Popping the lowest
rank merges the pair, unless the entry is stale (one of its symbols has merged since), and pushes the two new pairs.
Pretokens repeat, so each Python worker remembers up to ``cache`` of the latest ones with their packed ids, which changes
time only. Decoding concatenates the vocabulary's byte strings and reads them as UTF-8.

Each text is handled whole, in one task and in one pass without a shuffle.

Defined cases: null counts as empty and gives no ids, an empty decoded text; added tokens' strings in a text become
their ids, as the tokenizers library does by default; unknown bytes can't occur in a byte-level vocabulary; a very long text is
held whole by its task, beside its batch; repeated rows are encoded one by one; columns of any names are handed on, but those named
like an output (``out``) are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.common import arrow_limits, tidy
from threadlens.llm.places import unused
from threadlens.session import table

#: White space as the pattern's reference engines read ``\\s``; Python's own class has four control characters more.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed: the public pretoken pattern of this vocabulary, with its white space class spelled out.
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in vocabulary files: itself if visible, else the next free code point from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)}


class Bpe(dict):
    """Ids of pretokens: a mapping from a pretoken to its packed little-endian ids, computed when first asked."""

    def __init__(self, path: str, cache: int = 300_000):
        super().__init__()
        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        vocab = spec["model"]["vocab"]
        self.cache, self.old = cache // 2, {}
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.single = [vocab[letters[b]] for b in range(256)]
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.rank, self.info = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 16 | vocab[b]] = rank
            self.info.append((vocab[a], vocab[b], vocab[a + b]))
        #: (rank << 32) of two bytes side by side, -1 where they don't merge
        self.first = [self.rank.get(a << 16 | b, -1) for a in self.single for b in self.single]
        self.first = [r << 32 if r >= 0 else -1 for r in self.first]
        self.find = regex.compile(PRETOKEN).findall
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None

    def merged(self, word: bytes) -> list[int]:
        """Ids of one pretoken's bytes. Heap entries are rank << 32 | position; the list ends in a symbol that pairs with none."""
        single, first, info, rank, pop, push = self.single, self.first, self.info, self.rank.get, heapq.heappop, heapq.heappush
        ids = [single[b] for b in word]
        n = len(ids)
        ids.append(-1)
        left, right = list(range(-1, n)), list(range(1, n + 2))
        heap = [r | i for i, r in enumerate([first[a << 8 | b] for a, b in zip(word, word[1:])]) if r >= 0]
        heapq.heapify(heap)
        while heap:
            entry = pop(heap)
            i = entry & 0xFFFFFFFF
            a, b, new = info[entry >> 32]
            j = right[i]
            if ids[i] != a or ids[j] != b:
                continue  # stale: one of the two symbols has merged since
            ids[i] = new
            ids[j] = -1
            k = right[i] = right[j]
            left[k] = i
            if (r := rank(new << 16 | ids[k])) is not None:
                push(heap, r << 32 | i)
            h = left[i]
            if (r := rank(ids[h] << 16 | new)) is not None:
                push(heap, r << 32 | h)
        return [x for x in ids if x >= 0]

    def __missing__(self, word: str) -> bytes:
        packed = self.old.get(word)
        if packed is None:
            packed = array("I", self.merged(word.encode())).tobytes()
        if len(word) <= 64:
            if len(self) >= self.cache:
                self.old = dict(self)
                self.clear()
            self[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Packed little-endian unsigned 32-bit ids of a whole text."""
        if self.split is None or not any(s in text for s in self.added):
            return b"".join(map(self.__getitem__, self.find(text)))
        out = []
        for part in self.split(text):
            out.append(np.array([self.added[part]], "<u4").tobytes() if part in self.added else b"".join(map(self.__getitem__, self.find(part))))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """One vocabulary a worker process."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file is on this machine (the same on every worker)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(df: DataFrame, text: str = "text", path: str | None = None, out: tuple[str, str] = ("ids", "decoded")) -> DataFrame:
    """``df`` with the ids (packed little-endian unsigned 32-bit) and the decoded text that they give back, in the columns ``out``."""
    names, where = [c for c in df.columns if c.lower() not in out], path
    arrow_limits(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(where or vocabulary())
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column(len(names)).to_pylist()]
            back = [bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(ids, pa.binary()), pa.array(back, pa.string())], names=[*names, *out])

    schema = df.select(*names).select("*", F.lit(b"").alias(out[0]), F.lit("").alias(out[1])).schema
    return df.select(*names, F.coalesce(F.col(text), F.lit("")).alias(*unused(names, "text"))).mapInArrow(tidy(run), schema)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and the decoded text of every document, as digests taken beside the encoding."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    arrow_limits(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary())
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1).to_pylist():
                ids = bpe.encode(t)
                back = bpe.decode(np.frombuffer(ids, "<u4").tolist())
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=names)

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
