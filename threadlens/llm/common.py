"""What several operators share: Arrow batches of text cut to size, and arrays over the bytes of a block."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one block holds, unless a single text is longer.
BLOCK_BYTES = 4 << 20

#: The separators of the word pattern: space and U+0009 to U+000D.
SPACES = b" \t\n\x0b\x0c\r"


def arrow_limits(spark: SparkSession) -> None:
    """Bound what an Arrow batch holds, so that very long texts don't meet in one: the same bounds for all operators, a session's lower ones stay.

    Spark reads them when a plan runs, so they hold for the session from then on; results don't depend on them.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def held(of: str, modulus: int, remainder: int):
    """crc32 of an id's decimal text, taken by a modulus."""
    return F.crc32(F.coalesce(F.col(of).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def tidy(run: Callable) -> Callable:
    """``run`` for a Python worker that lives on: what its arrays leave in the allocator goes back when a task ends."""

    def wrapped(batches):
        yield from run(batches)
        with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def text_views(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column, without a copy; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), o


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer text stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def over_text(df: DataFrame, text: str, f: Callable, schema: str, keep: list[str]) -> DataFrame:
    """``mapInArrow`` of ``f(bytes, offsets, rows) -> dict of columns`` over blocks of bounded bytes.

    ``keep`` names the columns handed on; ``f`` sees one block's bytes, its offsets from 0, and the row range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_views(batch.column(len(keep)))
            for a, b in blocks(offsets):
                out = f(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(a, b - a) for i in range(len(keep))] + [x if isinstance(x, pa.Array) else pa.array(x) for x in out.values()],
                    names=keep + list(out),
                )

    kept = [df[c] for c in keep]
    return df.select(*kept, F.coalesce(df[text], F.lit("")).cast("binary").alias("__text")).mapInArrow(tidy(run), schema)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
_BYTE = np.random.Generator(np.random.PCG64(20240601)).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER] * np.uint64(2) + np.uint64(1)
_BYTE_CASED = np.random.Generator(np.random.PCG64(20240601)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and each text's offset into them."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = ~IS_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, step: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process; A-Z count as a-z unless ``lower`` is false.

    Bytes are folded in one position of all words at a time, so the cost is that of the longest words only
    for those words; the tail of a word beyond 64 bytes goes through blake2b.
    """
    import hashlib

    table = _BYTE if lower else _BYTE_CASED
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), step):
        s, n = starts[a : a + step], (ends - starts)[a : a + step]
        h = np.full(len(s), 0x9E3779B97F4A7C15, np.uint64)
        short = (65 - np.minimum(n, 65)).astype(np.uint8)
        order = np.argsort(short, kind="stable")  # longest first, by counting: those still folding are a prefix
        so, ho = s[order], h
        alive = np.cumsum(np.bincount(short, minlength=66))[64::-1]  # words longer than 0, 1, ...
        left = alive[: min(64, int(n.max()) if len(n) else 0)]
        for j, m in enumerate(left):
            x = ho[:m]
            x ^= table[data[so[:m] + j]]
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(29)
        for i in range(int(alive[64])):
            tail = data[so[i] + 64 : so[i] + n[order[i]]]
            ho[i] ^= np.frombuffer(hashlib.blake2b((_LOWER[tail] if lower else tail).tobytes(), digest_size=8).digest(), np.uint64)[0]
        back = np.empty(len(s), np.uint64)
        back[order] = ho
        out[a : a + step] = mix(back + n.astype(np.uint64))
    return out


def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each text."""
    return per_text((data & 0xC0) != 0x80, offsets)


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text a mask selects."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[offsets])
