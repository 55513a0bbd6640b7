"""Periodic runs of words, found on a harmonic grid with suffix arrays, and texts without their repetitions.

A run is a stretch of words with smallest period q, at least ``times`` * q and ``least`` words long, that no neighbouring word
extends. For each period p the grid are the words 0, p, 2p, ...; a run of period p holds two grid points side by side, jp and
(j+1)p, and from them it reaches as far forwards and backwards as the text agrees with itself p words on. Both reaches are
longest common extensions (LCE): the smallest entry between two suffixes in the LCP array of the suffix array, forwards, and of the
reversed array's, backwards, answered by a range-minimum index (RMQ). So a text of n words asks n/1 + n/2 + n/3 + ... times at most.

Three exact cuts keep that cheap. A run long enough holds ``max(least // p, times)`` grid points, which all carry the same word, so only
stretches of the grid with as many equal words are asked about; along a stretch the next question starts where the last reach ended; and
only texts with such a stretch get suffix arrays. The words of a text are numbered by a dictionary, so nothing rests on hashes.

A text is handled whole in one task, in memory proportional to its words; texts are independent, so nothing shuffles.

Defined cases: null counts as empty and has no run; its collapsed text is empty; texts shorter than ``least`` words have none; of a
text's runs with the same stretch only that of the smallest period exists; repeated rows are handled one by one; an empty table gives an
empty result; bytes that aren't UTF-8 come back as U+FFFD; columns of any names are handed on, but those named like an output are replaced.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.common import arrow_limits, blocks, text_views, tidy
from threadlens.llm.places import unused
from threadlens.session import table

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def suffix_array(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``a`` in order and their ranks, by doubling prefixes; only suffixes still tied are sorted again."""
    n = len(a)
    sa = np.argsort(a, kind="stable")
    at = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = a[sa[1:]] != a[sa[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, at, 0))
    tied, h = sa[~new | ~np.append(new[1:], True)], 1
    while len(tied):
        base = rank[tied]
        first = np.searchsorted(base, base, "left")  # tied suffixes are in the order of their groups
        spots = base + np.arange(len(tied)) - first
        after = tied + h
        next_ = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(base * (n + 1) + next_, kind="stable")
        tied, base, next_ = tied[order], base[order], next_[order]
        sa[spots] = tied
        new = np.ones(len(tied), bool)
        new[1:] = (base[1:] != base[:-1]) | (next_[1:] != next_[:-1])
        rank[tied] = np.maximum.accumulate(np.where(new, spots, 0))
        tied = tied[~new | ~np.append(new[1:], True)]
        h *= 2
    return sa, rank


def common_prefixes(a: np.ndarray, sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Entry r: how many symbols the suffixes of ranks r - 1 and r share. One pass over the text; the length falls by one at most."""
    n, h = len(a), 0
    text, order, place, out = (array("i", x.astype(np.int32).tobytes()) for x in (np.append(a, -1), sa, rank, np.zeros(n)))
    for i in range(n):
        r = place[i]
        if r:
            j = order[r - 1]
            while text[i + h] == text[j + h]:
                h += 1
            out[r] = h
            h -= h > 0
        else:
            h = 0
    return np.frombuffer(out, np.int32)


class Minima:
    """Smallest entries of ranges: prefixes and suffixes of small blocks, and a doubling table over the blocks."""

    SIZE = 32

    def __init__(self, a: np.ndarray):
        self.a = np.full(max(1, -(-len(a) // self.SIZE)) * self.SIZE, np.iinfo(np.int32).max, np.int32)
        self.a[: len(a)] = a
        rows = self.a.reshape(-1, self.SIZE)
        self.head = np.minimum.accumulate(rows, axis=1).ravel()
        self.tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [rows.min(axis=1)]
        while len(last := self.levels[-1]) > (step := 1 << len(self.levels) - 1):
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of entries lo to hi, both included."""
        a, b = lo // self.SIZE, hi // self.SIZE
        out = np.minimum(self.tail[lo], self.head[hi])
        near = np.flatnonzero(a == b)
        if len(near):
            left, right = lo[near], hi[near]
            least = self.a[right]
            for step in range(min(self.SIZE, int((right - left).max()) + 1)):
                least = np.minimum(least, self.a[np.minimum(left + step, right)])
            out[near] = least
        wide = np.flatnonzero(b - a > 1)
        if len(wide):
            width = (b - a)[wide] - 1
            k = np.frexp(width.astype(float))[1] - 1
            for level in np.unique(k):
                at = wide[k == level]
                out[at] = np.minimum(out[at], np.minimum(self.levels[level][a[at] + 1], self.levels[level][b[at] - (1 << int(level))]))
        return out


class Extensions:
    """How far two positions of a text agree, forwards from them or backwards before them."""

    def __init__(self, a: np.ndarray):
        self.n, self.sides = len(a), []
        for side in (a, a[::-1]):
            sa, rank = suffix_array(side)
            self.sides.append((rank, Minima(common_prefixes(side, sa, rank))))

    def _lce(self, side: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        rank, minima = self.sides[side]
        return minima.between(np.minimum(rank[i], rank[j]) + 1, np.maximum(rank[i], rank[j])).astype(np.int64)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self._lce(0, i, j)

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out, inside = np.zeros(len(i), np.int64), (i > 0) & (j > 0)
        out[inside] = self._lce(1, self.n - i[inside], self.n - j[inside])
        return out


def stretches(words: np.ndarray, offsets: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, first, last): where on the grids enough equal words stand side by side for a run to be there.

    ``words`` are numbered apart in each text, so nothing is equal across texts; first and last are grid points that
    can begin such a row of equal words.
    """
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = offsets[:-1][order], lengths[order]
    down, out = -lengths, []
    for p in range(1, (int(lengths[0]) // times if len(lengths) else 0) + 1):
        need = max(least // p, times) - 1
        m = int(np.searchsorted(down, -max(least, times * p), "right"))
        if not m:
            break
        points = (lengths[:m] - 1) // p + 1
        if m == 1:
            grid = np.arange(starts[0], starts[0] + lengths[0], p)
        else:
            ends = np.cumsum(points)
            grid = np.repeat(starts[:m] - p * (ends - points), points) + p * np.arange(ends[-1])
        on = words[grid]
        same = np.flatnonzero(on[1:] == on[:-1])
        if len(same) < need:
            continue
        cut = np.flatnonzero(np.diff(same) > 1)
        first, last = same[np.append(0, cut + 1)], same[np.append(cut, len(same) - 1)]
        long = last - first >= need - 1
        first, last = grid[first[long]], grid[last[long] - need + 1]
        single = first == last  # a chance match, mostly: other words of the same stretch must agree too
        if need > 1 and single.any():
            fits = np.ones(len(first), bool)
            for r in {1 % p, p // 2, p - 1}:
                fits[single] &= words[first[single] + r] == words[first[single] + p + r]
            first, last = first[fits], last[fits]
        out.append((np.full(len(first), p), first, last))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def maximal_runs(words: np.ndarray, offsets: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows (text, start, length, period) in order of text, start, period; starts count from the text's first word."""
    none = np.zeros((0, 4), np.int64)
    p, at, last = stretches(words, offsets, least, times)
    if not len(p):
        return none
    # suffix arrays of the texts concerned alone
    texts, inverse = np.unique(np.searchsorted(offsets, at, "right") - 1, return_inverse=True)
    sizes = np.diff(offsets)[texts]
    base = np.concatenate([[0], np.cumsum(sizes)])
    a = np.concatenate([words[offsets[t] : offsets[t + 1]] for t in texts])
    move = (base[:-1] - offsets[texts])[inverse]
    at, last, lce, found = at + move, last + move, Extensions(a), []
    while len(at):
        end = at + p + lce.forward(at, at + p)
        start = at - lce.backward(at, at + p)
        good = end - start >= np.maximum(least, times * p)
        found.append(np.stack([start, end, p], axis=1)[good])
        # grid points up to a period before the end find the same run; two runs of one period overlap by less than it
        at = at + p * np.maximum(1, -(-(end - p + 1 - at) // p))
        left = at <= last
        p, at, last = p[left], at[left], last[left]
    rows = np.concatenate(found)
    if not len(rows):
        return none
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[keep]
    text = np.searchsorted(base, rows[:, 0], "right") - 1
    out = np.stack([texts[text], rows[:, 0] - base[text], rows[:, 1] - rows[:, 0], rows[:, 2]], axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words outside every run's repetitions, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs.tolist():
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def with_runs(df: DataFrame, text: str = "text", least: int = 24, times: int = 3, out: tuple[str, str] = ("runs", "collapsed")) -> DataFrame:
    """``df`` with the runs of each text (by start, then period) and the text without repetitions, in the columns ``out``."""
    if times < 2:
        raise ValueError("a run repeats at least twice")
    names = [c for c in df.columns if c.lower() not in out]
    arrow_limits(df.sparkSession)
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def block(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array]:
        words = [data[a:b].tobytes().split() for a, b in zip(offsets, offsets[1:])]  # of bytes, it splits at [\x20\x09-\x0D] alone
        number, ids = count(), []
        for w in words:
            if len(w) >= least:
                own = defaultdict(number.__next__)
                ids.append(np.fromiter(map(own.__getitem__, w), np.int64, len(w)))
        sizes = [len(w) if len(w) >= least else 0 for w in words]
        runs = maximal_runs(np.concatenate(ids) if ids else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), least, times)
        edges = np.searchsorted(runs[:, 0], np.arange(len(words) + 1))
        short = [collapsed(w, runs[a:b, 1:]).decode("utf-8", "replace") for w, a, b in zip(words, edges, edges[1:])]
        fields = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, i])) for i in (1, 2, 3)], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), fields), pa.array(short, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_views(batch.column(len(names)))
            for a, b in blocks(offsets):
                made = block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(names))), *made], names=[*names, *out])

    schema = df.select(*names).select("*", F.lit(None).cast(RUNS).alias(out[0]), F.lit("").alias(out[1])).schema
    return df.select(*names, F.coalesce(F.col(text), F.lit("")).cast("binary").alias(*unused(names, "text"))).mapInArrow(tidy(run), schema)


def repeated(doc_id: str, text: str):
    """The text in which every tenth document (by crc32 of its id) repeats itself from some word on."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    words = rf"filter(split(coalesce({text}, ''), '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
    made = f"""
        transform(transform(array(struct({words} AS w, crc32(cast(cast({doc_id} AS string) AS binary)) div 10 AS g)),
                s -> struct(s.w AS w, s.g % size(s.w) AS a, 1 + (size(s.w) - s.g % size(s.w)) div (3 + s.g % 8) AS p)),
            s -> array_join(transform(s.w, (x, i) -> if(i < s.a, x, element_at(s.w, cast(s.a + (i - s.a) % s.p + 1 AS int)))), ' '))[0]"""
    return F.when((h % 10 == 0) & F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.expr(made)).otherwise(F.col(text))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's whole text, a tenth of which repeat themselves by rule."""
    docs = table(spark, sf_dir, "documents").select("doc_id", repeated("doc_id", "text").alias("text"))
    found = with_runs(docs.select("doc_id", "text"))
    # exact fractions: a longer exponent is length * other period > other length * period
    best = F.expr("""reduce(runs, cast(null AS struct<start:bigint,length:bigint,period:bigint>), (b, r) ->
        if(b IS NULL OR cast(r.length AS decimal(19, 0)) * b.period > cast(b.length AS decimal(19, 0)) * r.period, r, b))""")
    listed = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
