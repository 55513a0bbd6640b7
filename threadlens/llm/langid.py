"""Language identification by hyperdimensional letter n-grams.

Every letter has a random vector of ``dims`` signs, drawn from its code point. A trigram's vector binds (multiplies) its
letters' vectors, the first permuted twice and the second once; a text's vector bundles (adds) its trigrams' vectors. A
language's prototype bundles its training texts, each with the same weight, and all prototypes are centred by their mean.
A text gets the language whose prototype has the largest cosine with it; runs of other characters count as one gap.

Every text adds integers to its language's sum (its trigrams' vectors times a weight rounded once for the text), so sums don't depend on how
rows are partitioned; what reaches the driver and the tasks is one vector for each of the ``most`` languages with the most texts.

Defined cases: a null text or one without a letter is ``und`` with score 0; null languages teach nothing; with no training
text all are ``und``; equal cosines go to the language first in order; repeated rows are predicted one by one; a very long text
is one block of its own; columns of any names are handed on, but those named like an output (``out``) are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.common import arrow_limits, blocks, held, text_views, tidy
from threadlens.llm.places import unused
from threadlens.session import table

DIMS = 1024
UNIT = 1 << 24
#: Rows of dense trigram counts at once, and languages whose sums a task holds.
ROWS, HELD = 256, 512

_letters: np.ndarray | None = None
_vectors: dict[int, np.ndarray] = {}


def is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def letter_vectors(points: np.ndarray, dims: int) -> np.ndarray:
    """Sign vectors of code points (0: the gap), each from a generator keyed by the code point."""
    for p in points.tolist():
        if p not in _vectors or len(_vectors[p]) != dims:
            _vectors[p] = (np.random.Generator(np.random.Philox(key=[2024, p])).integers(0, 2, dims) * 2 - 1).astype(np.float32)
    out = np.stack([_vectors[p] for p in points.tolist()])
    if len(_vectors) > 20_000:
        _vectors.clear()
    return out


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each trigram occurrence, its kind, the kinds as code points) over a block of texts."""
    padded = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(padded), dtype=np.int32), [len(p) for p in padded])
    symbol = np.where(is_letter()[points], points, 0)
    keep = symbol != 0
    keep[1:] |= (symbol[:-1] != 0) | (owner[1:] != owner[:-1])
    keep[0] = True
    symbol, owner = symbol[keep], owner[keep]
    flag = np.zeros(0x110000, bool)
    flag[symbol] = True
    used = np.flatnonzero(flag)
    n = len(used)
    place = np.zeros(0x110000, np.int32)
    place[used] = np.arange(n)
    small = n**3 <= 1 << 21
    s = place[symbol].astype(np.int32 if small else np.int64)
    inside = owner[2:] == owner[:-2]
    code = ((s[:-2] * n + s[1:-1]) * n + s[2:])[inside]
    owner = owner[:-2][inside]
    if small:
        kinds = np.flatnonzero(np.bincount(code, minlength=1))
        at = np.zeros(n**3, np.int32)
        at[kinds] = np.arange(len(kinds))
        code = at[code]
    else:
        kinds, code = np.unique(code, return_inverse=True)
    return owner, code, used[np.stack([kinds // (n * n), kinds // n % n, kinds % n], axis=1)] if len(kinds) else np.zeros((0, 3), np.int64)


def bound(kinds: np.ndarray, dims: int) -> np.ndarray:
    """Vectors of trigram kinds."""
    used, at = np.unique(kinds, return_inverse=True)
    at = at.reshape(kinds.shape)
    base = letter_vectors(used, dims)
    return np.roll(base, 2, axis=1)[at[:, 0]] * np.roll(base, 1, axis=1)[at[:, 1]] * base[at[:, 2]]


def kind_steps(kinds: np.ndarray, step: int = 2048) -> Iterator[slice]:
    for i in range(0, len(kinds), step):
        yield slice(i, i + step)


def prototypes(docs: DataFrame, text: str, lang: str, dims: int = DIMS, most: int = 4096) -> tuple[list[str], np.ndarray]:
    """Languages in order and their centred prototypes of unit length, from every row of ``docs``; ``most`` bounds the number of languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs_all = batch.column(1).to_pylist()
            _, offsets = text_views(batch.column(0))
            for a, b in blocks(offsets, 1 << 20):
                owner, code, kinds = trigrams(batch.column(0).slice(a, b - a).to_pylist())
                names = sorted(set(langs_all[a:b]))
                if not len(kinds):
                    continue
                of = np.array([names.index(x) for x in langs_all[a:b]])
                weight = np.maximum(1, np.rint(UNIT / np.maximum(1, np.bincount(owner, minlength=b - a))))
                counts = np.bincount(of[owner] * len(kinds) + code, weight[owner], len(names) * len(kinds)).reshape(len(names), -1)
                for x in kind_steps(kinds):
                    part = counts[:, x] @ bound(kinds[x], dims).astype(np.float64)
                    for name, v in zip(names, part.astype(np.int64)):  # whole numbers below 2**53
                        sums[name] = sums[name] + v if name in sums else v
            if len(sums) > HELD:
                yield from out(sums)
                sums = {}
        yield from out(sums)

    def out(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([v.tolist()], pa.list_(pa.int64()))], names=["lang", "v"])

    taught = docs.where(F.col(lang).isNotNull()).select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(lang).cast("string").alias("lang"))
    sizes = taught.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most + 1).collect()
    if len(sizes) > most:
        taught = taught.where(F.col("lang").isin([r["lang"] for r in sizes[:most]]))
    got = taught.mapInArrow(tidy(run), "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v")).collect()
    names = sorted({r["lang"] for r in got})
    sums = np.zeros((len(names), dims))
    for r in got:
        sums[names.index(r["lang"]), r["i"]] = r["v"]
    norm = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    sums = norm(sums)
    return names, norm(sums - sums.mean(0)) if len(names) > 1 else sums


def identified(docs: DataFrame, names: list[str], protos: np.ndarray, text: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and the score (the largest cosine, at least 0)."""
    kept, dims = [c for c in docs.columns if c.lower() not in out], protos.shape[1]
    shared = docs.sparkSession.sparkContext.broadcast(protos.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            column = batch.column(len(kept))
            _, offsets = text_views(column)
            for a, b in blocks(offsets, 1 << 20):
                owner, code, kinds = trigrams(column.slice(a, b - a).to_pylist())
                pred, score = np.full(b - a, len(names)), np.zeros(b - a)
                if len(names) and len(kinds):
                    whole = np.zeros((b - a, dims), np.float32)
                    ends = np.searchsorted(owner, np.arange(0, b - a + ROWS, ROWS))
                    for x in kind_steps(kinds):
                        vectors, n = bound(kinds[x], dims), len(kinds[x])
                        for i, (u, v) in enumerate(zip(ends, ends[1:])):
                            o, c = owner[u:v] - i * ROWS, code[u:v]
                            if len(kinds) > n:
                                inside = (c >= x.start) & (c < x.start + n)
                                o, c = o[inside], c[inside] - x.start
                            rows = min(ROWS, b - a - i * ROWS)
                            whole[i * ROWS : i * ROWS + rows] += np.bincount(o * n + c, minlength=rows * n).reshape(rows, n).astype(np.float32) @ vectors
                    length = np.linalg.norm(whole, axis=1)
                    cos = (whole @ own.T) / np.maximum(length, 1e-12)[:, None]
                    some = np.bincount(owner, minlength=b - a) > 0
                    pred[some] = cos[some].argmax(1)
                    score[some] = np.clip(cos[some].max(1), 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(len(kept))), pa.array([[*names, "und"][i] for i in pred.tolist()], pa.string()), pa.array(score)],
                    names=[*kept, *out],
                )

    schema = docs.select(*kept).select("*", F.lit("").alias(out[0]), F.lit(0.0).alias(out[1])).schema
    return docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(*unused(kept, "text"))).mapInArrow(tidy(run), schema)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; ids whose crc32 leaves 2 (mod 4) teach nothing."""
    arrow_limits(spark)
    docs = table(spark, sf_dir, "documents")
    names, protos = prototypes(docs.where(~held("doc_id", 4, 2)).select("text", "lang"), "text", "lang")
    rows = docs.select("doc_id", held("doc_id", 4, 2).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return identified(rows, names, protos).select("doc_id", "held_out", "lang_pred", "score")
