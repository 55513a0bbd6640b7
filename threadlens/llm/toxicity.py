"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

A text's severity y in 0..G-1 follows P(y <= g) = logistic(threshold_g - w.x): one weight vector shared by all thresholds, which
are kept in order at every step. Features are words and their beginnings (``PREFIXES``)
hashed into ``2 ** bits`` places, each with its square-rooted count over the text's length term, weighted by rarity in the
training rows. Weights are fitted by proximal accelerated gradient descent with a fixed number of steps and a sparsity
penalty, on a sample of about 8000 labelled ids (``sampled``), the ones with the smallest hashes, one text each; every row is
scored, over its whole text. Fitted are places that stand in ``floor`` sampled rows at least and with
grades above 0, or apart from them, more surely than the luckiest of so many places would by chance (``evidence``), at most the ``screened`` surest: about
six toxic rows where a tenth is toxic, however large the sample. What is
broadcast is the weights, of a size that ``bits`` fixes.

Labels of 0 and 1 become three grades by the evidence in the texts (``graded``): 0 for clean rows, and for toxic ones 1 or 2 by how much of
the text the words are that mark toxic rows of the sample.

Expected severity is the sum over thresholds of P(y > g); a text is flagged where the chance of any grade above 0 is at least 0.5.

Defined cases: a null or empty text has no feature, its severity is that of the thresholds alone; labels that are null are
left out; an id labelled several times has its highest label, and an id of several rows teaches with one of them; if all sampled rows have
one grade, every text gets that grade; equal texts get equal severities; repeated rows are scored one by one; a very long text
is one block of its own; columns of any names are handed on, but those named like an output are replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.common import arrow_limits, blocks, mix, text_views, tidy, word_hashes, word_spans
from threadlens.llm.places import unused
from threadlens.session import table

BITS = 18
#: Bytes of the beginnings of words that are features.
PREFIXES = (5, 7, 9)


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, value) of a block's sparse features: words and their beginnings, each with the root of its count."""
    s, e, w = word_spans(data, offsets)
    owner = np.repeat(np.arange(len(w) - 1), np.diff(w))
    owners, hashes = [owner], [word_hashes(data, s, e)]
    for n in PREFIXES:
        long_ = e - s > n
        owners.append(owner[long_])
        hashes.append(word_hashes(data, s[long_], s[long_] + n) ^ mix(np.array([n], np.uint64)))
    place = (mix(np.concatenate(hashes)) >> np.uint64(64 - bits)).astype(np.int64)
    kinds, n = np.unique(np.concatenate(owners) << bits | place, return_counts=True)
    return kinds >> bits, kinds & ((1 << bits) - 1), np.sqrt(n)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def evidence(row: np.ndarray, at: np.ndarray, high: np.ndarray, places: int) -> np.ndarray:
    """How surely each place stands with the rows of ``high``, or apart from them: minus the log of a bound (Chernoff's) on the chance of so uneven a split."""
    yes, no = (np.bincount(at, high[row] == k, places) for k in (True, False))
    n, q = yes + no, np.clip(high.mean(), 1e-9, 1 - 1e-9)
    p = yes / np.maximum(1, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return n * (np.where(p > 0, p * np.log(p / q), 0) + np.where(p < 1, (1 - p) * np.log((1 - p) / (1 - q)), 0))


def loss_and_slopes(w: np.ndarray, theta: np.ndarray, row: np.ndarray, at: np.ndarray, x: np.ndarray, grade: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of the proportional-odds model, and its slopes by weights and thresholds."""
    n, grades = len(grade), len(theta) + 1
    cuts = np.concatenate([[-np.inf], theta, [np.inf]])
    z = np.bincount(row, x * w[at], n)
    up, low = cuts[grade + 1] - z, cuts[grade] - z
    fu, fl = np.where(np.isinf(up), 1.0, _sigmoid(np.where(np.isinf(up), 0, up))), np.where(np.isinf(low), 0.0, _sigmoid(np.where(np.isinf(low), 0, low)))
    du, dl, p = fu * (1 - fu), fl * (1 - fl), np.maximum(fu - fl, 1e-12)
    gw = np.bincount(at, x * ((du - dl) / p / n)[row], len(w))
    gc = np.bincount(np.minimum(grade, grades - 2), np.where(grade < grades - 1, -du / p / n, 0), grades - 1)
    gc += np.bincount(np.maximum(grade - 1, 0), np.where(grade > 0, dl / p / n, 0), grades - 1)
    return -np.log(p).mean(), gw, gc


def fit(row: np.ndarray, place: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, bits: int = BITS, steps: int = 300, sparsity: float = 3e-5, screened: int = 4096, floor: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the proportional-odds model by proximal accelerated gradient."""
    n = len(grade)
    used, at = np.unique(place, return_inverse=True)
    df = np.bincount(at, minlength=len(used))
    rarity = np.log((n + 1) / (df + 1)) * (df >= floor)
    x = value * rarity[at]
    norm = np.sqrt(np.bincount(row, x * x, n)) + 1e-9
    x = x / norm[row]
    scale = np.zeros(1 << bits, np.float32)
    scale[used] = rarity  # of all places: a text's norm is over all of them, when it is scored as when it teaches
    told = evidence(row, at, grade > 0, len(used)) * (df >= floor)
    strong = np.argsort(-told, kind="stable")[:screened]
    strong = strong[told[strong] > np.log(len(used) + 1)]
    to = np.full(len(used), -1)
    to[strong] = np.arange(len(strong))
    inside = to[at] >= 0
    row, x, at, used = row[inside], x[inside], to[at[inside]], used[strong]
    w, freq = np.zeros(len(used)), np.bincount(grade, minlength=grades) / n
    cum = np.clip(np.cumsum(freq)[:-1], 1e-4, 1 - 1e-4)

    def ordered(c: np.ndarray) -> np.ndarray:  # thresholds keep their order, a tenth apart at least
        return np.maximum.accumulate(c - 0.1 * np.arange(len(c))) + 0.1 * np.arange(len(c))

    theta = ordered(np.log(cum / (1 - cum)))
    u = np.ones(len(used))
    for _ in range(20):  # the largest curvature of the weights bounds their step; two blocks share the bound
        u /= np.linalg.norm(u) + 1e-30
        u = np.bincount(at, x * np.bincount(row, x * u[at], n)[row], len(used)).astype(float)
    rate = n / (np.linalg.norm(u) + 1e-30)
    # a threshold is moved by the rows of the two grades beside it alone, so its step is as much longer as they are few
    pace = 0.5 / np.maximum(freq[:-1] + freq[1:], 1e-3)
    v, tv, k, last = w.copy(), theta.copy(), 0, np.inf
    for _ in range(steps):
        loss, gw, gc = loss_and_slopes(v, tv, row, at, x, grade)
        new = v - rate * gw
        new = np.sign(new) * np.maximum(np.abs(new) - rate * sparsity, 0)
        newt = ordered(tv - pace * gc)
        loss += sparsity * np.abs(v).sum()
        k = 0 if loss > last else k + 1  # momentum starts anew when it overshoots
        last, m = loss, k / (k + 3)
        v, tv = new + m * (new - w), ordered(newt + m * (newt - theta))
        w, theta = new, newt
    weights = np.zeros(1 << bits, np.float32)
    weights[used] = w
    return np.stack([weights, scale]), theta


def graded(row: np.ndarray, place: np.ndarray, value: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades 0 to 2 of rows labelled 0 or 1: a toxic row is 2 if marking words make up as much of it, by the features' own weights, as of half of the toxic rows that have any.

    A place marks if it stands with toxic rows more surely than chance has it, and is 20 times as frequent in them as in clean ones.
    """
    n, places = len(toxic), place.max(initial=0) + 1
    yes, no = (np.bincount(place, toxic[row] == k, places) for k in (1, 0))
    sure = evidence(row, place, toxic == 1, places) > np.log(len(np.unique(place)) + 1)
    marks = sure & (yes / max(1, (toxic == 1).sum()) >= 20 * no / max(1, (toxic == 0).sum()))
    df = np.bincount(place, minlength=places)
    x = value * np.log((n + 1) / (df + 1))[place]
    dense = np.bincount(row, x * marks[place], n) / (np.sqrt(np.bincount(row, x * x, n)) + 1e-9)
    some = dense[(toxic == 1) & (dense > 0)]
    return np.where(toxic == 1, 1 + (dense >= np.median(some)) if len(some) else 1, 0)


def sampled(labels: DataFrame, most: int, label: str = "toxic") -> DataFrame:
    """About ``most`` ids of a label table with their highest label, those with the smallest id hashes; all ids if there are no more."""
    labels = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
    n = labels.count()
    return labels if n <= most else labels.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) < int(most / n * 2**63))


def without_copies(row: np.ndarray, place: np.ndarray, value: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sample without nearly all near copies of its rows, else chance words of a much-copied text would gain weight.

    A row goes if an earlier one has the same eight smallest-hash features, under any of 24 hash families: one of 0.8 of its features does with a chance of 0.99,
    one of 0.15 with a chance below 1e-5.
    """
    n = len(grade)
    filled = np.flatnonzero(np.bincount(row, minlength=n))
    at = np.searchsorted(row, filled)
    drop = np.zeros(n, bool)
    for family in range(24):
        low = [np.minimum.reduceat(mix(place.astype(np.uint64) + np.uint64(1 << 40) * np.uint64(8 * family + i + 1)), at) for i in range(8)]
        _, first = np.unique(np.stack(low, axis=1), axis=0, return_index=True)
        again = np.ones(len(filled), bool)
        again[first] = False
        drop[filled[again]] = True
    new = np.cumsum(~drop) - 1
    keep = ~drop[row]
    return new[row[keep]], place[keep], value[keep], grade[~drop]


def trained(labelled: DataFrame, text: str, grade: str, grades: int, bits: int = BITS, regrade: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Fit on a bounded frame of labelled rows; only their sparse features reach the driver. ``regrade`` makes grades of them and the labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_views(batch.column(1))
            for a, b in blocks(offsets):
                row, place, value = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits)
                at = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(at), x)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), lists(pa.array(place.astype(np.int32))), lists(pa.array(value.astype(np.float32)))], names=["grade", "h", "place", "value"])

    rows = labelled.where(F.col(grade).isNotNull()).select(F.col(grade).cast("int").alias("grade"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"), F.xxhash64("doc_id").alias("h"))
    got = rows.mapInArrow(tidy(run), "grade int, h long, place array<int>, value array<float>").toArrow().sort_by("h")
    grade_ = got["grade"].to_numpy().astype(np.int64)
    if len(np.unique(grade_)) < 2:
        only = int(grade_[0]) if len(grade_) else 0
        return np.zeros((2, 1 << bits), np.float32), np.array([-40.0 if g < only else 40.0 for g in range(grades - 1)])
    place, value = got["place"].combine_chunks(), got["value"].combine_chunks()
    n = np.array([len(x) for x in place])
    row, place, value = np.repeat(np.arange(len(n)), n), place.flatten().to_numpy(), value.flatten().to_numpy().astype(np.float64)
    row, place, value, grade_ = without_copies(row, place, value, grade_)
    return fit(row, place, value, regrade(row, place, value, grade_) if regrade else grade_, grades, bits)


def severity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", bits: int = BITS) -> DataFrame:
    """``docs`` with ``severity`` (expected grade) and ``p_any`` (chance of a grade above 0)."""
    kept = [c for c in docs.columns if c.lower() not in ("severity", "p_any")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (weights, rarity), cuts = shared.value
        for batch in batches:
            data, offsets = text_views(batch.column(len(kept)))
            for a, b in blocks(offsets):
                row, place, value = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits)
                x = value * rarity[place]
                norm = np.sqrt(np.bincount(row, x * x, b - a)) + 1e-9
                z = np.bincount(row, x * weights[place], b - a) / norm
                above = _sigmoid(z[:, None] - cuts[None, :])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(kept))), pa.array(above.sum(1)), pa.array(above[:, 0])], names=[*kept, "severity", "p_any"])

    rows = docs.select(*kept)
    schema = rows.select("*", F.lit(0.0).alias("severity"), F.lit(0.0).alias("p_any")).schema
    return docs.select(*kept, F.coalesce(F.col(text), F.lit("")).cast("binary").alias(*unused(kept, "text"))).mapInArrow(tidy(run), schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, learnt from the labelled ones."""
    arrow_limits(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    # the sample's bound is what makes the label side small enough to send to every task
    labelled = docs.join(F.broadcast(sampled(labels, 8000)), "doc_id").dropDuplicates(["doc_id"])
    model = trained(labelled, "text", "toxic", 3, regrade=graded)
    return severity(docs, model).select("doc_id", "severity", F.col("p_any").alias("p_toxic"), (F.col("p_any") >= 0.5).alias("toxic"))
