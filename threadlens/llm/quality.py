"""Quality rules whose cutoffs are certified on labelled rows.

Each rule rejects a text whose measure is above a cutoff; the cutoffs that may be chosen are fixed beforehand. What is certified
is the verdict of all rules together, by fixed-sequence testing: every stratum has one path of 40 steps, each lowering one rule's
cutoff to its next value, so that the texts rejected only grow along it. The path comes from the rows that are not labelled good,
never from the good ones (``path``). Along it the labelled good rows that are rejected are counted, and as long as the exact
(Clopper-Pearson) upper bound of their rate, at confidence ``1 - delta / strata``, is within ``alpha``, the step is taken; the first
that is not ends the path. So with chance ``1 - delta`` the rules of every stratum falsely reject at most ``alpha`` of its good
texts that pass the base rules, texts being independent; the base rules are given and what they reject isn't certified. Of equal texts
(same words) labelled good, one counts, so copies don't tighten a bound; near copies still count as different texts.

``strata`` is the number of strata with at least ``log(delta) / log(1 - alpha)`` good rows, 149; smaller ones can certify nothing and
are not tested. Of k tested ones each needs ``log(delta / k) / log(1 - alpha)`` good rows, 217 for four, to certify a step without an error;
strata with fewer reject nothing. Measures are taken in one pass over the whole texts; what reaches the driver are counts per tested stratum,
rule and cutoff, one stratum for every 149 good rows at most, and the cutoffs are joined to the rows as a table.

Defined cases: a null text has no words; a null stratum is the stratum ``?``; unlabelled rows and labels of other values
certify nothing; an id labelled several times counts once, as good only if all its labels are; an empty table gives an empty result; a very
long text is one block of its own; a measure equal to its cutoff passes.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.common import arrow_limits, code_points, mix, over_text, per_text, word_hashes, word_spans
from threadlens.llm.places import unused
from threadlens.session import table
from threadlens.work import Workspace

WINDOW = 5
_WEIGHTS = np.random.Generator(np.random.PCG64(17)).integers(1, 2**62, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bangs", "n_echoes")


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOLS, SPACE, UPPER, BANG = _mask(b"#*$%&|<>"), _mask(b" \t\n\x0b\x0c\r"), _mask(bytes(range(65, 91))), _mask(b"!")

#: name -> (measure as SQL, cutoffs from the lowest); fixed before any label is seen.
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.05, 0.08, 0.1, 0.12, 0.15, 0.2, 0.3, 0.5)),
    "echoes": ("n_echoes / greatest(n_words, 1)", (0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3)),
    "shouting": ("n_upper / greatest(word_chars, 1)", (0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.7)),
    "bangs": ("n_bangs / greatest(n_words, 1)", (0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.0, 1.5)),
}


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All measures of a block of texts."""
    s, e, w = word_spans(data, offsets)
    n = np.diff(w)
    h = word_hashes(data, s, e, lower=False)
    owner = np.repeat(np.arange(len(n)), n)
    covered, echo = np.zeros(len(h), bool), np.zeros(len(h), bool)
    if len(h) > 1:
        echo[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    if len(h) >= WINDOW:
        m = len(h) - WINDOW + 1
        starts = np.flatnonzero(owner[:m] == owner[WINDOW - 1 :])
        rolled = sum(h[i : m + i] * _WEIGHTS[i] for i in range(WINDOW))[starts]
        rolled = mix(rolled ^ mix(owner[starts].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(rolled)
        same = rolled[order][1:] == rolled[order][:-1]
        again = np.zeros(len(starts), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        for i in range(WINDOW):
            covered[starts[again] + i] = True
    lines = np.zeros(len(n), np.int64)
    raw = data.tobytes()
    for i in np.flatnonzero(per_text(data == 10, offsets)):
        rows = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x and not x.isspace()]
        lines[i] = len(rows) - len(set(rows))
    spaces = per_text(SPACE[data], offsets)
    return {
        "n_words": n,
        "word_chars": code_points(data, offsets) - spaces,
        "n_symbols": per_text(SYMBOLS[data], offsets),
        "n_dup_lines": lines,
        "n_repeat_words": np.bincount(owner[covered], minlength=len(n)),
        "n_upper": per_text(UPPER[data], offsets),
        "n_bangs": per_text(BANG[data], offsets),
        "n_echoes": np.bincount(owner[echo], minlength=len(n)),
        "print": fingerprints(h, w),
    }


def fingerprints(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text's words in their order; 0 without words."""
    out = np.zeros(len(w) - 1, np.uint64)
    at = np.arange(len(h), dtype=np.uint64) - np.repeat(w[:-1], np.diff(w)).astype(np.uint64)
    some = np.flatnonzero(np.diff(w))
    if len(some):
        out[some] = np.add.reduceat(mix(h + mix(at + np.uint64(1))), w[:-1][some])
    return out.astype(np.int64)


def upper_bound(bad: int, n: int, delta: float) -> float:
    """The Clopper-Pearson upper bound of a rate, of which ``bad`` in ``n`` were seen, at confidence ``1 - delta``."""
    if bad >= n:
        return 1.0
    log_choose = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(bad + 1)]

    def tail(p: float) -> float:  # P(X <= bad)
        logs = [c + k * math.log(p) + (n - k) * math.log1p(-p) for k, c in enumerate(log_choose)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    low, high = bad / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mid < 1 and tail(mid) > delta else (low, mid)
    return high


def path(poor: dict[str, list[int]], other: dict[str, list[int]], n_other: int, alpha: float) -> list[tuple[str, int]]:
    """The steps (rule, index of its cutoff) of a stratum, from how many poor and other rows are above each cutoff.

    First come the steps that reject poor rows, those with the most for the other rows they reject in front; then those that reject
    none, by what they reject, since a step without use may not end the path before one with it. Others count as costs only as to order:
    junk among them moves a step back, never behind one without poor rows. Where no row is labelled poor, steps that hardly any
    row meets (together at most a quarter of ``alpha``) come first. A rule's steps keep their order.
    """
    at = {rule: len(cuts) for rule, (_, cuts) in RULES.items()}
    cheap = alpha * n_other / (4 * sum(at.values()))
    out = []
    while any(at.values()):
        best = None
        for rank, (rule, now) in enumerate(at.items()):
            gone = (poor[rule][now], other[rule][now]) if now < len(RULES[rule][1]) else (0, 0)
            for to in range(now - 1, -1, -1):
                gain, cost = poor[rule][to] - gone[0], other[rule][to] - gone[1]
                key = (gain == 0, -gain / (cost + 1), cost > cheap, cost, -to, rank)
                if best is None or key < best[0]:
                    best = (key, rule, to)
        _, rule, to = best
        out += [(rule, i) for i in range(at[rule] - 1, to - 1, -1)]
        at[rule] = to
    return out


def certified(good: DataFrame, stratum: Column, alpha: float = 0.02, delta: float = 0.05, others: DataFrame | None = None) -> dict[str, dict[str, float]]:
    """The cutoff of each rule in each stratum, from the measures of rows labelled good; a rule without one is left out.

    ``others`` are the measures of all other rows and whether they are labelled ``poor``; without them no rule goes first.
    """
    spark = good.sparkSession
    fewest = math.log(delta) / math.log1p(-alpha)
    sizes = {r["stratum"]: r["n"] for r in good.groupBy(stratum.alias("stratum")).agg(F.count("*").alias("n")).where(F.col("n") >= fewest).collect()}
    strata = sorted(sizes)
    if not strata:
        return {}
    own = in_table(spark, [{"stratum": s} for s in strata], "stratum string")
    above: dict[str, dict[str, tuple]] = {rule: {} for rule in RULES}
    n_others: dict[str, int] = {}
    if others is not None:
        counts = [
            F.sum(F.when((F.expr(m) > c) & (F.col("poor") == p), 1).otherwise(0)).alias(f"{rule}_{i}_{p}")
            for rule, (m, cuts) in RULES.items() for i, c in enumerate(cuts) for p in (True, False)
        ]
        rows = others.withColumn("stratum", stratum).join(own, "stratum", "left_semi")
        for r in rows.groupBy("stratum").agg(F.sum(F.when(F.col("poor"), 0).otherwise(1)).alias("n"), *counts).collect():
            n_others[r["stratum"]] = r["n"]
            for rule, (_, cuts) in RULES.items():
                above[rule][r["stratum"]] = tuple([r[f"{rule}_{i}_{p}"] for i in range(len(cuts))] for p in (True, False))
    none = {rule: ([0] * len(cuts), [0] * len(cuts)) for rule, (_, cuts) in RULES.items()}
    paths = {s: path(*({rule: above[rule].get(s, none[rule])[k] for rule in RULES} for k in (0, 1)), n_others.get(s, 0), alpha) for s in strata}
    # the step from which on a row is rejected: of each rule, the one to the loosest cutoff that the row is above
    steps = in_table(spark, [{"stratum": s, **{rule: [p.index((rule, i)) for i in range(len(cuts))] for rule, (_, cuts) in RULES.items()}} for s, p in paths.items()], "stratum string, " + ", ".join(f"{rule} array<int>" for rule in RULES))
    level = {rule: sum((F.expr(f"cast({measure} > {c} AS int)") for c in cuts), F.lit(0)) for rule, (measure, cuts) in RULES.items()}
    first = [F.when(level[rule] > 0, F.get(F.col(f"steps.{rule}"), level[rule] - 1)) for rule in RULES]
    rows = good.withColumn("stratum", stratum).alias("g").join(steps.alias("steps"), "stratum")
    counted = rows.groupBy("stratum", F.least(*first).alias("first")).count().collect()
    out: dict[str, dict[str, float]] = {}
    for s, steps_ in paths.items():
        bad = np.zeros(len(steps_), np.int64)
        for r in counted:
            if r["stratum"] == s and r["first"] is not None:
                bad[r["first"] :] += r["count"]
        fits = lambda i: bad[i] <= alpha * sizes[s] and upper_bound(int(bad[i]), sizes[s], delta / len(paths)) <= alpha  # noqa: E731, B023
        for rule, i in steps_[: bisect_left(range(len(steps_)), True, key=lambda i: not fits(i))]:  # noqa: B023
            out.setdefault(s, {})[rule] = RULES[rule][1][i]
    return out


def in_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Rows made on the driver as a frame without Python workers."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def judged(rows: DataFrame, cutoffs: dict[str, dict[str, float]], stratum: Column) -> DataFrame:
    """``rows`` with ``rule_failed``: above a certified cutoff of its stratum."""
    name, own, limit = unused(rows.columns, "stratum", "of", "limit")
    limits = in_table(rows.sparkSession, [{"stratum": s, **c} for s, c in cutoffs.items()], "stratum string, " + ", ".join(f"{rule} double" for rule in RULES))
    limits = limits.select(F.col("stratum").alias(own), F.struct(*RULES).alias(limit))
    failed = F.lit(False)
    for rule, (measure, _) in RULES.items():
        failed = failed | F.coalesce(F.expr(measure) > F.col(f"{limit}.{rule}"), F.lit(False))
    kept = [c for c in rows.columns if c.lower() != "rule_failed"]
    return rows.withColumn(name, stratum).join(limits, F.col(name) == F.col(own), "left").select(*kept, failed.alias("rule_failed"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document, and the verdict: base rules first, then cutoffs certified per language."""
    arrow_limits(spark)
    work = Workspace(spark, "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang"), "text")
    schema = "doc_id long, lang string, " + ", ".join(f"{m} long" for m in (*MEASURES, "print"))
    rows = work.keep(over_text(docs, "text", measures, schema, ["doc_id", "lang"]), "measures")
    rows = rows.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
    quality = table(spark, sf_dir, "labels").where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good, poor = quality.where("quality = 1").select("doc_id"), quality.where("quality = 0").select("doc_id", F.lit(True).alias("poor"))
    passed = rows.where("NOT base_failed")
    others = passed.join(good, "doc_id", "left_anti").join(poor, "doc_id", "left").fillna(False, ["poor"])
    cutoffs = certified(passed.join(good, "doc_id").dropDuplicates(["lang", "print", "n_words"]), F.col("lang"), others=others)
    return judged(rows, cutoffs, F.col("lang")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("rule_failed")).alias("kept")
    )
