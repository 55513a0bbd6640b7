"""Mixing sources to target weights with soft memberships, by DataFrame functions only.

A classifier learnt from a labelled table gives every document posterior chances of each domain, in two steps of naive Bayes over
binned measures (``TELLS``): toxic against the rest, by how many word beginnings of a lexicon the text holds and by its length; then good
against poor by the other measures. The lexicon (at most ``lexicon`` beginnings) comes from
a bounded sample of labelled rows; the bins' counts come from all labelled rows. Labels may be wrong: the lowest chance of a label that any combination
of its measures has, of those with ``anchor`` labelled rows at least, is taken for the rate of wrong ones and removed from all chances. All bins together form a profile, of which
there are at most ``PROFILES``, so the posteriors are a table of bounded size.

Rates: projected-gradient least squares finds nonnegative document rates r for which the expected tokens of each domain,
sum(r * tokens * posterior), match the targets. The objective is the squared norm of the domains' gaps in the metric W, the inverse of
sum(tokens^2 * posterior * posterior'), in which the step length 1 is always short enough. A document's rate moves by
tokens * posterior' W gap and is projected to ``0 <= r <= most``, with momentum that starts anew when the objective rises. Each
iteration is one distributed sum over all documents. Documents equal in tokens and posteriors take equal steps, so a step is computed once for all of them
(``test_mixing_steps_are_those_of_single_documents``). Iterations end when every gap is below ``near`` of all tokens or when 20 of
them lower the objective by less than ``flat`` of itself: then the targets can't be met with these posteriors and bounds, and
``gap``, the largest gap as a share of all tokens, says by how much they are missed.

No text is ever shuffled: measures are computed where a document is read, once; rates come to rows by their number or place.

Defined cases: null text counts as empty (no tokens; its rate stays 1, for nothing moves it); unlabelled documents are mixed like others;
a domain without labelled rows gets only the smoothed chance; with no labelled rows all domains are equally likely; repeated rows
count each time, a row labelled several times teaches several times; rows without an id, or with one and the same, are drawn each for itself
(by their number in their file); columns of any names are handed on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.places import AT, FILE, picked, placed, stored
from threadlens.session import table
from threadlens.work import Workspace

DOMAINS = ("good", "poor", "toxic")
BEGINNING = 9
#: Measures by the upper ends of their bins; one more bin above the last.
BINS = {
    "hits": (0.5, 1.5, 2.5),
    "distinct": (0.15, 0.35, 0.5),
    "symbols": (0.005, 0.02, 0.05),
    "upper": (0.05, 0.15, 0.4),
    "length": (8.5, 40.5, 150.5, 1000.5),
}
PROFILES = 4 * 4 * 4 * 4 * 5
#: What tells toxic texts from others, and good ones from poor ones.
TELLS = (("toxic", ("hits", "length")), ("poor", ("distinct", "symbols", "upper", "length")))
BLANK = r"[ \t\n\x0B\f\r]+"


def beginnings(text: Column) -> Column:
    return F.transform(F.split(F.lower(text), BLANK), lambda w: F.substring(w, 1, BEGINNING))


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "poor").when(quality == 1, "good")


def sampled(labels: DataFrame, most: int) -> DataFrame:
    labels = labels.where("doc_id IS NOT NULL").distinct()
    n = labels.count()
    return labels if n <= most else labels.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) < int(most / n * 2**63))


def learnt_lexicon(docs: DataFrame, labels: DataFrame, most: int = 8000, lexicon: int = 256) -> list[str]:
    """Word beginnings that mark toxic texts, from about ``most`` labelled rows."""
    # the sample's bound is what makes the label side small enough to send to every task
    rows = docs.join(F.broadcast(sampled(labels.where("domain IN ('good', 'toxic')"), most)), "doc_id")
    words = rows.select((F.col("domain") == "toxic").alias("toxic"), F.explode(F.array_distinct(beginnings(F.coalesce("text", F.lit(""))))).alias("w"))
    counts = words.groupBy("w").agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b"))
    marks = counts.where("length(w) >= 3 AND a >= 5 AND a >= 20 * b").orderBy(F.col("a").desc(), "w").limit(lexicon)
    return sorted(r["w"] for r in marks.collect())


def binned(docs: DataFrame, lexicon: list[str], text: str = "text") -> DataFrame:
    """``docs`` with ``__tokens`` and a column of bin numbers for each measure."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(F.lower(t), BLANK), lambda w: w != "")
    out = docs.withColumn("__words", words).withColumn("__tokens", F.size("__words"))
    n, chars = F.greatest(F.col("__tokens"), F.lit(1)), F.greatest(F.length(t), F.lit(1))
    marks = F.array(*[F.lit(w) for w in lexicon]) if lexicon else F.array().cast("array<string>")
    measures = {
        "hits": F.size(F.array_intersect(F.transform("__words", lambda w: F.substring(w, 1, BEGINNING)), marks)),
        "distinct": F.size(F.array_distinct("__words")) / n,
        "symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>!", ""))) / chars,
        "upper": (F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) / chars,
        "length": F.col("__tokens"),
    }
    for name, m in measures.items():
        out = out.withColumn(f"__{name}", sum((F.when(m > edge, 1).otherwise(0) for edge in BINS[name]), F.lit(0)))
    return out.drop("__words")


def posteriors(rows: DataFrame, labels: DataFrame, anchor: int = 200) -> DataFrame:
    """(bins, p_good, p_poor, p_toxic) of every profile in ``rows`` (doc_id, bins), from all labelled rows."""
    bins = [f"__{b}" for b in BINS]
    known = rows.join(labels, "doc_id").where("domain IS NOT NULL")
    profiles = rows.select(*bins).distinct()
    chances = {}
    for domain_, measures in TELLS:
        of = known if domain_ == "toxic" else known.where("domain <> 'toxic'")
        sums = [F.count_if(F.col("domain") == domain_).alias("yes"), F.count_if(F.col("domain") != domain_).alias("no")]
        cells = of.groupBy(*[f"__{m}" for m in measures]).agg(*sums).collect()  # at most PROFILES rows
        yes, no = (sum(r[k] for r in cells) for k in ("yes", "no"))
        prior = {"toxic": (1, 2), "poor": (1, 1)}[domain_]  # as if one row of each domain had been seen
        start, ratios = math.log((yes + prior[0]) / (no + prior[1])), {}
        for m in measures:
            size = len(BINS[m]) + 1
            seen = [[sum(r[k] for r in cells if r[f"__{m}"] == v) for v in range(size)] for k in ("yes", "no")]
            ratios[m] = [math.log((seen[0][v] + 0.5) / (yes + 0.5 * size)) - math.log((seen[1][v] + 0.5) / (no + 0.5 * size)) for v in range(size)]
        told = [1 / (1 + math.exp(-start - sum(ratios[m][r[f"__{m}"]] for m in measures))) for r in cells if r["yes"] + r["no"] >= anchor]
        wrong = min(told, default=0.0)
        odds = F.lit(start) + sum(F.element_at(F.array(*map(F.lit, ratios[m])), F.col(f"__{m}") + 1) for m in measures)
        chances[domain_] = F.greatest(F.lit(0.0), (1 / (1 + F.exp(-odds)) - wrong) / (1 - wrong))
    toxic, poor = chances["toxic"], chances["poor"]
    return profiles.select(*bins, ((1 - toxic) * (1 - poor)).alias("p_good"), ((1 - toxic) * poor).alias("p_poor"), toxic.alias("p_toxic"))


def solved(m: list[list[float]], b: list[float]) -> list[float]:
    """Solve a small symmetric system by elimination, with a ridge for directions that nothing moves."""
    n = len(b)
    ridge = 1e-9 * max(1e-12, max(m[i][i] for i in range(n)))
    a = [[m[i][j] + (ridge if i == j else 0) for j in range(n)] + [b[i]] for i in range(n)]
    for i in range(n):
        k = max(range(i, n), key=lambda r: abs(a[r][i]))
        a[i], a[k] = a[k], a[i]
        for r in range(i + 1, n):
            f = a[r][i] / a[i][i]
            a[r] = [x - f * y for x, y in zip(a[r], a[i])]
    x = [0.0] * n
    for i in reversed(range(n)):
        x[i] = (a[i][n] - sum(a[i][j] * x[j] for j in range(i + 1, n))) / a[i][i]
    return x


def rates(groups: DataFrame, work: Workspace, targets: dict[str, float] | None, shares: dict[str, float] | None = None, most: float | None = None, near: float = 1e-6, flat: float = 0.1, steps: int = 2000) -> tuple[DataFrame, float]:
    """``groups`` (tokens, posteriors, n documents each) with ``rate``, and the largest gap as a share of all tokens.

    ``targets`` are shares of all tokens, or ``shares`` are parts of what a domain holds by expectation.
    """
    p = [f"p_{d}" for d in DOMAINS]
    t, n = F.col("tokens").cast("double"), F.col("n").cast("double")
    weighted = [F.sum(n * t * F.col(c)) for c in p]
    held = [x or 0.0 for x in groups.agg(F.sum(n * t), *weighted, *[F.sum(n * t * t * F.col(a) * F.col(b)) for a in p for b in p]).first()]
    total, held, moments = held[0], held[1:4], held[4:]
    goal = [targets[d] * total for d in DOMAINS] if targets is not None else [h * shares[d] for h, d in zip(held, DOMAINS)]
    square = [moments[3 * i : 3 * i + 3] for i in range(3)]
    norm = lambda gap: sum(g * x for g, x in zip(gap, solved(square, gap)))
    now = kept = work.keep(groups.withColumn("rate", F.lit(1.0)).withColumn("ahead", F.lit(1.0)), "rates")
    at, best, since, momentum = [h - g for h, g in zip(held, goal)], None, 0, 0
    gap_ahead, last = at, norm(at)
    for step in range(1, steps + 1):
        if max(map(abs, at)) <= near * total:
            break
        if best is None or last < best * (1 - flat):
            best, since = last, 0
        elif (since := since + 1) >= 20:
            break
        # one step of every document from its point ahead, whose gap is known
        push = solved(square, gap_ahead)
        moved = F.greatest(F.lit(0.0), F.col("ahead") - t * sum(F.col(c) * F.lit(g) for c, g in zip(p, push)))
        moved = F.least(F.lit(most), moved) if most is not None else moved
        now = now.withColumn("next", moved)
        now = now.withColumn("ahead", F.col("next") + (F.col("next") - F.col("rate")) * F.lit(momentum / (momentum + 3.0)))
        now = now.withColumn("rate", F.col("next")).drop("next")
        if step % 5 == 0:  # cut the chain of rates now and then
            after = work.keep(now, "rates")
            work.drop(kept)
            kept = now = after
        got = [x or 0.0 for x in now.agg(*[F.sum(n * t * F.col(c) * F.col(r)) for r in ("rate", "ahead") for c in p]).first()]
        at, gap_ahead = [s - g for s, g in zip(got[:3], goal)], [s - g for s, g in zip(got[3:], goal)]
        if (value := norm(at)) > last:  # momentum overshot: go on from the rates themselves
            momentum, gap_ahead, now = 0, at, now.withColumn("ahead", F.col("rate"))
        else:
            momentum += 1
        last = value
    return work.keep(now.drop("ahead"), "rates"), max(map(abs, at)) / total if total else 0.0


def fitted(rows: DataFrame, labels: DataFrame, names: list[str], work: Workspace, targets: dict[str, float] | None = None, shares: dict[str, float] | None = None, most: float | None = None) -> tuple[DataFrame, float]:
    """(names, tokens, posteriors, rate) of every row of (doc_id, text, names), and the gap. ``labels``: (doc_id, domain)."""
    bins = [f"__{b}" for b in BINS]
    lexicon = learnt_lexicon(rows, labels)
    seen = work.keep(binned(rows, lexicon).select(*names, F.col("__tokens").alias("tokens"), *bins), "bins")
    chances = work.keep(posteriors(seen, labels), "profiles")
    groups = seen.groupBy("tokens", *bins).agg(F.count("*").alias("n")).join(F.broadcast(chances), bins)  # at most PROFILES rows
    found, gap = rates(work.keep(groups, "groups"), work, targets, shares, most)
    return seen.join(found.drop("n"), ["tokens", *bins]).drop(*bins), gap


def document_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], text: str = "text") -> DataFrame:
    """(doc_id, tokens, posteriors, rate, gap) of every row; ``targets`` are shares of the corpus's tokens."""
    out, gap = fitted(docs.select("doc_id", F.col(text).alias("text")), labels, ["doc_id"], Workspace(docs.sparkSession, "mixing"), targets)
    return out.withColumn("gap", F.lit(gap))


def draw(salt: str) -> Column:
    """A number from 0 to 1 of each placed row, by its id and its number in its file: rows without an id, or with one and the same, are drawn apart."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), "doc_id", AT), 11) / F.lit(float(2**53))


def thinned(docs: DataFrame, labels: DataFrame, shares: dict[str, float], text: str = "text") -> tuple[DataFrame, float]:
    """Whole rows of ``docs``, each kept with the chance of its rate (at most 1), and the gap; ``shares`` are parts of what each domain holds."""
    work = Workspace(docs.sparkSession, "mixing")
    docs = stored(docs, work)
    rows = placed(docs, "doc_id", F.col(text).alias("text"))
    out, gap = fitted(rows, labels, ["doc_id", FILE, AT], work, shares=shares, most=1.0)
    return picked(docs, out.where(draw("mix") >= F.col("rate")).select(FILE, AT), False, work), gap


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", domain(F.col("quality"), F.col("toxic")).alias("domain"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by which documents mix to token shares of 90 % good, 8 % poor and 2 % toxic at the corpus's own size."""
    work = Workspace(spark, "mixing")
    docs = placed(stored(table(spark, sf_dir, "documents").select("doc_id", "text"), work), "doc_id", "text")
    out, gap = fitted(docs, labelled(spark, sf_dir), ["doc_id", AT], work, {"good": 0.90, "poor": 0.08, "toxic": 0.02})
    out = out.withColumn("gap", F.lit(gap))
    copies = F.floor(F.col("rate") + draw("copies"))
    return out.select("doc_id", F.col("tokens").cast("long").alias("n_tokens"), *[f"p_{d}" for d in DOMAINS], "rate", copies.alias("copies"), "gap")
