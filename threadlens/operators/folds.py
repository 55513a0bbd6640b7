"""Ordered folds as rounds of windows and joins: budgets that skip, prefixes of distinct contents, collapse onto slots.

What such a fold decides about a row depends on what it decided before it, but never on all of it: a budget changes what fits
only by halves, and similar rows depend on similar rows alone. So each fold is a few rounds over all keys at once; no list of a key's
rows is ever built and nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.work import Workspace


#: Rounds of a budget between two looks at whether any row is still undecided.
TOGETHER = 4


def budgeted(rows: DataFrame, key: str, order: list[Column], tokens: str, budget: Column, limit: int) -> DataFrame:
    """``rows`` with ``verdict``: ``selected``, ``token_budget`` (skipped, later rows may fit) or ``limit`` (after the last place).

    ``budget``: tokens left for a key, constant within it. ``tokens`` aren't negative; a row without tokens never fits. Ties of
    ``order`` go by tokens, then by the row.

    A round looks at the undecided rows of a key that still fit what is left. Of those that take at most half of it all are selected, one after the
    other, up to the first that brings their sum above half; of the larger ones only the first that fits beside the smaller ones before it
    is selected. Whichever comes first ends the round, and what is left has halved: a budget of b is spent after log2(b) rounds at most.
    """
    work = Workspace(rows.sparkSession, "budget")
    first = Window.partitionBy(key).orderBy(*order, F.col(tokens), F.struct(*rows.columns))
    numbered = rows.select(F.struct(key).alias("__k"), F.row_number().over(first).alias("__i"), F.col(tokens).cast("long").alias("__t"), budget.cast("long").alias("__left"), F.struct(*[rows[c] for c in rows.columns]).alias("__row"))
    left, decided, open_ = numbered.withColumn("__done", F.lit(None).cast("boolean")), None, F.col("__done").isNull() & F.coalesce(F.col("__t") <= F.col("__left"), F.lit(False))
    while True:
        for _ in range(TOGETHER):
            left = _halved(left, open_)
        left = work.keep(left, "rounds")
        settled = left.where(~open_)
        decided = settled if decided is None else decided.unionByName(settled)
        left = left.where(open_)
        if left.isEmpty():
            break
    taken = F.coalesce(F.count(F.when(F.col("__done"), 1)).over(Window.partitionBy("__k").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    verdict = F.when(taken >= limit, "limit").when(F.coalesce("__done", F.lit(False)), "selected").otherwise("token_budget")
    return decided.select("__row", verdict.alias("verdict")).select("__row.*", "verdict")


def _halved(rows: DataFrame, open_: Column) -> DataFrame:
    """A round of ``budgeted``: ``__done`` of the rows it decides, and what is left."""
    t, left, along = F.col("__t"), F.col("__left"), Window.partitionBy("__k").orderBy("__i")
    small, large = open_ & (2 * t <= left), open_ & (2 * t > left)
    rows = rows.withColumn("__sum", F.coalesce(F.sum(F.when(small, t)).over(along.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    fits = large & (t <= left - F.col("__sum"))
    ends = fits | (small & (2 * F.col("__sum") > left))
    after = left - F.col("__sum") - F.when(fits, t).otherwise(0)
    rows = rows.withColumn("__end", F.min(F.when(ends, F.struct("__i", after.alias("left")))).over(Window.partitionBy("__k")))
    before = F.col("__end").isNull() | (F.col("__i") < F.col("__end.__i"))
    done = F.when(~open_, F.col("__done")).when(F.col("__i") == F.col("__end.__i"), True).when(before, small)
    # without an end all small ones were selected and no large one fits
    return rows.withColumns({"__done": done, "__left": F.coalesce("__end.left", "__left")}).select("__k", "__i", "__t", "__left", "__row", "__done")


def _directed(ranked: DataFrame, pairs: DataFrame, key: str, item: str, rank: str) -> DataFrame:
    """(__k, a, b): ``pairs`` among ``ranked`` rows, a the earlier one; ranks in place of items, each pair once. The key is in a struct, so that null is one, too."""
    at = ranked.select(F.struct(key).alias("__k"), F.col(item).alias("__x"), F.col(rank).alias("__r"))
    both = pairs.select(F.struct(key).alias("__k"), F.col("left").alias("__l"), F.col("right").alias("__m"))
    met = both.join(at.withColumnsRenamed({"__x": "__l", "__r": "__p"}), ["__k", "__l"]).join(at.withColumnsRenamed({"__x": "__m", "__r": "__q"}), ["__k", "__m"])
    return met.where("__p <> __q").select("__k", F.least("__p", "__q").alias("a"), F.greatest("__p", "__q").alias("b")).distinct()


def repeats(edges: DataFrame, work: Workspace) -> tuple[DataFrame, int]:
    """((__k, b): rows that repeat an earlier kept one, number of rounds) of similar pairs (__k, a earlier, b later).

    The kept rows are the first independent set in order. A round settles every row whose earlier similar rows are settled: it repeats
    if one of them is kept, and is kept if none is. The number of rounds is that of the longest chain of similar rows at most, not the number of rows.
    """
    edges = work.keep(edges, "edges")
    later, earlier = edges.select("__k", F.col("b").alias("r")).distinct(), edges.select("__k", F.col("a").alias("r")).distinct()
    state = later.withColumn("kept", F.lit(None).cast("boolean")).unionByName(earlier.join(later, ["__k", "r"], "left_anti").withColumn("kept", F.lit(True)))
    state, rounds = work.keep(state, "state"), 0
    while not state.where("kept is null").isEmpty():
        rounds += 1
        met = edges.join(state.select("__k", F.col("r").alias("a"), "kept"), ["__k", "a"]).groupBy("__k", F.col("b").alias("r")).agg(F.bool_or("kept").alias("some"), F.bool_or(F.col("kept").isNull()).alias("waits"))
        now = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("some"), False).when(~F.col("waits"), True)
        after = work.keep(state.join(met, ["__k", "r"], "left").select("__k", "r", now.alias("kept")), "state")
        work.drop(state)
        state = after
    return state.where("not kept").select("__k", F.col("r").alias("b")), rounds


def distinct_prefix(ranked: DataFrame, pairs: DataFrame, key: str, item: str, rank: str, limit: int) -> DataFrame:
    """The ranked rows before the one that would be content number ``limit + 1``; repeats of kept contents don't count.

    ``pairs``: (key, left, right), both orders not needed. A row repeats if it is similar to an earlier *representative*. Ranks differ within a key.
    """
    work = Workspace(ranked.sparkSession, "distinct-prefix")
    ranked = work.keep(ranked, "ranked")
    dropped, _ = repeats(_directed(ranked, pairs, key, item, rank), work)
    again = dropped.select("__k", F.col("b").alias("__b"), F.lit(True).alias("__a"))
    marked = ranked.withColumns({"__k": F.struct(key), "__b": F.col(rank)}).join(again, ["__k", "__b"], "left").withColumn("__again", F.coalesce("__a", F.lit(False)))
    contents = F.count(F.when(~F.col("__again"), 1)).over(Window.partitionBy(key).orderBy(rank))
    return marked.withColumn("__n", contents).where(F.col("__n") <= limit).select(*ranked.columns)


def collapsed(ordered: DataFrame, pairs: DataFrame, key: str, item: str) -> DataFrame:
    """Collapse similar candidates onto the slot of the one kept first: (key, slot, item).

    ``ordered``: key, item, rank, latest (time), secondary (rank), origins (items it derives from). A newcomer takes the slot
    if the kept one derives from it, or if it is newer, not more secondary, and doesn't derive from the kept one; later rows
    compare with the winner, and where several slots hold similar ones, with that of the first slot.

    A row meets the occupants among its earlier similar rows, and whether one of these still holds its slot then depends on the rows that would win
    against it. So a round settles all rows of which both are settled: the earlier similar rows, and what before the row itself wins against these.
    """
    work = Workspace(ordered.sparkSession, "collapse")
    rows = work.keep(ordered.select(F.struct(key).alias("__k"), F.col(item).alias("x"), F.col("rank").cast("long").alias("r"), "latest", "secondary", "origins"), "rows")
    near = work.keep(_directed(rows.select(f"__k.{key}", F.col("x").alias(item), F.col("r").alias("rank")), pairs, key, item, "rank"), "near")
    other = rows.select("__k", F.col("r").alias("p"), F.col("x").alias("px"), F.col("latest").alias("pl"), F.col("secondary").alias("ps"), F.col("origins").alias("po"))
    has = lambda a, x: F.coalesce(F.array_contains(a, F.col(x)), F.lit(False))
    wins = has("po", "x") | ((F.col("latest") > F.col("pl")) & (F.col("secondary") <= F.col("ps")) & ~has("origins", "px"))
    met = near.select("__k", F.col("b").alias("r"), F.col("a").alias("p")).join(rows.select("__k", "r", "x", "latest", "secondary", "origins"), ["__k", "r"]).join(other, ["__k", "p"])
    met = work.keep(met.select("__k", "r", "p", F.lit(True).alias("similar"), F.coalesce(wins, F.lit(False)).alias("wins")), "met")
    # what has to be settled before a row: its earlier similar rows, and what before it could take the slots of these
    takers = met.where("wins").select("__k", F.col("p").alias("m"), F.col("r").alias("p"))
    second = met.select("__k", "r", F.col("p").alias("m")).join(takers, ["__k", "m"]).where("p < r").select("__k", "r", "p", F.lit(False).alias("similar"), F.lit(False).alias("wins"))
    waits = work.keep(met.unionByName(second).groupBy("__k", "r", "p").agg(F.bool_or("similar").alias("similar"), F.bool_or("wins").alias("wins")), "waits")
    # of each row: settled or not, the rank of its slot's first row (null: not kept), and the row that has taken its slot
    waiting = waits.select("__k", "r").distinct().withColumn("w", F.lit(True))
    state = rows.select("__k", "r").join(waiting, ["__k", "r"], "left").select("__k", "r", F.col("w").isNull().alias("done"), F.when(F.col("w").isNull(), F.col("r")).alias("slot"), F.lit(None).cast("long").alias("by"))
    state = work.keep(state, "state")
    while not state.where("not done").isEmpty():
        holds = F.col("similar") & F.col("slot").isNotNull() & (F.col("by").isNull() | (F.col("by") > F.col("r")))  # an occupant at the row's time
        seen = waits.join(state.withColumnRenamed("r", "p"), ["__k", "p"]).groupBy("__k", "r").agg(F.bool_and("done").alias("ready"), F.min(F.when(holds, F.struct("slot", "p", "wins"))).alias("m"))
        now = state.where("not done").select("__k", "r").join(seen.where("ready"), ["__k", "r"]).select("__k", "r", F.lit(True).alias("d"), F.when(F.col("m").isNull(), F.col("r")).when(F.col("m.wins"), F.col("m.slot")).alias("s"), F.when(F.col("m.wins"), F.col("m.p")).alias("over"))
        # of the rows settled at once no two take one slot: the later one waits for the earlier
        both = now.select("__k", "r", "d", "s", F.lit(None).cast("long").alias("y")).unionByName(now.where("over is not null").select("__k", F.col("over").alias("r"), F.lit(False).alias("d"), F.lit(None).cast("long").alias("s"), F.col("r").alias("y")))
        both = both.groupBy("__k", "r").agg(F.bool_or("d").alias("d"), F.max("s").alias("s"), F.max("y").alias("y"))
        after = state.join(both, ["__k", "r"], "left").select("__k", "r", (F.col("done") | F.coalesce("d", F.lit(False))).alias("done"), F.coalesce("slot", "s").alias("slot"), F.coalesce("by", "y").alias("by"))
        after = work.keep(after, "state")
        work.drop(state)
        state = after
    kept = state.where("slot is not null and by is null").join(rows.select("__k", "r", "x"), ["__k", "r"])
    place = F.row_number().over(Window.partitionBy("__k").orderBy("slot"))
    return kept.select(f"__k.{key}", place.alias("slot"), F.col("x").alias(item))
