"""Aggregates: counts, discrete percentiles, roll-ups of per-part judgments, ranks fused over routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed orders: what a text is kept for, and how far a statement is confirmed.
RETENTION = ("substantive", "decision_signal", "unknown", "progress_only")
STATUS = ("unknown", "proposal", "reported_completed", "reported_verified")
RRF_K = 60


def rank_of(value: Column, order: tuple[str, ...], missing: int = 0) -> Column:
    """Position of a value in a fixed order."""
    out = F.lit(missing)
    for i, name in enumerate(order):
        out = F.when(value == name, i).otherwise(out)
    return out


def percentile(fraction: float, column: str) -> Column:
    """The smallest value that at least this fraction of the values doesn't exceed."""
    return F.expr(f"percentile_disc({fraction}) WITHIN GROUP (ORDER BY {column})")


def nearest_rank(fraction: float, column: str) -> Column:
    """Value number ceil(fraction * n) in order, to three decimals: an exact counter of values, so memory follows distinct values."""
    return F.round(F.expr(f"percentile_disc({fraction}) WITHIN GROUP (ORDER BY {column})"), 3)


def percentiles(df: DataFrame, keys: list[str], column: str, fraction: float, name: str, bins: int = 1024) -> DataFrame:
    """(keys, ``name``): exactly what ``percentile`` says, of groups of any size, nulls left out.

    Three small aggregates: the range of each group, how many values lie in each of its bins, and the distinct values with their counts in the one
    bin that holds the wanted rank. So a task holds the values of a bin at most, and each once.
    """
    rows = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("__v"))
    ends = rows.groupBy(*keys).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.count("*").alias("__n"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    met = lambda a, b, *more: a.alias("a").join(b.alias("b"), [*same, *more]) if keys or more else a.alias("a").crossJoin(b.alias("b"))
    low, high = F.col("b.__low").cast("double"), F.col("b.__high").cast("double")
    place = F.when(high == low, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("a.__v").cast("double") - low) / (high - low) * bins)))
    binned = met(rows, ends).select(*[F.col(f"a.{k}").alias(k) for k in keys], "a.__v", place.cast("int").alias("__bin"), "b.__n")
    counts = binned.groupBy(*keys, "__bin", "__n").agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__bin"))
    want = F.greatest(F.lit(1), F.ceil(F.lit(fraction) * F.col("__n")))
    there = counts.withColumn("__to", upto).withColumn("__want", want).where((F.col("__to") >= F.col("__want")) & (F.col("__to") - F.col("__c") < F.col("__want")))
    there = there.select(*keys, "__bin", (F.col("__want") - F.col("__to") + F.col("__c")).alias("__left"))
    values = met(binned, there, F.col("a.__bin") == F.col("b.__bin")).groupBy(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.__v").alias("__v"), F.col("b.__left").alias("__left")).agg(F.count("*").alias("__c"))
    reached = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__v"))
    return values.withColumn("__to", reached).where(F.col("__to") >= F.col("__left")).groupBy(*keys).agg(F.min("__v").alias(name))


def recent(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The latest ``n`` rows."""
    return df.orderBy(*order).limit(n)


def strongest(value: Column, order: tuple[str, ...] = STATUS) -> Column:
    """The value that stands last in the order; unknown values count as the first."""
    return F.element_at(F.array(*[F.lit(v) for v in order]), F.max(rank_of(value, order)) + 1)


def priority(value: Column, order: tuple[str, ...] = RETENTION) -> Column:
    """The value that stands first in the order."""
    return F.element_at(F.array(*[F.lit(v) for v in order]), F.min(rank_of(value, order, len(order) - 1)) + 1)


def unanimous(value: Column) -> Column:
    """The value on which all agree, else ``unknown``."""
    same = (F.min(value) == F.max(value)) & (F.count(value) == F.count(F.lit(1)))
    return F.when(same, F.min(value)).otherwise("unknown")


def all_yes(value: Column) -> Column:
    return F.coalesce((F.count(F.lit(1)) > 0) & F.bool_and(F.coalesce(value == "yes", F.lit(False))), F.lit(False))


def strategy_terms(axis: Column, choice: Column) -> Column:
    """Sorted distinct ``axis:choice`` terms, without the choices that say nothing."""
    return F.array_sort(F.collect_set(F.when(~choice.isin("none", "unknown"), F.concat_ws(":", axis, choice))))


def in_first_order(position: Column, value: Column) -> Column:
    """Distinct values in the order in which they first appear."""
    seen = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(position.alias("p"), value.alias("v")))))
    return F.array_distinct(F.transform(seen, lambda x: x["v"]))


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def rrf(routes: DataFrame, key: list[str]) -> DataFrame:
    """Reciprocal-rank fusion of (key, document_id, route, chunk, rank): score, whether an identifier matched, kinds and the best chunk."""
    return routes.groupBy(*key, "document_id").agg(
        F.sum(1 / (RRF_K + F.col("rank"))).alias("rrf"),
        F.bool_or(F.col("route") == "entity").alias("entity_matched"),
        F.array_sort(F.collect_set("route")).alias("kinds"),
        F.min(F.when(F.col("chunk").isNotNull(), F.struct("rank", "chunk")))["chunk"].alias("query_chunk"),
    )


def message_rollup(parts: DataFrame) -> DataFrame:
    """Judgments of a message's parts as one analysis row, in one aggregation.

    Columns: message_id, part, retention, status, action, searchable, same_conditions.
    """
    return parts.groupBy("message_id").agg(
        priority(F.col("retention")).alias("retention_category"),
        unanimous(F.col("status")).alias("statement_status"),
        unanimous(F.col("action")).alias("decision_action"),
        F.bool_or("searchable").alias("is_searchable"),
        all_yes(F.col("same_conditions")).alias("same_conditions"),
        in_first_order(F.col("part"), F.col("model")).alias("response_models"),
    )
