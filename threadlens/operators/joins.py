"""Join operators: scopes, as-of, ranges, lateral tops, either-end edges; equi keys wherever the meaning allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inner_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi join; Spark broadcasts a side where its size, as measured, allows it."""
    return left.join(right, keys)


def asof_latest(rows: DataFrame, requests: DataFrame, key: str, at: str, request_at: str, created: str) -> DataFrame:
    """For each row the latest request of its key strictly before it; conditions on the request apply to that one only.

    Rows and requests are laid on one line per key and the latest request is carried forward, so a key costs one sort
    and no pair of a row with all its earlier requests is ever made.
    """
    carried = [c for c in requests.columns if c != key]
    line = Window.partitionBy(key).orderBy("__at", "__kind", "__created").rowsBetween(Window.unboundedPreceding, 0)
    a = rows.select(F.col(key), F.col(at).alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast(dict(requests.dtypes)[created]).alias("__created"), F.struct(*rows.columns).alias("__row"), F.lit(None).cast(requests.select(F.struct(*carried).alias("r")).schema["r"].dataType).alias("__request"))
    b = requests.select(F.col(key), F.col(request_at).alias("__at"), F.lit(1).alias("__kind"), F.col(created).alias("__created"), F.lit(None).cast(rows.select(F.struct(*rows.columns).alias("r")).schema["r"].dataType).alias("__row"), F.struct(*carried).alias("__request"))
    seen = a.unionByName(b).withColumn("__near", F.last("__request", ignorenulls=True).over(line)).where("__row IS NOT NULL")
    return seen.select("__row.*", *[F.col(f"__near.{c}").alias(f"near_{c}") for c in carried])


def within_range(rows: DataFrame, others: DataFrame, key: str, at: str, reach: int) -> DataFrame:
    """Pairs of a row and the others of its key whose number is within ``reach`` of the row's: by equi join on each number."""
    spread = rows.withColumn("near_no", F.explode(F.sequence(F.col(at) - reach, F.col(at) + reach)))
    o = others.select(F.col(key), F.col(at).alias("near_no"), *[F.col(c).alias(f"near_{c}") for c in others.columns if c not in (key, at)])
    return spread.join(o, [key, "near_no"])


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key in order, numbered from 1. The window's group limit cuts before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def either_end(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges seen from both ends: (node, other, ...), so that an OR condition becomes one equi join."""
    rest = [c for c in edges.columns if c not in (a, b)]
    one = edges.select(F.col(a).alias("node"), F.col(b).alias("other"), *rest)
    return one.unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"), *rest))


def pre_aggregated(rows: DataFrame, details: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Each row with the ordered array of its details, empty where there are none: aggregated before the join."""
    kept = [c for c in details.columns if c != key]
    lists = details.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in kept if c not in order]))).alias(name))
    kind = lists.schema[name].dataType
    return rows.join(lists, key, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))


def updated_from(target: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """UPDATE ... FROM: the columns of ``changes`` replace those of the rows it matches."""
    new = [c for c in changes.columns if c not in key]
    marked = changes.select(*key, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in new])
    met = target.join(marked, key, "left")
    return met.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in target.columns])


def deleted_using(target: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """DELETE ... USING: the rows without a match."""
    return target.join(keys.select(*on).distinct(), on, "left_anti")


def upserted(target: DataFrame, rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """INSERT ... ON CONFLICT DO UPDATE: the last of the new rows of a key replaces the old one."""
    last = top_per_key(rows, key, order, 1, "__n").drop("__n")
    return target.join(last.select(*key), key, "left_anti").unionByName(last)


def inserted_once(target: DataFrame, rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """INSERT ... ON CONFLICT DO NOTHING: old rows stay, of several new ones of a key the first is taken."""
    first = top_per_key(rows, key, order, 1, "__n").drop("__n")
    return target.unionByName(first.join(target.select(*key), key, "left_anti"))


def previous(rows: DataFrame, keys: list[str], order: str, n: int, columns: list[str]) -> DataFrame:
    """``rows`` once for each of the ``n`` rows before them in ``order`` (which differs within a key), with their ``columns`` in place of their own, and ``rank``, 1 the nearest.

    One sort per key and as many lags; a row never meets more than ``n`` others.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.array(*[F.struct(F.lit(i).alias("rank"), *[F.lag(c, i).over(w).alias(c) for c in columns], F.lag(F.lit(True), i, False).over(w).alias("__met")) for i in range(1, n + 1)])
    met = rows.withColumn("__before", F.filter(before, lambda b: b["__met"])).select(*[c for c in rows.columns if c not in columns], F.inline("__before"))
    return met.drop("__met")
