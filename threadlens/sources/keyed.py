"""Tables that change by key: rows are replaced bucket by bucket, answers are stored under the hash of what was asked.

A keyed table lies in folders by a hash of its key. A change reads and writes the folders alone that its keys fall into; all other files stay
as they are. The new content of those folders is computed into a working table first and then put in their place (Spark's dynamic partition overwrite), so
a change that is applied again, or after a task was lost, gives the same table. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from threadlens.work import Workspace, remove

BUCKET, PREFIX = "bucket", "prefix"


def bucketed(rows: DataFrame, key: list[str], buckets: int) -> DataFrame:
    """``rows`` with the bucket that their key falls into."""
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))


def _put(rows: DataFrame, path: str, by: str, mode: str) -> None:
    """Write folders by ``by``; a large one in several files, as Spark rebalances them."""
    rows.hint("rebalance", by).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def created(rows: DataFrame, path: str, key: list[str], buckets: int = 64) -> None:
    """A new keyed table of ``rows``."""
    _put(bucketed(rows, key, buckets), path, BUCKET, "errorifexists")


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields]).add(BUCKET, "integer")).parquet(path)


def replaced(spark: SparkSession, path: str, schema: StructType, key: list[str], rows: DataFrame, gone: DataFrame | None = None, buckets: int = 64) -> list[int]:
    """Put ``rows`` in the place of all rows of their keys and of the keys of ``gone``; the buckets that changed.

    With ``gone`` a key may lose rows without getting any, as when a document's revision no longer names an identifier. Null keys are keys like any other.
    """
    work = Workspace(spark, "replaced")
    keys = rows.select(*key) if gone is None else rows.select(*key).unionByName(gone.select(*key))
    keys = work.keep(bucketed(keys.distinct(), key, buckets), "keys")
    touched = sorted(r[0] for r in keys.select(BUCKET).distinct().collect())  # at most as many as there are buckets
    if not touched:
        return []
    old = read(spark, path, schema).where(F.col(BUCKET).isin(touched))
    same = keys.select(BUCKET, *[F.col(c).alias(f"__{c}") for c in key])
    stay = old.join(same, [old[BUCKET] == same[BUCKET], *[old[c].eqNullSafe(same[f"__{c}"]) for c in key]], "left_anti")
    after = work.keep(stay.unionByName(bucketed(rows.select(*[f.name for f in schema.fields]), key, buckets)), "after")
    filled = {r[0] for r in after.select(BUCKET).distinct().collect()}
    _put(after, path, BUCKET, "overwrite")
    for b in touched:
        if b not in filled:
            remove(spark, f"{path}/{BUCKET}={b}")
    work.drop(keys, after)
    return touched


def upserted(spark: SparkSession, path: str, schema: StructType, key: list[str], rows: DataFrame, order: list, buckets: int = 64) -> list[int]:
    """INSERT ... ON CONFLICT DO UPDATE into a keyed table: of several new rows of a key the first in ``order`` is taken."""
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
    return replaced(spark, path, schema, key, first, buckets=buckets)


def answers(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Stored answers: ``schema`` begins with the hash (hexadecimal) of what was asked."""
    return spark.read.schema(StructType([*schema.fields]).add(PREFIX, "string")).parquet(path)


def stored(rows: DataFrame, path: str) -> None:
    """Add answers (hash, ...) in folders by the hash's first two digits."""
    _put(rows.withColumn(PREFIX, F.substring(rows.columns[0], 1, 2)), path, PREFIX, "append")


def known(spark: SparkSession, path: str, schema: StructType, asked: DataFrame) -> DataFrame:
    """The part of the stored answers that ``asked`` hashes can be in: only their folders are listed and read (at most 256)."""
    name = schema.fields[0].name
    folders = sorted(r[0] for r in asked.select(F.substring(name, 1, 2)).distinct().collect() if r[0] is not None)
    return answers(spark, path, schema).where(F.col(PREFIX).isin(folders)) if folders else answers(spark, path, schema).where("false")


def answered(spark: SparkSession, path: str, schema: StructType, asked: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """An answer for each distinct hash of ``asked`` (hash, ...): stored ones, and for the others those of ``ask``, which are stored.

    Nothing is asked where nothing is missing, equal inputs are asked once, and an input that is null has no answer.
    """
    name = schema.fields[0].name
    work = Workspace(spark, "answered")
    asked = work.keep(asked.where(F.col(name).isNotNull()).dropDuplicates([name]), "asked")
    have = known(spark, path, schema, asked)
    missing = work.keep(asked.join(have.select(name), name, "left_anti"), "missing")
    if not missing.isEmpty():
        new = work.keep(ask(missing).select(*[f.name for f in schema.fields]), "new")
        stored(new, path)
    return known(spark, path, schema, asked).join(asked.select(name), name, "left_semi").drop(PREFIX)
