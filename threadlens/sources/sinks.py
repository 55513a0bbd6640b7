"""Sinks: outbox batches under row and byte limits, notification texts, delivery outcomes, idempotent writes of micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.operators.chains import reached
from threadlens.sources.keyed import BUCKET, bucketed
from threadlens.work import Workspace

#: Fixed limits of one delivery and one notification.
BATCH_ROWS, BATCH_BYTES = 100, 1 << 20
NOTIFY_ITEMS, NOTIFY_POINTS = 5, 400


def outbox_batches(rows: DataFrame, key: str, order: list[str], size: str, most_rows: int = BATCH_ROWS, most_bytes: int = BATCH_BYTES) -> DataFrame:
    """``rows`` with ``batch``: in order, a new batch begins where a row would exceed the rows or bytes of the one before.

    Where a batch ends depends only on where it began: from each row a pointer goes to the first row that a batch from there can't hold, found by
    laying the rows' running bytes and each row's reach on one line per key. The rows reached from a key's first one begin its
    batches; they are marked by doubling: pointers of 1, 2, 4, ... batches are followed from all rows marked so far. A row
    above the bytes alone is a batch of its own; sizes aren't negative, null counts as 0. Ties of ``order`` go by the other columns.
    """
    work = Workspace(rows.sparkSession, "outbox")
    along = Window.partitionBy("__k").orderBy("__i")
    others = [c for c in rows.columns if c not in (*order, key)]
    line = rows.withColumn("__i", F.row_number().over(Window.partitionBy(key).orderBy(*order, *others)).cast("long"))
    line = work.keep(line.select(F.struct(key).alias("__k"), "__i", F.coalesce(F.col(size), F.lit(0)).cast("long").alias("__s"), F.struct(*[rows[c] for c in rows.columns]).alias("__row")), "line")
    ends = line.select("__k", "__i", F.sum("__s").over(along).alias("end"), "__s")
    # rows at their end, reaches at the end that still fits: the last row before a reach is the last that fits
    marks = ends.select("__k", F.col("end").alias("at"), F.lit(0).alias("kind"), "__i").unionByName(ends.select("__k", (F.col("end") - F.col("__s") + most_bytes).alias("at"), F.lit(1).alias("kind"), "__i"))
    fits = F.max(F.when(F.col("kind") == 0, F.col("__i"))).over(Window.partitionBy("__k").orderBy("at", "kind", "__i").rowsBetween(Window.unboundedPreceding, 0))
    reach = marks.withColumn("fits", fits).where("kind = 1").select("__k", "__i", F.least(F.col("__i") + most_rows, F.greatest(F.col("__i"), F.coalesce("fits", F.lit(0))) + 1).alias("to"))
    starts = reached(reach, line.where("__i = 1").select("__k", "__i"), work)
    begun = line.join(starts.withColumn("__b", F.lit(1)), ["__k", "__i"], "left")
    batch = F.count("__b").over(along) - 1
    return begun.select("__row", batch.alias("batch")).select("__row.*", "batch")


def notices(requests: DataFrame, evidence: DataFrame, related: DataFrame, items: int = NOTIFY_ITEMS, points: int = NOTIFY_POINTS) -> DataFrame:
    """(request_id, context): what is told about a finished request.

    ``requests``: request_id, status, outcome, error_code, truncated; ``evidence``: request_id, position, message_id, revision, text; ``related``: the same and source_kind. Blank
    texts are left out; of the related ones corrections come first, and what is beyond ``items`` is counted. Only excerpts of listed items are collected.
    """
    name = F.concat(F.lit("[message_id="), F.col("message_id"), F.lit(" revision="), F.col("revision"), F.lit("] "), F.substring("text", 1, points))
    said = lambda df: df.where(F.length(F.trim("text")) > 0)
    place = lambda *order: F.row_number().over(Window.partitionBy("request_id").orderBy(*order))
    lines = lambda c, where=F.lit(True): F.array_join(F.transform(F.array_sort(F.collect_list(F.when(where, F.struct("n", F.col(c).alias("line"))))), lambda x: x["line"]), "\n")
    own = said(evidence).withColumn("n", place("position")).where(F.col("n") <= items).withColumn("line", F.concat(F.lit("- "), name))
    own = own.groupBy("request_id").agg(lines("line").alias("evidence"))
    fix = F.col("source_kind") == "correction"
    other = said(related).withColumn("n", place((~fix), "position"))
    counts = other.groupBy("request_id").agg(F.greatest(F.count("*") - items, F.lit(0)).alias("omitted"))
    other = other.where(F.col("n") <= items).withColumn("line", F.concat(F.lit("- "), F.col("source_kind"), F.lit(" "), name))
    other = other.groupBy("request_id").agg(lines("line", fix).alias("corrections"), lines("line", ~fix).alias("related"))
    met = requests.join(own, "request_id", "left").join(other, "request_id", "left").join(counts, "request_id", "left")
    head = F.concat(F.lit("request_id="), F.col("request_id"))
    part = lambda c: F.when(F.length(c) > 0, F.concat(F.lit(f"{c}:\n"), F.col(c)))
    found = F.concat_ws("\n", F.concat(head, F.lit(" outcome=matched")), part("corrections"), part("evidence"), part("related"), F.when(F.col("omitted") > 0, F.concat("omitted", F.lit(" related omitted"))), F.when(F.col("truncated"), "incomplete"))
    context = F.when(F.col("status") == "failed", F.concat(head, F.lit(" status=failed error_code="), F.col("error_code"))).when(F.col("status") != "completed", None).when(F.col("outcome") == "matched", found).otherwise(F.concat(head, F.lit(" outcome="), F.col("outcome")))
    return met.select("request_id", context.alias("context"))


def outcome(status: Column) -> Column:
    """What a delivery's HTTP status means: 202 acknowledged, 429 and 5xx to retry, all else permanent."""
    return F.when(status == 202, "acknowledged").when((status == 429) | status.between(500, 599), "retry").otherwise("permanent")


def appended_once(path: str, keys: list[str], buckets: int = 256):
    """A ``foreachBatch`` writer that adds each key once, so a batch that runs again changes nothing.

    The sink lies in folders by a hash of the key (column ``bucket``); a batch looks only into those that its keys fall into. One stream writes to a sink.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        work = Workspace(spark, "appended")
        rows = work.keep(bucketed(batch.dropDuplicates(keys), keys, buckets), "rows")
        touched = sorted(r[0] for r in rows.select(BUCKET).distinct().collect())  # at most as many as there are buckets
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        new = rows
        if touched and where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            new = rows.join(spark.read.schema(rows.schema).parquet(path).where(F.col(BUCKET).isin(touched)).select(*keys), keys, "left_anti")
        new.write.mode("append").partitionBy(BUCKET).parquet(path)
        work.drop(rows)

    return write
