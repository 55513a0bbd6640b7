"""Incremental ingestion: idempotent receipts, the revision rule, revisions from changed hashes, build state; batch and stream.

The same functions decide in a batch and inside ``foreachBatch``; the stream only adds what it must remember.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadlens.operators.chains import reached
from threadlens.sources.sinks import appended_once
from threadlens.work import Workspace


def receipts(events: DataFrame, keys: list[str], body_hash: str, order: list[Column]) -> DataFrame:
    """``events`` with ``receipt``: stored (first of its key), repeated (same body), conflict (the key with another body)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.first(body_hash).over(w.rowsBetween(Window.unboundedPreceding, 0))
    n = F.row_number().over(w)
    return events.withColumn("receipt", F.when(n == 1, "stored").when(F.col(body_hash) == first, "repeated").otherwise("conflict"))


def revision_verdicts(events: DataFrame, message: str, revision: str, body_hash: str, arrival: str, identity: list[str] | None = None) -> DataFrame:
    """``events`` with ``verdict``: accepted if it is revision 1 of a new message or the one after the message's current revision, repeated if
    it equals the stored revision of its number, else conflict. Arrivals differ within a message.

    What conflicts is not stored, so a gap or another body changes nothing for later events. With ``identity`` an event conflicts, too, whose columns of
    these names differ from those that the message was stored with.

    The accepted events of a message are a chain: from its first revision 1 to the first later revision 2, from there to the first later
    revision 3, and so on. Each event points to the first later event of the next revision; ``chains.reached`` marks the chain.
    """
    work = Workspace(events.sparkSession, "revisions")
    of_id = F.struct(*[F.col(c) for c in identity]) if identity else F.lit(0)
    rows = events.select(F.struct(message).alias("__k"), F.col(arrival).cast("long").alias("__i"), F.col(revision).cast("long").alias("__r"), F.col(body_hash).alias("__b"), of_id.alias("__id"), F.struct(*[events[c] for c in events.columns]).alias("__row"))
    rows = work.keep(rows, "rows")
    first = work.keep(rows.where("__r = 1").groupBy("__k").agg(F.min("__i").alias("__first"), F.min_by("__id", "__i").alias("__own")), "first")
    met = rows.join(first, "__k", "left").withColumn("__fits", F.coalesce((F.col("__i") >= F.col("__first")) & F.col("__id").eqNullSafe(F.col("__own")), F.lit(False)))
    fit = met.where("__fits").select("__k", "__i", "__r")
    marks = fit.withColumn("at", F.col("__i")).unionByName(fit.select("__k", "__i", (F.col("__r") + 1).alias("__r"), F.lit(None).cast("long").alias("at")))
    later = Window.partitionBy("__k", "__r").orderBy(F.col("__i").desc()).rowsBetween(Window.unboundedPreceding, -1)
    pointers = marks.withColumn("to", F.min("at").over(later)).where("at is null and to is not null").select("__k", "__i", "to")
    chain = reached(pointers, first.select("__k", F.col("__first").alias("__i")), work)
    judged = met.join(chain.withColumn("__ok", F.lit(True)), ["__k", "__i"], "left")
    stored = F.last(F.when(F.col("__ok"), F.struct("__b")), ignorenulls=True).over(Window.partitionBy("__k", "__r").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1))
    same = F.col("__fits") & stored.isNotNull() & stored["__b"].eqNullSafe(F.col("__b"))
    return judged.withColumn("verdict", F.when(F.col("__ok"), "accepted").when(same, "repeated").otherwise("conflict")).select("__row.*", "verdict")


def collected_revisions(rows: DataFrame, message: str, body_hash: str, arrival: str) -> DataFrame:
    """``rows`` with ``revision``: a repeated hash is dropped, a changed one is the next revision."""
    w = Window.partitionBy(message).orderBy(arrival)
    changed = rows.withColumn("__new", F.coalesce(F.lag(body_hash).over(w) != F.col(body_hash), F.lit(True)).cast("int")).where("__new = 1")
    return changed.withColumn("revision", F.sum("__new").over(w)).drop("__new")


def next_run(attempts: Column, retry_after: Column, base: int = 30, cap: int = 3600) -> Column:
    """Seconds until a failed job runs again: exponential, never before the provider allows, at most an hour."""
    return F.least(F.lit(cap), F.greatest(base * F.pow(F.lit(2.0), F.least(attempts, F.lit(20))), F.coalesce(retry_after, F.lit(0)).cast("double")))


def send_backoff(failures: Column, base: int = 30, cap: int = 300) -> Column:
    return F.least(F.lit(float(cap)), base * F.pow(F.lit(2.0), F.least(failures, F.lit(20))))


def dirty_from(changes: DataFrame, session: str, sequence: str) -> DataFrame:
    """(session, dirty_sequence): from where each changed session must be built again."""
    return changes.groupBy(session).agg(F.min(sequence).alias("dirty_sequence"))


def needs_build(dirty: DataFrame, through: DataFrame, session: str) -> DataFrame:
    """Whether a session only grew, so that its last chunk can be continued, or must be rebuilt."""
    met = dirty.join(through, session, "left")
    return met.withColumn("mode", F.when(F.col("through_sequence").isNotNull() & (F.col("dirty_sequence") > F.col("through_sequence")), "append").otherwise("rebuild"))


#: Fixed: seconds within which a notice goes the fast way, and after which it goes no more.
FAST, LATE = 5, 60


def deliveries(done: DataFrame, polls: DataFrame) -> DataFrame:
    """(request_id, poller, path): who tells of a finished request. The first poll that finds it finished claims it, so it is told once.

    ``done``: request_id, asked_at, finished_at; ``polls``: request_id, poller, polled_at. The claim is one minimum per request.
    """
    found = polls.join(done, "request_id").where(F.col("polled_at") >= F.col("finished_at"))
    first = found.groupBy("request_id", "asked_at").agg(F.min(F.struct("polled_at", "poller")).alias("c"))
    wait = F.col("c.polled_at") - F.col("asked_at")
    return first.where(wait <= LATE).select("request_id", F.col("c.poller").alias("poller"), F.when(wait <= FAST, "fast").otherwise("late").alias("path"))


def stream_once(events: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """A stream whose events reach ``path`` once per key, whatever is sent again or run again; processes what is there and ends."""
    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(appended_once(path, keys)).start()


def stream_dedup(events: DataFrame, at: str, keys: list[str], lateness: str = "10 minutes") -> DataFrame:
    """Drop repeated keys within the watermark, which bounds the state."""
    return events.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)
