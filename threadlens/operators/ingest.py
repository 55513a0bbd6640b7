"""One batch of events into sessions, messages, revisions, requests, jobs and receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.operators.queue import PRIORITY
from threadlens.streaming.ingest import receipts, revision_verdicts

#: Fixed: the oldest input that is still searched for, in seconds; events of a batch at most.
FRESH, MOST_EVENTS = 600, 100


def ingested(events: DataFrame, seen: DataFrame, stored: DataFrame, now: Column) -> dict[str, DataFrame]:
    """What a batch changes, by table; every later step works on what the one before let through.

    ``events``: arrival, employee_id, idempotency_key, body_hash, source_session_id, source_message_id, revision, role, sequence_no, occurred_at (seconds);
    ``seen``: employee_id, idempotency_key, body_hash of earlier receipts; ``stored``: source_session_id, source_message_id, revision, body_hash, role,
    sequence_no of stored revisions. Conflicts become rows of ``rejected`` with their reason, instead of undoing the batch.
    """
    key = ["employee_id", "idempotency_key"]
    before = seen.select(*key, F.col("body_hash").alias("__was"))
    told = receipts(events, key, "body_hash", [F.col("arrival")]).join(before, key, "left")
    told = told.withColumn("receipt", F.when(F.col("__was").isNull(), F.col("receipt")).when(F.col("__was") == F.col("body_hash"), "repeated").otherwise("conflict")).drop("__was")
    fresh = told.where("receipt = 'stored'").drop("receipt")
    # stored revisions come before all of the batch, so the same rule holds across batches
    message = F.concat_ws("\0", "source_session_id", "source_message_id")
    columns = ["arrival", "message", "revision", "body_hash", "role", "sequence_no"]
    met = stored.withColumn("arrival", F.lit(-1).cast("long") - F.lit(1_000_000) + F.col("revision")).withColumn("message", message).select(*columns, F.lit(None).cast("string").alias("idempotency_key"), F.lit(False).alias("__new"))
    here = fresh.withColumn("message", message)
    rows = met.unionByName(here.withColumn("__new", F.lit(True)).select(*columns, "idempotency_key", "__new"))
    judged = revision_verdicts(rows, "message", "revision", "body_hash", "arrival", ["role", "sequence_no"]).where("__new").select("arrival", "verdict")
    out = here.join(judged, "arrival")
    good = out.where("verdict <> 'conflict'")
    accepted = out.where("verdict = 'accepted'")
    asked = good.where((F.col("role") == "user") & (now - F.col("occurred_at") <= FRESH))
    job = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), F.concat_ws(":", F.lit(kind), "message", "revision").alias("job_key"), F.lit(PRIORITY[kind]).alias("priority")).distinct()
    rejected = told.where("receipt = 'conflict'").select("arrival", F.lit("receipt_conflict").alias("reason")).unionByName(out.where("verdict = 'conflict'").select("arrival", F.lit("revision_conflict").alias("reason")))
    return {
        "sessions": good.groupBy("source_session_id").agg(F.min_by("occurred_at", "arrival").alias("started_at")),
        "messages": accepted.where("revision = 1").select("message", "role", "sequence_no"),
        "revisions": accepted.select("message", "revision", "body_hash"),
        "requests": asked.select("message", "revision").distinct(),
        "jobs": job(good, "classify_message").unionByName(job(asked, "route_search")),
        "receipts": good.select(*key, "body_hash", "message", "revision"),
        "rejected": rejected,
    }
