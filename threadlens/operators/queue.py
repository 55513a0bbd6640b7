"""The job queue as snapshots: which jobs may be claimed, and how a claimed job ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: priorities of the kinds, and delays of failed jobs in seconds.
PRIORITY = {"route_search": 100, "execute_search": 80, "build_documents": 20, "classify_message": 10, "judge_continuity": 5}
RETRY_BASE, RETRY_CAP, RETRY_DOUBLINGS, JITTER = 1.0, 3600.0, 10, 0.1
#: The kind whose jobs keep their order within a session.
ORDERED = "classify_message"


def claimable(jobs: DataFrame, messages: DataFrame, kinds: list[str], now: Column) -> DataFrame:
    """The jobs that a worker of ``kinds`` may take now.

    ``jobs``: id, kind, status, next_run_at, session_id, message_id, target_revision; ``messages``: message_id, sequence_no. A job of the
    ordered kind waits while another of its session runs, or while an earlier one by (sequence, revision) is pending or blocked; failed ones
    are passed over. What is earlier is one minimum per session, so a session's jobs are never compared in pairs.
    """
    placed = jobs.where(F.col("kind") == ORDERED).join(messages.select("message_id", "sequence_no"), "message_id", "left")
    place = F.struct("sequence_no", "target_revision")
    open_ = F.col("status").isin("pending", "blocked_policy") & F.col("sequence_no").isNotNull()
    first = placed.groupBy("session_id").agg(F.count_if(F.col("status") == "running").alias("__running"), F.min(F.when(open_, place)).alias("__first"))
    ready = jobs.where((F.col("status") == "pending") & (F.col("next_run_at") <= now) & F.col("kind").isin(kinds))
    free = ready.where(F.col("kind") != ORDERED)
    own = ready.where(F.col("kind") == ORDERED).join(messages.select("message_id", "sequence_no"), "message_id", "left").join(first, "session_id", "left")
    waits = (F.coalesce("__running", F.lit(0)) > 0) | F.coalesce(F.col("__first") < place, F.lit(False))
    return free.unionByName(own.where(~waits).select(*jobs.columns))


def claimed(jobs: DataFrame, messages: DataFrame, kinds: list[str], now: Column, limit: int) -> DataFrame:
    """The next ``limit`` claimable jobs: by priority, then age, then id; of a session's ordered jobs only the first can be among them."""
    return claimable(jobs, messages, kinds, now).orderBy(F.col("priority").desc(), "created_at", "id").limit(limit)


def retry_delay(attempts: Column, retry_after: Column, jitter: Column | float = 0.0) -> Column:
    """Seconds until a failed job runs again: doubling up to an hour, never before the provider allows, and up to a tenth more by ``jitter`` in 0..1."""
    doubled = F.least(RETRY_BASE * F.pow(F.lit(2.0), F.least(attempts, F.lit(RETRY_DOUBLINGS))), F.lit(RETRY_CAP))
    return F.greatest(F.coalesce(retry_after.cast("double"), F.lit(0.0)), doubled) * (1 + JITTER * (jitter if isinstance(jitter, Column) else F.lit(jitter)))


def settled(jobs: DataFrame, outcomes: DataFrame, now: Column, jitter: Column | float = 0.0) -> DataFrame:
    """``jobs`` after their workers' reports, and after the recovery of those whose lease ran out.

    ``jobs``: id, status, lease_token, lease_expires_at, attempts, target_revision, next_run_at (times in seconds); ``outcomes``: id, lease_token,
    outcome (complete, retry, fail, block, renew), revision, retry_after, lease. A report counts only while its lease holds; completion only
    for the revision that was asked for.
    """
    met = jobs.join(outcomes.select("id", F.col("lease_token").alias("__token"), "outcome", "revision", "retry_after", "lease"), "id", "left")
    owned = (F.col("status") == "running") & (F.col("lease_token") == F.col("__token")) & (F.col("lease_expires_at") > now)
    done = (F.col("outcome") != "complete") | F.col("target_revision").eqNullSafe(F.col("revision"))
    report = F.when(F.coalesce(owned & done, F.lit(False)), F.col("outcome"))
    status = F.when(report == "complete", "completed").when(report == "retry", "pending").when(report == "fail", "failed").when(report == "block", "blocked_policy")
    lost = (F.col("status") == "running") & (F.col("lease_expires_at") <= now)
    status = F.coalesce(status, F.when(lost, "pending"), F.col("status"))
    delay = retry_delay(F.col("attempts"), F.col("retry_after"), jitter)
    return met.select(
        "id", status.alias("status"), F.when(status == "running", F.col("lease_token")).alias("lease_token"),
        F.when(status == "running", F.when(report == "renew", now + F.col("lease")).otherwise(F.col("lease_expires_at"))).alias("lease_expires_at"),
        F.when(report == "retry", now + delay).otherwise(F.col("next_run_at")).alias("next_run_at"),
    )
