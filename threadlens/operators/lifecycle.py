"""State transitions of requests, documents and index generations, as columns over joined snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.streaming.ingest import receipts


def route(action: Column, same_conditions: Column, reusable: Column) -> Column:
    """What an input's search does: nothing, take an earlier result, or search anew."""
    return F.when(action == "skip", "skip").when((action == "reuse") & same_conditions & reusable, "reuse").otherwise("new_search")


def view_status(status: Column, expires_at: Column, revision: Column, current: Column, now: Column) -> Column:
    """The status a reader sees: a changed input or a passed expiry comes before what was stored."""
    return F.when(current.isNull() | (current != revision), "expired").when(expires_at <= now, "expired").otherwise(status)


def view_outcome(outcome: Column, valid_matches: Column) -> Column:
    """A match none of whose evidence is still valid reads as no match."""
    return F.when((outcome == "matched") & (valid_matches == 0), "no_match").otherwise(outcome)


def reconcile(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """(document_key, action) of planned (document_key, content_hash) against existing (document_key, content_hash, status, searchable).

    One comparison of both sides by key: insert what is new, exclude what is gone, and for the rest decide by hash and state.
    """
    p = planned.select("document_key", F.col("content_hash").alias("new_hash"))
    met = p.join(existing, "document_key", "full_outer")
    same = F.col("new_hash") == F.col("content_hash")
    action = (
        F.when(F.col("content_hash").isNull(), "insert")
        .when(F.col("new_hash").isNull(), F.when(F.col("searchable"), "exclude").otherwise("none"))
        .when(same & (F.col("status") == "failed"), "retry")
        .when(same & ~F.col("searchable"), "revive")
        .when(same, "same")
        .when(F.col("status") == "pending", "replace_pending")
        .otherwise("new_revision")
    )
    return met.select("document_key", action.alias("action"))


def keeps_prefix(old: Column, new: Column) -> Column:
    """Whether a new source list only adds to the old one, so the published revision may stay up as stale."""
    return (F.size(new) >= F.size(old)) & (F.slice(new, 1, F.greatest(F.size(old), F.lit(1))) == old) | (F.size(old) == 0)


def applied_embeddings(revisions: DataFrame, vectors: DataFrame) -> DataFrame:
    """Revisions whose embedding arrived for the same text become ready, older ready ones of the document superseded."""
    met = revisions.join(vectors.select("document_id", F.col("input_hash").alias("got")), "document_id", "left")
    ready = (F.col("status") == "pending") & (F.col("got") == F.col("content_hash"))
    new = met.where(ready).groupBy("document_id").agg(F.max("revision").alias("published"))
    out = met.withColumn("status", F.when(ready, "ready").otherwise(F.col("status"))).drop("got").join(new, "document_id", "left")
    return out.withColumn("status", F.when((F.col("status") == "ready") & (F.col("revision") < F.col("published")), "superseded").otherwise(F.col("status"))).drop("published")


def missing(asked: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """What a cache lacks, each key once."""
    return asked.dropDuplicates(key).join(cache.select(*key), key, "left_anti")


#: Fixed: what makes an evaluation the same one, and how sure a judge of continuity must be.
JUDGED = ("company_id", "state_hash", "provider", "model", "policy_version", "question_set", "purpose", "endpoint", "account_ref")
SURE = 0.8


def cached(asked: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """``asked`` with the cached columns of its whole key, null where nothing is cached."""
    return asked.join(cache, key, "left")


def applied_judgments(analysis: DataFrame, answers: DataFrame, found: DataFrame, messages: DataFrame) -> dict[str, DataFrame]:
    """Answers taken over: the new ``analysis``, the ``relations`` that hold, and from where sessions must be built again (``builds``).

    ``analysis``: message_id, statement_status; ``answers``: message_id, revision, statement_status; ``found``: from_id, to_id, to_revision, relation; ``messages``: message_id,
    session_id, sequence_no, current_revision. Answers about a revision that is no longer current are dropped, and so are relations to such targets.
    """
    current = messages.select("message_id", F.col("current_revision").alias("revision"))
    good = answers.join(current, ["message_id", "revision"], "left_semi")
    after = analysis.join(good.select("message_id", F.col("statement_status").alias("__new")), "message_id", "left").select("message_id", F.coalesce("__new", "statement_status").alias("statement_status"))
    holds = found.join(good.select(F.col("message_id").alias("from_id")), "from_id", "left_semi").join(current.select(F.col("message_id").alias("to_id"), F.col("revision").alias("to_revision")), ["to_id", "to_revision"], "left_semi")
    changed = good.select("message_id").unionByName(holds.select(F.col("to_id").alias("message_id"))).distinct()
    builds = messages.join(changed, "message_id", "left_semi").groupBy("session_id").agg(F.min("sequence_no").alias("dirty_sequence"))
    return {"analysis": after, "relations": holds.select("from_id", "to_id", "relation"), "builds": builds}


def continuity_judgments(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """``pairs`` (session_id, candidate_session_id) with ``continuous``: the answer says so with enough confidence; without an answer it is not."""
    met = pairs.join(answers.select("session_id", "candidate_session_id", "choice", "confidence"), ["session_id", "candidate_session_id"], "left")
    return met.withColumn("continuous", F.coalesce((F.col("choice") == "continued") & (F.col("confidence") >= SURE), F.lit(False)))


def created_links(asked: DataFrame, order: str, messages: DataFrame) -> DataFrame:
    """``asked`` (idempotency_key, from_session, to_session, evidence_id) with ``verdict``: the first request of a key is checked, later ones repeat or conflict with it.

    ``messages``: evidence_id, evidence_session.
    """
    body = F.sha2(F.concat_ws("|", "from_session", "to_session", "evidence_id"), 256)
    told = receipts(asked.withColumn("__body", body), ["idempotency_key"], "__body", [F.col(order)]).drop("__body").join(messages, "evidence_id", "left")
    at = F.col("evidence_session")
    check = F.when(F.col("from_session") == F.col("to_session"), "same_session").when(at.isNull(), "evidence_missing").when((at == F.col("from_session")) | (at == F.col("to_session")), "accepted").otherwise("evidence_elsewhere")
    return told.withColumn("verdict", F.when(F.col("receipt") == "stored", check).otherwise(F.col("receipt"))).drop("receipt", "evidence_session")


def manual_requests(asked: DataFrame, key: list[str], order: str) -> DataFrame:
    """``asked`` (question, input_text, force_new, primary_only) with ``decision``: the automatic result if it was asked the same, else a search of its own; once per key."""
    body = F.sha2(F.concat_ws("|", "question", F.col("force_new").cast("string"), F.col("primary_only").cast("string")), 256)
    told = receipts(asked.withColumn("__body", body), key, "__body", [F.col(order)]).drop("__body")
    same = (F.col("question") == F.col("input_text")) & ~F.col("force_new") & ~F.col("primary_only")
    return told.withColumn("decision", F.when(F.col("receipt") != "stored", F.col("receipt")).when(same, "reuse_auto").otherwise("new_manual")).drop("receipt")
