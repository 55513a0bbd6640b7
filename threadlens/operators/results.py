"""The stored result of a search: the adopted match with its evidence, all evaluations, warnings and the state of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed: relevances that can be adopted, and the roles whose claims are an agent's.
RELEVANT, AGENTS = ("direct", "useful"), ("assistant", "agent_report")


def build_results(requests: DataFrame, assessed: DataFrame, evidence: DataFrame, warnings: DataFrame, index: DataFrame, mode: str) -> DataFrame:
    """(request_id, outcome, adopted, result as JSON) of every request.

    ``requests``: request_id, project_id; ``assessed``: request_id, document_id, revision, place, relevance, valid, statement_status; ``evidence``: document_id, message_id,
    revision, role, occurred_at, text, position (rows of one message count once); ``warnings``: request_id, code; ``index``: project_id, pending_documents,
    failed_documents. The adopted document is the first relevant one whose evidence is still valid; lists are bounded by the candidate limit.
    """
    can = F.col("relevance").isin(*RELEVANT) & F.col("valid")
    adopted = assessed.where(can).groupBy("request_id").agg(F.min_by(F.struct("document_id", "relevance", "statement_status"), "place").alias("a"))
    adopted = adopted.select("request_id", F.col("a.document_id").alias("adopted"), F.col("a.relevance").alias("relevance"), F.col("a.statement_status").alias("statement_status"))
    once = evidence.groupBy("document_id", "message_id", "revision").agg(F.min_by(F.struct("role", "occurred_at", "text"), "position").alias("e"), F.min("position").alias("position"))
    listed = once.join(adopted.select(F.col("adopted").alias("document_id")).distinct(), "document_id", "left_semi").groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("position", F.struct("message_id", "revision", "e.role", "e.occurred_at", "e.text").alias("e")))).alias("l"),
        F.bool_or(F.col("e.role").isin(*AGENTS)).alias("agent"),
    )
    match = F.struct(
        F.col("adopted").alias("case_or_document_id"), "relevance", "statement_status", F.when(F.col("agent"), "agent_reported").otherwise("not_reported").alias("claim_status"), F.transform("l", lambda x: x["e"]).alias("evidence")
    )
    matches = adopted.join(listed.withColumnRenamed("document_id", "adopted"), "adopted").select("request_id", "adopted", F.array(match).alias("matches"))
    rows = assessed.join(adopted.select("request_id", "adopted"), "request_id", "left")
    verdict = F.struct("document_id", "revision", "relevance", "statement_status", F.coalesce(F.col("adopted") == F.col("document_id"), F.lit(False)).alias("adopted"))
    evaluations = rows.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("place", verdict.alias("v")))).alias("l")).select("request_id", F.transform("l", lambda x: x["v"]).alias("candidate_evaluations"))
    codes = warnings.groupBy("request_id").agg(F.array_sort(F.collect_set(F.struct("code"))).alias("warnings"))
    out = requests.join(matches, "request_id", "left").join(evaluations, "request_id", "left").join(codes, "request_id", "left").join(index, "project_id", "left")
    status = F.struct(F.coalesce("pending_documents", F.lit(0)).alias("pending_documents"), F.coalesce("failed_documents", F.lit(0)).alias("failed_documents"), F.lit(mode).alias("search_mode"))
    empty = lambda c: F.coalesce(c, F.expr(f"filter({c}, x -> false)"), F.from_json(F.lit("[]"), out.schema[c].dataType))
    outcome = F.when(F.col("adopted").isNotNull(), "matched").otherwise("no_match")
    result = F.to_json(F.struct("request_id", outcome.alias("outcome"), status.alias("index_status"), empty("matches").alias("matches"), empty("candidate_evaluations").alias("candidate_evaluations"), empty("warnings").alias("warnings")))
    return out.select("request_id", outcome.alias("outcome"), "adopted", result.alias("result"))


def saved(requests: DataFrame, results: DataFrame, inputs: DataFrame) -> DataFrame:
    """``requests`` (request_id, status, input_id, input_revision) after their results were written.

    ``inputs``: input_id, current_revision. Only a running request whose input is unchanged takes its result; one whose input was revised or is gone expires,
    whatever was computed for it; any other stays as it is.
    """
    met = requests.join(results.select("request_id", "outcome", "result"), "request_id", "left").join(inputs, "input_id", "left")
    running, same = F.col("status") == "running", F.coalesce(F.col("current_revision") == F.col("input_revision"), F.lit(False))
    done = running & same & F.col("result").isNotNull()
    return met.select(
        "request_id",
        F.when(running & ~same, "expired").when(done, "completed").otherwise(F.col("status")).alias("status"),
        F.when(running & ~same, "input_revision_stale").alias("error_code"),
        F.when(done, F.col("outcome")).alias("outcome"),
    )
