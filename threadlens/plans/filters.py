"""Queries of the predicates (inventory: projections, filters, predicates)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.operators import filters as op
from threadlens.plans.base import analysis, cte, documents, messages, relations, requests
from threadlens.session import table


def tenant_scope(spark, d):
    return op.tenant_scope(documents(spark, d), project_id=3).select("document_id", "session_id")


def visible_document(spark, d):
    o = table(spark, d, "orders")
    revisions = o.select(F.col("o_orderkey").alias("document_id"), F.lit(1).alias("revision"), F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "failed").otherwise("superseded").alias("status"))
    entries = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("document_id"), F.lit(1).alias("revision"), (F.col("o_orderkey") % 5 == 0).alias("correction_only"))
    return op.visible(revisions, entries, ["document_id", "revision"]).select("document_id", "status", "correction_only")


def input_boundary(spark, d):
    docs, asked = documents(spark, d), requests(spark, d)
    candidates = asked.select("query_id", "project_id").join(docs, "project_id").select(F.col("query_id").alias("request_id"), "document_id")
    inputs = asked.select(F.col("query_id").alias("request_id"), "session_id", F.col("input_no").alias("input_sequence_no"))
    return op.before_input(candidates, docs, inputs)


def searchable_messages(spark, d):
    gone = relations(spark, d).select(F.col("to_id").alias("message_id"))
    return op.searchable(messages(spark, d).join(analysis(spark, d), "message_id"), gone).select("message_id", "session_id", "sequence_no")


def row_value_in(spark, d):
    picked = table(spark, d, "nation").select((F.col("n_nationkey") * 3).alias("session_id"), (F.col("n_regionkey") + 1).cast("long").alias("sequence_no"))
    return op.row_value_in(messages(spark, d), picked, ["session_id", "sequence_no"]).select("message_id")


def row_value_cmp(spark, d):
    return messages(spark, d).where(op.row_value_after(["session_id", "sequence_no"], [50, 3])).select("message_id", "session_id", "sequence_no")


def _terms(df):
    return F.array_compact(F.array(F.when(F.col("conv_id") % 2 == 0, "structure:layered"), F.when(F.col("conv_id") % 3 == 0, "storage:table"), F.when(F.col("turn") % 2 == 0, "testing:unit")))


def array_overlap(spark, d):
    c = table(spark, d, "conversations")
    return c.withColumn("terms", _terms(c)).where(op.array_overlap("terms", ["storage:table", "testing:unit"])).select("conv_id", "turn", F.size("terms").alias("n_terms"))


def null_safe_eq(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("was"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority"))
    now = o.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, None).otherwise(F.col("was")).alias("now"))
    return o.join(now, "o_orderkey").where(F.col("was").eqNullSafe(F.col("now"))).select("o_orderkey", "was")


def not_all(spark, d):
    shut = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey")).where("c_nationkey < 10")
    return table(spark, d, "customer").join(shut, "c_nationkey", "left_anti").select("c_custkey", "c_nationkey")


def approval_gate(spark, d):
    s = table(spark, d, "supplier")
    approvals = s.select(
        F.col("s_nationkey").alias("company_id"), "s_suppkey", (F.col("s_suppkey") % 7 != 0).alias("active"), (F.col("s_acctbal") > 0).alias("training_disabled"), (F.col("s_suppkey") % 90).alias("confirmed_at"), (F.col("s_suppkey") % 40).alias("terms_checked_at")
    )
    ok = op.approved(approvals, F.lit(30)).select(F.col("company_id").alias("c_nationkey")).distinct()
    return table(spark, d, "customer").join(ok, "c_nationkey", "left_semi").select("c_custkey")


def freshness_gate(spark, d):
    e = table(spark, d, "events").withColumn("age", F.col("value"))
    return e.where(op.fresh(F.lit(0), F.col("age") * 60)).select("event_id", "age")


def confidence(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", (F.col("event_id") % 100 / 100).alias("confidence"))
    return e.select("event_id", op.high_choice(F.col("event_type"), F.col("confidence")).alias("choice"))


def event_validity(spark, d):
    m = messages(spark, d)
    rows = m.select(
        "message_id",
        F.when(F.col("message_id") % 11 == 0, "").otherwise(F.col("session_id").cast("string")).alias("source_session_id"),
        F.col("message_id").cast("string").alias("source_message_id"),
        F.when(F.col("message_id") % 13 == 0, "tool").otherwise(F.col("role")).alias("role"),
        (F.col("sequence_no") - F.when(F.col("message_id") % 17 == 0, F.col("sequence_no")).otherwise(0)).alias("sequence_no"),
        F.lit(1).alias("revision"),
        F.when(F.col("message_id") % 19 == 0, "").otherwise(F.col("text")).alias("text"),
        F.when(F.col("message_id") % 7 == 0, "2024-01-01 00:00:00").otherwise("2024-01-01T00:00:00Z").alias("occurred_at"),
        F.when(F.col("message_id") % 5 == 0, "high").alias("reasoning_effort"),
        F.when(F.col("message_id") % 10 == 0, "m1").alias("model_id"),
    )
    return rows.select("message_id", F.array_join(op.event_violations(), ",").alias("violations"))


def judge_answer_validity(spark, d):
    e = table(spark, d, "events")
    p = F.when(F.col("event_id") % 3 == 0, 0.5).otherwise(0.25)
    rows = e.select("event_id", F.when(F.col("event_id") % 10 == 0, "maybe").otherwise("yes").alias("choice"), F.create_map(F.lit("yes"), p, F.lit("no"), F.lit(0.5)).alias("probabilities"), (F.col("value") / 100).alias("confidence"))
    return rows.select("event_id", op.answer_valid(F.col("choice"), F.array(F.lit("yes"), F.lit("no")), F.col("probabilities"), F.col("confidence")).alias("valid"))


def embedding_validity(spark, d):
    v = documents(spark, d).withColumn("e", F.when(F.col("document_id") % 9 == 0, F.slice("embedding", 1, 10)).when(F.col("document_id") % 7 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")))
    return v.select("document_id", op.embedding_valid(F.col("e"), 64).alias("valid"))


def evidence_view(spark, d):
    m = messages(spark, d).join(analysis(spark, d), "message_id", "left")
    return m.select("message_id", F.lit(1).alias("revision"), "role", "occurred_at", "text", "statement_status")


def public_fields(spark, d):
    m = messages(spark, d).withColumn("_internal", F.lit(1))
    return op.public_fields(m).select("message_id", "role", F.lit("_internal" in op.public_fields(m).columns).alias("leaks"))


def hexed(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lower(F.hex(F.unhex(F.sha2("text", 256)))).alias("input_hash"))


_TERMS = "[x FOR x IN [CASE WHEN conv_id % 2 = 0 THEN 'structure:layered' END, CASE WHEN conv_id % 3 = 0 THEN 'storage:table' END, CASE WHEN turn % 2 = 0 THEN 'testing:unit' END] IF x IS NOT NULL]"

QUERIES = {
    "flt.tenant_scope": tenant_scope, "flt.visible_document": visible_document, "flt.input_boundary": input_boundary, "flt.searchable_messages": searchable_messages,
    "flt.row_value_in": row_value_in, "flt.row_value_cmp": row_value_cmp, "flt.array_overlap": array_overlap, "flt.null_safe_eq": null_safe_eq, "flt.not_all": not_all,
    "flt.approval_gate": approval_gate, "flt.freshness_gate": freshness_gate, "flt.confidence": confidence, "flt.event_validity": event_validity,
    "flt.judge_answer_validity": judge_answer_validity, "flt.embedding_validity": embedding_validity, "prj.evidence_view": evidence_view, "prj.public_fields": public_fields, "prj.hex": hexed,
}

ORACLES = {
    "flt.tenant_scope": cte("docs") + " SELECT document_id, session_id FROM docs WHERE project_id = 3",
    "flt.visible_document": "SELECT o_orderkey AS document_id, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'failed' ELSE 'superseded' END AS status, o_orderkey % 5 = 0 AS correction_only FROM orders WHERE o_orderkey % 3 <> 0 AND (o_orderstatus <> 'O' OR o_orderkey % 5 = 0)",
    "flt.input_boundary": cte("docs", "requests") + " SELECT q.query_id AS request_id, d.document_id FROM requests q JOIN docs d USING (project_id) WHERE NOT EXISTS (SELECT 1 FROM docs s WHERE s.document_id = d.document_id AND s.session_id = q.session_id AND s.sequence_no >= q.input_no)",
    "flt.searchable_messages": cte("messages", "analysis", "relations") + " SELECT m.message_id, session_id, sequence_no FROM messages m JOIN analysis a USING (message_id) WHERE length(text) > 0 AND is_searchable AND retention_category <> 'progress_only' AND NOT EXISTS (SELECT 1 FROM relations r WHERE r.to_id = m.message_id)",
    "flt.row_value_in": cte("messages") + " SELECT message_id FROM messages WHERE (session_id, sequence_no) IN (SELECT n_nationkey * 3, n_regionkey + 1 FROM nation)",
    "flt.row_value_cmp": cte("messages") + " SELECT message_id, session_id, sequence_no FROM messages WHERE session_id > 50 OR (session_id = 50 AND sequence_no > 3)",
    "flt.array_overlap": f"SELECT conv_id, turn, len({_TERMS})::INT AS n_terms FROM conversations WHERE list_has_any({_TERMS}, ['storage:table', 'testing:unit'])",
    "flt.null_safe_eq": "WITH o AS (SELECT o_orderkey, nullif(o_orderstatus, 'O') AS was FROM orders) SELECT o_orderkey, was FROM o WHERE was IS NOT DISTINCT FROM CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE was END",
    "flt.not_all": "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey <> ALL (SELECT n_nationkey FROM nation WHERE n_nationkey < 10)",
    "flt.approval_gate": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_suppkey % 7 <> 0 AND s_acctbal > 0 AND s_suppkey % 90 <= 30 AND s_suppkey % 40 <= 30)",
    "flt.freshness_gate": "SELECT event_id, value AS age FROM events WHERE value * 60 - 0 <= 600",
    "flt.confidence": "SELECT event_id, CASE WHEN event_id % 100 / 100.0 >= 0.8 THEN event_type END AS choice FROM events",
    "flt.event_validity": cte("messages") + """ SELECT message_id, concat_ws(',', CASE WHEN message_id % 11 = 0 THEN 'source_session_id_invalid' END, CASE WHEN message_id % 13 = 0 THEN 'role_invalid' END,
        CASE WHEN message_id % 17 = 0 THEN 'sequence_invalid' END, CASE WHEN message_id % 19 = 0 OR text = '' THEN 'text_empty' END, CASE WHEN length(text) > 65536 AND message_id % 19 <> 0 THEN 'text_too_long' END,
        CASE WHEN message_id % 7 = 0 THEN 'time_invalid' END, CASE WHEN message_id % 5 = 0 AND message_id % 10 <> 0 THEN 'effort_without_model' END) AS violations FROM messages""",
    "flt.judge_answer_validity": "SELECT event_id, event_id % 10 <> 0 AND event_id % 3 = 0 AND value / 100 BETWEEN 0 AND 1 AS valid FROM events",
    "flt.embedding_validity": "SELECT vec_id AS document_id, vec_id % 9 <> 0 AND vec_id % 7 <> 0 AND len(embedding) = 64 AS valid FROM embeddings",
    "prj.evidence_view": cte("messages", "analysis") + " SELECT message_id, 1 AS revision, role, occurred_at, text, statement_status FROM messages LEFT JOIN analysis USING (message_id)",
    "prj.public_fields": cte("messages") + " SELECT message_id, role, false AS leaks FROM messages",
    "prj.hex": "SELECT doc_id, sha256(text) AS input_hash FROM documents",
}
