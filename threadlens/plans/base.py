"""How the driver's tables stand in for the engine's own, with the same mapping as SQL.

conversations are sessions (conv_id) of messages (turn + 1), system rows left out; embeddings are documents whose project is the
label; a document's only source is message (vec_id % 20, vec_id div 20 + 1); every vec_id divisible by 50 is a request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.session import table

#: SQL common table expressions with the same rows as the functions below.
CTE = {
    "messages": "messages AS (SELECT conv_id AS session_id, conv_id * 1000 + turn AS message_id, turn + 1 AS sequence_no, role, text, conv_id * 60 + turn AS occurred_at FROM conversations WHERE role IN ('user', 'assistant'))",
    "docs": "docs AS (SELECT vec_id AS document_id, label AS project_id, embedding::DOUBLE[] AS embedding, vec_id % 20 AS session_id, vec_id // 20 + 1 AS sequence_no FROM embeddings)",
    "requests": "requests AS (SELECT vec_id AS query_id, label AS project_id, embedding::DOUBLE[] AS embedding, vec_id % 20 AS session_id, vec_id // 20 + 1 AS input_no FROM embeddings WHERE vec_id % 50 = 0)",
    "analysis": "analysis AS (SELECT conv_id * 1000 + turn AS message_id, CASE turn % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'proposal' WHEN 2 THEN 'reported_completed' ELSE 'reported_verified' END AS statement_status, CASE WHEN length(text) < 120 THEN 'progress_only' ELSE 'substantive' END AS retention_category, length(text) % 5 <> 0 AS is_searchable FROM conversations WHERE role IN ('user', 'assistant'))",
    "relations": "relations AS (SELECT conv_id * 1000 + turn AS from_id, conv_id * 1000 + turn - 2 AS to_id, CASE WHEN turn % 3 = 0 THEN 'revoke' ELSE 'change' END AS relation FROM conversations WHERE role = 'assistant' AND turn >= 3)",
    "samples": "samples AS (SELECT event_id, user_id AS project_id, event_type AS status, ts AS created_at, value AS duration_ms FROM events)",
    "chats": "chats AS (SELECT event_id AS request_id, user_id AS session_id, CASE WHEN event_type = 'purchase' THEN 'completed' ELSE 'failed' END AS status, ts AS created_at, date_diff('hour', timestamp '1970-01-01', date_trunc('hour', ts)) AS input_no FROM events WHERE event_type IN ('purchase', 'signup'))",
}


def cte(*names: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names)


#: Each request's documents ranked by cosine distance within scope and boundary: t (query_id, document_id, distance, rank).
KNN = cte("docs", "requests") + """, k AS (SELECT q.query_id, d.document_id, 1 - list_cosine_similarity(q.embedding, d.embedding) AS distance FROM requests q JOIN docs d USING (project_id) WHERE NOT (d.session_id = q.session_id AND d.sequence_no >= q.input_no)),
 t AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, document_id))::INT AS rank FROM k)"""


def messages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))
    return c.select(F.col("conv_id").alias("session_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), (F.col("turn") + 1).alias("sequence_no"), "role", "text", (F.col("conv_id") * 60 + F.col("turn")).alias("occurred_at"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("document_id"), F.col("label").alias("project_id"), "embedding", (F.col("vec_id") % 20).alias("session_id"), F.expr("vec_id div 20 + 1").alias("sequence_no"))


def with_sources(docs: DataFrame) -> DataFrame:
    return docs.withColumn("sources", F.array(F.struct("session_id", F.col("sequence_no").alias("last_no"))))


def requests(spark: SparkSession, d: str) -> DataFrame:
    e = documents(spark, d).where("document_id % 50 = 0")
    return e.select(F.col("document_id").alias("query_id"), "project_id", "embedding", "session_id", F.col("sequence_no").alias("input_no"))


def analysis(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    turn = F.col("sequence_no") - 1
    status = F.when(turn % 4 == 0, "unknown").when(turn % 4 == 1, "proposal").when(turn % 4 == 2, "reported_completed").otherwise("reported_verified")
    return m.select("message_id", status.alias("statement_status"), F.when(F.length("text") < 120, "progress_only").otherwise("substantive").alias("retention_category"), (F.length("text") % 5 != 0).alias("is_searchable"))


def relations(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).where("role = 'assistant' AND sequence_no >= 4")
    return m.select(F.col("message_id").alias("from_id"), (F.col("message_id") - 2).alias("to_id"), F.when((F.col("sequence_no") - 1) % 3 == 0, "revoke").otherwise("change").alias("relation"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("project_id"), F.col("event_type").alias("status"), F.col("ts").alias("created_at"), F.col("value").alias("duration_ms"))


def chat_requests(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type IN ('purchase', 'signup')")
    return e.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("session_id"), F.when(F.col("event_type") == "purchase", "completed").otherwise("failed").alias("status"), F.col("ts").alias("created_at"), F.expr("timestampdiff(HOUR, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))").alias("input_no"))
