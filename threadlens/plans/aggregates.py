"""Queries of the aggregates (inventory: aggregations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.operators import aggregates as op
from threadlens.plans.base import analysis, cte, documents, messages, relations, samples
from threadlens.session import table


def count_group(spark, d):
    return samples(spark, d).groupBy("project_id", "status").agg(F.count("*").alias("n"))


def count_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"))


def _terms(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("term"))


def having(spark, d):
    asked = table(spark, d, "part").orderBy("p_partkey").limit(1).select(F.explode(F.split("p_name", " ")).alias("term")).distinct()
    return _terms(spark, d).join(asked, "term", "left_semi").groupBy("p_partkey").agg(F.count_distinct("term").alias("matched_terms")).where(F.col("matched_terms") >= 2)


def count_filter(spark, d):
    return samples(spark, d).groupBy("project_id").agg(F.count_if(F.col("status") == "view").alias("pending"), F.count_if(F.col("status") == "error").alias("failed"))


def count_filter_exists(spark, d):
    e = table(spark, d, "events").select("event_type", F.from_json(F.concat(F.lit("["), "props", F.lit(',{"k":'), F.col("user_id").cast("string"), F.lit("}]")), "array<struct<k:int>>").alias("items"))
    return e.groupBy("event_type").agg(F.count_if(F.exists("items", lambda x: x["k"] > 120)).alias("adopted"), F.count("*").alias("n"))


def percentile_disc(spark, d):
    half, most = (op.percentiles(samples(spark, d), ["status"], "duration_ms", fraction, name) for fraction, name in ((0.5, "p50"), (0.95, "p95")))
    return half.join(most, "status")


def percentile_recent(spark, d):
    rows = op.recent(samples(spark, d).where("status <> 'error' AND duration_ms IS NOT NULL"), [F.col("created_at").desc(), F.col("event_id").desc()], 200)
    return rows.agg(op.percentile(0.95, "duration_ms").alias("p95"), F.count("*").alias("n"))


def percentile_nearest_rank(spark, d):
    found = op.percentiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.95, "p95")
    return found.select("l_returnflag", F.round("p95", 3).alias("p95"))


def mean_min(spark, d):
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(F.col("o_orderkey") % 20).alias("a"), F.collect_set(F.col("o_orderkey") % 30).alias("b"))
    recall = F.size(F.array_intersect("a", "b")) / F.size("a")
    return lists.agg(F.round(F.avg(recall), 6).alias("mean_recall"), F.round(F.min(recall), 6).alias("min_recall"))


def min_group_order(spark, d):
    return messages(spark, d).groupBy("session_id").agg(F.min("occurred_at").alias("started_at"), F.min("message_id").alias("first_message"))


def collect_struct(spark, d):
    r = relations(spark, d).groupBy("to_id").agg(F.array_sort(F.collect_list(F.struct("from_id", "relation"))).alias("l"))
    return r.select("to_id", F.to_json("l").alias("relations"))


def _parts(spark, d):
    li = table(spark, d, "lineitem")
    retention = F.when(F.col("l_linenumber") % 4 == 1, "progress_only").when(F.col("l_linenumber") % 4 == 2, "unknown").when(F.col("l_returnflag") == "R", "decision_signal").otherwise("substantive")
    return li.select(
        F.col("l_orderkey").alias("message_id"), F.col("l_linenumber").alias("part"), retention.alias("retention"), F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("action"),
        (F.col("l_quantity") > 25).alias("searchable"), F.when(F.col("l_discount") < 0.06, "yes").otherwise("no").alias("same_conditions"), F.when(F.col("l_tax") > 0.02, (F.col("l_suppkey") % 7).cast("string")).alias("model"),
    )


def priority_merge(spark, d):
    return _parts(spark, d).groupBy("message_id").agg(op.priority(F.col("retention")).alias("retention_category"))


def unanimous(spark, d):
    return _parts(spark, d).groupBy("message_id").agg(op.unanimous(F.col("action")).alias("action"))


def bool_all(spark, d):
    return _parts(spark, d).groupBy("message_id").agg(op.all_yes(F.col("same_conditions")).alias("same"))


def set_union_sorted(spark, d):
    p = _parts(spark, d).select("message_id", "status", F.when(F.col("action") == "N", "none").otherwise(F.col("action")).alias("choice"))
    return p.groupBy("message_id").agg(F.array_join(op.strategy_terms(F.col("status"), F.col("choice")), ",").alias("terms"))


def distinct_ordered(spark, d):
    return _parts(spark, d).groupBy("message_id").agg(F.array_join(op.in_first_order(F.col("part"), F.col("model")), ",").alias("models"))


def relations_first(spark, d):
    return op.first_of(_parts(spark, d), ["message_id", "action"], [F.col("part"), F.col("retention")]).select("message_id", "action", "part", "retention")


def message_rollup(spark, d):
    r = op.message_rollup(_parts(spark, d))
    return r.withColumn("response_models", F.array_join("response_models", ","))


def strongest_status(spark, d):
    m = messages(spark, d).join(analysis(spark, d), "message_id", "left")
    return m.groupBy("session_id").agg(op.strongest(F.col("statement_status")).alias("statement_status"))


def request_only(spark, d):
    m = messages(spark, d).withColumn("document_id", F.expr("message_id div 3"))
    return m.groupBy("document_id").agg(F.bool_and((F.col("role") == "user") & (F.length("text") > 60)).alias("request_only"))


def latest_source(spark, d):
    return messages(spark, d).groupBy("session_id").agg(F.max("occurred_at").alias("latest"))


def _routes(spark, d):
    li = table(spark, d, "lineitem")
    route = F.when(F.col("l_returnflag") == "A", "vector").when(F.col("l_returnflag") == "N", "entity").otherwise("strategy")
    return li.select(
        (F.col("l_orderkey") % 50).alias("request_id"), (F.col("l_partkey") % 40).alias("document_id"), route.alias("route"), F.when(F.col("l_returnflag") == "A", F.col("l_linenumber")).alias("chunk"), (F.col("l_suppkey") % 20 + 1).alias("rank")
    )


def sum_rrf(spark, d):
    return op.rrf(_routes(spark, d), ["request_id"]).select("request_id", "document_id", F.round("rrf", 9).alias("rrf"), "entity_matched", F.array_join("kinds", ",").alias("kinds"))


def min_rank(spark, d):
    return op.rrf(_routes(spark, d), ["request_id"]).select("request_id", "document_id", F.col("query_chunk"))


def distinct_rows(spark, d):
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()


def completeness(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", "quality")
    state = docs.join(labels, "doc_id", "left").join(documents(spark, d).select(F.col("document_id").alias("doc_id"), F.lit(1).alias("embedded")), "doc_id", "left")
    return state.groupBy("source").agg(F.count_if(F.col("embedded").isNull() | F.col("quality").isNull()).alias("incomplete"), F.count("*").alias("n"))


def storage_estimate(spark, d):
    return documents(spark, d).groupBy("project_id").agg(F.sum(4 * F.size("embedding") + 8).alias("bytes"))


def eval_report(spark, d):
    found = _routes(spark, d).groupBy("request_id", "document_id").agg(F.min("rank").alias("position"))
    expected = table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), (F.col("c_custkey") * 7 % 40).alias("document_id"))
    hit = expected.join(found, ["request_id", "document_id"], "left")
    return hit.select("request_id", "document_id", F.col("position").isNotNull().alias("in_candidates"), "position", F.coalesce(F.col("position") <= 10, F.lit(False)).alias("adopted"))


QUERIES = {f"agg.{f.__name__}": f for f in (
    count_group, count_distinct, having, count_filter, count_filter_exists, percentile_disc, percentile_recent, percentile_nearest_rank, mean_min, min_group_order, collect_struct, priority_merge,
    unanimous, bool_all, set_union_sorted, distinct_ordered, relations_first, message_rollup, strongest_status, request_only, latest_source, sum_rrf, min_rank, distinct_rows, completeness, storage_estimate, eval_report,
)}

_P = """p AS (SELECT l_orderkey AS message_id, l_linenumber AS part, CASE WHEN l_linenumber % 4 = 1 THEN 'progress_only' WHEN l_linenumber % 4 = 2 THEN 'unknown' WHEN l_returnflag = 'R' THEN 'decision_signal' ELSE 'substantive' END AS retention,
  l_linestatus AS status, l_returnflag AS action, l_quantity > 25 AS searchable, CASE WHEN l_discount < 0.06 THEN 'yes' ELSE 'no' END AS same_conditions, CASE WHEN l_tax > 0.02 THEN (l_suppkey % 7)::VARCHAR END AS model FROM lineitem)"""
_RETENTION = "['substantive', 'decision_signal', 'unknown', 'progress_only'][min(CASE retention WHEN 'substantive' THEN 1 WHEN 'decision_signal' THEN 2 WHEN 'unknown' THEN 3 ELSE 4 END)]"
_MODELS = "coalesce((SELECT string_agg(model, ',' ORDER BY first_part) FROM (SELECT model, min(part) AS first_part FROM p q WHERE q.message_id = p.message_id AND model IS NOT NULL GROUP BY model)), '')"
_R = "r AS (SELECT l_orderkey % 50 AS request_id, l_partkey % 40 AS document_id, CASE l_returnflag WHEN 'A' THEN 'vector' WHEN 'N' THEN 'entity' ELSE 'strategy' END AS route, CASE WHEN l_returnflag = 'A' THEN l_linenumber END AS chunk, l_suppkey % 20 + 1 AS rank FROM lineitem)"
_UNANIMOUS = "CASE WHEN min({0}) = max({0}) AND count({0}) = count(*) THEN min({0}) ELSE 'unknown' END"

ORACLES = {
    "agg.count_group": cte("samples") + " SELECT project_id, status, count(*) AS n FROM samples GROUP BY 1, 2",
    "agg.count_distinct": "SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1",
    "agg.having": "WITH t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part) SELECT p_partkey, count(DISTINCT term) AS matched_terms FROM t WHERE term IN (SELECT unnest(string_split(p_name, ' ')) FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part)) GROUP BY 1 HAVING count(DISTINCT term) >= 2",
    "agg.count_filter": cte("samples") + " SELECT project_id, count(*) FILTER (WHERE status = 'view') AS pending, count(*) FILTER (WHERE status = 'error') AS failed FROM samples GROUP BY 1",
    "agg.count_filter_exists": "SELECT event_type, count(*) FILTER (WHERE CAST(json_extract(props, '$.k') AS INT) > 120 OR user_id > 120) AS adopted, count(*) AS n FROM events GROUP BY 1",
    "agg.percentile_disc": cte("samples") + " SELECT status, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95 FROM samples GROUP BY 1",
    "agg.percentile_recent": cte("samples") + " SELECT quantile_disc(duration_ms, 0.95) AS p95, count(*) AS n FROM (SELECT duration_ms FROM samples WHERE status <> 'error' AND duration_ms IS NOT NULL ORDER BY created_at DESC, event_id DESC LIMIT 200)",
    "agg.percentile_nearest_rank": "SELECT l_returnflag, round(list_sort(list(l_extendedprice))[CAST(ceil(0.95 * count(*)) AS INT)], 3) AS p95 FROM lineitem GROUP BY 1",
    "agg.mean_min": "WITH l AS (SELECT list(DISTINCT o_orderkey % 20) AS a, list(DISTINCT o_orderkey % 30) AS b FROM orders GROUP BY o_custkey) SELECT round(avg(len(list_intersect(a, b)) / len(a)), 6) AS mean_recall, round(min(len(list_intersect(a, b)) / len(a)), 6) AS min_recall FROM l",
    "agg.min_group_order": cte("messages") + " SELECT session_id, min(occurred_at) AS started_at, min(message_id) AS first_message FROM messages GROUP BY 1",
    "agg.collect_struct": cte("relations") + " SELECT to_id, '[' || string_agg('{\"from_id\":' || from_id || ',\"relation\":\"' || relation || '\"}', ',' ORDER BY from_id) || ']' AS relations FROM relations GROUP BY 1",
    "agg.priority_merge": f"WITH {_P} SELECT message_id, {_RETENTION} AS retention_category FROM p GROUP BY 1",
    "agg.unanimous": f"WITH {_P} SELECT message_id, {_UNANIMOUS.format('action')} AS action FROM p GROUP BY 1",
    "agg.bool_all": f"WITH {_P} SELECT message_id, bool_and(same_conditions = 'yes') AS same FROM p GROUP BY 1",
    "agg.set_union_sorted": f"WITH {_P} SELECT message_id, coalesce(string_agg(DISTINCT CASE WHEN action <> 'N' THEN status || ':' || action END, ',' ORDER BY CASE WHEN action <> 'N' THEN status || ':' || action END), '') AS terms FROM p GROUP BY 1",
    "agg.distinct_ordered": f"WITH {_P}, f AS (SELECT message_id, model, min(part) AS n FROM p GROUP BY 1, 2) SELECT message_id, coalesce(string_agg(model, ',' ORDER BY n, model), '') AS models FROM f GROUP BY 1",
    "agg.relations_first": f"WITH {_P}, f AS (SELECT *, row_number() OVER (PARTITION BY message_id, action ORDER BY part, retention) AS n FROM p) SELECT message_id, action, part, retention FROM f WHERE n = 1",
    "agg.message_rollup": f"WITH {_P}, f AS (SELECT message_id, model, min(part) AS n FROM p GROUP BY 1, 2), m AS (SELECT message_id, coalesce(string_agg(model, ',' ORDER BY n, model), '') AS response_models FROM f GROUP BY 1), g AS (SELECT message_id, {_RETENTION} AS retention_category, {_UNANIMOUS.format('status')} AS statement_status, {_UNANIMOUS.format('action')} AS decision_action, bool_or(searchable) AS is_searchable, bool_and(same_conditions = 'yes') AS same_conditions FROM p GROUP BY 1) SELECT * FROM g JOIN m USING (message_id)",
    "agg.strongest_status": cte("messages", "analysis") + " SELECT session_id, ['unknown', 'proposal', 'reported_completed', 'reported_verified'][max(CASE statement_status WHEN 'proposal' THEN 2 WHEN 'reported_completed' THEN 3 WHEN 'reported_verified' THEN 4 ELSE 1 END)] AS statement_status FROM messages LEFT JOIN analysis USING (message_id) GROUP BY 1",
    "agg.request_only": cte("messages") + " SELECT message_id // 3 AS document_id, bool_and(role = 'user' AND length(text) > 60) AS request_only FROM messages GROUP BY 1",
    "agg.latest_source": cte("messages") + " SELECT session_id, max(occurred_at) AS latest FROM messages GROUP BY 1",
    "agg.sum_rrf": f"WITH {_R} SELECT request_id, document_id, round(sum(1 / (60 + rank)), 9) AS rrf, bool_or(route = 'entity') AS entity_matched, string_agg(DISTINCT route, ',' ORDER BY route) AS kinds FROM r GROUP BY 1, 2",
    "agg.min_rank": f"WITH {_R} SELECT request_id, document_id, arg_min(chunk, (rank, chunk)) FILTER (WHERE chunk IS NOT NULL) AS query_chunk FROM r GROUP BY 1, 2",
    "agg.distinct_rows": "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem",
    "agg.completeness": "SELECT source, count(*) FILTER (WHERE vec_id IS NULL OR quality IS NULL) AS incomplete, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY 1",
    "agg.storage_estimate": "SELECT label AS project_id, sum(4 * len(embedding) + 8)::BIGINT AS bytes FROM embeddings GROUP BY 1",
    "agg.eval_report": f"WITH {_R}, f AS (SELECT request_id, document_id, min(rank) AS position FROM r GROUP BY 1, 2), x AS (SELECT c_custkey AS request_id, c_custkey * 7 % 40 AS document_id FROM customer) SELECT request_id, document_id, position IS NOT NULL AS in_candidates, position, coalesce(position <= 10, false) AS adopted FROM x LEFT JOIN f USING (request_id, document_id)",
}
