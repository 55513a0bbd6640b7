"""Queries of the join operators (inventory: joins, set operations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions.vectors import cosine, knn
from threadlens.operators import joins as op
from threadlens.plans.base import KNN, chat_requests, cte, documents, messages, relations, requests, samples, with_sources
from threadlens.session import table


def inner_equi(spark, d):
    docs = documents(spark, d).select("document_id", "project_id")
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "n_chars", "lang")
    entries = table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), "quality")
    return op.inner_on(op.inner_on(docs, texts, ["document_id"]), entries, ["document_id"])


def message_scope(spark, d):
    sessions = messages(spark, d).groupBy("session_id").agg(F.min("occurred_at").alias("started_at"))
    projects = table(spark, d, "nation").select(F.col("n_nationkey").alias("project_id"), "n_name")
    m = messages(spark, d).select("message_id", "session_id", "sequence_no").join(sessions, "session_id").withColumn("project_id", F.col("session_id") % 25)
    return op.inner_on(m, projects, ["project_id"]).select("message_id", "started_at", "n_name")


def left_outer(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")


def anti(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


def semi(spark, d):
    live = relations(spark, d).where("relation = 'revoke'").select(F.col("to_id").alias("message_id"))
    return messages(spark, d).join(live, "message_id", "left_semi").select("message_id", "role")


def theta_self(spark, d):
    """Similar pairs among each request's fetched rows, which the fetch limit bounds."""
    fetched = knn(with_sources(documents(spark, d)), requests(spark, d), 60, "project_id").select("query_id", "document_id")
    v = fetched.join(documents(spark, d).select("document_id", "embedding"), "document_id")
    a, b = v.alias("a"), v.alias("b")
    pairs = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.document_id") < F.col("b.document_id")))
    return pairs.where(cosine(F.col("a.embedding"), F.col("b.embedding")) >= 0.2).select("a.query_id", F.col("a.document_id").alias("left_id"), F.col("b.document_id").alias("right_id"))


def ranged(spark, d):
    m = messages(spark, d).select("session_id", "sequence_no", "message_id")
    return op.within_range(m, m, "session_id", "sequence_no", 2).where("near_message_id <> message_id").select("message_id", "near_message_id", "near_no")


def asof_lateral(spark, d):
    rows = samples(spark, d).where("status NOT IN ('purchase', 'signup')").select("event_id", F.col("project_id").alias("session_id"), F.expr("timestampdiff(HOUR, timestamp_ntz'1970-01-01 00:00:00', cast(created_at AS timestamp_ntz))").alias("sequence_no"))
    near = op.asof_latest(rows, chat_requests(spark, d), "session_id", "sequence_no", "input_no", "created_at")
    return near.where("near_status = 'completed'").select("event_id", "near_request_id")


def lateral_topn(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    newest = op.top_per_key(docs, ["source"], [F.col("doc_id").desc()], 20, "newest")
    return op.top_per_key(newest, ["source"], [F.col("n_chars"), F.col("doc_id")], 2, "rank").select("source", "doc_id", "rank")


def lateral_unnest(spark, d):
    words = table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("term"))
    return words.where("length(term) > 4").select("p_partkey", "term")


def _edges(spark, d):
    return table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("a"), (F.col("o_orderkey") % 37).alias("b"), "o_orderkey")


def or_key(spark, d):
    starts = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"))
    return op.either_end(_edges(spark, d), "a", "b").join(starts, "node").where("node <> other").groupBy("node", "other").agg(F.count("*").alias("links"))


def cross_param(spark, d):
    params = spark.range(1, 4).select(F.col("id").alias("param"))
    return table(spark, d, "nation").select("n_nationkey").crossJoin(F.broadcast(params)).select("n_nationkey", "param", (F.col("n_nationkey") * F.col("param")).alias("product"))


def scalar_subquery(spark, d):
    by_message = messages(spark, d).select("message_id", "session_id")
    jobs = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("own"), (F.col("event_id") % 90 * 1000 + 1).alias("message_id"))
    return jobs.join(by_message, "message_id", "left").select("event_id", F.coalesce("own", "session_id").alias("session_id"))


def corr_agg_subquery(spark, d):
    r = relations(spark, d).select(F.col("to_id").alias("message_id"), "from_id", "relation")
    rows = op.pre_aggregated(messages(spark, d).select("message_id"), r, "message_id", ["from_id"], "invalidating")
    return rows.select("message_id", F.array_join(F.transform("invalidating", lambda x: F.concat_ws(":", x["from_id"], x["relation"])), ";").alias("invalidating"))


def update_from(spark, d):
    target = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.lit("ready").alias("status"))
    gone = table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey"), F.lit("superseded").alias("status"))
    return op.updated_from(target, gone, ["s_nationkey"])


def delete_using(spark, d):
    return op.deleted_using(messages(spark, d).select("message_id", "session_id"), relations(spark, d).select(F.col("to_id").alias("message_id")), ["message_id"])


def hash_lookup(spark, d):
    ranks = documents(spark, d).select("document_id", "project_id", (F.col("document_id") % 7 + 1).alias("base_rank"))
    origins = documents(spark, d).select(F.col("document_id").alias("derived_id"), (F.col("document_id") * 3 % 500).alias("document_id"))
    return origins.join(ranks, "document_id").groupBy("document_id").agg(F.min("base_rank").alias("best"), F.count("*").alias("derived"))


def union_all(spark, d):
    docs = documents(spark, d)
    published = docs.where("document_id % 2 = 0").select("document_id", F.lit(False).alias("correction_only"))
    anchors = docs.where("document_id % 3 = 0").select("document_id", F.lit(True).alias("correction_only"))
    live = relations(spark, d).select((F.col("to_id") % 500).alias("document_id")).distinct()
    hidden = anchors.join(published.select("document_id"), "document_id", "left_anti").join(live, "document_id", "left_semi")
    return published.unionByName(hidden)


def union_distinct(spark, d):
    own = table(spark, d, "customer").select(F.col("c_nationkey").alias("key"))
    return own.union(table(spark, d, "supplier").select("s_nationkey")).distinct()


def route_concat(spark, d):
    docs = documents(spark, d)
    v = docs.where("document_id < 60").select(F.lit("vector").alias("route"), "document_id")
    e = docs.where("document_id % 11 = 0").select(F.lit("entity").alias("route"), "document_id")
    return v.unionByName(e).groupBy("document_id").agg(F.count("*").alias("routes"), F.array_join(F.array_sort(F.collect_set("route")), ",").alias("kinds"))


def ordered_union_dedup(spark, d):
    c = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey", (F.col("o_orderkey") % 9).alias("candidate"), F.lit(0).alias("priority"), F.col("o_orderkey").alias("n"))
    x = table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_custkey", (F.col("o_orderkey") % 7).alias("candidate"), F.lit(1).alias("priority"), F.col("o_orderkey").alias("n"))
    first = c.unionByName(x).groupBy("o_custkey", "candidate").agg(F.min(F.struct("priority", "n")).alias("at"))
    return op.top_per_key(first, ["o_custkey"], [F.col("at")], 6).select("o_custkey", "candidate", "rank")


def array_intersection(spark, d):
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(F.col("o_orderkey") % 20).alias("a"), F.collect_set(F.col("o_orderkey") % 30).alias("b"))
    return lists.select("o_custkey", F.round(F.size(F.array_intersect("a", "b")) / F.size("a"), 6).alias("recall"))


QUERIES = {
    "jn.inner_equi": inner_equi, "jn.message_scope": message_scope, "jn.left_outer": left_outer, "jn.anti": anti, "jn.semi": semi, "jn.theta_self": theta_self, "jn.range": ranged,
    "jn.asof_lateral": asof_lateral, "jn.lateral_topn": lateral_topn, "jn.lateral_unnest": lateral_unnest, "jn.or_key": or_key, "jn.cross_param": cross_param, "jn.scalar_subquery": scalar_subquery,
    "jn.corr_agg_subquery": corr_agg_subquery, "jn.update_from": update_from, "jn.delete_using": delete_using, "jn.hash_lookup": hash_lookup, "set.union_all": union_all,
    "set.union_distinct": union_distinct, "set.route_concat": route_concat, "set.ordered_union_dedup": ordered_union_dedup, "set.array_intersection": array_intersection,
}

ORACLES = {
    "jn.inner_equi": "SELECT vec_id AS document_id, label AS project_id, n_chars, lang, quality FROM embeddings JOIN documents ON vec_id = documents.doc_id JOIN labels ON vec_id = labels.doc_id",
    "jn.message_scope": cte("messages") + " SELECT message_id, min(occurred_at) OVER (PARTITION BY session_id) AS started_at, n_name FROM messages JOIN nation ON n_nationkey = session_id % 25",
    "jn.left_outer": "SELECT d.doc_id, lang, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "jn.anti": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "jn.semi": cte("messages", "relations") + " SELECT message_id, role FROM messages WHERE message_id IN (SELECT to_id FROM relations WHERE relation = 'revoke')",
    "jn.theta_self": KNN + ", v AS (SELECT query_id, document_id, embedding FROM t JOIN docs USING (document_id) WHERE rank <= 60) SELECT a.query_id, a.document_id AS left_id, b.document_id AS right_id FROM v a JOIN v b ON a.query_id = b.query_id AND a.document_id < b.document_id WHERE list_cosine_similarity(a.embedding, b.embedding) >= 0.2",
    "jn.range": cte("messages") + " SELECT a.message_id, b.message_id AS near_message_id, b.sequence_no AS near_no FROM messages a JOIN messages b ON a.session_id = b.session_id AND b.sequence_no BETWEEN a.sequence_no - 2 AND a.sequence_no + 2 AND a.message_id <> b.message_id",
    "jn.asof_lateral": cte("chats") + """, e AS (SELECT event_id, user_id AS session_id, date_diff('hour', timestamp '1970-01-01', date_trunc('hour', ts)) AS sequence_no FROM events WHERE event_type NOT IN ('purchase', 'signup')),
        n AS (SELECT e.event_id, c.request_id, c.status, row_number() OVER (PARTITION BY e.event_id ORDER BY c.input_no DESC, c.created_at DESC) AS r FROM e JOIN chats c ON c.session_id = e.session_id AND c.input_no < e.sequence_no)
        SELECT event_id, request_id AS near_request_id FROM n WHERE r = 1 AND status = 'completed'""",
    "jn.lateral_topn": "WITH n AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM documents), t AS (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id))::INT AS rank FROM n WHERE r <= 20) SELECT * FROM t WHERE rank <= 2",
    "jn.lateral_unnest": "SELECT p_partkey, term FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part) WHERE length(term) > 4",
    "jn.or_key": "WITH e AS (SELECT o_custkey % 40 AS a, o_orderkey % 37 AS b FROM orders) SELECT n_nationkey::BIGINT AS node, CASE WHEN a = n_nationkey THEN b ELSE a END AS other, count(*) AS links FROM e JOIN nation ON n_nationkey = a OR n_nationkey = b WHERE a <> b GROUP BY 1, 2",
    "jn.cross_param": "SELECT n_nationkey, param, n_nationkey * param AS product FROM nation CROSS JOIN (SELECT unnest([1, 2, 3])::BIGINT AS param)",
    "jn.scalar_subquery": cte("messages") + " SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN user_id END, (SELECT session_id FROM messages m WHERE m.message_id = e.event_id % 90 * 1000 + 1)) AS session_id FROM events e",
    "jn.corr_agg_subquery": cte("messages", "relations") + " SELECT message_id, coalesce((SELECT string_agg(from_id || ':' || relation, ';' ORDER BY from_id) FROM relations r WHERE r.to_id = m.message_id), '') AS invalidating FROM messages m",
    "jn.update_from": "SELECT s_suppkey, s_nationkey, CASE WHEN s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) THEN 'superseded' ELSE 'ready' END AS status FROM supplier",
    "jn.delete_using": cte("messages", "relations") + " SELECT message_id, session_id FROM messages WHERE message_id NOT IN (SELECT to_id FROM relations)",
    "jn.hash_lookup": "WITH o AS (SELECT vec_id AS derived, vec_id * 3 % 500 AS document_id FROM embeddings) SELECT document_id, min(document_id % 7 + 1) AS best, count(*) AS derived FROM o WHERE document_id IN (SELECT vec_id FROM embeddings) GROUP BY 1",
    "set.union_all": cte("docs", "relations") + " SELECT document_id, false AS correction_only FROM docs WHERE document_id % 2 = 0 UNION ALL SELECT document_id, true FROM docs WHERE document_id % 3 = 0 AND document_id % 2 <> 0 AND document_id IN (SELECT to_id % 500 FROM relations)",
    "set.union_distinct": "SELECT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier",
    "set.route_concat": cte("docs") + ", r AS (SELECT 'vector' AS route, document_id FROM docs WHERE document_id < 60 UNION ALL SELECT 'entity', document_id FROM docs WHERE document_id % 11 = 0) SELECT document_id, count(*) AS routes, string_agg(DISTINCT route, ',' ORDER BY route) AS kinds FROM r GROUP BY 1",
    "set.ordered_union_dedup": "WITH u AS (SELECT o_custkey, o_orderkey % 9 AS candidate, 0 AS p, o_orderkey AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey % 7, 1, o_orderkey FROM orders WHERE o_orderstatus = 'O'), f AS (SELECT o_custkey, candidate, min((p, n)) AS first_at FROM u GROUP BY 1, 2), r AS (SELECT o_custkey, candidate, (row_number() OVER (PARTITION BY o_custkey ORDER BY first_at))::INT AS rank FROM f) SELECT * FROM r WHERE rank <= 6",
    "set.array_intersection": "WITH l AS (SELECT o_custkey, list(DISTINCT o_orderkey % 20) AS a, list(DISTINCT o_orderkey % 30) AS b FROM orders GROUP BY 1) SELECT o_custkey, round(len(list_intersect(a, b)) / len(a), 6) AS recall FROM l",
}
