"""Queries of the window equivalents and of sorts, limits and top lists (inventory: window functions, sorts / limits / top-k)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadlens.functions import identifiers
from threadlens.functions.vectors import cosine, knn
from threadlens.operators import aggregates as agg
from threadlens.operators import folds
from threadlens.operators import joins as op
from threadlens.operators import continuity, postings, queue, related
from threadlens.plans import streams
from threadlens.plans.aggregates import _R, _routes
from threadlens.plans.base import KNN, cte, documents, messages, requests, samples, with_sources
from threadlens.session import table

#: Fixed limits of the routes and of the selection.
VECTOR_FETCH, VECTOR_LIMIT, ENTITY_LIMIT, STRATEGY_LIMIT, PROVENANCE_LIMIT, CANDIDATE_LIMIT, CANDIDATE_TOKENS = 60, 20, 20, 10, 10, 10, 8_000
#: The test data's vectors are far apart, so queries over it call contents similar from here.
SIMILAR = 0.2


def rank_route(spark, d):
    r = _routes(spark, d).select("request_id", "route", "document_id").distinct()
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("request_id", "route").orderBy("document_id")))


def latest_per_key(spark, d):
    return op.top_per_key(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 1).select("o_custkey", "o_orderkey")


def prior_messages(spark, d):
    m = messages(spark, d).select("session_id", "sequence_no", "role", "message_id")
    return op.previous(m, ["session_id"], "sequence_no", 6, ["message_id"]).where("role = 'user'").select("session_id", F.col("sequence_no").alias("input_no"), "message_id", "rank")


def neighbors(spark, d):
    w = Window.partitionBy("session_id").orderBy("sequence_no").rangeBetween(-2, 2)
    return messages(spark, d).select("message_id", F.count("*").over(w).alias("near"), F.min("message_id").over(w).alias("first"), F.max("message_id").over(w).alias("last"))


def first_last_n(spark, d):
    m = messages(spark, d).select("session_id", "sequence_no", "message_id")
    first = op.top_per_key(m, ["session_id"], [F.col("sequence_no")], 5).withColumn("part", F.lit("first"))
    last = op.top_per_key(m, ["session_id"], [F.col("sequence_no").desc()], 5).withColumn("part", F.lit("last"))
    return first.unionByName(last).select("session_id", "message_id", "part")


def _candidates(spark, d):
    r = agg.rrf(_routes(spark, d), ["request_id"])
    return r.select("request_id", "document_id", "rrf", ((F.col("document_id") * 37) % 900 + 300).alias("tokens"))


def running_budget(spark, d):
    out = folds.budgeted(_candidates(spark, d), "request_id", [-F.round("rrf", 12), F.col("document_id")], "tokens", F.lit(CANDIDATE_TOKENS - 500), 1000)
    return out.select("request_id", "document_id", "verdict")


def _knn(spark, d, k):
    return knn(with_sources(documents(spark, d)), requests(spark, d), k, "project_id")


def distinct_prefix(spark, d):
    ranked = _knn(spark, d, 40).select("query_id", "document_id", "rank")
    pairs = similar_pairs(spark, d, ranked)
    return folds.distinct_prefix(ranked, pairs, "query_id", "document_id", "rank", VECTOR_LIMIT)


def similar_pairs(spark, d, ranked):
    """Pairs of similar contents among a request's fetched rows; the fetch limit bounds them."""
    v = ranked.join(documents(spark, d).select("document_id", "embedding"), "document_id")
    a, b = v.alias("a"), v.alias("b")
    both = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.document_id") < F.col("b.document_id")))
    return both.where(cosine(F.col("a.embedding"), F.col("b.embedding")) >= SIMILAR).select("a.query_id", F.col("a.document_id").alias("left"), F.col("b.document_id").alias("right"))


def keyset_page(spark, d):
    o = table(spark, d, "orders").select("o_orderdate", "o_orderkey")
    return o.where(F.struct("o_orderdate", "o_orderkey") > F.struct(F.lit("1995-06-01").cast("timestamp_ntz").alias("o_orderdate"), F.lit(1000).cast("long").alias("o_orderkey"))).orderBy("o_orderdate", "o_orderkey").limit(64)


def sample_recent(spark, d):
    rows = samples(spark, d)
    return agg.recent(rows.where("status = 'view'"), [F.col("created_at").desc(), F.col("event_id").desc()], 200).select("event_id", "duration_ms")


def sequence_assign(spark, d):
    known = messages(spark, d).groupBy("session_id").agg(F.max("sequence_no").alias("last_no"))
    new = table(spark, d, "events").select((F.col("user_id") % 120).alias("session_id"), "event_id")
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("event_id"))
    return new.join(known, "session_id", "left").select("event_id", "session_id", (F.coalesce("last_no", F.lit(0)) + n).alias("sequence_no"))


def vector_knn(spark, d):
    return _knn(spark, d, VECTOR_FETCH).select("query_id", "document_id", "rank", F.round("distance", 5).alias("distance"))


def entity(spark, d):
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("document_id"), F.explode(F.split("p_name", " ")).alias("entity_key"))
    asked = docs.where("document_id % 50 = 0").select(F.col("document_id").alias("request_id"), "entity_key")
    return postings.first_sharing(docs, asked, ["entity_key"], [F.col("document_id")], ENTITY_LIMIT)


def strategy(spark, d):
    # all names of a part count as one
    docs = table(spark, d, "part").groupBy(F.col("p_partkey").alias("document_id")).agg(F.split(F.array_join(F.collect_set("p_name"), " "), " ").alias("terms"))
    asked = docs.where("document_id % 50 = 0").select(F.col("document_id").alias("request_id"), "terms")
    return postings.top_sharing(docs, asked, [], STRATEGY_LIMIT)


def provenance(spark, d):
    derived = _routes(spark, d).select("request_id", F.col("document_id").alias("derived_id"), "rank")
    origin = derived.select("request_id", (F.col("derived_id") * 3 % 40).alias("document_id"), "rank").groupBy("request_id", "document_id").agg(F.min("rank").alias("best"))
    return op.top_per_key(origin, ["request_id"], [F.col("best"), F.col("document_id")], PROVENANCE_LIMIT)


def candidate_order(spark, d):
    c = _candidates(spark, d).withColumn("secondary", (F.col("document_id") % 3 == 0).cast("int"))
    return op.top_per_key(c, ["request_id"], [F.col("secondary"), F.round("rrf", 12).desc(), F.col("document_id")], 1000).select("request_id", "document_id", "rank")


def budgeted(spark, d):
    out = folds.budgeted(_candidates(spark, d), "request_id", [-F.round("rrf", 12), F.col("document_id")], "tokens", F.lit(CANDIDATE_TOKENS - 500), CANDIDATE_LIMIT)
    return out.groupBy("request_id").agg(F.count_if(F.col("verdict") == "selected").alias("selected"), F.count_if(F.col("verdict") == "limit").alias("candidate_limit_exceeded"), F.count_if(F.col("verdict") == "token_budget").alias("candidate_token_budget_exceeded"))


def rank_accepted(spark, d):
    c = _candidates(spark, d).withColumns(
        {"relevance": F.col("document_id") % 3, "derived": (F.col("document_id") % 7 == 0).cast("int"), "secondary": (F.col("document_id") % 5 == 0).cast("int"), "entity": (F.col("document_id") % 2).cast("int"), "status": F.col("document_id") % 4, "latest": F.col("document_id") * 13 % 31}
    ).where("relevance >= 1")
    order = [F.col("relevance").desc(), F.col("derived"), F.col("secondary"), F.col("entity").desc(), F.col("status").desc(), F.round("rrf", 12).desc(), F.when(F.col("status") != 0, F.col("latest")).desc_nulls_last(), F.col("document_id")]
    return op.top_per_key(c, ["request_id"], order, 1000).select("request_id", "document_id", "rank")


def primary_match(spark, d):
    """(query_id, primary): how similar each request's own best match is."""
    return _knn(spark, d, 1).select("query_id", (1 - F.col("distance")).alias("primary"))


def nearest_2_per_session(spark, d):
    reach = F.explode(F.array(*[(F.col("session_id") + i) % 20 for i in range(1, 13)])).alias("other_session")
    asked = requests(spark, d).select("query_id", F.col("embedding").alias("q"), reach)
    return related.nearest_documents(documents(spark, d), asked, primary_match(spark, d))


def continuity_candidates(spark, d):
    """Sessions that may continue another, by their neighbours and by issues and pull requests that their messages name; one pull request is named by every third session."""
    m, n = messages(spark, d), F.col("session_id")
    sessions = m.select("session_id").distinct().select("session_id", (n % 5).alias("project_id"), (n % 3).alias("employee_id"), (n * 7 % 50).alias("started_at"))
    said = F.concat("text", F.lit(" see Issue #"), n % 7, F.when(n % 3 == 0, " and PR #1").otherwise(""))
    named = m.select("session_id", F.explode(identifiers.extract_entities(said)).alias("e")).select("session_id", "e.*")
    pairs = lambda step, by: sessions.where(n % by == 0).select(n.alias("a"), (n + step).alias("b"))
    return continuity.candidates(sessions, named, pairs(5, 4), pairs(-10, 6))


def job_claim(spark, d):
    return queue.claimed(*streams.jobs(spark, d), ["classify_message", "build_documents"], F.lit(700), 25).select("id", "kind", "priority")


def outbox(spark, d):
    return messages(spark, d).orderBy("session_id", "sequence_no", "message_id").limit(100).select("message_id", "session_id")


def nulls_last(spark, d):
    runs = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("completed_at"))
    return op.top_per_key(runs, ["o_custkey"], [F.col("completed_at").desc_nulls_last(), F.col("o_orderkey")], 1).select("o_custkey", "o_orderkey")


WINDOWS = (rank_route, latest_per_key, prior_messages, neighbors, first_last_n, running_budget, distinct_prefix, keyset_page, sample_recent, sequence_assign)
TOPS = (vector_knn, entity, strategy, provenance, candidate_order, budgeted, rank_accepted, nearest_2_per_session, continuity_candidates, job_claim, outbox, nulls_last)
QUERIES = {f"win.{f.__name__}": f for f in WINDOWS} | {f"top.{f.__name__}": f for f in TOPS}

_C = f"{_R}, c AS (SELECT request_id, document_id, sum(1 / (60 + rank)) AS rrf, document_id * 37 % 900 + 300 AS tokens FROM r GROUP BY 1, 2)"
# the skipping budget as recursion over each request's ranked list
_FOLD = """n AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(rrf, 12) DESC, document_id) AS i FROM c),
f AS (SELECT request_id, document_id, i, CASE WHEN tokens <= 7500 THEN 'selected' ELSE 'token_budget' END AS verdict, CASE WHEN tokens <= 7500 THEN 7500 - tokens ELSE 7500 END AS room, CASE WHEN tokens <= 7500 THEN 1 ELSE 0 END AS taken FROM n WHERE i = 1
  UNION ALL SELECT n.request_id, n.document_id, n.i, CASE WHEN f.taken >= {limit} THEN 'limit' WHEN n.tokens <= f.room THEN 'selected' ELSE 'token_budget' END, CASE WHEN f.taken < {limit} AND n.tokens <= f.room THEN f.room - n.tokens ELSE f.room END, CASE WHEN f.taken < {limit} AND n.tokens <= f.room THEN f.taken + 1 ELSE f.taken END
  FROM f JOIN n ON n.request_id = f.request_id AND n.i = f.i + 1)"""
_KNN = KNN

#: Fetched rows with the earlier rows (documents) that each is similar to; then the prefix of distinct contents as recursion over the rank.
SIMILAR_SQL = "WITH RECURSIVE " + KNN[5:] + f""", f AS (SELECT t.query_id, t.document_id, t.rank, d.embedding FROM t JOIN docs d ON d.document_id = t.document_id WHERE rank <= 40),
    near AS (SELECT a.query_id, a.document_id, list(b.document_id) AS near FROM f a JOIN f b ON b.query_id = a.query_id AND b.document_id <> a.document_id WHERE list_cosine_similarity(a.embedding, b.embedding) >= {SIMILAR} GROUP BY 1, 2),
    s AS (SELECT f.query_id, f.document_id, f.rank, coalesce(near, []) AS near FROM f LEFT JOIN near ON near.query_id = f.query_id AND near.document_id = f.document_id)"""
DISTINCT = SIMILAR_SQL + f""", g AS (SELECT query_id, document_id, rank, [document_id] AS seen FROM s WHERE rank = 1
    UNION ALL SELECT s.query_id, s.document_id, s.rank, CASE WHEN list_has_any(g.seen, s.near) THEN g.seen ELSE list_append(g.seen, s.document_id) END FROM g JOIN s ON s.query_id = g.query_id AND s.rank = g.rank + 1 WHERE list_has_any(g.seen, s.near) OR len(g.seen) < {VECTOR_LIMIT}),
    kept AS (SELECT query_id, document_id, rank FROM g)"""

ORACLES = {
    "win.rank_route": f"WITH {_R} SELECT *, (row_number() OVER (PARTITION BY request_id, route ORDER BY document_id))::INT AS rank FROM (SELECT DISTINCT request_id, route, document_id FROM r)",
    "win.latest_per_key": "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1",
    "win.prior_messages": cte("messages") + ", p AS (SELECT i.session_id, i.sequence_no AS input_no, m.message_id, (row_number() OVER (PARTITION BY i.session_id, i.sequence_no ORDER BY m.sequence_no DESC))::INT AS rank FROM messages i JOIN messages m ON m.session_id = i.session_id AND m.sequence_no < i.sequence_no WHERE i.role = 'user') SELECT * FROM p WHERE rank <= 6",
    "win.neighbors": cte("messages") + " SELECT a.message_id, count(*) AS near, min(b.message_id) AS first, max(b.message_id) AS last FROM messages a JOIN messages b ON b.session_id = a.session_id AND b.sequence_no BETWEEN a.sequence_no - 2 AND a.sequence_no + 2 GROUP BY 1",
    "win.first_last_n": cte("messages") + ", n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sequence_no) AS a, row_number() OVER (PARTITION BY session_id ORDER BY sequence_no DESC) AS b FROM messages) SELECT session_id, message_id, 'first' AS part FROM n WHERE a <= 5 UNION ALL SELECT session_id, message_id, 'last' FROM n WHERE b <= 5",
    "win.running_budget": "WITH RECURSIVE " + _C + ", " + _FOLD.format(limit=1000) + " SELECT request_id, document_id, verdict FROM f",
    "win.keyset_page": "SELECT o_orderdate, o_orderkey FROM orders WHERE (o_orderdate, o_orderkey) > (date '1995-06-01', 1000) ORDER BY 1, 2 LIMIT 64",
    "win.sample_recent": cte("samples") + " SELECT event_id, duration_ms FROM samples WHERE status = 'view' ORDER BY created_at DESC, event_id DESC LIMIT 200",
    "win.sequence_assign": cte("messages") + ", k AS (SELECT session_id, max(sequence_no) AS last_no FROM messages GROUP BY 1) SELECT event_id, user_id % 120 AS session_id, coalesce(last_no, 0) + row_number() OVER (PARTITION BY user_id % 120 ORDER BY event_id) AS sequence_no FROM events LEFT JOIN k ON session_id = user_id % 120",
    "top.vector_knn": _KNN + " SELECT query_id, document_id, rank, round(distance, 5) AS distance FROM t WHERE rank <= 60",
    "top.entity": "WITH t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS k FROM part), h AS (SELECT DISTINCT a.p_partkey AS request_id, b.p_partkey AS document_id FROM t a JOIN t b USING (k) WHERE a.p_partkey % 50 = 0), n AS (SELECT *, (row_number() OVER (PARTITION BY request_id ORDER BY document_id))::INT AS rank FROM h) SELECT * FROM n WHERE rank <= 20",
    "top.strategy": "WITH t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS k FROM part), h AS (SELECT a.p_partkey AS request_id, b.p_partkey AS document_id, count(DISTINCT k) AS matched_terms FROM t a JOIN t b USING (k) WHERE a.p_partkey % 50 = 0 GROUP BY 1, 2 HAVING count(DISTINCT k) >= 2), n AS (SELECT *, (row_number() OVER (PARTITION BY request_id ORDER BY matched_terms DESC, document_id))::INT AS rank FROM h) SELECT * FROM n WHERE rank <= 10",
    "top.provenance": f"WITH {_R}, o AS (SELECT request_id, document_id * 3 % 40 AS document_id, min(rank) AS best FROM r GROUP BY 1, 2), n AS (SELECT *, (row_number() OVER (PARTITION BY request_id ORDER BY best, document_id))::INT AS rank FROM o) SELECT * FROM n WHERE rank <= 10",
    "top.candidate_order": f"WITH {_C} SELECT request_id, document_id, (row_number() OVER (PARTITION BY request_id ORDER BY (document_id % 3 = 0)::INT, round(rrf, 12) DESC, document_id))::INT AS rank FROM c",
    "top.budgeted": "WITH RECURSIVE " + _C + ", " + _FOLD.format(limit=10) + " SELECT request_id, count(*) FILTER (WHERE verdict = 'selected') AS selected, count(*) FILTER (WHERE verdict = 'limit') AS candidate_limit_exceeded, count(*) FILTER (WHERE verdict = 'token_budget') AS candidate_token_budget_exceeded FROM f GROUP BY 1",
    "top.rank_accepted": f"WITH {_C} SELECT request_id, document_id, (row_number() OVER (PARTITION BY request_id ORDER BY document_id % 3 DESC, (document_id % 7 = 0)::INT, (document_id % 5 = 0)::INT, document_id % 2 DESC, document_id % 4 DESC, round(rrf, 12) DESC, CASE WHEN document_id % 4 <> 0 THEN document_id * 13 % 31 END DESC NULLS LAST, document_id))::INT AS rank FROM c WHERE document_id % 3 >= 1",
    "top.nearest_2_per_session": KNN + ", p AS (SELECT query_id, 1 - distance AS primary_similarity FROM t WHERE rank = 1), n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY document_id DESC) AS r FROM docs), s AS (SELECT q.query_id, n.session_id AS other_session, n.document_id, list_cosine_similarity(n.embedding, q.embedding) AS similarity FROM n, requests q WHERE n.r <= 200 AND (n.session_id - q.session_id + 20) % 20 BETWEEN 1 AND 12), b AS (SELECT *, (row_number() OVER (PARTITION BY query_id, other_session ORDER BY similarity DESC, document_id))::INT AS rank FROM s) SELECT query_id, other_session, document_id, rank FROM b LEFT JOIN p USING (query_id) WHERE rank <= 2 AND similarity >= greatest(0.3, 0.8 * coalesce(primary_similarity, 1))",
    "top.continuity_candidates": cte("messages") + """, s AS (SELECT DISTINCT session_id, session_id % 5 AS project_id, session_id % 3 AS employee_id, session_id * 7 % 50 AS started_at FROM messages),
        i AS (SELECT session_id, project_id, 'issue' AS t, session_id % 7 AS k FROM s UNION ALL SELECT session_id, project_id, 'pr', 1 FROM s WHERE session_id % 3 = 0),
        l AS (SELECT session_id AS a, session_id + 5 AS b FROM s WHERE session_id % 4 = 0), g AS (SELECT session_id AS a, session_id - 10 AS b FROM s WHERE session_id % 6 = 0),
        p AS (SELECT x.session_id, y.session_id AS candidate, y.started_at, x.employee_id = y.employee_id AND y.started_at <= x.started_at AS near, EXISTS (SELECT 1 FROM i u JOIN i v USING (t, k) WHERE u.session_id = x.session_id AND v.session_id = y.session_id) AS shares
            FROM s x JOIN s y ON x.project_id = y.project_id AND x.session_id <> y.session_id WHERE NOT EXISTS (SELECT 1 FROM l WHERE (a = x.session_id AND b = y.session_id) OR (b = x.session_id AND a = y.session_id))),
        c AS (SELECT session_id, candidate, 0 AS part, row_number() OVER (PARTITION BY session_id ORDER BY started_at DESC, candidate DESC) AS place FROM p WHERE near QUALIFY place <= 3
            UNION ALL SELECT session_id, candidate, 1, row_number() OVER (PARTITION BY session_id ORDER BY started_at DESC, candidate DESC) AS place FROM p WHERE shares QUALIFY place <= 6),
        f AS (SELECT session_id, candidate, min(part * 100 + place) AS spot FROM c GROUP BY 1, 2), r AS (SELECT session_id, candidate, (row_number() OVER (PARTITION BY session_id ORDER BY spot))::INT AS rank FROM f)
        SELECT * FROM r WHERE rank <= 6 AND NOT EXISTS (SELECT 1 FROM g WHERE (a = session_id AND b = candidate) OR (b = session_id AND a = candidate))""",
    "top.job_claim": streams.JOBS + " SELECT id, kind, priority FROM claimable WHERE kind IN ('classify_message', 'build_documents') ORDER BY priority DESC, created_at, id LIMIT 25",
    "top.outbox": cte("messages") + " SELECT message_id, session_id FROM messages ORDER BY session_id, sequence_no, message_id LIMIT 100",
    "top.nulls_last": "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END DESC NULLS LAST, o_orderkey) AS n FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE n = 1",
    "win.distinct_prefix": DISTINCT + " SELECT query_id, document_id, rank FROM kept",
}
