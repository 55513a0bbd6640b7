"""Queries of views, requests, documents, generations, caches and administration (inventory: lifecycle operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions import identifiers
from threadlens.operators import generations as gen
from threadlens.operators import graph
from threadlens.operators import joins as op
from threadlens.operators import lifecycle as lc
from threadlens.plans.base import analysis, cte, documents, messages, relations
from threadlens.session import table
from threadlens.sources import keyed
from threadlens.work import Workspace


def revalidate_matches(spark, d):
    e = messages(spark, d).where("role = 'user'").select(F.col("message_id").alias("request_id"), F.explode(F.array((F.col("session_id") + 1) % 100 * 1000 + 1, F.col("message_id") + 1)).alias("message_id"))
    current = messages(spark, d).select("message_id").join(relations(spark, d).where("relation = 'revoke'").select(F.col("to_id").alias("message_id")), "message_id", "left_anti").withColumn("ok", F.lit(True))
    return e.join(current, "message_id", "left").groupBy("request_id").agg(F.count_if(F.coalesce("ok", F.lit(False))).alias("valid"), F.count("*").alias("evidence"))


def build_view(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"), (F.col("o_orderkey") % 50).alias("expires_at"), F.lit(1).alias("revision"), F.when(F.col("o_orderkey") % 9 != 0, F.when(F.col("o_orderkey") % 7 == 0, 2).otherwise(1)).alias("current"), F.when(F.col("o_orderkey") % 2 == 0, "matched").otherwise("no_match").alias("outcome"), (F.col("o_orderkey") % 4).alias("valid"))
    return o.select("o_orderkey", lc.view_status(F.col("status"), F.col("expires_at"), F.col("revision"), F.col("current"), F.lit(10)).alias("status"), lc.view_outcome(F.col("outcome"), F.col("valid")).alias("outcome"))


def lookup(spark, d):
    asked = table(spark, d, "lineitem").select((F.col("l_orderkey") + F.col("l_linenumber") % 2 * F.col("l_partkey")).alias("o_orderkey")).distinct()
    return asked.join(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "left").select("o_orderkey", F.coalesce("o_orderstatus", F.lit("not_received")).alias("status"))


def create(spark, d):
    m = messages(spark, d).where("role = 'user'").select("message_id", "session_id", "text")
    asked = m.select("message_id", F.when(F.col("message_id") % 3 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("question"), (F.col("message_id") % 5 == 0).alias("force_new"), (F.col("message_id") % 7 == 0).alias("primary_only"), (F.col("message_id") % 1000).alias("idempotency_key"))
    met = asked.join(m.select("message_id", F.col("text").alias("input_text")), "message_id")
    return lc.manual_requests(met, ["idempotency_key"], "message_id").select("message_id", "decision")


def routed(spark, d):
    e = table(spark, d, "events")
    action = F.when(F.col("event_type") == "view", "skip").when(F.col("event_type") == "click", "reuse").otherwise("new_search")
    return e.select("event_id", lc.route(action, F.col("user_id") % 2 == 0, F.col("value") > 5).alias("route"))


def reuse_chain(spark, d):
    e = table(spark, d, "events")
    r = e.select(F.col("event_id").alias("request_id"), F.when((F.col("event_id") % 3 != 0) & (F.col("event_id") >= 7), F.col("event_id") - 7).alias("reused_from"), (F.col("event_type") != "error").alias("eligible"))
    return graph.reuse_origin(r)


def reconcile(spark, d):
    docs, old = table(spark, d, "documents"), table(spark, d, "labels")
    planned = docs.where("doc_id % 10 <> 3").select(F.col("doc_id").cast("string").alias("document_key"), F.when(F.col("doc_id") % 4 == 0, "new").otherwise("old").alias("content_hash"))
    existing = old.select(F.col("doc_id").cast("string").alias("document_key"), F.lit("old").alias("content_hash"), F.when(F.col("doc_id") % 5 == 0, "failed").when(F.col("doc_id") % 7 == 0, "pending").otherwise("ready").alias("status"), (F.col("doc_id") % 3 != 0).alias("searchable"))
    return lc.reconcile(planned, existing)


def publish_rule(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("l"))
    rows = li.select("l_orderkey", F.transform("l", lambda x: x["l_partkey"]).alias("new"))
    old = F.when(F.col("l_orderkey") % 2 == 0, F.slice("new", 1, 2)).otherwise(F.transform(F.slice("new", 1, 2), lambda x: x + 1))
    return rows.select("l_orderkey", lc.keeps_prefix(old, F.col("new")).alias("keep_stale"))


def embed_apply(spark, d):
    docs = documents(spark, d).select("document_id")
    r = docs.crossJoin(F.broadcast(spark.range(1, 3).select(F.col("id").cast("int").alias("revision")))).select("document_id", "revision", F.concat_ws("-", "document_id", "revision").alias("content_hash"), F.when(F.col("revision") == 1, "ready").otherwise("pending").alias("status"))
    got = docs.where("document_id % 3 <> 0").select("document_id", F.concat(F.col("document_id"), F.when(F.col("document_id") % 5 == 0, "-9").otherwise("-2")).alias("input_hash"))
    return lc.applied_embeddings(r, got).select("document_id", "revision", "status")


def fail_pending(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.md5("text").alias("hash"), F.when(F.col("doc_id") % 2 == 0, "pending").otherwise("ready").alias("status"))
    bad = rows.where("doc_id % 50 = 0").select("hash", F.lit("failed").alias("status"))
    hit = rows.where("status = 'pending'").join(bad.select("hash").distinct(), "hash", "left_semi").select("doc_id", F.lit("failed").alias("status"))
    return op.updated_from(rows.select("doc_id", "status"), hit, ["doc_id"])


def entities(spark, d):
    """Identifiers of every document, put in the place of those that an earlier text of it named."""
    n = F.col("document_id")
    named = lambda t: documents(spark, d).select("document_id", F.explode(identifiers.extract_entities(t)).alias("e")).select("document_id", "e.entity_type", "e.entity_key")
    old, new = F.concat(F.lit("see old/n"), n % 5, F.lit(".py and PR #"), n % 3), F.concat(F.lit("in lib/m"), n % 9, F.lit(".ts run_"), n % 4, F.lit("()"))
    path, before = Workspace(spark, "entities").path, named(old)
    keyed.created(before, path, ["document_id"])
    keyed.replaced(spark, path, before.schema, ["document_id"], named(new), gone=documents(spark, d).select("document_id"))
    return keyed.read(spark, path, before.schema).drop(keyed.BUCKET)


def _spec(n, odd):
    """The ten fields of a specification by a number; ``odd`` makes one of them differ."""
    values = {f: F.lit(f[:4]) for f in gen.SPEC} | {"model": F.concat(F.lit("m"), n % 3), "dimensions": F.when(n % 2 == 0, 64).otherwise(128), "normalization": F.when(odd, "none").otherwise(F.when(n % 5 != 0, "unit"))}
    return [values[f].alias(f) for f in gen.SPEC]


def ensure(spark, d):
    n = F.col("s_nationkey")
    asked = table(spark, d, "supplier").select(F.col("s_suppkey").alias("company_id"), *_spec(n, F.col("s_suppkey") % 7 == 0))
    have = table(spark, d, "supplier").where("s_suppkey % 3 <> 0").select((F.col("s_suppkey") * 10).alias("generation_id"), F.col("s_suppkey").alias("company_id"), F.when(F.col("s_suppkey") % 4 == 0, "retired").otherwise("active").alias("status"), *_spec(n, F.lit(False)))
    return gen.ensured(asked, have.unionByName(have.withColumn("generation_id", F.col("generation_id") + 1)))


def _runs(spark, d):
    runs = documents(spark, d).select("project_id").distinct().select(F.col("project_id").alias("run_id"), F.col("project_id").alias("company_id"), F.col("project_id").alias("generation_id"), F.when(F.col("project_id") == 4, gen.PASSES).otherwise(F.col("project_id")).alias("passes"))
    docs = documents(spark, d).select(F.col("project_id").alias("company_id"), "document_id", (F.col("document_id") % 2 + 1).alias("desired_revision"))
    done = docs.where("document_id % 3 <> 0 OR company_id = 2").select(F.col("company_id").alias("generation_id"), "document_id", F.when(F.col("document_id") % 7 == 0, 1).otherwise(F.col("desired_revision")).alias("revision"))
    return runs, gen.next_pages(docs, done, runs)


def reindex(spark, d):
    runs, pages = _runs(spark, d)
    last = pages.groupBy("run_id").agg(F.max("page").alias("last_page"))
    return gen.run_states(runs, pages).join(last, "run_id", "left")


def delete(spark, d):
    key = lambda t, c, where: table(spark, d, t).where(where).select(F.col(c).alias("generation_id"))
    guards = {"active": key("customer", "c_nationkey", "c_nationkey % 4 = 0"), "run": key("supplier", "s_nationkey", "s_nationkey % 5 = 0"), "request": key("customer", "c_nationkey", "c_nationkey % 7 = 0"), "retry_job": key("supplier", "s_nationkey", "s_suppkey = 3")}
    return gen.deletable(table(spark, d, "nation").select(F.col("n_nationkey").alias("generation_id")), guards)


def cache(spark, d):
    """Inputs that have to be embedded: those without an answer that is stored under their hash; they are stored, so none is left after."""
    hashed = table(spark, d, "documents").select(F.sha2("text", 256).alias("input_hash"), "doc_id")
    have = hashed.join(table(spark, d, "labels"), "doc_id", "left_semi").select("input_hash").distinct().withColumn("first_run", F.lit(False))
    path = Workspace(spark, "answers").path
    keyed.stored(have, path)
    out = keyed.answered(spark, path, have.schema, hashed.select("input_hash"), lambda missing: missing.withColumn("first_run", F.lit(True)))
    return out.where("first_run").select("input_hash")


def judge(spark, d):
    """Evaluations by their whole key: the same state judged with another model, policy or set of questions is another one."""
    key = lambda odd: [F.lit("c1").alias("company_id"), F.sha2(F.concat_ws("|", "role", "text"), 256).alias("state_hash"), F.lit("p").alias("provider"), F.when(odd, "m2").otherwise("m1").alias("model"), F.lit("initial-v1").alias("policy_version"), F.lit("q1").alias("question_set"), F.col("role").alias("purpose"), F.lit("e").alias("endpoint"), F.lit("a").alias("account_ref")]
    m = messages(spark, d)
    asked = m.select("message_id", *key(F.col("message_id") % 5 == 0))
    answers = m.where("message_id % 2 = 0").select(*key(F.lit(False)), F.length("text").alias("answer")).dropDuplicates(list(lc.JUDGED))
    return lc.cached(asked, answers, list(lc.JUDGED)).select("message_id", F.col("answer").isNotNull().alias("hit"), "answer")


def apply(spark, d):
    """Answers become the analysis; their relations hold only towards targets still at the revision that was judged; changed sessions are built again."""
    m = messages(spark, d).select("message_id", "session_id", "sequence_no", F.when(F.col("message_id") % 8 == 0, 2).otherwise(1).alias("current_revision"))
    answers = analysis(spark, d).where("message_id % 3 = 0").select("message_id", F.lit(1).alias("revision"), F.lit("judged").alias("statement_status"))
    found = relations(spark, d).where("from_id % 3 = 0").select("from_id", "to_id", F.lit(1).alias("to_revision"), "relation")
    out = lc.applied_judgments(analysis(spark, d).select("message_id", "statement_status"), answers, found, m)
    rows = lambda t, c: out[t].select(F.lit(t).alias("written"), F.concat_ws("|", *c).alias("key"))
    return rows("analysis", ["message_id", "statement_status"]).unionByName(rows("relations", ["from_id", "to_id", "relation"])).unionByName(rows("builds", ["session_id", "dirty_sequence"]))


def continuity(spark, d):
    """Pairs of sessions by the judge's answer: continuous only if it chose so, confidently enough."""
    pairs = messages(spark, d).groupBy("session_id").agg(F.sum("sequence_no").alias("n")).withColumn("candidate_session_id", F.col("session_id") - 1).where("candidate_session_id >= 0")
    answers = pairs.where("n % 11 <> 0").select("session_id", "candidate_session_id", F.when(F.col("n") % 3 == 0, "separate").when(F.col("n") % 7 == 0, "unknown").otherwise("continued").alias("choice"), (F.col("n") % 100 / 100).alias("confidence"))
    return lc.continuity_judgments(pairs, answers).select("session_id", "candidate_session_id", "continuous")


def link(spark, d):
    """Links asked for between sessions, each with a key: sent again they are the same link, with another content a conflict."""
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 450).alias("idempotency_key"), (F.col("event_id") % 900 % 90).alias("from_session"), (F.col("event_id") % 900 % 90 + F.when(F.col("event_id") % 900 % 50 == 0, 0).otherwise(5)).alias("to_session"), ((F.col("event_id") % 900 % 90 + F.col("event_id") % 900 % 3) * 1000 + 1).alias("evidence_id"))
    return lc.created_links(e, "event_id", messages(spark, d).select(F.col("message_id").alias("evidence_id"), F.col("session_id").alias("evidence_session"))).select("event_id", "verdict")


def last_admin(spark, d):
    """Removing a token must leave its company an administrator."""
    t = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("company_id"), (F.col("s_suppkey") % 4 == 0).alias("admin"))
    n = t.where("admin").groupBy("company_id").agg(F.count("*").alias("admins"))
    return t.join(n, "company_id", "left").select("s_suppkey", (F.col("admin") & (F.col("admins") == 1)).alias("protected"))


def projects(spark, d):
    own = table(spark, d, "customer").select(F.col("c_nationkey").alias("project_id")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()
    return own.join(table(spark, d, "nation").select(F.col("n_nationkey").alias("project_id"), "n_name"), "project_id")


def token(spark, d):
    known = table(spark, d, "customer").where("c_custkey % 10 <> 0").select(F.sha2(F.concat(F.lit("token-"), F.col("c_custkey")), 256).alias("token_hash"), "c_custkey", "c_nationkey")
    asked = table(spark, d, "orders").select("o_orderkey", F.sha2(F.concat(F.lit("token-"), F.col("o_custkey")), 256).alias("token_hash"))
    return asked.join(known, "token_hash").select("o_orderkey", "c_custkey", "c_nationkey")


QUERIES = {
    "vw.revalidate_matches": revalidate_matches, "vw.build_view": build_view, "vw.lookup": lookup, "rq.create": create, "rq.route": routed, "rq.reuse_chain": reuse_chain, "dc.reconcile": reconcile, "dc.publish_rule": publish_rule,
    "dc.embed_apply": embed_apply, "dc.fail_pending": fail_pending, "dc.entities": entities, "gn.ensure": ensure, "gn.reindex": reindex, "gn.delete": delete, "em.cache": cache, "cj.judge": judge, "cj.apply": apply, "ct.judge": continuity,
    "ln.create": link, "ad.tokens": last_admin, "ad.projects": projects, "au.token": token,
}

ORACLES = {
    "vw.revalidate_matches": cte("messages", "relations") + ", e AS (SELECT message_id AS request_id, unnest([(session_id + 1) % 100 * 1000 + 1, message_id + 1]) AS mid FROM messages WHERE role = 'user') SELECT request_id, count(*) FILTER (WHERE mid IN (SELECT message_id FROM messages) AND mid NOT IN (SELECT to_id FROM relations WHERE relation = 'revoke')) AS valid, count(*) AS evidence FROM e GROUP BY 1",
    "vw.build_view": "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 50 <= 10 THEN 'expired' WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'running' END AS status, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 4 <> 0 THEN 'matched' ELSE 'no_match' END AS outcome FROM orders",
    "vw.lookup": "WITH a AS (SELECT DISTINCT l_orderkey + l_linenumber % 2 * l_partkey AS k FROM lineitem) SELECT k AS o_orderkey, coalesce(o_orderstatus, 'not_received') AS status FROM a LEFT JOIN orders ON o_orderkey = k",
    "rq.create": cte("messages") + """, a AS (SELECT message_id, message_id % 1000 AS key, text || CASE WHEN message_id % 3 = 0 THEN '?' ELSE '' END AS q, message_id % 5 = 0 AS fn, message_id % 7 = 0 AS po FROM messages WHERE role = 'user'), f AS (SELECT key, arg_min((q, fn, po), message_id) AS was, min(message_id) AS first_id FROM a GROUP BY 1)
        SELECT message_id, CASE WHEN message_id <> first_id THEN CASE WHEN was = (q, fn, po) THEN 'repeated' ELSE 'conflict' END WHEN message_id % 3 <> 0 AND NOT fn AND NOT po THEN 'reuse_auto' ELSE 'new_manual' END AS decision FROM a JOIN f USING (key)""",
    "rq.route": "SELECT event_id, CASE WHEN event_type = 'view' THEN 'skip' WHEN event_type = 'click' AND user_id % 2 = 0 AND value > 5 THEN 'reuse' ELSE 'new_search' END AS route FROM events",
    "rq.reuse_chain": "WITH RECURSIVE r AS (SELECT event_id AS id, CASE WHEN event_id % 3 <> 0 AND event_id >= 7 THEN event_id - 7 END AS f, event_type <> 'error' AS ok FROM events), w AS (SELECT id AS request_id, id AS pos, f, ok, 0 AS n FROM r UNION ALL SELECT w.request_id, r.id, r.f, w.ok AND r.ok, n + 1 FROM w JOIN r ON r.id = w.f WHERE n < 10), l AS (SELECT request_id, arg_max(pos, n) AS pos, arg_max(ok, n) AS ok, arg_max(coalesce(f, -1), n) AS f FROM w GROUP BY 1) SELECT request_id, CASE WHEN ok AND f = -1 THEN pos END AS origin_id FROM l",
    "dc.reconcile": """WITH p AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'old' END AS h FROM documents WHERE doc_id % 10 <> 3) SELECT coalesce(p.doc_id, l.doc_id)::VARCHAR AS document_key, CASE WHEN l.doc_id IS NULL THEN 'insert' WHEN p.doc_id IS NULL THEN CASE WHEN l.doc_id % 3 <> 0 THEN 'exclude' ELSE 'none' END
        WHEN h = 'old' AND l.doc_id % 5 = 0 THEN 'retry' WHEN h = 'old' AND l.doc_id % 3 = 0 THEN 'revive' WHEN h = 'old' THEN 'same' WHEN l.doc_id % 5 <> 0 AND l.doc_id % 7 = 0 THEN 'replace_pending' ELSE 'new_revision' END AS action FROM p FULL JOIN labels l ON l.doc_id = p.doc_id""",
    "dc.publish_rule": "SELECT DISTINCT l_orderkey, l_orderkey % 2 = 0 AS keep_stale FROM lineitem",
    "dc.embed_apply": "SELECT vec_id AS document_id, r::INT AS revision, CASE WHEN vec_id % 3 <> 0 AND vec_id % 5 <> 0 THEN CASE r WHEN 1 THEN 'superseded' ELSE 'ready' END ELSE CASE r WHEN 1 THEN 'ready' ELSE 'pending' END END AS status FROM embeddings, (SELECT unnest([1, 2]) AS r)",
    "dc.fail_pending": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 50 = 0) THEN 'failed' WHEN doc_id % 2 = 0 THEN 'pending' ELSE 'ready' END AS status FROM documents",
    "dc.entities": "SELECT vec_id AS document_id, 'file' AS entity_type, 'lib/m' || vec_id % 9 || '.ts' AS entity_key FROM embeddings UNION ALL SELECT vec_id, 'function', 'run_' || vec_id % 4 || '()' FROM embeddings",
    "gn.ensure": "SELECT s_suppkey AS company_id, CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 0 AND s_suppkey % 7 <> 0 THEN s_suppkey * 10 END AS generation_id, NOT (s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 0 AND s_suppkey % 7 <> 0) AS created FROM supplier",
    "gn.reindex": "WITH m AS (SELECT label, count(*) FILTER (WHERE label <> 4 AND ((vec_id % 3 = 0 AND label <> 2) OR (vec_id % 7 = 0 AND vec_id % 2 = 1))) AS missing FROM embeddings GROUP BY 1) SELECT label AS run_id, CASE WHEN label = 4 THEN 'failed' WHEN missing = 0 THEN 'cutover' ELSE 'running' END AS state, missing, CASE WHEN missing > 0 THEN (missing - 1) // 64 END::INT AS last_page FROM m",
    "gn.delete": "SELECT n_nationkey AS generation_id, CASE WHEN n_nationkey % 4 = 0 AND n_nationkey IN (SELECT c_nationkey FROM customer) THEN 'active' WHEN n_nationkey % 5 = 0 AND n_nationkey IN (SELECT s_nationkey FROM supplier) THEN 'run' WHEN n_nationkey % 7 = 0 AND n_nationkey IN (SELECT c_nationkey FROM customer) THEN 'request' WHEN n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey = 3) THEN 'retry_job' END AS refused FROM nation",
    "em.cache": "SELECT DISTINCT sha256(text) AS input_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))",
    "cj.judge": cte("messages") + ", a AS (SELECT role, text, any_value(length(text))::INT AS answer FROM messages WHERE message_id % 2 = 0 GROUP BY 1, 2) SELECT message_id, answer IS NOT NULL AND message_id % 5 <> 0 AS hit, CASE WHEN message_id % 5 <> 0 THEN answer END AS answer FROM messages LEFT JOIN a USING (role, text)",
    "cj.apply": cte("messages", "analysis", "relations") + """, f AS (SELECT message_id FROM messages WHERE message_id % 3 = 0 AND message_id % 8 <> 0), r AS (SELECT * FROM relations WHERE from_id IN (SELECT message_id FROM f) AND to_id % 8 <> 0 AND to_id IN (SELECT message_id FROM messages))
        SELECT 'analysis' AS written, message_id || '|' || CASE WHEN message_id IN (SELECT message_id FROM f) THEN 'judged' ELSE statement_status END AS key FROM analysis UNION ALL SELECT 'relations', from_id || '|' || to_id || '|' || relation FROM r
        UNION ALL SELECT 'builds', session_id || '|' || min(sequence_no) FROM messages WHERE message_id IN (SELECT message_id FROM f UNION SELECT to_id FROM r) GROUP BY session_id""",
    "ct.judge": cte("messages") + ", p AS (SELECT session_id, sum(sequence_no) AS n FROM messages GROUP BY 1) SELECT session_id, session_id - 1 AS candidate_session_id, n % 11 <> 0 AND n % 3 <> 0 AND n % 7 <> 0 AND n % 100 / 100 >= 0.8 AS continuous FROM p WHERE session_id >= 1",
    "ln.create": cte("messages") + """, e AS (SELECT event_id, event_id % 450 AS key, event_id % 900 % 90 AS a, event_id % 900 % 90 + CASE WHEN event_id % 900 % 50 = 0 THEN 0 ELSE 5 END AS b, (event_id % 900 % 90 + event_id % 900 % 3) * 1000 + 1 AS ev FROM events), f AS (SELECT key, arg_min((a, b, ev), event_id) AS was, min(event_id) AS first_id FROM e GROUP BY 1)
        SELECT event_id, CASE WHEN event_id <> first_id THEN CASE WHEN was = (a, b, ev) THEN 'repeated' ELSE 'conflict' END WHEN a = b THEN 'same_session' WHEN m.message_id IS NULL THEN 'evidence_missing' WHEN m.session_id IN (a, b) THEN 'accepted' ELSE 'evidence_elsewhere' END AS verdict FROM e JOIN f USING (key) LEFT JOIN messages m ON m.message_id = ev""",
    "ad.tokens": "SELECT s_suppkey, s_suppkey % 4 = 0 AND count(*) FILTER (WHERE s_suppkey % 4 = 0) OVER (PARTITION BY s_nationkey) = 1 AS protected FROM supplier",
    "ad.projects": "SELECT n_nationkey AS project_id, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)",
    "au.token": "SELECT o_orderkey, c_custkey, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 10 <> 0",
}
