"""Queries of the support operators (inventory: support operators)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadlens.operators import aggregates as agg
from threadlens.operators import filters, judging, providers
from threadlens.operators import joins as op
from threadlens.plans import texts
from threadlens.plans.base import analysis, cte, documents, messages, relations
from threadlens.session import table
from threadlens.sources.sinks import outcome


def tenant_check(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey", "left_semi").select("c_custkey")


def session_upsert(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 300).alias("source_key"), (F.col("o_custkey") % 2).alias("project_id"), "o_orderkey")
    return o.groupBy("source_key").agg(F.min_by("project_id", "o_orderkey").alias("project_id"), (F.count_distinct("project_id") > 1).alias("conflict"))


def message_insert(spark, d):
    old = messages(spark, d).where("message_id % 4 <> 0").select("message_id", "role")
    return op.inserted_once(old, messages(spark, d).select("message_id", "role"), ["message_id"], [F.col("role")])


def auto_request(spark, d):
    m = messages(spark, d).where("role = 'user'")
    return m.where(filters.fresh(F.lit(0), F.col("sequence_no") * 200)).select("message_id", F.lit("initial-v1").alias("policy_version")).dropDuplicates(["message_id"])


def link_evidence(spark, d):
    m = messages(spark, d).select("message_id", "session_id")
    asked = messages(spark, d).select(F.col("session_id").alias("id")).distinct().select((F.col("id") * 1000 + 1).alias("message_id"), F.sha2(F.to_json(F.struct(F.col("id").alias("from"), (F.col("id") + 1).alias("to"))), 256).alias("condition_hash"))
    return asked.join(m, "message_id").select("message_id", "session_id", "condition_hash")


def request_rows(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    a, b = o.alias("a"), o.select(F.col("o_orderkey").alias("origin_id"), "o_custkey", "o_orderstatus").alias("b")
    pick = a.withColumn("origin_id", F.col("o_orderkey") - 40)
    return pick.join(b, ["origin_id", "o_custkey", "o_orderstatus"]).select("o_orderkey", "origin_id")


def result_parts(spark, d):
    id_ = F.col("o_orderkey")
    j = table(spark, d, "orders").select(id_.alias("request_id"), F.when(id_ % 3 == 0, "completed").otherwise("failed").alias("status"), F.when(id_ % 2 == 0, "matched").otherwise("no_match").alias("outcome"), F.sequence(F.lit(1), (id_ % 4 + 1).cast("int")).alias("matches"))
    done = F.col("status") == "completed"
    return j.select("request_id", F.when(done & (F.col("outcome") == "matched"), F.size("matches")).otherwise(0).alias("n_matches"), done.alias("has_warnings"))


def input_valid(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    now = o.select("o_orderkey", (F.col("o_custkey") + F.when(F.col("o_orderkey") % 10 == 0, 1).otherwise(0)).alias("custkey"), F.when(F.col("o_orderkey") % 15 == 0, "X").otherwise(F.col("o_orderstatus")).alias("orderstatus"))
    return o.join(now, "o_orderkey").select("o_orderkey", (F.struct("o_custkey", "o_orderstatus") == F.struct(F.col("custkey").alias("o_custkey"), F.col("orderstatus").alias("o_orderstatus"))).alias("valid"))


def relation_tuples(spark, d):
    m = messages(spark, d).join(relations(spark, d).groupBy(F.col("from_id").alias("message_id")).agg(F.collect_list("to_id").alias("many")), "message_id", "left")
    listed = F.when(F.size("many") > 0, F.col("many")).otherwise(F.array(F.col("message_id") - 1))
    return m.select("message_id", F.explode(listed).alias("target_id"))


def assign_guard(spark, d):
    from threadlens.functions import redaction

    t = F.concat(F.lit("API_KEY="), F.element_at(F.array(F.lit("[REDACTED:jwt]"), F.lit("$HOME"), F.lit("${X_Y}"), F.lit("plain")), (F.col("sequence_no") % 4 + 1).cast("int")))
    return messages(spark, d).select("message_id", redaction.redact_credentials(t).alias("text"))


def hook_message(spark, d):
    e = table(spark, d, "events")
    kind = F.when((F.col("event_type") == "view") & (F.col("event_id") % 2 == 0), "prompt").when(F.col("event_type") == "click", "transcript").when(F.col("event_type") == "error", "stop").otherwise("ignored")
    return e.select("event_id", kind.alias("kind"))


def record_dispatch(spark, d):
    rows = texts.jsonl_claude(spark, d).select((F.col("conv_id") % 40).alias("file"), "kind", F.when(F.col("conv_id") % 13 == 0, 1).otherwise(0).alias("mismatch"))
    held = rows.groupBy("file").agg(F.max("mismatch").alias("m")).where("m = 1").select("file")
    return rows.join(held, "file", "left_anti").groupBy("file").agg(F.count_if(F.col("kind") == "message").alias("messages"), F.count("*").alias("lines"))


def hook_ingest(spark, d):
    e = table(spark, d, "events").withColumn("message", F.col("event_id") % 400)
    return e.groupBy("message").agg(F.min_by("value", "event_id").alias("observed"), F.count("*").alias("seen"))


def source_registry(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.max(F.col("event_type") == "signup").alias("registered"), F.max_by("event_type", "event_id").alias("last_kind"))


def policy_resolve(spark, d):
    n = table(spark, d, "nation")
    server, cached = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey")), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey"))
    return n.select("n_nationkey", F.coalesce(server, cached).alias("policy"), F.coalesce(server, cached).isNull().alias("held"))


def repo_resolve(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct(F.col("l_suppkey") % 2).alias("n"), F.min(F.col("l_suppkey") % 2).alias("repo"))
    return li.select("l_orderkey", F.when(F.col("n") == 1, F.col("repo")).alias("repo"))


def collector_keys(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.sha2(F.concat(F.lit("https://api"), F.sha2(F.col("c_custkey").cast("string"), 256)), 256).alias("namespace"))


def diagnostics(spark, d):
    return table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 5).alias("place")).agg(F.count("*").alias("n"))


def notify_state(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return agg.first_of(e, ["user_id"], [F.col("event_id")]).select("user_id", "event_id")


def outbox_gates(spark, d):
    e = table(spark, d, "events")
    failed, waiting = e.where("event_type = 'error'").select("user_id").where("user_id % 5 = 0"), e.where("value > 150").select("user_id")
    left = e.join(failed.distinct(), "user_id", "left_anti").join(waiting.distinct(), "user_id", "left_anti")
    status = F.element_at(F.array(F.lit(202), F.lit(429), F.lit(503), F.lit(400)), (F.col("event_id") % 4 + 1).cast("int"))
    return left.select("event_id", outcome(status).alias("outcome"))


def judge_request(spark, d):
    """The questions of every message's request, in order: those of user inputs also ask for the search, those after a search for its conditions."""
    m = messages(spark, d)
    prior = F.collect_list("message_id").over(Window.partitionBy("session_id").orderBy("sequence_no").rowsBetween(-2, -1))
    user = F.col("role") == "user"
    ids = judging.question_ids(F.col("prior"), user & (F.col("message_id") % 4 == 0), user)
    return m.select("message_id", "role", F.reverse(prior).alias("prior")).select("message_id", F.array_join(ids, " ").alias("questions"))


def provider_parse(spark, d):
    return providers.classified(texts._answers(spark, d), F.lit(texts._NOW)).where("code IS NULL").select("event_id", "model", "input_tokens", "output_tokens")


def usage_log(spark, d):
    """Attempts and tokens by model, failed attempts under their code; what a provider didn't say counts as nothing."""
    rows = providers.classified(texts._answers(spark, d), F.lit(texts._NOW))
    return rows.groupBy(F.coalesce("code", "model").alias("entry")).agg(F.count("*").alias("attempts"), F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"), F.count_if(F.col("retryable")).alias("retryable"))


def prior_search(spark, d):
    m = messages(spark, d).where("role = 'user'").select("session_id", "sequence_no", "message_id")
    near = op.asof_latest(m, m.select("session_id", F.col("sequence_no").alias("input_no"), F.col("message_id").alias("request_id"), F.col("message_id").alias("created_at")), "session_id", "sequence_no", "input_no", "created_at")
    return near.select("message_id", F.col("near_request_id").alias("prior_id"))


def error_map(spark, d):
    codes = spark.createDataFrame([("error", "provider_failed", True), ("view", "timeout", True), ("signup", "invalid", False)], "event_type string, code string, retryable boolean")
    return table(spark, d, "events").join(F.broadcast(codes), "event_type", "left").select("event_id", F.coalesce("code", F.lit("internal")).alias("code"), F.coalesce("retryable", F.lit(False)).alias("retryable"))


def search_failed(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    jobs = table(spark, d, "lineitem").where("l_linenumber = 7").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("F!").alias("o_orderstatus")).distinct()
    return op.updated_from(o, jobs, ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


def retry(spark, d):
    o = table(spark, d, "orders")
    ok = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("approved"))
    met = o.join(ok, "o_custkey", "left")
    return met.select("o_orderkey", F.when((F.col("o_orderstatus") == "F") & F.coalesce("approved", F.lit(False)), "pending").otherwise(F.col("o_orderstatus")).alias("status"))


def request_state(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "F", "finish_job").otherwise("load").alias("step"))


def candidate_sources(spark, d):
    picked = documents(spark, d).select(F.col("session_id"), F.col("document_id"))
    m = messages(spark, d).join(analysis(spark, d), "message_id", "left")
    return picked.join(m, "session_id").select("document_id", "message_id", "role", "statement_status", "sequence_no")


def session_load(spark, d):
    m = messages(spark, d).join(analysis(spark, d), "message_id", "left").join(relations(spark, d).select(F.col("to_id").alias("message_id")).distinct().withColumn("gone", F.lit(True)), "message_id", "left")
    return m.select("message_id", "session_id", "sequence_no", "retention_category", F.coalesce("gone", F.lit(False)).alias("invalidated"))


def source_compare(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("now"))
    was = F.when(F.col("l_orderkey") % 3 == 0, F.slice("now", 1, 1)).otherwise(F.col("now"))
    return li.select("l_orderkey", (was == F.col("now")).alias("same"))


def generation_rows(spark, d):
    return table(spark, d, "nation").where("n_nationkey % 2 = 0").select("n_nationkey", F.sha2(F.concat_ws("|", "n_name", F.lit("64"), F.lit("cosine")), 256).alias("spec"))


def run_state(spark, d):
    runs = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return op.top_per_key(runs.where("o_orderstatus <> 'F'"), ["o_custkey"], [F.col("o_orderkey").desc()], 1).select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "P", "resume").otherwise("wait").alias("action"))


def continuity_job(spark, d):
    return messages(spark, d).groupBy("session_id").agg(F.min("message_id").alias("trigger"))


def reuse_evidence(spark, d):
    rows = messages(spark, d).select("message_id", F.when(F.col("message_id") % 4 == 0, "broken{").when(F.col("message_id") % 4 == 1, '{"matches":[]}').otherwise(F.concat(F.lit('{"matches":[{"id":'), F.col("message_id"), F.lit(',"revision":1}]}'))).alias("result"))
    parsed = F.from_json("result", "struct<matches:array<struct<id:bigint,revision:int>>>")["matches"]
    return rows.select("message_id", (F.coalesce(F.size(parsed), F.lit(0)) > 0).alias("reusable"))


def eval_seed(spark, d):
    cases = table(spark, d, "supplier").select(F.col("s_suppkey").alias("case_id"), (F.col("s_suppkey") * 3 % 100).alias("session_id"))
    return cases.join(messages(spark, d).select("session_id", "message_id"), "session_id").groupBy("case_id").agg(F.count("*").alias("sources"))


def known_secrets(spark, d):
    from threadlens.functions.redaction import secrets_problems

    cases = {"good": ["abcdefgh"], "short": ["abc"], "twice": ["abcdefgh", "abcdefgh"]}
    return spark.createDataFrame([(k, ",".join(secrets_problems(v))) for k, v in cases.items()], "name string, problems string")


def atoms(spark, d):
    from threadlens.functions import chunking

    # an empty text has no atoms, and none of them is too long; a null one covers nothing that is known
    find = F.udf(lambda t: None if t is None else [(a.start, a.end, a.tokens) for a in chunking.atoms_of([(0, 1, t)], chunking.words_and_signs)], "array<struct<a:int,b:int,tokens:int>>", useArrow=True)
    return table(spark, d, "documents").select("doc_id", find("text").alias("s")).select("doc_id", F.aggregate("s", F.lit(0), lambda x, y: x + y["b"] - y["a"]).alias("covered"), F.coalesce(F.forall("s", lambda y: y["tokens"] <= 1067), F.lit(True)).alias("within"))


def collector_state(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.max("event_id").alias("cursor"), F.count_distinct("event_type").alias("versions"))


def dispatch(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "classify").when(F.col("event_type") == "click", "search").when(F.col("event_type") == "error", "build").otherwise("continuity")
    return e.groupBy(kind.alias("processor")).agg(F.count("*").alias("jobs"))


def ann_plumbing(spark, d):
    docs = documents(spark, d).groupBy("project_id").agg(F.count("*").alias("n"))
    return docs.select("project_id", F.concat(F.lit("index_"), F.substring(F.sha2(F.col("project_id").cast("string"), 256), 1, 16)).alias("name"), (F.col("n") > 20).alias("valid"))


def admin_cli(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("company_id"), "s_suppkey")
    last = Window.partitionBy("company_id").orderBy(F.col("s_suppkey").desc())
    return s.select("company_id", "s_suppkey", (F.row_number().over(last) == 1).alias("active"))


NAMES = (
    tenant_check, session_upsert, message_insert, auto_request, link_evidence, request_rows, result_parts, input_valid, relation_tuples, assign_guard, hook_message, record_dispatch, hook_ingest, source_registry, policy_resolve, repo_resolve, collector_keys,
    diagnostics, notify_state, outbox_gates, judge_request, provider_parse, usage_log, prior_search, error_map, search_failed, retry, request_state, candidate_sources, session_load, source_compare, generation_rows, run_state, continuity_job, reuse_evidence, eval_seed, admin_cli, known_secrets, atoms, collector_state, dispatch, ann_plumbing,
)
QUERIES = {f"sp.{f.__name__}": f for f in NAMES}

ORACLES = {
    "sp.tenant_check": "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "sp.session_upsert": "SELECT o_custkey % 300 AS source_key, arg_min(o_custkey % 2, o_orderkey) AS project_id, count(DISTINCT o_custkey % 2) > 1 AS conflict FROM orders GROUP BY 1",
    "sp.message_insert": cte("messages") + " SELECT message_id, role FROM messages",
    "sp.auto_request": cte("messages") + " SELECT message_id, 'initial-v1' AS policy_version FROM messages WHERE role = 'user' AND sequence_no * 200 <= 600",
    "sp.link_evidence": cte("messages") + " SELECT message_id, session_id, sha256('{\"from\":' || range || ',\"to\":' || range + 1 || '}') AS condition_hash FROM (SELECT DISTINCT session_id AS range FROM messages) JOIN messages ON message_id = range * 1000 + 1",
    "sp.request_rows": "SELECT a.o_orderkey, b.o_orderkey AS origin_id FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey - 40 AND a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus",
    "sp.result_parts": "SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN (o_orderkey % 4 + 1)::INT ELSE 0 END AS n_matches, o_orderkey % 3 = 0 AS has_warnings FROM orders",
    "sp.input_valid": "SELECT o_orderkey, o_orderkey % 10 <> 0 AND o_orderkey % 15 <> 0 AS valid FROM orders",
    "sp.relation_tuples": cte("messages", "relations") + " SELECT message_id, coalesce(to_id, message_id - 1) AS target_id FROM messages LEFT JOIN relations ON from_id = message_id",
    "sp.assign_guard": cte("messages") + " SELECT message_id, 'API_KEY=' || ['[REDACTED:jwt]', '$HOME', '${X_Y}', '[REDACTED:env_value]'][sequence_no % 4 + 1] AS text FROM messages",
    "sp.hook_message": "SELECT event_id, CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'prompt' WHEN event_type = 'click' THEN 'transcript' WHEN event_type = 'error' THEN 'stop' ELSE 'ignored' END AS kind FROM events",
    "sp.record_dispatch": "WITH r AS (SELECT conv_id % 40 AS file, role <> 'system' AND turn % 7 <> 6 AS m, conv_id % 13 = 0 AS bad FROM conversations) SELECT file, count(*) FILTER (WHERE m) AS messages, count(*) AS lines FROM r GROUP BY 1 HAVING NOT bool_or(bad)",
    "sp.hook_ingest": "SELECT event_id % 400 AS message, arg_min(value, event_id) AS observed, count(*) AS seen FROM events GROUP BY 1",
    "sp.source_registry": "SELECT user_id, bool_or(event_type = 'signup') AS registered, arg_max(event_type, event_id) AS last_kind FROM events GROUP BY 1",
    "sp.policy_resolve": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey WHEN n_nationkey % 2 = 0 THEN n_regionkey END AS policy, n_nationkey % 3 <> 0 AND n_nationkey % 2 <> 0 AS held FROM nation",
    "sp.repo_resolve": "SELECT l_orderkey, CASE WHEN count(DISTINCT l_suppkey % 2) = 1 THEN min(l_suppkey % 2) END AS repo FROM lineitem GROUP BY 1",
    "sp.collector_keys": "SELECT c_custkey, sha256('https://api' || sha256(c_custkey::VARCHAR)) AS namespace FROM customer",
    "sp.diagnostics": "SELECT event_type, user_id % 5 AS place, count(*) AS n FROM events GROUP BY ALL",
    "sp.notify_state": "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1",
    "sp.outbox_gates": "SELECT event_id, ['acknowledged', 'retry', 'retry', 'permanent'][event_id % 4 + 1] AS outcome FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id % 5 = 0) AND user_id NOT IN (SELECT user_id FROM events WHERE value > 150)",
    "sp.judge_request": cte("messages") + """, p AS (SELECT message_id, role, lag(message_id) OVER w AS a, lag(message_id, 2) OVER w AS b FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY sequence_no)) SELECT message_id, concat_ws(' ', 'retention#0 decision_action#0 continuity#0 statement_status#0', CASE WHEN role = 'user' THEN 'search_action#0' END,
        'relation_target#0 strategy:state_hazard#0 strategy:consistency_strategy#0 strategy:lifecycle_strategy#0 strategy:failure_strategy#0 strategy:performance_strategy#0 strategy:scope_invariant#0 strategy:evidence_strategy#0', CASE WHEN role = 'user' AND message_id % 4 = 0 THEN 'same_conditions#0' END, 'relation_explicit:' || a || '#0', 'relation_explicit:' || b || '#0') AS questions FROM p""",
    "sp.provider_parse": texts._PROVIDER + " SELECT event_id, 'm' || user_id % 3 AS model, user_id::BIGINT AS input_tokens, CASE WHEN event_id % 5 >= 1 THEN event_id % 5 - 1 END::BIGINT AS output_tokens FROM c WHERE code IS NULL",
    "sp.usage_log": texts._PROVIDER + """, k AS (SELECT code, status, event_id % 13 = 0 AND event_id % 7 <> 0 AS half, event_id % 7 = 0 AS broken, user_id FROM c) SELECT coalesce(code, 'm' || user_id % 3) AS entry, count(*) AS attempts, sum(CASE WHEN status BETWEEN 200 AND 299 AND NOT broken THEN CASE WHEN half THEN 5 ELSE user_id END ELSE 0 END)::BIGINT AS input_tokens, count(*) FILTER (WHERE code IN ('provider_timeout', 'provider_unavailable', 'provider_rate_limited')) AS retryable FROM k GROUP BY 1""",
    "sp.prior_search": cte("messages") + " SELECT message_id, lag(message_id) OVER (PARTITION BY session_id ORDER BY sequence_no) AS prior_id FROM messages WHERE role = 'user'",
    "sp.error_map": "SELECT event_id, CASE event_type WHEN 'error' THEN 'provider_failed' WHEN 'view' THEN 'timeout' WHEN 'signup' THEN 'invalid' ELSE 'internal' END AS code, event_type IN ('error', 'view') AS retryable FROM events",
    "sp.search_failed": "SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7) THEN 'F!' ELSE o_orderstatus END AS o_orderstatus FROM orders",
    "sp.retry": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'pending' ELSE o_orderstatus END AS status FROM orders",
    "sp.request_state": "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'F' THEN 'finish_job' ELSE 'load' END AS step FROM orders",
    "sp.candidate_sources": cte("messages", "analysis", "docs") + " SELECT document_id, message_id, role, statement_status, m.sequence_no FROM docs d JOIN messages m ON m.session_id = d.session_id LEFT JOIN analysis USING (message_id)",
    "sp.session_load": cte("messages", "analysis", "relations") + " SELECT message_id, session_id, sequence_no, retention_category, message_id IN (SELECT to_id FROM relations) AS invalidated FROM messages LEFT JOIN analysis USING (message_id)",
    "sp.source_compare": "SELECT l_orderkey, l_orderkey % 3 <> 0 OR count(*) = 1 AS same FROM lineitem GROUP BY 1",
    "sp.generation_rows": "SELECT n_nationkey, sha256(n_name || '|64|cosine') AS spec FROM nation WHERE n_nationkey % 2 = 0",
    "sp.run_state": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, CASE arg_max(o_orderstatus, o_orderkey) WHEN 'P' THEN 'resume' ELSE 'wait' END AS action FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1",
    "sp.continuity_job": cte("messages") + " SELECT session_id, min(message_id) AS trigger FROM messages GROUP BY 1",
    "sp.reuse_evidence": cte("messages") + " SELECT message_id, message_id % 4 >= 2 AS reusable FROM messages",
    "sp.eval_seed": cte("messages") + " SELECT s_suppkey AS case_id, count(*) AS sources FROM supplier JOIN messages ON session_id = s_suppkey * 3 % 100 GROUP BY 1",
    "sp.known_secrets": "SELECT * FROM (VALUES ('good', ''), ('short', 'secret_length'), ('twice', 'duplicate_secret')) t(name, problems)",
    "sp.atoms": "SELECT doc_id, length(text)::INT AS covered, true AS within FROM documents",
    "sp.collector_state": "SELECT user_id, max(event_id) AS cursor, count(DISTINCT event_type) AS versions FROM events GROUP BY 1",
    "sp.dispatch": "SELECT CASE event_type WHEN 'view' THEN 'classify' WHEN 'click' THEN 'search' WHEN 'error' THEN 'build' ELSE 'continuity' END AS processor, count(*) AS jobs FROM events GROUP BY 1",
    "sp.ann_plumbing": "SELECT label AS project_id, 'index_' || substring(sha256(label::VARCHAR), 1, 16) AS name, count(*) > 20 AS valid FROM embeddings GROUP BY 1",
    "sp.admin_cli": "SELECT s_nationkey AS company_id, s_suppkey, s_suppkey = max(s_suppkey) OVER (PARTITION BY s_nationkey) AS active FROM supplier",
}
