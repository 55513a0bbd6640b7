"""Queries of the streaming-like operators over batches (inventory: streaming-like and stateful operators)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadlens.functions import chunking
from threadlens.operators import filters, lifecycle, queue
from threadlens.operators import joins as op
from threadlens.operators.ingest import ingested
from threadlens.plans.base import cte, messages, relations
from threadlens.session import table
from threadlens.streaming import ingest as ing


def _events(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", (F.col("event_id") % 700).alias("key"), (F.col("event_id") % 1400 % 3).alias("body"), "ts", "value", "event_type")


def ingest(spark, d):
    """One batch of all events against what was stored before, as (written, key) rows of everything written or rejected."""
    e = table(spark, d, "events")
    rows = e.select(
        F.col("event_id").alias("arrival"), (F.col("event_id") % 3).alias("employee_id"), (F.col("event_id") % 700).alias("idempotency_key"), F.expr("event_id % 1400 % 3").alias("body_hash"), (F.col("event_id") % 300 % 40).alias("source_session_id"), (F.col("event_id") % 300).alias("source_message_id"),
        F.when(F.col("event_id") % 7 == 3, 4).otherwise(F.expr("cast(event_id div 600 + 1 AS int)")).alias("revision"), F.when(F.col("event_id") % 2 == 0, "user").otherwise("assistant").alias("role"), (F.col("event_id") % 300 + F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)).alias("sequence_no"), F.col("value").alias("occurred_at"),
    )
    seen = rows.where("arrival < 40").select("employee_id", "idempotency_key", (F.col("body_hash") % 2).alias("body_hash"))
    stored = rows.where("arrival < 300 AND arrival % 5 = 0").select("source_session_id", "source_message_id", F.lit(1).alias("revision"), "body_hash", "role", F.col("source_message_id").alias("sequence_no"))
    out = ingested(rows, seen, stored, F.lit(630))
    key = {"sessions": ["source_session_id"], "messages": ["message"], "revisions": ["message", "revision"], "requests": ["message", "revision"], "jobs": ["job_key", "priority"], "receipts": ["employee_id", "idempotency_key", "message", "revision"], "rejected": ["arrival", "reason"]}
    parts = [out[t].select(F.lit(t).alias("written"), F.replace(F.concat_ws("|", *c), F.lit("\0"), F.lit("/")).alias("key")) for t, c in key.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def idempotency(spark, d):
    return ing.receipts(_events(spark, d), ["key"], "body", [F.col("event_id")]).select("event_id", "receipt")


def revision_fsm(spark, d):
    e = _events(spark, d).withColumn("message", F.col("event_id") % 300).withColumn("revision", F.when(F.col("event_id") % 7 == 3, 4).otherwise(F.expr("event_id div 600 + 1").cast("int")))
    return ing.revision_verdicts(e, "message", "revision", "body", "event_id").select("event_id", "verdict")


def collector_dedup(spark, d):
    return ing.collected_revisions(_events(spark, d), "user_id", "event_type", "event_id").select("event_id", "user_id", "revision")


def queue_enqueue(spark, d):
    jobs = _events(spark, d).select("user_id", "event_type", "event_id")
    old = jobs.where("event_id < 500").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return op.inserted_once(old, jobs.where("event_id >= 500"), ["user_id", "event_type"], [F.col("event_id")])


def jobs(spark, d):
    """Orders as jobs: (jobs, the messages that classification jobs belong to)."""
    o = table(spark, d, "orders")
    kind = F.element_at(F.array(F.lit("classify_message"), F.lit("route_search"), F.lit("build_documents"), F.lit("classify_message")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "O", F.when(F.col("o_orderkey") % 11 == 0, "failed").otherwise("pending")).when(F.col("o_orderstatus") == "P", "blocked_policy").otherwise(F.when(F.col("o_orderkey") % 20 == 0, "running").otherwise("completed"))
    rows = o.select(
        F.col("o_orderkey").alias("id"), kind.alias("kind"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), status.alias("status"), (F.col("o_orderkey") * 31 % 1000).alias("next_run_at"), (F.col("o_orderkey") * 17 % 500).alias("created_at"),
        F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("message_id"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("target_revision"),
    )
    return rows, o.select(F.col("o_orderkey").alias("message_id"), (F.col("o_orderkey") % 97).alias("sequence_no"))


def queue_claim(spark, d):
    return queue.claimable(*jobs(spark, d), ["classify_message", "route_search"], F.lit(700)).select("id", "kind", "session_id")


def queue_settle(spark, d):
    e = table(spark, d, "events")
    rows = e.select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 13 == 0, "pending").otherwise("running").alias("status"), F.concat(F.lit("t"), F.col("event_id") % 7).alias("lease_token"), (F.col("event_id") % 100).alias("lease_expires_at"),
        (F.col("event_id") % 12).cast("int").alias("attempts"), F.when(F.col("event_id") % 10 != 0, 1).alias("target_revision"), F.lit(0.0).alias("next_run_at"),
    )
    outcome = F.element_at(F.array(*map(F.lit, ("complete", "retry", "fail", "block", "renew"))), (F.col("event_id") % 6).cast("int"))
    told = e.where("event_id % 6 <> 0").select(
        F.col("event_id").alias("id"), F.concat(F.lit("t"), F.when(F.col("event_id") % 11 == 0, 9).otherwise(F.col("event_id") % 7)).alias("lease_token"), outcome.alias("outcome"), F.when(F.col("event_id") % 20 != 0, F.when(F.col("event_id") % 9 == 0, 2).otherwise(1)).alias("revision"),
        F.when(F.col("event_id") % 5 == 0, F.col("event_id")).alias("retry_after"), F.lit(60).alias("lease"),
    )
    return queue.settled(rows, told, F.lit(30)).select("id", "status", "lease_token", F.col("lease_expires_at").cast("long").alias("lease_expires_at"), F.col("next_run_at").cast("double").alias("next_run_at"))


def recover_builds(spark, d):
    dirty = table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey", "c_acctbal")
    busy = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return dirty.join(busy, "c_custkey", "left_anti").orderBy("c_acctbal", "c_custkey").limit(100).select("c_custkey")


def dirty_tracking(spark, d):
    changes = messages(spark, d).join(relations(spark, d).select(F.col("to_id").alias("message_id")), "message_id", "left_semi")
    return ing.dirty_from(changes, "session_id", "sequence_no")


def incremental_build(spark, d):
    changes = messages(spark, d).where("message_id % 5 = 0")
    through = messages(spark, d).where("session_id % 3 <> 0").groupBy("session_id").agg((F.max("sequence_no") - 3).alias("through_sequence"))
    build = ing.needs_build(ing.dirty_from(changes, "session_id", "sequence_no"), through, "session_id")
    # sessions that only grew continue their last chunk, the others are built anew; either way the documents must be those of a full build
    rows = messages(spark, d).withColumn("revision", F.lit(1)).join(build.select("session_id", F.when(F.col("mode") == "append", F.col("through_sequence")).alias("through")), "session_id")
    built = chunking.plan_documents(rows, through="through").select("session_id", "chunk", "document_key", "content_hash")
    full = chunking.plan_documents(rows.drop("through")).select("session_id", "chunk", "document_key", "content_hash").withColumn("same", F.lit(True))
    docs = built.join(full, ["session_id", "chunk", "document_key", "content_hash"], "full_outer").groupBy("session_id").agg(F.bool_and(F.coalesce("same", F.lit(False))).alias("as_rebuilt"))
    return build.join(docs, "session_id").select("session_id", "mode", "as_rebuilt")


def late_data(spark, d):
    """Sequence numbers in any order of arrival: all are taken, nothing waits for the missing ones. Of events with the same number the earliest is first or last."""
    e = _events(spark, d).withColumn("sequence_no", F.col("event_id") * 7919 % 10007)
    gaps = F.max("sequence_no") - F.min("sequence_no") + 1 - F.count_distinct("sequence_no")
    late = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) != F.row_number().over(Window.partitionBy("user_id").orderBy("sequence_no", "event_id"))
    place = lambda then: F.when(F.col("sequence_no").isNotNull(), F.struct("sequence_no", then))
    return e.withColumn("late", late).groupBy("user_id").agg(F.min_by("event_id", place(F.col("event_id"))).alias("first"), F.max_by("event_id", place(-F.col("event_id"))).alias("last"), gaps.alias("missing"), F.count_if("late").alias("out_of_place"))


def input_age(spark, d):
    """Inputs that are searched for: those of users that arrive within ten minutes of when they were written."""
    rows = _events(spark, d).select("event_id", (F.col("event_type") != "error").alias("user"), F.col("ts").cast("timestamp").alias("occurred"), (F.col("ts").cast("timestamp") + F.make_dt_interval(mins=F.col("value").cast("int"))).alias("received"))
    return rows.select("event_id", (F.col("user") & filters.fresh(F.col("occurred"), F.col("received"))).alias("searched"))


def expire(spark, d):
    """Running requests whose input was revised or removed since, or whose time is over, read as expired."""
    m = messages(spark, d).select("message_id", F.lit("running").alias("status"), F.lit(1).alias("revision"), F.col("sequence_no").alias("expires_at"))
    now = messages(spark, d).where("message_id % 11 <> 0").select("message_id", F.when(F.col("message_id") % 6 == 0, 2).otherwise(1).alias("current"))
    met = m.join(now, "message_id", "left")
    return met.select("message_id", lifecycle.view_status(F.col("status"), F.col("expires_at"), F.col("revision"), F.col("current"), F.lit(2)).alias("status"))


def fast_late_notify(spark, d):
    """Orders' lines as polls for the orders' results, by two pollers; each result is told once, soon or late."""
    done = table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.lit(0).alias("asked_at"), (F.col("o_orderkey") * 13 % 90).alias("finished_at"))
    polls = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), (F.col("l_partkey") % 2).alias("poller"), (F.col("l_linenumber") * F.col("l_suppkey") % 80).alias("polled_at"))
    return ing.deliveries(done, polls)


LANES = {"search": ("route_search", "execute_search"), "external": ("classify_message", "build_documents", "judge_continuity")}


def lanes(spark, d):
    """The job that each lane takes next; a lane works on one job at a time."""
    rows, of = jobs(spark, d)
    out = None
    for lane, kinds in LANES.items():
        one = queue.claimed(rows, of, list(kinds), F.lit(700), 1).select(F.lit(lane).alias("lane"), "id", "kind")
        out = one if out is None else out.unionByName(one)
    return out


def backoff_queue(spark, d):
    return _events(spark, d).select("event_id", ing.send_backoff(F.col("event_id") % 7).alias("delay"))


QUERIES = {f"stm.{f.__name__}": f for f in (ingest, idempotency, revision_fsm, collector_dedup, queue_enqueue, queue_claim, queue_settle, recover_builds, dirty_tracking, incremental_build, late_data, input_age, expire, fast_late_notify, lanes, backoff_queue)}

_E = "WITH e AS (SELECT event_id, user_id, event_id % 700 AS key, event_id % 1400 % 3 AS body, ts, value, event_type FROM events)"
#: Orders as jobs, and those that may be claimed at 700: correlated, as the queue's own statement asks it.
JOBS = """WITH jobs AS (SELECT o_orderkey AS id, ['classify_message', 'route_search', 'build_documents', 'classify_message'][o_orderkey % 4 + 1] AS kind, o_orderpriority[1]::INT AS priority,
        CASE o_orderstatus WHEN 'O' THEN CASE WHEN o_orderkey % 11 = 0 THEN 'failed' ELSE 'pending' END WHEN 'P' THEN 'blocked_policy' ELSE CASE WHEN o_orderkey % 20 = 0 THEN 'running' ELSE 'completed' END END AS status,
        o_orderkey * 31 % 1000 AS next_run_at, o_orderkey * 17 % 500 AS created_at, o_custkey AS session_id, o_orderkey % 97 AS sequence_no, o_orderkey % 3 + 1 AS revision FROM orders),
    claimable AS (SELECT * FROM jobs j WHERE status = 'pending' AND next_run_at <= 700 AND (kind <> 'classify_message' OR NOT EXISTS (SELECT 1 FROM jobs o WHERE o.session_id = j.session_id AND o.kind = 'classify_message' AND o.id <> j.id
        AND (o.status = 'running' OR (o.status IN ('pending', 'blocked_policy') AND (o.sequence_no < j.sequence_no OR (o.sequence_no = j.sequence_no AND o.revision < j.revision)))))))"""
_INGEST = """WITH RECURSIVE e AS (SELECT event_id, event_id % 3 AS emp, event_id % 700 AS key, event_id % 1400 % 3 AS body, event_id % 300 % 40 AS s, event_id % 300 AS m, CASE WHEN event_id % 7 = 3 THEN 4 ELSE event_id // 600 + 1 END AS revision,
        CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, event_id % 300 + (event_id % 97 = 0)::INT AS seq, value FROM events),
    f AS (SELECT emp, key, arg_min(body, event_id) AS body, min(event_id) AS first_id FROM e GROUP BY 1, 2), b AS (SELECT emp, key, body % 2 AS body FROM e WHERE event_id < 40),
    t AS (SELECT e.*, CASE WHEN b.body IS NOT NULL THEN CASE WHEN b.body = e.body THEN 'repeated' ELSE 'conflict' END WHEN e.event_id = first_id THEN 'stored' WHEN e.body = f.body THEN 'repeated' ELSE 'conflict' END AS receipt FROM e JOIN f USING (emp, key) LEFT JOIN b USING (emp, key)),
    h AS (SELECT event_id, emp, key, s || '/' || m AS message, s, m, revision, body, role, seq, value FROM t WHERE receipt = 'stored'
        UNION ALL SELECT -1000000 + event_id, NULL, NULL, s || '/' || m, s, m, 1, body, role, m, NULL FROM e WHERE event_id < 300 AND event_id % 5 = 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY message ORDER BY event_id) AS n FROM h),
    w AS (SELECT message, n, (revision = 1)::INT AS cur, role AS role0, seq AS seq0, CASE WHEN revision = 1 THEN [body] ELSE [] END AS bodies, CASE WHEN revision = 1 THEN 'accepted' ELSE 'conflict' END AS verdict FROM n WHERE n = 1
        UNION ALL SELECT n.message, n.n, CASE WHEN n.revision = cur + 1 AND (cur = 0 OR (n.role = role0 AND n.seq = seq0)) THEN cur + 1 ELSE cur END, CASE WHEN cur = 0 THEN n.role ELSE role0 END, CASE WHEN cur = 0 THEN n.seq ELSE seq0 END, CASE WHEN n.revision = cur + 1 AND (cur = 0 OR (n.role = role0 AND n.seq = seq0)) THEN list_append(bodies, n.body) ELSE bodies END,
            CASE WHEN n.revision = cur + 1 AND (cur = 0 OR (n.role = role0 AND n.seq = seq0)) THEN 'accepted' WHEN cur > 0 AND n.role = role0 AND n.seq = seq0 AND n.revision <= cur AND bodies[n.revision] = n.body THEN 'repeated' ELSE 'conflict' END FROM w JOIN n ON n.message = w.message AND n.n = w.n + 1),
    j AS (SELECT n.*, w.verdict FROM n JOIN w USING (message, n) WHERE emp IS NOT NULL),
    good AS (SELECT * FROM j WHERE verdict <> 'conflict'), asked AS (SELECT * FROM good WHERE role = 'user' AND 630 - value <= 600) """
ORACLES = {
    "stm.ingest": _INGEST + """SELECT 'sessions' AS written, s::VARCHAR AS key FROM good GROUP BY s UNION ALL SELECT 'messages', message FROM good WHERE verdict = 'accepted' AND revision = 1 UNION ALL SELECT 'revisions', message || '|' || revision FROM good WHERE verdict = 'accepted'
        UNION ALL SELECT DISTINCT 'requests', message || '|' || revision FROM asked UNION ALL SELECT DISTINCT 'jobs', 'classify_message:' || message || ':' || revision || '|10' FROM good UNION ALL SELECT DISTINCT 'jobs', 'route_search:' || message || ':' || revision || '|100' FROM asked
        UNION ALL SELECT 'receipts', emp || '|' || key || '|' || message || '|' || revision FROM good UNION ALL SELECT 'rejected', event_id || '|revision_conflict' FROM j WHERE verdict = 'conflict' UNION ALL SELECT 'rejected', event_id || '|receipt_conflict' FROM t WHERE receipt = 'conflict'""",
    "stm.idempotency": _E + ", f AS (SELECT key, min(event_id) AS first_id, arg_min(body, event_id) AS body FROM e GROUP BY 1) SELECT e.event_id, CASE WHEN event_id = first_id THEN 'stored' WHEN e.body = f.body THEN 'repeated' ELSE 'conflict' END AS receipt FROM e JOIN f USING (key)",
    "stm.revision_fsm": "WITH RECURSIVE " + _E[5:] + """, r AS (SELECT *, event_id % 300 AS message, CASE WHEN event_id % 7 = 3 THEN 4 ELSE event_id // 600 + 1 END AS revision, row_number() OVER (PARTITION BY event_id % 300 ORDER BY event_id) AS n FROM e),
        f AS (SELECT message, n, event_id, (revision = 1)::INT AS cur, CASE WHEN revision = 1 THEN [body] ELSE [] END AS bodies, CASE WHEN revision = 1 THEN 'accepted' ELSE 'conflict' END AS verdict FROM r WHERE n = 1
            UNION ALL SELECT r.message, r.n, r.event_id, CASE WHEN r.revision = cur + 1 THEN cur + 1 ELSE cur END, CASE WHEN r.revision = cur + 1 THEN list_append(bodies, r.body) ELSE bodies END,
                CASE WHEN r.revision = cur + 1 THEN 'accepted' WHEN r.revision <= cur AND bodies[r.revision] = r.body THEN 'repeated' ELSE 'conflict' END FROM f JOIN r ON r.message = f.message AND r.n = f.n + 1)
        SELECT event_id, verdict FROM f""",
    "stm.collector_dedup": "WITH l AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS revision FROM l WHERE was IS NULL OR was <> event_type",
    "stm.queue_enqueue": "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2",
    "stm.queue_claim": JOBS + " SELECT id, kind, session_id FROM claimable WHERE kind IN ('classify_message', 'route_search')",
    "stm.queue_settle": """WITH r AS (SELECT event_id AS id, CASE WHEN event_id % 13 = 0 THEN 'pending' ELSE 'running' END AS status, 't' || event_id % 7 AS tok, event_id % 100 AS lea, event_id % 12 AS att, CASE WHEN event_id % 6 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 100 > 30 THEN ['complete', 'retry', 'fail', 'block', 'renew'][event_id % 6] END AS o,
        CASE WHEN event_id % 10 <> 0 THEN 1 END AS want, CASE WHEN event_id % 20 <> 0 THEN CASE WHEN event_id % 9 = 0 THEN 2 ELSE 1 END END AS got, CASE WHEN event_id % 5 = 0 THEN event_id ELSE 0 END AS wait FROM events),
        x AS (SELECT *, CASE WHEN o = 'complete' AND want IS DISTINCT FROM got THEN NULL ELSE o END AS rep FROM r),
        y AS (SELECT *, CASE rep WHEN 'complete' THEN 'completed' WHEN 'retry' THEN 'pending' WHEN 'fail' THEN 'failed' WHEN 'block' THEN 'blocked_policy' ELSE CASE WHEN status = 'running' AND lea <= 30 THEN 'pending' ELSE status END END AS now_status FROM x)
        SELECT id, now_status AS status, CASE WHEN now_status = 'running' THEN tok END AS lease_token, CASE WHEN now_status = 'running' THEN CASE WHEN rep = 'renew' THEN 90 ELSE lea END END::BIGINT AS lease_expires_at, CASE WHEN rep = 'retry' THEN 30 + greatest(wait, least(pow(2, least(att, 10)), 3600)) ELSE 0 END::DOUBLE AS next_run_at FROM y""",
    "stm.recover_builds": "SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ORDER BY c_acctbal, c_custkey LIMIT 100",
    "stm.dirty_tracking": cte("messages", "relations") + " SELECT session_id, min(sequence_no) AS dirty_sequence FROM messages WHERE message_id IN (SELECT to_id FROM relations) GROUP BY 1",
    "stm.incremental_build": cte("messages") + ", c AS (SELECT session_id, min(sequence_no) AS s FROM messages WHERE message_id % 5 = 0 GROUP BY 1), t AS (SELECT session_id, max(sequence_no) - 3 AS t FROM messages WHERE session_id % 3 <> 0 GROUP BY 1) SELECT c.session_id, CASE WHEN t IS NOT NULL AND s > t THEN 'append' ELSE 'rebuild' END AS mode, true AS as_rebuilt FROM c LEFT JOIN t ON t.session_id = c.session_id",
    "stm.late_data": "WITH e AS (SELECT event_id, user_id, event_id * 7919 % 10007 AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id * 7919 % 10007, event_id) AS b FROM events) SELECT user_id, arg_min(event_id, s) AS first, arg_max(event_id, s) AS last, max(s) - min(s) + 1 - count(DISTINCT s) AS missing, count(*) FILTER (WHERE a <> b) AS out_of_place FROM e GROUP BY 1",
    "stm.input_age": "SELECT event_id, event_type <> 'error' AND trunc(value) <= 10 AS searched FROM events",
    "stm.expire": cte("messages") + " SELECT message_id, CASE WHEN message_id % 11 = 0 OR message_id % 6 = 0 OR sequence_no <= 2 THEN 'expired' ELSE 'running' END AS status FROM messages",
    "stm.fast_late_notify": "WITH p AS (SELECT l_orderkey AS request_id, l_partkey % 2 AS poller, l_linenumber * l_suppkey % 80 AS polled FROM lineitem), f AS (SELECT request_id, min((polled, poller)) AS c FROM p WHERE polled >= request_id * 13 % 90 GROUP BY 1) SELECT request_id, c[2] AS poller, CASE WHEN c[1] <= 5 THEN 'fast' ELSE 'late' END AS path FROM f WHERE c[1] <= 60",
    "stm.lanes": JOBS + " SELECT * FROM (SELECT 'search' AS lane, id, kind FROM claimable WHERE kind = 'route_search' ORDER BY priority DESC, created_at, id LIMIT 1) UNION ALL SELECT * FROM (SELECT 'external' AS lane, id, kind FROM claimable WHERE kind <> 'route_search' ORDER BY priority DESC, created_at, id LIMIT 1)",
    "stm.backoff_queue": "SELECT event_id, least(300.0::DOUBLE, 30 * pow(2.0, event_id % 7)) AS delay FROM events",
}
