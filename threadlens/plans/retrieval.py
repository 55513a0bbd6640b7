"""Queries of the composite retrieval and context operators (inventory: composite retrieval / graph)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions import identifiers, inverted_file
from threadlens.functions.vectors import knn
from threadlens.operators import aggregates as agg
from threadlens.operators import folds, graph, postings, related, results
from threadlens.operators import joins as op
from threadlens.plans import ordering
from threadlens.plans.aggregates import _R, _routes
from threadlens.plans.base import KNN, cte, documents, messages, relations, requests, samples, with_sources
from threadlens.session import table
from threadlens.work import Workspace


def vector(spark, d):
    return ordering.distinct_prefix(spark, d).groupBy("query_id").agg(F.count("*").alias("rows"), F.max("rank").alias("last_rank"))


def entity(spark, d):
    docs = table(spark, d, "pages").select(F.col("page_id").alias("document_id"), F.explode(identifiers.extract_entities(F.concat(F.lit("see f"), F.col("page_id") % 17, F.lit(".py and PR #"), F.col("page_id") % 5))).alias("e")).select("document_id", "e.*")
    n = F.col("n_nationkey")
    asked = table(spark, d, "nation").select(n.cast("long").alias("request_id"), F.explode(identifiers.extract_entities(F.concat(F.lit("why f"), n, F.lit(".py? PR #"), n % 7))).alias("e")).select("request_id", "e.*")
    return postings.first_sharing(docs, asked, ["entity_type", "entity_key"], [F.col("document_id")], ordering.ENTITY_LIMIT)


def strategy(spark, d):
    """Messages that share at least two strategy terms with an input of the same project, without its own session's later ones; terms that say nothing don't count."""
    m = messages(spark, d).select("message_id", "session_id", "sequence_no", "role", (F.col("session_id") % 5).alias("project_id"))
    value = lambda n, names: F.element_at(F.array(*map(F.lit, names)), (F.col("message_id") % n + 1).cast("int"))
    axes = [("state_hazard", value(3, ("race", "stale", "none"))), ("consistency_strategy", value(5, ("lock", "version", "queue", "unknown", "merge"))), ("lifecycle_strategy", value(7, ("expire", "retry", "none", "rebuild", "pin", "swap", "none")))]
    named = F.filter(F.array(*[F.struct(F.lit(a).alias("axis"), c.alias("choice")) for a, c in axes]), lambda x: ~x["choice"].isin("none", "unknown"))
    m = m.withColumn("terms", F.transform(named, lambda x: F.concat_ws(":", x["axis"], x["choice"])))
    asked = m.where("role = 'user' AND message_id % 7 = 0").select(F.col("message_id").alias("request_id"), F.col("session_id").alias("own"), F.col("sequence_no").alias("input_no"), "project_id", "terms")
    docs = m.select(F.col("message_id").alias("document_id"), "session_id", "sequence_no", "project_id", "terms")
    return postings.top_sharing(docs, asked, ["project_id"], ordering.STRATEGY_LIMIT, session=("session_id", "sequence_no", "own", "input_no"))


def _turn_requests(spark, d):
    m = messages(spark, d).where("role = 'user'")
    evidence = F.array((F.col("session_id") + 1) % 100 * 1000 + 1, (F.col("session_id") + 2) % 100 * 1000 + 3)
    return m.select(F.col("message_id").alias("request_id"), "session_id", F.col("sequence_no").alias("input_no"), F.when((F.col("session_id") + F.col("sequence_no")) % 3 != 0, "completed").otherwise("failed").alias("status"), evidence.alias("evidence"), F.col("message_id").alias("created_at"))


def _derived(spark, d):
    rows = messages(spark, d).where("role = 'assistant'").select(F.col("message_id").alias("derived_id"), "session_id", "sequence_no")
    return op.asof_latest(rows, _turn_requests(spark, d), "session_id", "sequence_no", "input_no", "created_at").where("near_status = 'completed'")


def provenance(spark, d):
    origin = _derived(spark, d).where("session_id % 2 = 0").select("derived_id", F.explode("near_evidence").alias("document_id")).distinct()
    return origin.join(messages(spark, d).select(F.col("message_id").alias("document_id")), "document_id", "left_semi").where("document_id <> derived_id").select("derived_id", "document_id")


def rrf(spark, d):
    r = agg.rrf(_routes(spark, d), ["request_id"])
    return op.top_per_key(r, ["request_id"], [F.round("rrf", 12).desc(), F.col("document_id")], 10).select("request_id", "document_id", "rank", F.round("rrf", 9).alias("rrf"), F.size("kinds").alias("n_kinds"))


def primary_only(spark, d):
    return messages(spark, d).select(F.col("message_id").alias("document_id")).join(_derived(spark, d).select(F.col("derived_id").alias("document_id")).distinct(), "document_id", "left_anti")


def collapse(spark, d):
    ranked = knn(with_sources(documents(spark, d)), requests(spark, d), 40, "project_id").select("query_id", "document_id", "rank")
    pairs = ordering.similar_pairs(spark, d, ranked)
    rows = ranked.select("query_id", "document_id", "rank", (F.col("document_id") * 13 % 101).alias("latest"), (F.col("document_id") % 4 == 0).cast("int").alias("secondary"), F.when(F.col("document_id") % 9 == 0, F.array(F.col("document_id") - 9)).otherwise(F.array().cast("array<bigint>")).alias("origins"))
    return folds.collapsed(rows, pairs, "query_id", "document_id")


def _judged(spark, d):
    r = rrf(spark, d)
    return r.select("request_id", "document_id", "rank", F.floor((F.col("rank") - 1) / 5).cast("int").alias("round"), F.element_at(F.array(F.lit("unrelated"), F.lit("background"), F.lit("useful"), F.lit("direct")), (F.col("document_id") * 7 % 11 % 4 + 1).cast("int")).alias("relevance"))


def judge_rounds(spark, d):
    j = _judged(spark, d)
    settled = j.where("round = 0 AND relevance IN ('useful', 'direct')").select("request_id").distinct()
    return j.where("round = 0").unionByName(j.where("round = 1").join(settled, "request_id", "left_anti")).select("request_id", "document_id", "round")


def derived_demotion(spark, d):
    j = _judged(spark, d).where("relevance IN ('useful', 'direct')").withColumn("level", F.when(F.col("relevance") == "direct", 2).otherwise(1))
    origins = j.select("request_id", F.col("document_id").alias("origin_id"), F.col("level").alias("origin_level"))
    hit = j.withColumn("origin_id", (F.col("document_id") * 3) % 40).join(origins, ["request_id", "origin_id"], "left")
    return hit.select("request_id", "document_id", (F.col("origin_level").isNotNull() & (F.col("origin_level") >= F.col("level")) & (F.col("origin_id") != F.col("document_id"))).alias("demoted"))


def select_primary(spark, d):
    valid = table(spark, d, "part").select((F.col("p_partkey") % 40).alias("document_id")).where("document_id % 3 <> 1").distinct()
    return op.top_per_key(_judged(spark, d).drop("round").join(valid, "document_id", "left_semi").withColumnRenamed("rank", "place"), ["request_id"], [F.col("place")], 1).select("request_id", "document_id")


def corrections_covered(spark, d):
    need = graph.corrections(relations(spark, d), messages(spark, d)).select("primary_id", "message_id")
    have = messages(spark, d).where("message_id % 3 <> 0").select("message_id")
    return need.join(have, "message_id", "left_anti").groupBy("primary_id").agg(F.count("*").alias("uncovered"))


def _results(spark, d):
    j = _judged(spark, d).withColumnRenamed("rank", "place").withColumn("revision", F.lit(1)).withColumn("valid", F.col("document_id") % 3 != 1)
    j = j.withColumn("statement_status", F.when(F.col("document_id") % 2 == 0, "proposal").otherwise("reported_verified"))
    asked = j.select("request_id", (F.col("request_id") % 7).cast("int").alias("project_id")).distinct()
    # a document's sources are the first messages of the session of its number; each source is listed twice, as two ranges of one message are
    m = messages(spark, d).where("sequence_no <= 4").select(F.col("session_id").alias("document_id"), "message_id", F.lit(1).alias("revision"), "role", "occurred_at", "text", F.explode(F.array(F.col("sequence_no") * 2, F.col("sequence_no") * 2 + 1)).alias("position"))
    warned = j.where("relevance IN ('useful', 'direct') AND NOT valid").select("request_id", F.lit("evidence_changed").alias("code"))
    index_ = documents(spark, d).groupBy("project_id").agg(F.count_if(F.col("document_id") % 5 == 0).cast("int").alias("pending_documents"), F.count_if(F.col("document_id") % 11 == 0).cast("int").alias("failed_documents"))
    return results.build_results(asked, j, m, warned, index_, "exact")


def build_result(spark, d):
    return _results(spark, d)


def save(spark, d):
    """Orders' customers as requests: some no longer run, some inputs were revised or are gone since."""
    asked = table(spark, d, "customer").select((F.col("c_custkey") - 1).alias("request_id"), F.when(F.col("c_custkey") % 6 == 0, "queued").otherwise("running").alias("status"), F.col("c_custkey").alias("input_id"), F.lit(1).alias("input_revision"))
    inputs = table(spark, d, "customer").where("c_custkey % 13 <> 0").select(F.col("c_custkey").alias("input_id"), F.when(F.col("c_nationkey") % 4 == 0, 2).otherwise(1).alias("current_revision"))
    return results.saved(asked, _results(spark, d), inputs)


def pin_generation(spark, d):
    asked = requests(spark, d).select("query_id", (F.col("query_id") % 3).alias("generation_id"))
    stored = documents(spark, d).groupBy((F.col("document_id") % 3).alias("generation_id")).agg(F.count("*").alias("n"))
    return asked.join(stored, "generation_id").select("query_id", "n")


def neighbors(spark, d):
    return op.within_range(messages(spark, d).select("session_id", "sequence_no", "message_id"), messages(spark, d).select("session_id", "sequence_no", "message_id"), "session_id", "sequence_no", 2).where("near_message_id <> message_id").select("message_id", "near_message_id")


def corrections(spark, d):
    return graph.corrections(relations(spark, d), messages(spark, d))


def _links(spark, d):
    e = table(spark, d, "orders").select((F.col("o_custkey") % 900).alias("a"), (F.col("o_orderkey") % 997).alias("b"), F.col("o_orderkey").alias("edge_id"))
    return op.either_end(e, "a", "b").where("node <> other")


def links(spark, d):
    starts = table(spark, d, "nation").where("n_nationkey < 10").select((F.col("n_nationkey").cast("long") * 9).alias("request_id"), (F.col("n_nationkey").cast("long") * 9).alias("node"))
    return graph.bounded_bfs(_links(spark, d), starts, 3, 10_000).select("request_id", "node", "hop")


def inferred(spark, d):
    """Documents of sessions that continue a request's session by judgment, without those that are linked to it or left out."""
    asked = requests(spark, d)
    known = documents(spark, d).select("session_id").distinct()
    judged_ = known.select("session_id", F.explode(F.sequence(F.col("session_id") + 1, F.col("session_id") + 9)).alias("candidate_session_id")).where("candidate_session_id < 20").withColumn("continuous", (F.col("session_id") + F.col("candidate_session_id")) % 4 != 0)
    linked = table(spark, d, "nation").select((F.col("n_nationkey") % 20).alias("from_session"), ((F.col("n_nationkey") * 3 + 1) % 20).alias("to_session"))
    origins = asked.select(F.col("query_id").alias("request_id"), "session_id")
    excluded = asked.select(F.col("query_id").alias("request_id"), ((F.col("session_id") + 2) % 20).alias("session_id"))
    sessions = related.continued_sessions(judged_, linked, origins, excluded)
    pairs = sessions.select(F.col("request_id").alias("query_id"), F.col("session_id").alias("other_session")).join(asked.select("query_id", F.col("embedding").alias("q")), "query_id")
    return related.nearest_documents(documents(spark, d), pairs, ordering.primary_match(spark, d))


def budget(spark, d):
    m = messages(spark, d)
    kind = F.element_at(F.array(F.lit("correction"), F.lit("neighbor"), F.lit("explicit"), F.lit("inferred")), (F.col("sequence_no") % 4 + 1).cast("int"))
    rows = m.select("session_id", "message_id", (F.col("sequence_no") % 4).cast("int").alias("priority"), kind.alias("kind"), F.length("text").alias("tokens"))
    return folds.budgeted(rows, "session_id", [F.col("priority"), F.col("message_id")], "tokens", F.lit(1500), 1000).select("session_id", "message_id", "verdict")


def revalidate(spark, d):
    """Items found around requests, of which some hold no longer, each for its own reason."""
    m = messages(spark, d).select("message_id", "session_id", "sequence_no", F.when(F.col("message_id") % 10 == 0, 2).otherwise(1).alias("current_revision"), (F.col("session_id") % 5).alias("project_id"))
    asked = messages(spark, d).where("role = 'user'").select(F.col("message_id").alias("request_id"), "session_id", "sequence_no", (F.col("session_id") % 5).alias("project_id"))
    kind = F.element_at(F.array(*map(F.lit, ("neighbor", "correction", "explicit_session_link", "inferred_session_link"))), (F.col("message_id") % 4 + 1).cast("int"))
    found = messages(spark, d).select(
        F.col("message_id").alias("item_id"), "message_id", F.lit(1).alias("revision"), kind.alias("kind"), F.array(F.col("message_id") % 7, F.col("message_id") % 5 + 7).alias("link_ids"),
        F.array(*[F.struct(F.lit(1).alias("source_revision"), (F.col("message_id") - 2).alias("to_id"), F.lit(1).alias("to_revision"), F.lit(x).alias("relation")) for x in ("change", "revoke")]).alias("relations"),
        (F.col("message_id") + F.when(F.col("message_id") % 3 == 0, 2000).when(F.col("message_id") % 3 == 1, 5001).otherwise(-1)).alias("request_id"),
    )
    links_ = table(spark, d, "nation").where("n_nationkey < 12").select(F.col("n_nationkey").cast("long").alias("link_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("project_id"), (F.col("n_nationkey") != 3).alias("valid"))
    stored = relations(spark, d).select("from_id", F.lit(1).alias("from_revision"), "to_id", F.lit(1).alias("to_revision"), "relation")
    out = related.revalidated(found, m, links_, stored, asked)
    return out.select("item_id", "request_id", "kind", F.when(F.col("kind") == "correction", F.array_join(F.transform("relations", lambda r: r["relation"]), ",")).alias("still"))


def _index(spark, d):
    return inverted_file.build(with_sources(documents(spark, d)), Workspace(spark, "index").path, "project_id")


def index(spark, d):
    """The approximate index: a code of a byte an entry for every document, stored in the list of its nearest centroid."""
    codes = _index(spark, d).codes(spark)
    return codes.select("document_id", "project_id", F.array_join(F.transform("embedding", lambda x: x.cast("string")), ",").alias("code"))


def recall(spark, d):
    """Exact against approximate top 20 under the same scope and boundary, the vectors that each compares exactly, and the codes that are read."""
    built, docs, asked = _index(spark, d), with_sources(documents(spark, d)), requests(spark, d)
    out = inverted_file.recall(built, docs, asked, 20).join(inverted_file.reads(built, asked), "query_id")
    n = F.col("codes_in_scope")
    out = out.agg(
        F.round(F.avg("recall"), 3).alias("mean_recall"), F.round(F.min("recall"), 3).alias("min_recall"), F.sum(F.least(n, F.lit(40))).alias("compared"), F.sum(n).alias("compared_by_scan"),
        F.sum("codes_read").alias("codes_read"), F.count("*").alias("requests"),
    )
    whole = built.sizes(spark).agg(F.sum("n")).first()[0]
    return out.select("*", F.lit(whole).cast("long").alias("codes"), F.lit(len(built.centroids)).alias("lists"))


def project(spark, d):
    s = samples(spark, d)
    last = op.top_per_key(s, ["project_id"], [F.col("created_at").desc(), F.col("event_id").desc()], 200)
    vector_ = last.groupBy("project_id").agg(F.count("*").alias("samples"), agg.percentile(0.95, "duration_ms").alias("p95"))
    docs = documents(spark, d).groupBy("project_id").agg(F.count("*").alias("documents"))
    slow = (F.col("samples") >= 50) & (F.col("p95") > 100)
    out = vector_.join(docs, "project_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))
    return out.select("project_id", "samples", "p95", "documents", (slow | (F.col("documents") > 20_000)).alias("use_index"), (F.col("samples") < 50).alias("insufficient_samples"))


def search_eval(spark, d):
    key = F.col("c_custkey")
    cases = table(spark, d, "customer").select((key % 50).alias("request_id"), F.array(key * 7 % 40, key * 11 % 40).alias("expected")).groupBy("request_id").agg(F.array_distinct(F.flatten(F.collect_set("expected"))).alias("expected"))
    hit = cases.select("request_id", F.explode("expected").alias("document_id")).join(rrf(spark, d).select("request_id", "document_id", "rank"), ["request_id", "document_id"], "left")
    per = hit.groupBy("request_id").agg(F.min("rank").alias("position"))
    return per.agg(F.count("*").alias("total"), F.count("position").alias("hits"))


QUERIES = {f"rt.{f.__name__}": f for f in (vector, entity, strategy, provenance, rrf, primary_only, collapse, judge_rounds, derived_demotion, select_primary, corrections_covered, build_result, save, pin_generation)}
QUERIES |= {f"ex.{f.__name__}": f for f in (neighbors, corrections, links, inferred, budget, revalidate)}
QUERIES |= {"an.index": index, "an.recall": recall, "mt.project": project, "ev.search_eval": search_eval}

_TOP10 = f"WITH {_R}, c AS (SELECT request_id, document_id, sum(1 / (60 + rank)) AS rrf, count(DISTINCT route)::INT AS n_kinds FROM r GROUP BY 1, 2), n AS (SELECT *, (row_number() OVER (PARTITION BY request_id ORDER BY round(rrf, 12) DESC, document_id))::INT AS rank FROM c), t AS (SELECT * FROM n WHERE rank <= 10)"
_J = _TOP10 + ", j AS (SELECT request_id, document_id, rank, (rank - 1) // 5 AS round, ['unrelated', 'background', 'useful', 'direct'][document_id * 7 % 11 % 4 + 1] AS relevance FROM t)"
_DERIVED = cte("messages") + ", q AS (SELECT *, (session_id + sequence_no) % 3 <> 0 AS done FROM messages WHERE role = 'user'), x AS (SELECT m.message_id AS derived_id, m.session_id, q.done, row_number() OVER (PARTITION BY m.message_id ORDER BY q.sequence_no DESC) AS n FROM messages m JOIN q ON q.session_id = m.session_id AND q.sequence_no < m.sequence_no WHERE m.role = 'assistant'), dv AS (SELECT derived_id, session_id FROM x WHERE n = 1 AND done)"
_CORR = "WITH RECURSIVE " + cte("messages", "relations")[5:] + ", c AS (SELECT message_id AS primary_id, message_id, 0 AS hop FROM messages WHERE {0} UNION SELECT c.primary_id, r.from_id, c.hop + 1 FROM c JOIN relations r ON r.to_id = c.message_id WHERE c.hop < 3), g AS (SELECT primary_id, message_id, min(hop) AS hop FROM c GROUP BY 1, 2)"
_BFS = "WITH RECURSIVE o AS (SELECT o_custkey % 900 AS a, o_orderkey % 997 AS b FROM orders), e AS (SELECT a AS node, b AS other FROM o WHERE a <> b UNION SELECT b, a FROM o WHERE a <> b), w AS (SELECT range AS request_id, range AS node, 0 AS hop FROM range(0, 90, 9) UNION SELECT w.request_id, e.other, w.hop + 1 FROM w JOIN e USING (node) WHERE w.hop < 3), g AS (SELECT request_id, node, min(hop) AS hop FROM w GROUP BY 1, 2)"

_RESULT = _J + """, asd AS (SELECT *, document_id % 3 <> 1 AS valid, CASE WHEN document_id % 2 = 0 THEN 'proposal' ELSE 'reported_verified' END AS st FROM j), ad AS (SELECT request_id, arg_min(document_id, rank) AS adopted, arg_min(relevance, rank) AS relevance, arg_min(st, rank) AS st FROM asd WHERE relevance IN ('useful', 'direct') AND valid GROUP BY 1),
    src AS (SELECT conv_id AS document_id, conv_id * 1000 + turn AS message_id, turn, role, conv_id * 60 + turn AS occurred_at, text FROM conversations WHERE role IN ('user', 'assistant') AND turn < 4),
    ev AS (SELECT document_id, list({'message_id': message_id, 'revision': 1, 'role': role, 'occurred_at': occurred_at, 'text': text} ORDER BY turn) AS l, bool_or(role = 'assistant') AS agent FROM src GROUP BY 1),
    mt AS (SELECT request_id, [{'case_or_document_id': adopted, 'relevance': relevance, 'statement_status': st, 'claim_status': CASE WHEN agent THEN 'agent_reported' ELSE 'not_reported' END, 'evidence': l}] AS matches, adopted AS shown FROM ad JOIN ev ON ev.document_id = adopted),
    ce AS (SELECT asd.request_id, list({'document_id': document_id, 'revision': 1, 'relevance': asd.relevance, 'statement_status': asd.st, 'adopted': coalesce(document_id = adopted, false)} ORDER BY rank) AS evaluations FROM asd LEFT JOIN ad ON ad.request_id = asd.request_id GROUP BY 1),
    wa AS (SELECT request_id, [{'code': 'evidence_changed'}] AS warnings FROM asd WHERE relevance IN ('useful', 'direct') AND NOT valid GROUP BY 1),
    ix AS (SELECT label AS project_id, count(*) FILTER (WHERE vec_id % 5 = 0) AS pending, count(*) FILTER (WHERE vec_id % 11 = 0) AS failed FROM embeddings GROUP BY 1),
    res AS (SELECT ce.request_id, CASE WHEN shown IS NULL THEN 'no_match' ELSE 'matched' END AS outcome, shown AS adopted, '{"request_id":' || ce.request_id || ',"outcome":"' || CASE WHEN shown IS NULL THEN 'no_match' ELSE 'matched' END || '","index_status":{"pending_documents":' || coalesce(pending, 0) || ',"failed_documents":' || coalesce(failed, 0) || ',"search_mode":"exact"},"matches":' || coalesce(to_json(matches)::VARCHAR, '[]') || ',"candidate_evaluations":' || to_json(evaluations)::VARCHAR || ',"warnings":' || coalesce(to_json(warnings)::VARCHAR, '[]') || '}' AS result
      FROM ce LEFT JOIN mt ON mt.request_id = ce.request_id LEFT JOIN wa ON wa.request_id = ce.request_id LEFT JOIN ix ON ix.project_id = ce.request_id % 7)"""

ORACLES = {
    "rt.entity": "WITH h AS (SELECT DISTINCT q.n_nationkey AS request_id, page_id AS document_id FROM pages, nation q WHERE page_id % 17 = q.n_nationkey OR page_id % 5 = q.n_nationkey % 7), n AS (SELECT *, (row_number() OVER (PARTITION BY request_id ORDER BY document_id))::INT AS rank FROM h) SELECT request_id::BIGINT AS request_id, document_id, rank FROM n WHERE rank <= 20",
    "rt.strategy": cte("messages") + """, t AS (SELECT *, session_id % 5 AS p, list_filter(['state_hazard:' || ['race', 'stale', 'none'][message_id % 3 + 1], 'consistency_strategy:' || ['lock', 'version', 'queue', 'unknown', 'merge'][message_id % 5 + 1], 'lifecycle_strategy:' || ['expire', 'retry', 'none', 'rebuild', 'pin', 'swap', 'none'][message_id % 7 + 1]], lambda x: x NOT LIKE '%:none' AND x NOT LIKE '%:unknown') AS terms FROM messages),
        h AS (SELECT a.message_id AS request_id, b.message_id AS document_id, len(list_intersect(a.terms, b.terms)) AS matched_terms FROM t a JOIN t b USING (p) WHERE a.role = 'user' AND a.message_id % 7 = 0 AND NOT (b.session_id = a.session_id AND b.sequence_no >= a.sequence_no)),
        n AS (SELECT *, (row_number() OVER (PARTITION BY request_id ORDER BY matched_terms DESC, document_id))::INT AS rank FROM h WHERE matched_terms >= 2) SELECT request_id, document_id, matched_terms::BIGINT AS matched_terms, rank FROM n WHERE rank <= 10""",
    "rt.provenance": _DERIVED + ", o AS (SELECT derived_id, unnest([(session_id + 1) % 100 * 1000 + 1, (session_id + 2) % 100 * 1000 + 3]) AS document_id FROM dv WHERE session_id % 2 = 0) SELECT DISTINCT derived_id, document_id FROM o WHERE document_id <> derived_id AND document_id IN (SELECT message_id FROM messages)",
    "rt.rrf": _TOP10 + " SELECT request_id, document_id, rank, round(rrf, 9) AS rrf, n_kinds FROM t",
    "rt.primary_only": _DERIVED + " SELECT message_id AS document_id FROM messages WHERE message_id NOT IN (SELECT derived_id FROM dv)",
    "rt.judge_rounds": _J + " SELECT request_id, document_id, round FROM j WHERE round = 0 OR (round = 1 AND request_id NOT IN (SELECT request_id FROM j WHERE round = 0 AND relevance IN ('useful', 'direct')))",
    "rt.derived_demotion": _J + ", k AS (SELECT *, CASE relevance WHEN 'direct' THEN 2 ELSE 1 END AS level FROM j WHERE relevance IN ('useful', 'direct')) SELECT a.request_id, a.document_id, coalesce(b.level >= a.level AND b.document_id <> a.document_id, false) AS demoted FROM k a LEFT JOIN k b ON b.request_id = a.request_id AND b.document_id = a.document_id * 3 % 40",
    "rt.select_primary": _J + " SELECT request_id, arg_min(document_id, rank) AS document_id FROM j WHERE document_id % 3 <> 1 AND document_id IN (SELECT p_partkey % 40 FROM part) GROUP BY 1",
    "rt.corrections_covered": _CORR.format("true") + " SELECT primary_id, count(*) AS uncovered FROM g WHERE hop > 0 AND (message_id % 3 = 0 OR message_id NOT IN (SELECT message_id FROM messages)) GROUP BY 1",
    "rt.build_result": _RESULT + " SELECT request_id, outcome, adopted, result FROM res",
    "rt.save": _RESULT + """, a AS (SELECT c_custkey - 1 AS request_id, CASE WHEN c_custkey % 6 = 0 THEN 'queued' ELSE 'running' END AS status, c_custkey % 13 = 0 OR c_nationkey % 4 = 0 AS stale FROM customer)
        SELECT a.request_id, CASE WHEN status = 'queued' THEN status WHEN stale THEN 'expired' WHEN res.request_id IS NOT NULL THEN 'completed' ELSE status END AS status, CASE WHEN status = 'running' AND stale THEN 'input_revision_stale' END AS error_code, CASE WHEN status = 'running' AND NOT stale THEN outcome END AS outcome FROM a LEFT JOIN res ON res.request_id = a.request_id""",
    "rt.pin_generation": cte("docs", "requests") + " SELECT query_id, count(*) AS n FROM requests JOIN docs ON query_id % 3 = document_id % 3 GROUP BY 1",
    "ex.neighbors": cte("messages") + " SELECT a.message_id, b.message_id AS near_message_id FROM messages a JOIN messages b ON b.session_id = a.session_id AND abs(b.sequence_no - a.sequence_no) <= 2 AND b.message_id <> a.message_id",
    "ex.corrections": _CORR.format("true") + " SELECT primary_id, message_id, hop FROM g WHERE hop > 0",
    "ex.links": _BFS + " SELECT request_id, node, hop FROM g",
    "ex.inferred": KNN + """, p AS (SELECT query_id, 1 - distance AS primary_similarity FROM t WHERE rank = 1), ses AS (SELECT DISTINCT session_id AS s FROM docs), c AS (SELECT a.s AS a, b.range AS b FROM ses a JOIN range(20) b ON b.range BETWEEN a.s + 1 AND a.s + 9 WHERE (a.s + b.range) % 4 <> 0),
        e AS (SELECT a, b FROM c UNION SELECT b, a FROM c), l AS (SELECT n_nationkey % 20 AS a, (n_nationkey * 3 + 1) % 20 AS b FROM nation), lk AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        o AS (SELECT q.query_id, q.embedding AS v, e.b AS other_session FROM requests q JOIN e ON e.a = q.session_id WHERE e.b <> q.session_id AND e.b <> (q.session_id + 2) % 20 AND NOT EXISTS (SELECT 1 FROM lk WHERE lk.a = q.session_id AND lk.b = e.b)),
        n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY document_id DESC) AS r FROM docs), s AS (SELECT query_id, other_session, document_id, list_cosine_similarity(embedding, v) AS similarity FROM o JOIN n ON n.session_id = other_session WHERE r <= 200),
        b AS (SELECT *, (row_number() OVER (PARTITION BY query_id, other_session ORDER BY similarity DESC, document_id))::INT AS rank FROM s) SELECT query_id, other_session, document_id, rank FROM b LEFT JOIN p USING (query_id) WHERE rank <= 2 AND similarity >= greatest(0.3, 0.8 * coalesce(primary_similarity, 1))""",
    "ex.budget": "WITH RECURSIVE " + cte("messages")[5:] + """, n AS (SELECT session_id, message_id, length(text) AS tokens, row_number() OVER (PARTITION BY session_id ORDER BY sequence_no % 4, message_id) AS i FROM messages),
        f AS (SELECT session_id, message_id, i, CASE WHEN tokens <= 1500 THEN 'selected' ELSE 'token_budget' END AS verdict, CASE WHEN tokens <= 1500 THEN 1500 - tokens ELSE 1500 END AS room FROM n WHERE i = 1
        UNION ALL SELECT n.session_id, n.message_id, n.i, CASE WHEN n.tokens <= f.room THEN 'selected' ELSE 'token_budget' END, CASE WHEN n.tokens <= f.room THEN f.room - n.tokens ELSE f.room END FROM f JOIN n ON n.session_id = f.session_id AND n.i = f.i + 1) SELECT session_id, message_id, verdict FROM f""",
    "ex.revalidate": cte("messages", "relations") + """, i AS (SELECT message_id, session_id AS s, sequence_no AS n, ['neighbor', 'correction', 'explicit_session_link', 'inferred_session_link'][message_id % 4 + 1] AS kind, message_id + CASE message_id % 3 WHEN 0 THEN 2000 WHEN 1 THEN 5001 ELSE -1 END AS request_id FROM messages),
        v AS (SELECT i.*, (SELECT string_agg(relation, ',' ORDER BY relation) FROM relations r WHERE r.from_id = i.message_id AND r.to_id = i.message_id - 2) AS still FROM i JOIN messages q ON q.message_id = i.request_id AND q.role = 'user' WHERE i.message_id % 10 <> 0 AND i.s % 5 = q.session_id % 5 AND NOT (i.s = q.session_id AND i.n >= q.sequence_no))
        SELECT message_id AS item_id, request_id, kind, CASE WHEN kind = 'correction' THEN still END AS still FROM v WHERE kind IN ('neighbor', 'inferred_session_link') OR (kind = 'correction' AND still IS NOT NULL) OR (kind = 'explicit_session_link' AND message_id % 7 <> 3)""",
    "an.index": "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, list_max([abs(x) FOR x IN embedding::DOUBLE[]]) AS top FROM embeddings) SELECT vec_id AS document_id, label AS project_id, array_to_string([round(127 * x / greatest(top, 1e-30))::INT FOR x IN v], ',') AS code FROM e",
    "mt.project": cte("samples", "docs") + ", n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, event_id DESC) AS r FROM samples), v AS (SELECT project_id, count(*) AS samples, quantile_disc(duration_ms, 0.95) AS p95 FROM n WHERE r <= 200 GROUP BY 1), c AS (SELECT project_id, count(*) AS documents FROM docs GROUP BY 1) SELECT v.project_id, samples, p95, coalesce(documents, 0) AS documents, (samples >= 50 AND p95 > 100) OR coalesce(documents, 0) > 20000 AS use_index, samples < 50 AS insufficient_samples FROM v LEFT JOIN c ON c.project_id = v.project_id",
    "ev.search_eval": _TOP10 + ", e AS (SELECT c_custkey % 50 AS request_id, unnest([c_custkey * 7 % 40, c_custkey * 11 % 40]) AS document_id FROM customer), p AS (SELECT request_id, min(rank) AS position FROM e LEFT JOIN t USING (request_id, document_id) GROUP BY 1) SELECT count(*) AS total, count(position) AS hits FROM p",
    "rt.vector": ordering.DISTINCT + " SELECT query_id, count(*) AS rows, max(rank) AS last_rank FROM kept GROUP BY 1",
    "rt.collapse": ordering.SIMILAR_SQL + """, st AS (SELECT query_id, rank, [document_id] AS kept FROM s WHERE rank = 1
        UNION ALL SELECT s.query_id, s.rank, CASE WHEN slot IS NULL THEN list_append(kept, s.document_id)
          WHEN (kept[slot] % 9 = 0 AND kept[slot] - 9 = s.document_id) OR (s.document_id * 13 % 101 > kept[slot] * 13 % 101 AND (s.document_id % 4 = 0)::INT <= (kept[slot] % 4 = 0)::INT AND NOT (s.document_id % 9 = 0 AND s.document_id - 9 = kept[slot]))
          THEN list_concat(kept[:slot - 1], [s.document_id], kept[slot + 1:]) ELSE kept END
        FROM (SELECT st.query_id, s.rank, s.document_id, st.kept, list_filter(range(1, len(st.kept) + 1), lambda i: list_contains(s.near, st.kept[i]))[1] AS slot FROM st JOIN s ON s.query_id = st.query_id AND s.rank = st.rank + 1) s),
        last AS (SELECT query_id, arg_max(kept, rank) AS kept FROM st GROUP BY 1) SELECT query_id, unnest(range(1, len(kept) + 1))::INT AS slot, unnest(kept) AS document_id FROM last""",
}
