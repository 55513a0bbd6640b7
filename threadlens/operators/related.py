"""Evidence around a match: sessions that probably continue one another, and what of an explored context is still valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.vectors import cosine
from threadlens.operators.joins import either_end, top_per_key

#: Fixed: documents scanned and taken of each session, and the bar of their similarity.
SCANNED, TAKEN, LEAST, SHARE = 200, 2, 0.3, 0.8


def continued_sessions(judgments: DataFrame, links: DataFrame, origins: DataFrame, excluded: DataFrame) -> DataFrame:
    """(request_id, session_id): the other end of each judgment that says "continued", less sessions linked to an origin or excluded.

    ``judgments``: session_id, candidate_session_id, continuous; ``links``: from_session, to_session; ``origins``, ``excluded``: request_id, session_id.
    Both directions are rows of a union, so all joins are on equal keys.
    """
    near = either_end(judgments.where("continuous").select("session_id", "candidate_session_id"), "session_id", "candidate_session_id")
    found = origins.withColumnRenamed("session_id", "node").join(near.select("node", "other"), "node").select("request_id", F.col("other").alias("session_id")).distinct()
    linked = either_end(links.select("from_session", "to_session"), "from_session", "to_session").select("node", "other")
    linked = origins.withColumnRenamed("session_id", "node").join(linked, "node").select("request_id", F.col("other").alias("session_id"))
    out = found.join(linked.unionByName(excluded.select("request_id", "session_id")).unionByName(origins.select("request_id", "session_id")).distinct(), ["request_id", "session_id"], "left_anti")
    return out


def nearest_documents(docs: DataFrame, asked: DataFrame, primary: DataFrame) -> DataFrame:
    """(query_id, other_session, document_id, rank): of each session's newest documents the two nearest, if near enough.

    ``docs``: document_id, session_id, embedding; ``asked``: query_id, q (its vector), other_session; ``primary``: query_id, primary (similarity of the
    match itself; 1 where there is none). The bar is applied after the cut to two.
    """
    newest = top_per_key(docs, ["session_id"], [F.col("document_id").desc()], SCANNED, "newest").select("document_id", F.col("session_id").alias("other_session"), "embedding")
    near = newest.join(asked, "other_session").withColumn("similarity", cosine(F.col("embedding"), F.col("q")))
    best = top_per_key(near, ["query_id", "other_session"], [F.col("similarity").desc(), F.col("document_id")], TAKEN)
    bar = F.greatest(F.lit(LEAST), SHARE * F.coalesce("primary", F.lit(1.0)))
    return best.join(primary, "query_id", "left").where(F.col("similarity") >= bar).select("query_id", "other_session", "document_id", "rank")


def revalidated(items: DataFrame, messages: DataFrame, links: DataFrame, relations: DataFrame, targets: DataFrame) -> DataFrame:
    """The related items that still hold, with the relations that still hold.

    ``items``: item_id, request_id, message_id, revision, kind, link_ids (array), relations (array of source_revision, to_id, to_revision, relation);
    ``messages``: message_id, session_id, sequence_no, current_revision, project_id; ``links``: link_id, project_id, valid; ``relations``: from_id,
    from_revision, to_id, to_revision, relation; ``targets``: request_id, session_id, sequence_no, project_id. An item goes if its revision is not the current one, its
    project another, it lies at or after the input in the input's session, any link of its path is invalid, or none of its relations is left.
    """
    t = targets.select("request_id", F.col("session_id").alias("__s"), F.col("sequence_no").alias("__n"), F.col("project_id").alias("__p"))
    met = items.join(messages, "message_id").join(t, "request_id")
    late = (F.col("session_id") == F.col("__s")) & (F.col("sequence_no") >= F.col("__n"))
    met = met.where((F.col("current_revision") == F.col("revision")) & (F.col("project_id") == F.col("__p")) & ~late)
    path = met.where("kind = 'explicit_session_link'").select("item_id", "__p", F.explode_outer("link_ids").alias("link_id"))
    path = path.join(links.where("valid").select("link_id", F.col("project_id").alias("__p"), F.lit(True).alias("__ok")), ["link_id", "__p"], "left")
    whole = path.groupBy("item_id").agg(F.bool_and(F.coalesce("__ok", F.lit(False))).alias("__whole")).where("__whole").select("item_id")
    each = met.where("kind = 'correction'").select("item_id", F.col("message_id").alias("from_id"), F.explode("relations").alias("x")).select("item_id", "from_id", F.col("x.source_revision").alias("from_revision"), "x.to_id", "x.to_revision", "x.relation")
    left = each.join(relations, ["from_id", "from_revision", "to_id", "to_revision", "relation"], "left_semi")
    left = left.groupBy("item_id").agg(F.array_sort(F.collect_set(F.struct(F.col("from_revision").alias("source_revision"), "to_id", "to_revision", "relation"))).alias("__left"))
    free: Column = ~F.col("kind").isin("explicit_session_link", "correction")
    names = items.columns
    plain = met.where(free).select(*names)
    linked = met.where("kind = 'explicit_session_link'").join(whole, "item_id", "left_semi").select(*names)
    corrected = met.where("kind = 'correction'").drop("relations").join(left.withColumnRenamed("__left", "relations"), "item_id").select(*names)
    return plain.unionByName(linked).unionByName(corrected)
