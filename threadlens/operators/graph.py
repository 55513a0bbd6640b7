"""Bounded traversals: breadth-first search with hop and node limits, correction chains, reuse chains; all by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.work import Workspace


def bounded_bfs(edges: DataFrame, starts: DataFrame, hops: int = 3, cap: int = 10) -> DataFrame:
    """(request_id, node, hop, edge_id) of nodes within ``hops`` of a request's starts, at most ``cap`` nodes with the starts.

    ``edges``: (node, other, edge_id), seen from both ends; ``starts``: (request_id, node). A node counts once, at its first hop and
    smallest edge; within a hop nodes are taken by edge until the cap is full. Each hop is one join, one aggregation and one
    limit per request; visited nodes are few, for the cap bounds them.
    """
    work = Workspace(edges.sparkSession, "bfs")
    seen = work.keep(starts.select("request_id", "node").distinct().withColumns({"hop": F.lit(0), "edge_id": F.lit(None).cast("long")}), "seen")
    for hop in range(1, hops + 1):
        step = seen.where(F.col("hop") == hop - 1).select("request_id", "node").join(edges, "node")
        new = step.groupBy("request_id", F.col("other").alias("node")).agg(F.min("edge_id").alias("edge_id")).join(seen.select("request_id", "node"), ["request_id", "node"], "left_anti")
        taken = seen.groupBy("request_id").agg(F.count("*").alias("taken"))
        rank = F.row_number().over(Window.partitionBy("request_id").orderBy("edge_id", "node"))
        new = new.withColumn("r", rank).where(F.col("r") <= cap).join(taken, "request_id").where(F.col("r") + F.col("taken") <= cap)
        after = work.keep(seen.unionByName(new.select("request_id", "node", F.lit(hop).alias("hop"), "edge_id")), "seen")
        work.drop(seen)
        seen = after
    return seen


def corrections(relations: DataFrame, primary: DataFrame, hops: int = 3) -> DataFrame:
    """(primary_id, message_id, hop): messages that revoke or change a primary message, directly or through others, cycle-safe."""
    live = relations.where(F.col("relation").isin("revoke", "change")).select("from_id", "to_id").distinct()
    seen = primary.select(F.col("message_id").alias("primary_id"), "message_id", F.lit(0).alias("hop"))
    front = seen
    for hop in range(1, hops + 1):
        new = front.join(live, front["message_id"] == live["to_id"]).select("primary_id", F.col("from_id").alias("message_id"), F.lit(hop).alias("hop")).distinct()
        front = new.join(seen.select("primary_id", "message_id"), ["primary_id", "message_id"], "left_anti")
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def reuse_origin(requests: DataFrame, hops: int = 10) -> DataFrame:
    """(request_id, origin_id): the direct search that a chain of reused results ends at; null where the chain isn't usable.

    ``requests``: request_id, reused_from (null: a direct search), eligible. Every request on the way must be eligible, and the
    chain no longer than ``hops``, which also ends cycles.
    """
    r = requests.select("request_id", "reused_from", "eligible")
    at = r.select("request_id", F.col("reused_from").alias("next"), F.col("request_id").alias("at"), F.col("eligible").alias("ok"))
    for _ in range(hops):
        n = r.select(F.col("request_id").alias("next"), F.col("reused_from").alias("after"), F.col("eligible").alias("fine"))
        met = at.join(n, "next", "left")
        moved = F.col("next").isNotNull()
        at = met.select(
            "request_id", F.when(moved, F.col("after")).alias("next"), F.when(moved, F.col("next")).otherwise(F.col("at")).alias("at"), (F.col("ok") & F.when(moved, F.coalesce("fine", F.lit(False))).otherwise(True)).alias("ok")
        )
    return at.select("request_id", F.when(F.col("ok") & F.col("next").isNull(), F.col("at")).alias("origin_id"))
