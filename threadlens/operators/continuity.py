"""Which sessions may continue one another: those just before, and those that name the same issue or pull request."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.operators.joins import either_end, top_per_key
from threadlens.operators.postings import first_sharing

#: Fixed limits: sessions just before, candidates in all; kinds of identifiers that count.
ADJACENT, CANDIDATES, KINDS = 3, 6, ("issue", "pull_request")


def candidates(sessions: DataFrame, identifiers: DataFrame, links: DataFrame, judged: DataFrame) -> DataFrame:
    """(session_id, candidate, rank): whom to compare each session with.

    ``sessions``: session_id, project_id, employee_id, started_at; ``identifiers``: session_id, entity_type, entity_key; ``links``, ``judged``: pairs a, b in either
    order. First the ``ADJACENT`` latest sessions of the same project and employee that didn't start later, then the latest ``CANDIDATES`` of the project that
    share an identifier, linked ones left out of both; of these in that order the first ``CANDIDATES``, and of them those not judged yet. Equal starts go by the
    larger session_id.

    Neither part pairs sessions at large: neighbours are found by their number in the line of their employee, and an identifier's list is cut to
    the latest few. As a session itself and those linked to it are left out afterwards, both look at as many more as the most linked session has.
    """
    linked = either_end(links, "a", "b").select(F.col("node").alias("session_id"), F.col("other").alias("candidate")).distinct()
    spare = 1 + (linked.groupBy("session_id").count().agg(F.max("count")).first()[0] or 0)
    free = lambda pairs: pairs.where("session_id <> candidate").join(linked, ["session_id", "candidate"], "left_anti")
    line = Window.partitionBy("project_id", "employee_id").orderBy("started_at", "session_id")
    numbered = sessions.withColumn("n", F.row_number().over(line))
    last = F.max("n").over(Window.partitionBy("project_id", "employee_id", "started_at"))  # the last that didn't start later
    wanted = numbered.withColumn("last", last).select("project_id", "employee_id", "session_id", F.explode(F.sequence(F.col("last") - (ADJACENT + spare - 1), F.col("last"))).alias("n"))
    near = wanted.join(numbered.select("project_id", "employee_id", "n", F.col("session_id").alias("candidate")), ["project_id", "employee_id", "n"])
    near = top_per_key(free(near.select("session_id", "candidate", "n")), ["session_id"], [F.col("n").desc()], ADJACENT, "place")
    named = identifiers.where(F.col("entity_type").isin(*KINDS)).join(sessions.select("session_id", "project_id", "started_at"), "session_id")
    keys = ["project_id", "entity_type", "entity_key"]
    order = [F.col("started_at").desc(), F.col("candidate").desc()]
    shared = first_sharing(named.withColumnRenamed("session_id", "candidate"), named, keys, order, CANDIDATES + spare, "session_id", "candidate")
    shared = top_per_key(free(shared).withColumnRenamed("rank", "__r"), ["session_id"], [F.col("__r")], CANDIDATES, "place")
    both = near.select("session_id", "candidate", F.lit(0).alias("part"), "place").unionByName(shared.select("session_id", "candidate", F.lit(1).alias("part"), "place"))
    first = both.groupBy("session_id", "candidate").agg(F.min(F.struct("part", "place")).alias("at"))
    cut = top_per_key(first, ["session_id"], [F.col("at")], CANDIDATES)
    done = either_end(judged, "a", "b").select(F.col("node").alias("session_id"), F.col("other").alias("candidate"))
    return cut.join(done, ["session_id", "candidate"], "left_anti").select("session_id", "candidate", "rank")
