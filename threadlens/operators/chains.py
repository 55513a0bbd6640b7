"""Chains in ordered rows: each row points to one later row, and what counts are the rows reached from a key's first one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.work import Workspace


def reached(pointers: DataFrame, starts: DataFrame, work: Workspace) -> DataFrame:
    """(__k, __i): the rows reached from ``starts`` (__k, __i), these included, along ``pointers`` (__k, __i, to), one a row at most, always onwards.

    By doubling: pointers over 1, 2, 4, ... steps are followed from all rows reached so far, so a chain of n rows takes log2(n) rounds of
    equi joins on key and row, which spread a long chain of one key over all tasks.
    """
    pointers, starts = work.keep(pointers, "pointers"), work.keep(starts, "starts")
    while not pointers.isEmpty():
        onward = pointers.join(pointers.select("__k", F.col("__i").alias("to"), F.col("to").alias("then")), ["__k", "to"])
        twice = work.keep(onward.select("__k", "__i", F.col("then").alias("to")), "pointers")  # a pointer beyond the last row goes
        further = work.keep(starts.unionByName(starts.join(pointers, ["__k", "__i"]).select("__k", F.col("to").alias("__i"))), "starts")
        work.drop(pointers, starts)
        pointers, starts = twice, further
    return starts
