"""Generations of an index: one for each exact specification, built in passes, put into use when complete, deleted when nothing refers to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: the fields that must all be equal, rows of a page, passes at most.
SPEC = ("provider", "account_ref", "endpoint", "model", "dimensions", "metric", "tokenizer_version", "document_input_type", "query_input_type", "normalization")
PAGE, PASSES = 64, 10


def ensured(companies: DataFrame, generations: DataFrame) -> DataFrame:
    """(company_id, generation_id, created): the oldest active generation of a company's exact specification, or that one must be made.

    ``companies``: company_id and the fields of ``SPEC``; ``generations``: generation_id, company_id, status, the fields of ``SPEC``. Null fields are equal.
    """
    spec = lambda: F.sha2(F.to_json(F.struct(*SPEC), {"ignoreNullFields": "false"}), 256)
    have = generations.where("status = 'active'").groupBy("company_id", spec().alias("spec")).agg(F.min("generation_id").alias("generation_id"))
    return companies.select("company_id", spec().alias("spec")).join(have, ["company_id", "spec"], "left").select("company_id", "generation_id", F.col("generation_id").isNull().alias("created"))


def next_pages(documents: DataFrame, embedded: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, document_id, page) of what a pass has to embed next: pages of documents, in order, that lack an embedding of the desired revision.

    ``documents``: company_id, document_id, desired_revision; ``embedded``: generation_id, document_id, revision; ``runs``: run_id, company_id, generation_id, passes.
    Runs that had all their passes get nothing more.
    """
    want = runs.where(F.col("passes") < PASSES).join(documents, "company_id")
    left = want.join(embedded.withColumnRenamed("revision", "desired_revision"), ["generation_id", "document_id", "desired_revision"], "left_anti")
    n = F.row_number().over(Window.partitionBy("run_id").orderBy("document_id"))
    return left.select("run_id", "document_id", F.floor((n - 1) / PAGE).cast("int").alias("page"))


def run_states(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """(run_id, state, missing): cutover when nothing is missing, failed when the passes are used up, else running."""
    missing = pages.groupBy("run_id").agg(F.count("*").alias("missing"))
    out = runs.join(missing, "run_id", "left").withColumn("missing", F.coalesce("missing", F.lit(0)))
    return out.select("run_id", F.when(F.col("passes") >= PASSES, "failed").when(F.col("missing") == 0, "cutover").otherwise("running").alias("state"), "missing")


def deletable(generations: DataFrame, guards: dict[str, DataFrame]) -> DataFrame:
    """(generation_id, refused): the first guard, in the order given, whose generation_id refers to it; null if it may go."""
    rows = generations.select("generation_id")
    for name, refers in guards.items():
        rows = rows.join(refers.select("generation_id").distinct().withColumn(f"__{name}", F.lit(name)), "generation_id", "left")
    return rows.select("generation_id", F.coalesce(*[F.col(f"__{name}") for name in guards]).alias("refused"))
