"""An inverted file for vector search: every vector's code lies in the list of its nearest centroid, and a query opens the lists nearest to it.

Centroids are fitted on a bounded sample (spherical k-means), every row is assigned to one, and codes of a byte an entry are stored
partitioned by list, so the lists that no query opens are never read: they show as partition filters of the plan. A query opens all lists whose
centroid is at most ``reach`` less similar to it than its nearest one, calibrated on the same sample: as small a reach as finds the wanted share of
nearest neighbours there. Where vectors have structure that is a few lists; where they have none it is most, for no list structure can
tell such vectors apart, and the figures returned say so.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from threadlens.functions.vectors import coded, cosine, knn

#: Bounds of what is fitted: rows of the sample, lists, queries of the calibration.
SAMPLE, LISTS, ASKED = 50_000, 1024, 1000


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)) if n else np.zeros((0, 0))


def centroids_of(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Unit centroids of unit vectors; a centroid that loses its last vector takes the one that fits its own worst."""
    rng = np.random.default_rng(seed)
    centroids = sample[np.sort(rng.choice(len(sample), lists, replace=False))]
    for _ in range(rounds):
        near, best = nearest(sample, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        empty = np.flatnonzero(np.bincount(near, minlength=lists) == 0)
        sums[empty] = sample[np.argsort(best, kind="stable")[: len(empty)]]
        after = _unit(sums)
        if np.allclose(after, centroids):
            break
        centroids = after
    return centroids


def nearest(vectors: np.ndarray, centroids: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Of each unit vector the nearest list (of equal ones the first) and its similarity."""
    lists, sims = np.empty(len(vectors), np.int64), np.empty(len(vectors))
    for a in range(0, len(vectors), block):
        s = vectors[a : a + block] @ centroids.T
        lists[a : a + block], sims[a : a + block] = s.argmax(axis=1), s.max(axis=1)
    return lists, sims


def reach_for(sample: np.ndarray, scopes: np.ndarray, centroids: np.ndarray, k: int, mean: float, least: float, asked: int = ASKED) -> float:
    """The smallest reach that finds, of the sample's own nearest ``k`` in scope, the ``mean`` share on average and the ``least`` for each of up to ``asked`` rows."""
    own, _ = nearest(sample, centroids)
    gaps = []
    for i in np.linspace(0, len(sample) - 1, min(asked, len(sample))).astype(int):
        others = np.flatnonzero((scopes == scopes[i]) & (np.arange(len(sample)) != i))
        if not len(others):
            continue
        top = others[np.argsort(-(sample[others] @ sample[i]), kind="stable")[:k]]
        sims = centroids @ sample[i]
        gaps.append(np.sort(sims.max() - sims[own[top]]))
    if not gaps:
        return 2.0  # no evidence: all lists
    tried = np.unique(np.concatenate(gaps))
    shares = np.array([np.searchsorted(g, tried, "right") / len(g) for g in gaps])
    return float(tried[np.argmax((shares.mean(axis=0) >= mean) & (shares.min(axis=0) >= least))])  # the largest one finds all


@dataclass
class InvertedFile:
    """A built index: where it lies, its centroids, how far a query reaches beyond its nearest list."""

    path: str
    scope: str
    centroids: np.ndarray
    reach: float
    schema: StructType

    def codes(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/codes")

    def sizes(self, spark: SparkSession) -> DataFrame:
        """(scope, list, n) of all lists."""
        kinds = [self.schema[self.scope], self.schema["list"]]
        return spark.read.schema(StructType(kinds).add("n", "long")).parquet(f"{self.path}/sizes")


def _listed(rows: DataFrame, column: str, centroids: np.ndarray, reach: float | None) -> DataFrame:
    """``rows`` with ``lists``: the nearest list of their vectors, or with a ``reach`` all within it. One pass; nothing shuffles."""
    names = rows.columns
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(at))
            if len(centroids) == 1:  # also that of an index without rows, of which no dimension is known
                flat, ends = np.zeros(len(m), np.int64), np.arange(len(m) + 1)
            elif reach is None:
                flat, ends = nearest(m, centroids)[0], np.arange(len(m) + 1)
            else:
                sims = m @ centroids.T
                row, flat = np.nonzero(sims >= sims.max(axis=1, keepdims=True) - reach - 1e-12)
                ends = np.searchsorted(row, np.arange(len(m) + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*names, "lists"])

    return rows.mapInArrow(run, rows.select("*", F.lit(None).cast("array<int>").alias("lists")).schema)


def build(vectors: DataFrame, path: str, scope: str, k: int = 20, mean: float = 0.99, least: float = 0.95, lists: int | None = None, sample: int = SAMPLE) -> InvertedFile:
    """Fit, assign and store ``vectors`` (document_id, <scope>, embedding, sources) below ``path``.

    The sample are the ``sample`` rows with the smallest hashes of their ids; without ``lists`` there are as many as the root of the number of rows, up
    to ``LISTS``. Rows are assigned and coded where they are; one shuffle brings a list's codes together, in files that Spark rebalances, so a list with a third of all
    rows is split over tasks and small lists share one. Null vectors are left out.
    """
    spark = vectors.sparkSession
    vectors = vectors.where("embedding is not null")
    taken = vectors.select("document_id", F.col(scope).cast("string").alias("s"), "embedding").orderBy(F.xxhash64("document_id"), "document_id").limit(sample).toArrow()
    if not taken.num_rows:
        centroids, reach = np.zeros((1, 1)), 2.0
    else:
        rows = _matrix(taken["embedding"].combine_chunks())
        want = lists or int(np.sqrt(vectors.count()))
        centroids = centroids_of(rows, max(1, min(want, LISTS, len(rows))))
        _, scopes = np.unique(np.array(taken["s"].fill_null("").to_pylist()), return_inverse=True)
        reach = reach_for(rows, scopes, centroids, k, mean, least)
    placed = _listed(vectors, "embedding", centroids, None) if taken.num_rows else vectors.withColumn("lists", F.array(F.lit(0)))
    codes = coded(placed).withColumn("list", F.col("lists")[0]).drop("lists")
    codes.hint("rebalance", "list").sortWithinPartitions("list", scope).write.partitionBy("list").parquet(f"{path}/codes")
    index = InvertedFile(path, scope, centroids, reach, codes.schema)
    index.codes(spark).groupBy(scope, "list").agg(F.count("*").alias("n")).write.parquet(f"{path}/sizes")
    about = json.dumps({"scope": scope, "reach": reach, "schema": codes.schema.jsonValue()})
    rows = [(about if i == 0 else None, i, c.tolist()) for i, c in enumerate(centroids)]
    spark.createDataFrame(rows, "about string, list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    return index


def opened(spark: SparkSession, path: str) -> InvertedFile:
    """An index that ``build`` has stored; its centroids are at most ``LISTS`` rows."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    about = json.loads(rows[0]["about"])
    return InvertedFile(path, about["scope"], np.array([r["centroid"] for r in rows]), about["reach"], StructType.fromJson(about["schema"]))


def probed(index: InvertedFile, queries: DataFrame, reach: float | None = None) -> DataFrame:
    """``queries`` once for each list that they open."""
    listed = _listed(queries.where("embedding is not null"), "embedding", index.centroids, index.reach if reach is None else reach)
    return listed.withColumn("list", F.explode("lists")).drop("lists")


def search(index: InvertedFile, vectors: DataFrame, queries: DataFrame, k: int, reach: float | None = None, width: int = 2) -> DataFrame:
    """As ``vectors.knn``, from the opened lists' codes: the ``width * k`` best by code are compared exactly, no others."""
    spark = queries.sparkSession
    asked = probed(index, queries, reach)
    lists = sorted(r[0] for r in asked.select("list").distinct().collect())  # at most LISTS numbers
    codes = index.codes(spark).where(F.col("list").isin(lists)) if lists else index.codes(spark).where("false")
    short = knn(codes, asked, width * k, [index.scope, "list"]).select("query_id", "document_id")
    met = short.join(vectors.select("document_id", F.col("embedding").alias("__a")), "document_id").join(queries.select("query_id", F.col("embedding").alias("__b")), "query_id")
    met = met.select("query_id", "document_id", (1 - cosine(F.col("__a"), F.col("__b"))).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "document_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def reads(index: InvertedFile, queries: DataFrame, reach: float | None = None) -> DataFrame:
    """(query_id, codes_read, codes_in_scope): codes of its scope in the lists that a query opens, and in all lists."""
    sizes = index.sizes(queries.sparkSession)
    read = probed(index, queries, reach).select("query_id", index.scope, "list").join(sizes, [index.scope, "list"]).groupBy("query_id").agg(F.sum("n").alias("codes_read"))
    whole = queries.join(sizes.groupBy(index.scope).agg(F.sum("n").alias("codes_in_scope")), index.scope).select("query_id", "codes_in_scope")
    return whole.join(read, "query_id", "left").select("query_id", F.coalesce("codes_read", F.lit(0)).alias("codes_read"), "codes_in_scope")


def recall(index: InvertedFile, vectors: DataFrame, queries: DataFrame, k: int, reach: float | None = None) -> DataFrame:
    """(query_id, recall): the share of the exact ``k`` nearest that the index finds, under the same scope and boundary; requests without any are left out."""
    exact = knn(vectors, queries, k, index.scope).select("query_id", "document_id")
    near = search(index, vectors, queries, k, reach).select("query_id", "document_id", F.lit(1).alias("hit"))
    return exact.join(near, ["query_id", "document_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
