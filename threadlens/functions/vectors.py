"""Vector search, exact or over codes of a byte an entry: parts of vectors meet parts of queries of the same scope."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, in doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) if n else m


#: Vectors and queries that one task compares at once.
VECTORS, QUERIES = 8192, 1024


def knn(vectors: DataFrame, queries: DataFrame, k: int, scope: str | list[str]) -> DataFrame:
    """(query_id, document_id, distance, rank): the ``k`` nearest vectors of each query within its scope, ties by id.

    ``vectors``: document_id, <scope>, embedding, and sources (array of session_id, last_no), the documents' latest source in each
    session; ``queries``: query_id, <scope>, embedding, session_id, input_no. A document with a source of the query's own session at
    or after its input is left out.

    Vectors are read once, whatever the number of queries. A scope's vectors and queries are dealt to parts of bounded size, and each part
    of vectors meets each part of its scope's queries in one task, which returns at most ``k`` rows a query.
    """
    scope = [scope] if isinstance(scope, str) else scope
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # columns of its own, should it come from the vectors
    # one row for each scope that both sides have: what is joined below is as small as the scopes are many
    sizes = vectors.groupBy(*scope).agg(F.ceil(F.count("*") / VECTORS).alias("__vs")).join(queries.groupBy(*scope).agg(F.ceil(F.count("*") / QUERIES).alias("__qs")), scope)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    left = vectors.join(sizes, scope).withColumn("__v", part("document_id", "__vs")).withColumn("__q", every("__qs")).select(*scope, "__v", "__q", "document_id", "embedding", "sources")
    right = queries.join(sizes, scope).withColumn("__q", part("query_id", "__qs")).withColumn("__v", every("__vs")).select(*scope, "__v", "__q", "query_id", "embedding", "session_id", "input_no")

    def nearest(have: pa.Table, asked: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if have.num_rows and asked.num_rows:
            ids = have["document_id"].combine_chunks().to_numpy(zero_copy_only=False)
            m = _matrix(have["embedding"].combine_chunks())
            late: dict = {}
            for i, sources in enumerate(have["sources"].to_pylist()):
                for s in sources or ():
                    late.setdefault(s["session_id"], []).append((s["last_no"], i))
            for a in range(0, asked.num_rows, 128):
                block = asked.slice(a, 128)
                sims = _matrix(block["embedding"].combine_chunks()) @ m.T
                for sim, qid, session, no in zip(sims, block["query_id"].to_pylist(), block["session_id"].to_pylist(), block["input_no"].to_pylist()):
                    sim[[i for last, i in late.get(session, ()) if last >= no]] = -np.inf
                    some = np.arange(len(sim)) if len(sim) <= k else np.flatnonzero(sim >= np.partition(sim, -k)[-k])
                    some = some[sim[some] > -np.inf]
                    best = some[np.lexsort((ids[some], -sim[some]))[:k]]
                    out[0].extend([qid] * len(best))
                    out[1].extend(ids[best].tolist())
                    out[2].extend((1 - sim[best]).tolist())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "document_id": pa.array(out[1], pa.int64()), "distance": pa.array(out[2], pa.float64())})

    keys = [*scope, "__v", "__q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearest, "query_id long, document_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "document_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def coded(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vectors`` with ``column`` as whole numbers of -127 to 127, a byte each, scaled by the vector's largest entry.

    Nothing is fitted, every row is coded, and a code's direction is close to its vector's, so a search over codes moves a quarter of the bytes.
    """
    top = F.greatest(F.array_max(F.transform(column, F.abs)), F.lit(1e-30))
    return vectors.withColumn(column, F.transform(column, lambda x: F.round(F.lit(127.0) * x.cast("double") / top.cast("double")).cast("tinyint")))


def approximate_knn(codes: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, scope: str | list[str], width: int = 2) -> DataFrame:
    """As ``knn``, from ``coded`` vectors: the ``width * k`` best by code are compared exactly, no others."""
    short = knn(codes, queries, width * k, scope).select("query_id", "document_id")
    # the short lists carry ids only; each side's vectors come to them by an equi join
    met = short.join(vectors.select("document_id", F.col("embedding").alias("__a")), "document_id").join(queries.select("query_id", F.col("embedding").alias("__b")), "query_id")
    met = met.select("query_id", "document_id", (1 - cosine(F.col("__a"), F.col("__b"))).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "document_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)
