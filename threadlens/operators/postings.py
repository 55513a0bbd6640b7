"""Joins over postings: documents that share keys with a request, without walking through the lists of hot keys.

Exact cuts keep a key that a third of all documents carry out of the join: where the order of the result doesn't depend on the
request, only the first few of a list can be in it; where several shared terms are asked for, one of them is not among the commonest of either side; and
where only the first few by the number of shared terms are wanted, they are among the first few of those that have the same terms in common with the request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.operators import joins as op

#: Rows of up to so many terms are listed under every set of their terms (120 of two terms or more), others are joined by single terms.
FEW_TERMS = 7


def first_sharing(docs: DataFrame, asked: DataFrame, keys: list[str], order: list[Column], limit: int, request: str = "request_id", document: str = "document_id") -> DataFrame:
    """(request, document, rank): of each request the first ``limit`` documents, by ``order`` of the documents, that share any key with it.

    ``docs``: document, <keys> and what ``order`` names; ``asked``: request, <keys>. The first of a union are among the first of its parts, so every key's list
    is cut to ``limit`` before the join (Spark cuts it before the shuffle, too), and no request meets more than that for each of its keys.
    """
    held = docs.distinct()
    listed = held.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, document))).where(F.col("__n") <= limit).drop("__n")
    hits = asked.select(request, *keys).distinct().join(listed, keys).drop(*keys).distinct()
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(request).orderBy(*order, document))).where(F.col("rank") <= limit).select(request, document, "rank")


def rarest_first(rows: DataFrame, frequencies: DataFrame, scope: list[str], terms: str) -> DataFrame:
    """``rows`` with ``terms`` as sorted structs (n, term) of those that documents have, the rarest first; rows without any are left out."""
    rest = [c for c in rows.columns if c not in (*scope, terms)]
    each = rows.select(F.struct(*rest).alias("__row"), *scope, F.explode(F.array_distinct(terms)).alias("term"))
    met = each.join(frequencies, [*scope, "term"]).groupBy("__row", *scope).agg(F.array_sort(F.collect_list(F.struct("n", "term"))).alias(terms))  # a row's own terms
    return met.select(*scope, "__row.*", terms)


def sharing(docs: DataFrame, asked: DataFrame, scope: list[str], least: int = 2, terms: str = "terms") -> DataFrame:
    """Pairs of a request and a document of its scope that share at least ``least`` terms, with ``matched_terms``.

    ``docs`` and ``asked``: <scope>, ``terms`` (array) and columns of their own, of different names, that tell their rows apart. Terms are ordered by how many documents of the
    scope have them. Of the terms that a pair shares the rarest has ``least - 1`` shared ones after it, so it is among neither side's last ``least - 1``: these aren't
    joined at all, and the commonest term of a scope never is. A pair comes once, at its rarest shared term.
    """
    each = docs.select(*scope, F.explode(F.array_distinct(terms)).alias("term"))
    frequencies = each.groupBy(*scope, "term").agg(F.count("*").alias("n"))
    left, right = rarest_first(docs, frequencies, scope, terms), rarest_first(asked, frequencies, scope, terms)
    prefix = lambda c: F.explode(F.slice(c, F.lit(1), F.greatest(F.size(c) - (least - 1), F.lit(0)))).alias("__x")
    left = left.withColumnRenamed(terms, "__d").select("*", prefix("__d"))
    right = right.withColumnRenamed(terms, "__q").select("*", prefix("__q"))
    met = right.join(left, [*scope, "__x"]).withColumn("__both", F.array_intersect("__q", "__d"))
    met = met.where((F.size("__both") >= least) & (F.col("__both")[0] == F.col("__x")))
    return met.withColumn("matched_terms", F.size("__both").cast("long")).drop("__x", "__q", "__d", "__both")


def _subsets(terms: Column, least: int, kind: str) -> Column:
    """Every set of ``least`` entries or more of a sorted array without repetitions, in its order."""
    none = F.array(F.array().cast(kind))
    every = F.aggregate(terms, none, lambda sets, t: F.concat(sets, F.transform(sets, lambda s: F.concat(s, F.array(t)))))
    return F.filter(every, lambda s: F.size(s) >= least)


def _first(rows: DataFrame, keys: list[str], order: Column, limit: int, session: list[str]) -> DataFrame:
    """The rows of each key that can be among its first ``limit`` once any one session is taken out: ``limit`` of each session, of those twice as many."""
    if session:
        rows = op.top_per_key(rows, [*keys, *session], [order], limit, "__n").drop("__n")
    return op.top_per_key(rows, keys, [order], 2 * limit if session else limit, "__n").drop("__n")


def _earlier(docs: DataFrame, asked: DataFrame, keys: list[str], limit: int, at: str, until: str, document: str) -> DataFrame:
    """Requests, each beside the first ``limit`` documents of its key (keys that end in the session) whose ``at`` lies before its ``until``.

    Both are laid on one line per key. The least documents so far are running minima: what does not become the least, or is the least no more, goes on to the next.
    """
    kinds = {c: d.select(F.struct(*[x for x in d.columns if x not in keys]).alias("r")).schema["r"].dataType for c, d in (("__doc", docs), ("__ask", asked))}
    put = lambda d, own, other, when, n: d.select(*keys, F.col(when).alias("__at"), F.lit(n).alias("__kind"), F.struct(*[x for x in d.columns if x not in keys]).alias(own), F.lit(None).cast(kinds[other]).alias(other))
    line = put(docs, "__doc", "__ask", at, 1).unionByName(put(asked, "__ask", "__doc", until, 0))
    w = Window.partitionBy(*keys).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, -1)
    line = line.withColumn("__x", F.when(F.col("__doc").isNotNull(), F.struct(f"__doc.{document}", "__doc")))
    for i in range(limit):
        least = F.col(f"__m{i}")
        line = line.withColumn(f"__m{i}", F.min("__x").over(w)).withColumn("__x", F.when(F.col("__x").isNotNull() & least.isNotNull(), F.greatest("__x", least)))
    found = line.where("__ask IS NOT NULL").select(*keys, "__ask.*", F.explode(F.array_compact(F.array(*[f"__m{i}" for i in range(limit)]))).alias("__m"))
    return found.select(*[c for c in found.columns if c != "__m"], "__m.__doc.*")


def top_sharing(docs: DataFrame, asked: DataFrame, scope: list[str], limit: int, least: int = 2, session: tuple[str, str, str, str] | None = None, terms: str = "terms", request: str = "request_id", document: str = "document_id") -> DataFrame:
    """(request, document, matched_terms, rank): of each request the first ``limit`` documents of its scope that share at least ``least`` terms with it, those that share more first, then by document.

    ``docs``: document, <scope>, ``terms`` (array); ``asked``: request, <scope>, ``terms``. ``session`` names the columns (session, number) of a document and (session, number) of a
    request: documents of the request's session with its number or a later one don't count. A document that shares the terms S, and no more, with a request comes after all earlier
    documents that have S; so it is among the first ``limit`` that have S, and no list beyond those is walked through. Documents of other sessions are met in lists of twice the limit (less
    at most ``limit`` of the request's own), those of its own session in running minima. The lists of all sets of terms are kept for rows of ``FEW_TERMS`` or fewer; pairs
    with a row of more terms come from ``sharing``. One number, the most terms of a row, comes to the driver.
    """
    there, at, own, until = session or (None,) * 4
    kind = docs.schema[terms].dataType.simpleString()
    plain = lambda d, name: d.withColumn(name, F.array_sort(F.array_distinct(F.array_compact(terms)))).where(F.size(name) >= least)
    docs, asked = plain(docs, terms), plain(asked, terms)
    counts = docs.select(F.size(terms).alias("n")).unionByName(asked.select(F.size(terms).alias("n")))
    widest = counts.agg(F.max("n")).first()[0] or 0
    few = lambda d: d.where(F.size(terms) <= FEW_TERMS) if widest > FEW_TERMS else d
    many = lambda d: d.where(F.size(terms) > FEW_TERMS)

    keys, order = [*scope, "__s"], F.col(document).asc_nulls_last()
    held = few(docs).withColumnRenamed(terms, "__d")
    listed = _first(held, [*scope, "__d"], order, limit, [there] if session else [])
    listed = _first(listed.withColumn("__s", F.explode(_subsets(F.col("__d"), least, kind))), keys, order, limit, [there] if session else [])
    wanted = few(asked).withColumnRenamed(terms, "__q").withColumn("__s", F.explode(_subsets(F.col("__q"), least, kind)))
    whole = F.array_intersect("__q", "__d") == F.col("__s")  # a pair comes once, by all that it shares
    out = [request, document, F.size("__s").cast("long").alias("matched_terms")]
    met = wanted.join(listed, keys).where(whole)
    hits = (met.where(F.col(there) != F.col(own)) if session else met).select(*out)
    if session:
        asking = wanted.withColumnRenamed(own, there)
        near = held.join(asking.select(*scope, there).distinct(), [*scope, there], "left_semi").withColumn("__s", F.explode(_subsets(F.col("__d"), least, kind)))
        hits = hits.unionByName(_earlier(near, asking, [*keys, there], limit, at, until, document).where(whole).select(*out))
    if widest > FEW_TERMS:
        for d, a in ((many(docs), asked), (few(docs), many(asked))):
            pairs = sharing(d, a, scope, least, terms)
            hits = hits.unionByName((pairs.where(~((F.col(there) == F.col(own)) & (F.col(at) >= F.col(until)))) if session else pairs).select(request, document, "matched_terms"))
    return op.top_per_key(hits, [request], [F.col("matched_terms").desc(), order], limit)
