"""Near duplicates by MinHash signatures and a multi-index Hamming join.

A text's set holds its distinct shingles of five words. Equal sets form a class with one representative. A signature has
``symbols`` MinHash values of 16 bits, in chunks; two signatures that differ in fewer than two symbols per chunk on
average agree, by the pigeonhole principle, in all but at most one symbol of some chunk. So each representative goes into one bucket
for each chunk and omitted symbol, and every pair within the distance ``2 * chunks - 1`` meets in a bucket, guaranteed.
``plan`` sizes the chunks so that sets at the similarity threshold exceed that distance with a chance below 1e-5.

Within a bucket a search by signature distance and set size finds the groups of similar signatures, and only a spanning
forest of them goes on, not their pairs. The groups' connected components are the families in which exact links can be.
Each family's full sets then meet, and a search by exact similarity gives the links' spanning forest: a member is compared only
with what no link has reached yet, so a dense group costs about one comparison a member, and no link between different texts is lost.

Large buckets and families (``forest``) are cut into parts. Each part is searched together with a few members of the whole
group; what is connected with the most popular of those needs no further look at its like, and only the others are compared
with the other parts, in blocks. So a hot group of near copies costs a copy of its rows or two. A group of n of which nothing
links costs n comparisons a member, whatever is done, and n / ``BUCKET`` copies of its signatures (n / (``FAMILY`` / shingles of a
text) of its sets).

Rows are known by their place in the files (``places``), and classes by a number, so ids may be null or repeated. Full
sets are computed only for members of a family, and found by bitmaps of places: texts don't shuffle.

Defined cases: null, empty and blank texts have the empty set, are linked with nothing and stay; fewer than five words
make one shingle; of a component the row with the smallest doc_id stays (null ids last, then by place), exactly one row; its
doc_id is the component's id, null only if all its ids are null; columns beside doc_id and text don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlens.llm.common import arrow_limits, blocks, mix, text_views, tidy, word_hashes, word_spans
from threadlens.llm.components import members as connected
from threadlens.llm.places import AT, FILE, picked, placed, stored
from threadlens.session import table
from threadlens.work import Workspace

SHINGLE = 5
_WEIGHTS = np.random.Generator(np.random.PCG64(11)).integers(1, 2**62, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Members of a bucket, and shingles of a family, that one task takes at once; more go in parts, each with some members of the whole.
BUCKET, FAMILY, PIVOTS = 1024, 50_000, 8


def plan(percent: int, miss: float = 1e-5, most_keys: int = 64) -> tuple[int, int]:
    """(chunks, symbols of a chunk): the longest chunks for which a pair at the threshold is missed with a chance below ``miss``."""
    p = 1 - percent / 100
    for width in range(8, 1, -1):
        chunks = most_keys // width
        n, least = chunks * width, 2 * chunks
        if sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(least, n + 1)) < miss:
            while chunks > 1:  # as few chunks as the chance allows
                n, least = (chunks - 1) * width, 2 * (chunks - 1)
                if sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(least, n + 1)) >= miss:
                    break
                chunks -= 1
            return chunks, width
    return most_keys // 2, 2


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    s, e, w = word_spans(data, offsets)
    h = word_hashes(data, s, e)
    if len(h) >= SHINGLE:
        rolled = sum(h[i : len(h) - SHINGLE + 1 + i] * _WEIGHTS[i] for i in range(SHINGLE))
        rolled = mix(rolled)
    out = []
    for a, b in zip(w[:-1], w[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix(np.array([(h[a:b] * _WEIGHTS[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, two fingerprints of the whole sets); zeros for empty sets."""
    full = [i for i, x in enumerate(sets) if len(x)]
    sig = np.zeros((len(sets), symbols), np.uint16)
    prints = np.zeros((2, len(sets)), np.uint64)
    if full:
        g = np.concatenate([sets[i] for i in full])
        at = np.cumsum([0] + [len(sets[i]) for i in full])[:-1]
        rng = np.random.Generator(np.random.PCG64(5))
        for k in range(symbols):
            low = np.minimum.reduceat((g ^ rng.integers(0, 2**63, dtype=np.uint64)) * (rng.integers(0, 2**62, dtype=np.uint64) * np.uint64(2) + np.uint64(1)), at)
            sig[full, k] = mix(low) >> np.uint64(48)
        prints[0, full] = np.add.reduceat(mix(g), at)
        prints[1, full] = np.add.reduceat(mix(g ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
    return sig, prints[0].astype(np.int64), prints[1].astype(np.int64)


def signed(rows: DataFrame, symbols: int) -> DataFrame:
    """(doc_id, __file, __at, n_shingles, f1, f2, sig) per row of (doc_id, t, __file, __at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_views(batch.column(1))
            for a, b in blocks(offsets, 2 << 20):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sig, f1, f2 = signatures(sets, symbols)
                own = [batch.column(i).slice(a, b - a) for i in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array([len(x) for x in sets], pa.int64()), pa.array(f1), pa.array(f2), pa.array([x.tobytes() for x in sig], pa.binary())],
                    names=["doc_id", FILE, AT, "n_shingles", "f1", "f2", "sig"],
                )

    return rows.mapInArrow(tidy(run), f"doc_id long, {FILE} long, {AT} long, n_shingles long, f1 long, f2 long, sig binary")


def keyed(reps: DataFrame, chunks: int, width: int) -> DataFrame:
    """(key, rep) for each chunk and omitted symbol."""
    salts = mix(np.arange(1, chunks * width + 1, dtype=np.uint64)).reshape(chunks, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, chunks, width).astype(np.uint64)
            keys = np.empty((len(sig), chunks, width), np.uint64)
            for omit in range(width):
                k = np.zeros((len(sig), chunks), np.uint64)
                for j in range(width):
                    if j != omit:
                        k = mix(k * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, j])
                keys[:, :, omit] = mix(k ^ salts[:, omit])
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), chunks * width)
            keys = keys.reshape(-1).astype(np.int64)
            for i in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 50_000]), pa.array(ids[i : i + 50_000])], names=["key", "rep"])

    return reps.select("rep", "sig").mapInArrow(tidy(run), "key long, rep long")


def reach(n: int, near) -> list[tuple[int, int]]:
    """A spanning forest of 0..n-1: ``near(i, open)`` says which of the open members are linked with i."""
    open_, edges = np.arange(n), []
    while len(open_) > 1:
        queue, open_ = [int(open_[0])], open_[1:]
        while queue and len(open_):
            i = queue.pop()
            hit = near(i, open_)
            if hit.any():
                found = open_[hit].tolist()
                edges += [(i, j) for j in found]
                queue += found
                open_ = open_[~hit]
    return edges


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of consecutive rows with equal leading columns, across batches."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
    for key, group in groupby(rows, lambda r: r[:keys]):
        yield key, list(group)


def in_batches(rows: Iterator[tuple], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Rows of integers as Arrow batches."""
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], names=list(names))
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], names=list(names))


def roots(n: int, edges: list[tuple[int, int]]) -> list[int]:
    """The component of each of 0..n-1."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    return [root(x) for x in range(n)]


def forest(rows: DataFrame, nearness: Callable, work: Workspace, hot: bool) -> DataFrame:
    """Edges (a, b) that connect exactly the members that chains of near ones connect, for each group ``key`` of (key, parts, member, size, load).

    ``hot`` says whether any group has several parts. ``nearness(sizes, loads)`` gives the function that says which of an array of positions are near one position.
    """
    own = F.pmod(F.xxhash64("member"), F.col("parts")).cast("int")
    columns = ["key", "p", "parts", "pivot", "member", "size", "load"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges, and for members of groups in parts (b is null) the pivots that they are connected with, as bits."""

        def found():
            for _, rows in grouped(batches, 3):
                if len(rows) > 1:
                    edges = reach(len(rows), nearness(np.array([r[5] for r in rows]), [r[6] for r in rows]))
                    for i, j in edges:
                        yield rows[i][4], rows[j][4], None, None
                    if rows[0][2] > 1:
                        of, bits = roots(len(rows), edges), {}
                        for r, x in zip(rows, of):
                            bits[x] = bits.get(x, 0) | (1 << r[3] if r[3] >= 0 else 0)
                        for r, x in zip(rows, of):
                            if r[3] < 0:
                                yield r[4], None, r[0], bits[x]

        yield from in_batches(found(), ("a", "b", "key", "met"))

    first = rows.select("key", own.alias("p"), "parts", F.lit(-1).alias("pivot"), "member", "size", "load")
    if hot:
        large = work.keep(rows.where("parts > 1"), "large")
        # members of the whole group that join each part: copies of theirs, so that they stand beside themselves
        some = large.withColumn("pivot", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("member"))) - 1).where(F.col("pivot") < PIVOTS)
        first = first.unionByName(some.withColumn("p", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")))).select(*columns))
    met = work.keep(first.repartition("key", "p").sortWithinPartitions("key", "p", "member").select(*columns).mapInArrow(tidy(search), "a long, b long, key long, met long"), "searched")
    edges = met.where("b IS NOT NULL").select("a", "b")
    if not hot:
        return edges
    marks = met.where("b IS NULL").select(F.col("a").alias("member"), "key", "met")
    # every member of a group in parts has a mark, so the marks' counts are the members'
    popular = marks.groupBy("key").agg(F.array(*[F.sum(F.getbit("met", F.lit(i))) for i in range(PIVOTS)]).alias("n"), F.count("*").alias("all"))
    popular = popular.select("key", (F.array_position("n", F.array_max("n")) - 1).cast("int").alias("best"), (F.col("all") - F.array_max("n")).alias("left"), "all")
    popular = work.keep(popular.where(F.col("left") > 0), "popular")
    alone = marks.join(popular, "key").where("getbit(met, best) = 0").select("key", "member", "left", "all")
    # the others, in blocks of the size of a part, against every part
    many = F.ceil(F.col("left") * F.col("parts") / F.col("all")).cast("int")
    block = lambda c: F.explode(F.sequence(F.lit(0), c.cast("int") - 1))
    open_ = large.join(alone, ["key", "member"]).withColumn("q", F.pmod(F.xxhash64("member"), many).cast("int")).withColumn("p", block(F.col("parts"))).withColumn("open", F.lit(1))
    whole = large.join(popular, "key").withColumn("p", own).withColumn("q", block(many)).withColumn("open", F.lit(0))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for _, rows in grouped(batches, 3):
                near = nearness(np.array([r[5] for r in rows]), [r[6] for r in rows])
                here = np.array([i for i, r in enumerate(rows) if not r[3]], np.int64)
                parent = list(range(len(rows)))

                def root(x):
                    while parent[x] != x:  # noqa: B023
                        parent[x] = x = parent[parent[x]]  # noqa: B023
                    return x

                for i, r in enumerate(rows):
                    if r[3] and len(here):
                        for j in here[near(i, here)].tolist():
                            x, y = root(i), root(j)
                            if x != y and rows[j][4] != r[4]:
                                parent[x] = y
                                yield r[4], rows[j][4]

        yield from in_batches(found(), ("a", "b"))

    columns = ["key", "p", "q", "open", "member", "size", "load"]
    both = whole.select(*columns).unionByName(open_.select(*columns))
    more = both.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "member").mapInArrow(tidy(compare), "a long, b long")
    return edges.unionByName(more)


def by_signature(distance: int, percent: int, symbols: int) -> Callable:
    """``forest``'s nearness of signatures: within the distance, of sizes that allow the similarity."""

    def nearness(size: np.ndarray, loads: list[bytes]) -> Callable:
        sig = np.frombuffer(b"".join(loads), np.uint16).reshape(len(loads), symbols)

        def near(i, others):
            fits = 100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i])
            fits[fits] = (sig[others[fits]] != sig[i]).sum(1) <= distance
            return fits

        return near

    return nearness


def by_similarity(percent: int) -> Callable:
    """``forest``'s nearness of whole sets: 100 * intersection >= percent * union."""

    def nearness(size: np.ndarray, loads: list[bytes]) -> Callable:
        all_ = np.frombuffer(b"".join(loads), np.uint64)
        _, column = np.unique(all_, return_inverse=True)
        at = np.concatenate([[0], np.cumsum(size)])
        mark = np.zeros(len(all_) + 1, bool)

        def near(i, others):
            fits = 100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i])
            own, some = column[at[i] : at[i + 1]], others[fits]
            mark[own] = True
            both = np.fromiter((np.count_nonzero(mark[column[at[j] : at[j + 1]]]) for j in some), np.int64, len(some))
            mark[own] = False
            fits[fits] = 100 * both >= percent * (size[some] + size[i] - both)
            return fits

        return near

    return nearness


def shingled(rows: DataFrame) -> DataFrame:
    """(__file, __at, shingles as packed hashes) of (t, __file, __at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_views(batch.column(0))
            for a, b in blocks(offsets, 2 << 20):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (1, 2)), pa.array([x.tobytes() for x in sets], pa.binary())], names=[FILE, AT, "shingles"])

    return rows.mapInArrow(tidy(run), f"{FILE} long, {AT} long, shingles binary")


def compared(docs: DataFrame, work: Workspace, text: str, percent: int) -> DataFrame:
    """(doc_id, __file, __at, n_shingles, component_id, stays) per row of stored ``docs``."""
    arrow_limits(docs.sparkSession)
    chunks, width = plan(percent)
    t = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")
    rows = work.keep(signed(placed(docs, "doc_id", t), chunks * width), "signatures")
    same = ["f1", "f2", "n_shingles"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", FILE, AT))
    classes = rows.where("n_shingles > 0").groupBy(*same).agg(first.alias("first"), F.any_value("sig").alias("sig"))
    reps = work.keep(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    keys = keyed(reps, chunks, width)
    # buckets of one member go, and of buckets with the same members one stays
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("m"), F.bit_xor(F.xxhash64("rep")).alias("x")).where("n > 1")
    buckets = buckets.groupBy("n", "m", "x").agg(F.min("key").alias("key")).select("key", "n")
    members = work.keep(keys.join(buckets, "key"), "members")
    hot = not members.where(F.col("n") > BUCKET).isEmpty()
    signed_ = members.join(reps.select("rep", "n_shingles", "sig"), "rep")
    signed_ = signed_.select("key", F.ceil(F.col("n") / BUCKET).alias("parts"), F.col("rep").alias("member"), F.col("n_shingles").alias("size"), F.col("sig").alias("load"))
    found = connected(forest(signed_, by_signature(2 * chunks - 1, percent, chunks * width), work, hot), work)
    work.drop(members)
    families = found.select(F.col("root").alias("key"), F.col("node").alias("member"))
    families = work.keep(families.join(reps.select(F.col("rep").alias("member"), "n_shingles", f"first.{FILE}", f"first.{AT}"), "member"), "families")
    parts = families.groupBy("key").agg(F.ceil(F.sum("n_shingles") / FAMILY).alias("parts"))
    sets = shingled(picked(docs, families.select(FILE, AT), True, work, [t]))
    sets = families.join(parts, "key").join(sets, [FILE, AT]).select("key", "parts", "member", F.col("n_shingles").alias("size"), F.col("shingles").alias("load"))
    sets = work.keep(sets, "sets")
    links = connected(forest(sets, by_similarity(percent), work, not sets.where("parts > 1").isEmpty()), work)
    linked = links.select("root", F.col("node").alias("rep"))
    best = linked.join(reps.select("rep", "first"), "rep").groupBy("root").agg(F.min("first").alias("best"))
    best = work.keep(linked.join(best, "root").select("rep", "best"), "best")
    best = reps.join(best, "rep", "left").select(*same, F.coalesce("best", "first").alias("best"))
    stays = (F.col(FILE) == F.col(f"best.{FILE}")) & (F.col(AT) == F.col(f"best.{AT}"))
    return rows.join(best, same, "left").select(
        "doc_id", FILE, AT, "n_shingles", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"), F.coalesce(stays, F.lit(True)).alias("stays")
    )


def near_duplicates(docs: DataFrame, text: str = "text", percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that links reach), stays."""
    work = Workspace(docs.sparkSession, "minhash")
    return compared(stored(docs, work), work, text, percent).drop(FILE, AT)


def one_of_each(docs: DataFrame, text: str = "text", percent: int = 80) -> DataFrame:
    """``docs`` with one row of every component; rows stay where they are, the others are left out by their places."""
    work = Workspace(docs.sparkSession, "minhash")
    docs = stored(docs, work)
    return picked(docs, compared(docs, work, text, percent).where("NOT stays").select(FILE, AT), False, work)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of 0.85 or more."""
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("stays")).alias("kept"))
