"""Exact deduplication by two-pass Bloom filtering.

A text's identity is the SHA-256 of its bytes without white space. Pass one writes the digests and notes, per bit of a
Bloom filter, whether one or several digests set it; pass two lets every digest of which some bit was set once only
pass straight through, for it cannot repeat. Only the rest (true repeats and a few false positives) shuffle, grouped
by the full digest, so the result is exact whatever the filter lets through.

The filter has ``bits_per_row`` bits for each row but never more than ``max_bits``: for more rows the digests are dealt by their first
bytes to slices, each in a folder of its own, and one slice after the other builds its filter and is probed with it. So what the driver
and every task hold is one filter of at most ``max_bits``, and each digest is read twice however many slices there are.

``keep_one`` drops rows by their place (``places``): digests and places shuffle, whole rows never do.

Defined cases: a null text equals the empty one; repeated rows with one doc_id are copies like any other, one row of
them stays; a null doc_id loses ties against any other; an empty table gives an empty result; other columns, of whatever
names, are handed on by ``keep_one`` and left out by ``decide``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.common import arrow_limits, SPACES, tidy
from threadlens.llm.places import AT, FILE, picked, placed, stored
from threadlens.session import table
from threadlens.work import Workspace, kept_at

HASHES = 2
BLOCK_BITS = 1 << 19


def positions(digests: list[bytes] | np.ndarray, bits: int) -> np.ndarray:
    """Filter positions of 32-byte digests, one row per digest: taken from bytes that slicing doesn't use."""
    a = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)
    return (a[:, 2 : 2 + HASHES] % np.uint64(bits)).astype(np.int64)


def digested(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__digest`` and ``__length`` (code points of the original text)."""
    names = docs.columns
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(len(names)).to_pylist()
            d = [hashlib.sha256(t.translate(None, SPACES)).digest() for t in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(d, pa.binary()), batch.column(len(names) + 1)], names=[*names, "__digest", "__length"])

    filled = F.coalesce(F.col(text), F.lit(""))
    schema = docs.select("*", F.lit(b"").alias("__digest"), F.lit(0).alias("__length")).schema
    return docs.select("*", filled.cast("binary").alias("__text"), F.length(filled).alias("__length")).mapInArrow(tidy(run), schema)


def may_repeat(digests: list[bytes], filter_: bytes, bits: int) -> np.ndarray:
    """Which digests have all their bits set by several rows."""
    at = positions(digests, bits) if digests else np.zeros((0, HASHES), np.int64)
    return ((np.frombuffer(filter_, np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)


def several(digests: DataFrame, bits: int) -> bytes:
    """The filter of bits that more than one row set, merged block by block from what the partitions send."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts):
            at, n = np.unique(np.concatenate(parts), return_counts=True)
            edges = np.searchsorted(at, np.arange(0, bits + BLOCK_BITS, BLOCK_BITS))
            rows = [(i, (at[a:b] - i * BLOCK_BITS).astype(np.uint32).tobytes(), (at[a:b][n[a:b] > 1] - i * BLOCK_BITS).astype(np.uint32).tobytes()) for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
            block, once, more = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["block", "once", "more"])

        parts, held = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(positions(batch.column(0).to_pylist(), bits).ravel())
                held += len(parts[-1])
                if held > 4_000_000:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen, twice = None, None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(twice).tobytes()], pa.binary())], names=["block", "bits"])

        for batch in batches:
            for b, once, more in zip(*(c.to_pylist() for c in batch.columns)):
                if b != block:
                    if block is not None:
                        yield out()
                    block, seen, twice = b, np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
                at = np.frombuffer(once, np.uint32)
                twice[at] |= seen[at]
                seen[at] = True
                twice[np.frombuffer(more, np.uint32)] = True
        if block is not None:
            yield out()

    parts = digests.select("__digest").mapInArrow(tidy(sets), "block long, once binary, more binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(tidy(merge), "block long, bits binary")
    whole = np.zeros(-(-bits // BLOCK_BITS) * BLOCK_BITS // 8, np.uint8)
    for r in merged.toLocalIterator():
        whole[r["block"] * BLOCK_BITS // 8 : (r["block"] + 1) * BLOCK_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return whole.tobytes()


def probed(df: DataFrame, shared: Broadcast, bits: int) -> DataFrame:
    """``df`` (with ``__digest``) and ``__maybe``: false where the digest cannot repeat."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = may_repeat(batch.column(names.index("__digest")).to_pylist(), shared.value, bits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], names=[*names, "__maybe"])

    return df.mapInArrow(tidy(run), df.select("*", F.lit(False).alias("__maybe")).schema)


def flagged(digests: DataFrame, work: Workspace, bits_per_row: int, max_bits: int) -> DataFrame:
    """``digests`` (a working table) with ``__maybe``, one filter at a time; as a working table."""
    spark = digests.sparkSession
    n = digests.count()
    slices = max(1, -(-n * bits_per_row // max_bits))
    bits = max(64, -(-n * bits_per_row // slices))
    parts = [digests]
    if slices > 1:
        slice_ = F.conv(F.hex(F.substring("__digest", 1, 4)), 16, 10).cast("long") % slices
        # a slice in up to 16 files, which its first bytes don't tell apart
        dealt = digests.withColumn("__slice", slice_).repartition("__slice", F.pmod(F.xxhash64("__digest"), F.lit(16)))
        folder = f"{work.path}/slices"
        dealt.write.option("compression", "zstd").partitionBy("__slice").parquet(folder)
        met = sorted(r[0] for r in dealt_slices(spark, folder))
        parts = [spark.read.schema(digests.schema).parquet(f"{folder}/__slice={i}") for i in met]
    out = []
    for part in parts:
        shared = spark.sparkContext.broadcast(several(part, bits))
        out.append(work.keep(probed(part, shared, bits), "flagged"))
        shared.destroy()
    return spark.read.schema(out[0].schema).parquet(*[kept_at(x) for x in out])


def dealt_slices(spark: SparkSession, folder: str) -> list:
    return spark.read.parquet(folder).select("__slice").distinct().collect()


def winners(maybe: DataFrame, row: list[str], work: Workspace) -> DataFrame:
    """Per digest: how many rows, and which stays (most code points, then smallest id, then the first by ``row``)."""
    best = F.max(F.struct("__length", F.bitwise_not("doc_id").alias("__o"), *[F.bitwise_not(c).alias(c) for c in row]))  # of integers, ~x orders as -x and never overflows
    groups = maybe.groupBy("__digest").agg(F.count("*").alias("group_size"), best.alias("__b"))
    stays = [F.bitwise_not(F.col(f"__b.{c}")).alias(f"__keep{c}") for c in row]
    # a table of its own, so that the join that follows can split a hot digest's rows
    return work.keep(groups.select("__digest", "group_size", F.bitwise_not("__b.__o").alias("keep_id"), *stays), "groups")


def decide(docs: DataFrame, text: str = "text", bits_per_row: int = 16, max_bits: int = 1 << 30) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    work = Workspace(docs.sparkSession, "bloom")
    rows = digested(docs.select("doc_id", F.col(text).alias("__t")), "__t").select("doc_id", "__digest", "__length", F.monotonically_increasing_id().alias("__row"))
    seen = flagged(work.keep(rows, "digests"), work, bits_per_row, max_bits)
    maybe = seen.where("__maybe")
    met = maybe.join(winners(maybe, ["__row"], work), "__digest").select("doc_id", "keep_id", "group_size", (F.col("__row") == F.col("__keep__row")).alias("kept"), "__digest")
    alone = seen.where(~F.col("__maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "__digest")
    return alone.unionByName(met).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("__digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, text: str = "text", bits_per_row: int = 16, max_bits: int = 1 << 30) -> DataFrame:
    """``docs`` with one row of every class of equal texts; rows stay where they are, the others are left out by their places."""
    work = Workspace(docs.sparkSession, "bloom")
    docs = stored(docs, work)
    rows = digested(placed(docs, "doc_id", F.col(text).alias("__t")), "__t").select("doc_id", "__digest", "__length", FILE, AT)
    maybe = flagged(work.keep(rows, "digests"), work, bits_per_row, max_bits).where("__maybe")
    met = maybe.join(winners(maybe, [FILE, AT], work), "__digest")
    losers = met.where((F.col(FILE) != F.col(f"__keep{FILE}")) | (F.col(AT) != F.col(f"__keep{AT}")))
    return picked(docs, losers.select(FILE, AT), False, work)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of every document's whole text."""
    return decide(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
h AS (SELECT doc_id, length(t) AS len, sha256(n) AS text_sha256 FROM d)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id)
"""
