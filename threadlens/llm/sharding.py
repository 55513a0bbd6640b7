"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into ``2 ** ring_bits`` slots; each shard owns ``vnodes`` hashed slots, and a key belongs to the
first virtual node clockwise of its slot. Only the rows per slot (a table whose size the ring bounds) reach the
driver, which fills the shards there: a slot's keys go to their home shard while it has room, the rest continue
clockwise to the next shard with room, until all stand. Within a slot the keys stand in the order of their hash, so
each row finds its shard and its slot number from its rank alone. With ``epsilon=0`` a shard's capacity is its
exact share, hence row counts are at most one apart; a larger ``epsilon`` lets fewer keys move when a shard is added.

A slot with more than ``HOT`` times the mean number of rows, as a null or repeated key makes it, is ranked in ``SUBS`` parts, dealt by the
rows' places (``places``), and counted by part: no window holds more than a part.

Defined cases: a null key hashes as null and is placed like any other; a null text counts as no bytes; repeated rows
are placed one by one, ties between identical rows go by their place; an empty table gives an empty result; other
columns, of whatever names, are handed on untouched, but those named ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

import bisect
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlens.llm.places import AT, FILE, stored, unused
from threadlens.session import table
from threadlens.work import Workspace

#: A slot is hot from so many times the mean on, and ranked in so many parts.
HOT, SUBS = 64, 64


def ring_nodes(n_shards: int, vnodes: int, ring_bits: int) -> list[tuple[int, int]]:
    """(slot, shard) of all virtual nodes, clockwise. A shard's own nodes don't depend on how many shards there are."""
    at = lambda s, r: int.from_bytes(hashlib.blake2b(f"{s}:{r}".encode(), digest_size=8).digest(), "big") >> (64 - ring_bits)
    return sorted((at(s, r), s) for s in range(n_shards) for r in range(vnodes))


def fill(counts: dict[int, int], n_shards: int, vnodes: int, ring_bits: int, epsilon: float) -> list[tuple[int, int, int, int, int]]:
    """Place the rows of each slot: (slot, first rank, end rank, shard, first number in the shard)."""
    total = sum(counts.values())
    nodes = ring_nodes(n_shards, vnodes, ring_bits)
    places = [slot for slot, _ in nodes]
    if epsilon:
        room = [int(-(-total * (1 + epsilon) // n_shards))] * n_shards
    else:
        room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    clockwise: dict[int, list[int]] = {}

    def walk(first: int) -> list[int]:
        if first not in clockwise:
            clockwise[first] = list(dict.fromkeys(shard for _, shard in nodes[first:] + nodes[:first]))
        return clockwise[first]

    waiting = [[slot, 0, n, walk(bisect.bisect_left(places, slot) % len(places))] for slot, n in sorted(counts.items())]
    used, placed, hop = [0] * n_shards, [], 0
    while waiting:
        for job in waiting:
            slot, done, n, shards = job
            shard = shards[hop]
            if take := min(n - done, room[shard]):
                placed.append((slot, done, done + take, shard, used[shard]))
                used[shard] += take
                room[shard] -= take
                job[1] += take
        waiting = [job for job in waiting if job[1] < job[2]]
        hop += 1
    return placed


def ring_shards(df: DataFrame, key: str, n_shards: int, vnodes: int = 64, epsilon: float = 0.0, ring_bits: int = 14) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (its number in the shard, from 0 and gapless). DataFrame functions only."""
    spark = df.sparkSession
    df = stored(df, Workspace(spark, "ring"))
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    s, sub, r, file, at = unused(df.columns, "__s", "__sub", "__r", FILE, AT)
    spot = F.shiftrightunsigned(F.xxhash64(F.lit("ring"), F.col(key)), 64 - ring_bits)
    counts = {x["s"]: x["n"] for x in df.groupBy(spot.alias("s")).agg(F.count("*").alias("n")).collect()}
    hot = [x for x, n in counts.items() if n > HOT * sum(counts.values()) / 2**ring_bits + HOT]  # at most 2 ** ring_bits / HOT
    rows = df.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at), spot.alias(s))
    rows = rows.withColumn(sub, F.when(F.col(s).isin(hot), F.pmod(F.xxhash64(F.col(file), F.col(at)), F.lit(SUBS))).otherwise(0) if hot else F.lit(0).cast("long"))
    # where each part of a slot begins among the slot's ranks
    begins = {(x, 0): 0 for x in counts}
    if hot:
        parts = {(x[s], x[sub]): x["n"] for x in rows.where(F.col(s).isin(hot)).groupBy(s, sub).agg(F.count("*").alias("n")).collect()}
        for x in hot:
            for i in range(1, SUBS):
                begins[x, i] = begins[x, i - 1] + parts.get((x, i - 1), 0)
    spans = []
    for x, a, b, shard, used in fill(counts, n_shards, vnodes, ring_bits, epsilon):
        own = SUBS if x in set(hot) else 1
        for i in range(own):  # the span in the ranks of each part that it meets
            low, high = begins[x, i], begins[x, i + 1] if i + 1 < own else counts[x]
            if (first := max(a, low)) < (end := min(b, high)):
                spans.append({"s": x, "sub": i, "a": first - low, "b": end - low, "shard": shard, "at": used + first - a})
    plan = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(spans)), "array<struct<s long, sub long, a long, b long, shard int, at long>>")).alias("p")).select("p.*").alias("p")
    order = Window.partitionBy(s, sub).orderBy(F.xxhash64(F.lit("order"), F.col(key)), F.col(key), F.col(file), F.col(at))
    ranked = rows.withColumn(r, F.row_number().over(order).cast("long") - 1)
    # at most 2 ** ring_bits spans, n_shards more, and as many again for the parts of hot slots: the ring bounds what is broadcast
    met = ranked.join(F.broadcast(plan), (F.col(s) == F.col("p.s")) & (F.col(sub) == F.col("p.sub")) & (F.col(r) >= F.col("p.a")) & (F.col(r) < F.col("p.b")))
    return met.select(*[ranked[c] for c in kept], F.col("p.shard").alias("shard"), (F.col("p.at") + F.col(r) - F.col("p.a")).alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 39, row counts at most one apart."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return ring_shards(docs, "doc_id", 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
