"""Stateful streams against the batch rules over everything they have seen, across restarts."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from threadlens.streaming import ingest, stateful

@pytest.fixture(autouse=True)
def one_partition(spark):
    """Each partition of a stateful stream starts a worker of its own in every batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


KIND = "employee int, key int, body int, message int, revision int, role string, arrival long"


def events(n=240, seed=3):
    r = random.Random(seed)
    return [(r.randrange(3), r.choice([None, *range(20)]), r.randrange(2), r.randrange(12), r.choice([1, 1, 2, 2, 3, 4]), r.choice(["user"] * 9 + ["assistant"])) for _ in range(n)]


def started(spark, tmp_path, rows, of, kind, now):
    """A stream of ``of`` from its checkpoint on, after one more file of rows."""
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    w = of(spark.readStream.schema(kind).parquet(f"{tmp_path}/in")).writeStream.option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").format("parquet")
    return (w.trigger(availableNow=True) if now else w.trigger(processingTime="500 milliseconds")).start(f"{tmp_path}/out")


def streamed(spark, tmp_path, batches, of):
    """What a stream gives for batches: started anew for each."""
    for rows in batches:
        started(spark, tmp_path, rows, of, KIND, True).awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def until(spark, tmp_path, rows, of, kind, enough, seconds=90):
    """The rows of a stream that goes on by the clock, as soon as they are ``enough``; then it is stopped."""
    q, end, got = started(spark, tmp_path, rows, of, kind, False), time.time() + seconds, set()
    schema = of(spark.readStream.schema(kind).parquet(f"{tmp_path}/in")).schema
    try:
        while not enough(got) and time.time() < end:
            time.sleep(0.5)
            if os.path.isdir(f"{tmp_path}/out/_spark_metadata"):
                got = {tuple(x) for x in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()}
    finally:
        q.stop()
    return got


@pytest.mark.parametrize("rule, order", [("receipts", (1, 2, 0)), ("revisions", (2, 0, 1))])
def test_streams_decide_as_the_batch(spark, tmp_path, rule, order):
    parts = [events()[i::3] for i in range(3)]
    batches, n = [], 0
    for i in order:
        batches.append([(*x, n + j) for j, x in enumerate(parts[i])])
        n += len(parts[i])
    union = spark.createDataFrame([x for b in batches for x in b], KIND)
    if rule == "receipts":
        got = streamed(spark, tmp_path, batches, lambda s: stateful.receipts(s, ["employee", "key"], "body", "arrival"))
        want = ingest.receipts(union, ["employee", "key"], "body", [F.col("arrival")]).select("arrival", "receipt")
    else:
        got = streamed(spark, tmp_path, batches, lambda s: stateful.revisions(s, "message", "revision", "body", "arrival", ["role"]))
        want = ingest.revision_verdicts(union, "message", "revision", "body", "arrival", ["role"]).select("arrival", "verdict")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def plain_verdicts(rows):
    current, bodies, own, out = {}, {}, {}, {}
    for _, _, body, message, revision, role, arrival in sorted(rows, key=lambda x: x[-1]):
        now = current.get(message, 0)
        fits = now == 0 or own[message] == role
        if fits and revision == now + 1:
            current[message], bodies[message, revision], out[arrival] = revision, body, "accepted"
            own.setdefault(message, role)
        else:
            out[arrival] = "repeated" if fits and 0 < revision <= now and bodies[message, revision] == body else "conflict"
    return out


def test_the_revision_rule(spark):
    """A gap or another body is not stored, so what comes after it is judged as if it had not been there."""
    for seed in range(3):
        rows = [(*x, i) for i, x in enumerate(events(400, seed))]
        got = ingest.revision_verdicts(spark.createDataFrame(rows, KIND), "message", "revision", "body", "arrival", ["role"])
        assert {r["arrival"]: r["verdict"] for r in got.collect()} == plain_verdicts(rows)
    few = [(0, 0, 0, 1, 4, "u", 0), (0, 0, 0, 1, 1, "u", 1), (0, 0, 1, 1, 1, "u", 2), (0, 0, 0, 1, 1, "u", 3), (0, 0, 0, 1, 2, "x", 4), (0, 0, 5, 1, 2, "u", 5), (0, 0, 5, None, 1, "u", 6)]
    got = ingest.revision_verdicts(spark.createDataFrame(few, KIND), "message", "revision", "body", "arrival", ["role"]).orderBy("arrival").collect()
    assert [r["verdict"] for r in got] == ["conflict", "accepted", "conflict", "repeated", "conflict", "accepted", "accepted"]


def test_receipts_are_forgotten_after_their_time(spark, tmp_path):
    of = lambda s: stateful.receipts(s, ["employee", "key"], "body", "arrival", ttl_ms=500)
    assert until(spark, tmp_path, [(1, 1, 7, 0, 0, "u", 1)], of, KIND, lambda got: len(got) == 1) == {(1, "stored")}
    time.sleep(1.0)
    assert until(spark, tmp_path, [(1, 1, 8, 0, 0, "u", 2)], of, KIND, lambda got: len(got) == 2) == {(1, "stored"), (2, "stored")}


def test_dirty_sessions_are_told_when_quiet(spark, tmp_path):
    kind = "session long, sequence long"
    of = lambda s: stateful.dirty_sessions(s, "session", "sequence", quiet_ms=300)
    first = {(1, 4), (2, 7), (3, 1)}
    assert until(spark, tmp_path, [(1, 9), (1, 4), (2, 7), (1, 6), (3, 1)], of, kind, lambda got: len(got) == 3) == first
    assert until(spark, tmp_path, [(1, 8)], of, kind, lambda got: len(got) == 4) == first | {(1, 8)}
