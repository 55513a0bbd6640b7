"""Tables that change by key, and answers stored under hashes."""

import os
import random

from pyspark.sql import functions as F

from threadlens.sources import keyed


def files(path):
    return {f: os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def content(spark, path, schema):
    return sorted(map(tuple, keyed.read(spark, path, schema).drop("bucket").collect()), key=repr)


def test_replaced_rows_leave_other_buckets_alone(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = [(k, i, f"{k}-{i}") for k in [None, *range(200)] for i in range(3)]
    df = spark.createDataFrame(rows, "k int, i int, v string")
    keyed.created(df, path, ["k"], 16)
    before = files(path)
    new = spark.createDataFrame([(5, 0, "new"), (None, 7, "none"), (900, 1, "more")], df.schema)
    gone = spark.createDataFrame([(6,), (777,)], "k int")
    touched = keyed.replaced(spark, path, df.schema, ["k"], new, gone, 16)
    want = sorted([r for r in rows if r[0] not in (5, None, 6)] + [(5, 0, "new"), (None, 7, "none"), (900, 1, "more")], key=repr)
    assert content(spark, path, df.schema) == want and 1 < len(touched) < 16
    after = files(path)
    same = {f for d, _, names in os.walk(path) for f in names if f.startswith("part-") and int(d.split("bucket=")[1]) not in touched}
    assert same and all(after[f] == before[f] for f in same)  # not written again
    assert keyed.replaced(spark, path, df.schema, ["k"], new, gone, 16) == touched  # again: the same table
    assert content(spark, path, df.schema) == want
    assert keyed.replaced(spark, path, df.schema, ["k"], new.limit(0), buckets=16) == [] and content(spark, path, df.schema) == want


def test_a_bucket_may_become_empty(spark, tmp_path):
    path = f"{tmp_path}/t"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    keyed.created(df, path, ["k"], 64)
    keyed.replaced(spark, path, df.schema, ["k"], df.limit(0), df.where("k = 1").select("k"), 64)
    assert content(spark, path, df.schema) == [(2, "b")]


def test_upserts_against_a_dictionary(spark, tmp_path):
    r, path, own = random.Random(1), f"{tmp_path}/t", {}
    kind = "k int, v int"
    keyed.created(spark.createDataFrame([], kind), path, ["k"], 8)
    schema = spark.createDataFrame([], kind).schema
    for _ in range(3):
        rows = [(r.randrange(40), r.randrange(1000)) for _ in range(30)]
        keyed.upserted(spark, path, schema, ["k"], spark.createDataFrame(rows, kind), [F.col("v").desc()], 8)
        own |= {k: max(v for x, v in rows if x == k) for k, _ in rows}
        assert content(spark, path, schema) == sorted(own.items(), key=repr)


def test_answers_are_asked_for_once(spark, tmp_path):
    path, kind = f"{tmp_path}/a", "input_hash string, answer int"
    schema = spark.createDataFrame([], kind).schema
    asked = spark.createDataFrame([(f"t{i % 50}",) for i in range(80)] + [(None,)], "text string").withColumn("input_hash", F.sha2("text", 256))
    keyed.stored(asked.where("text in ('t1', 't2')").selectExpr("input_hash", "-1 AS answer").distinct(), path)
    calls = []

    def ask(missing):
        calls.append(missing.count())
        return missing.selectExpr("input_hash", "length(text) AS answer")

    got = keyed.answered(spark, path, schema, asked, ask).collect()
    assert len(got) == 50 and sum(r["answer"] == -1 for r in got) == 2 and calls == [48]
    before = files(path)
    assert sorted(keyed.answered(spark, path, schema, asked, ask).collect()) == sorted(got) and calls == [48] and files(path) == before
    # one input opens one folder
    one = asked.where("text = 't7'").select("input_hash").distinct()
    part = keyed.known(spark, path, schema, one)
    part.collect()
    node = part._jdf.queryExecution().executedPlan()
    while node.children().size():
        node = node.children().apply(0)
    assert node.metrics().apply("numPartitions").value() == 1 < len(next(os.walk(path))[1])
