"""Operators whose decisions SQL can't state: folds, bounded traversals, streams, sources."""

import json
import math
import os
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from threadlens import registry
from threadlens.functions import inverted_file, vectors
from threadlens.operators import aggregates, folds, graph, judging, postings, queue, results
from threadlens.operators import joins as op
from threadlens.sources import sinks, tail, transcripts
from threadlens.streaming import ingest
from threadlens.work import Workspace


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_budget_skips_and_limits(spark):
    df = spark.createDataFrame([("r", i, t) for i, t in enumerate([50, 60, 40, 10, 5])], "k string, i long, t long")
    got = folds.budgeted(df, "k", [F.col("i")], "t", F.lit(100), 3)
    assert [r[-1] for r in rows(got, "i")] == ["selected", "token_budget", "selected", "selected", "limit"]


def plain_budget(tokens, budget, limit):
    out, left, taken = [], budget, 0
    for t in tokens:
        fits = t is not None and t <= left
        out.append("limit" if taken >= limit else "selected" if fits else "token_budget")
        if taken < limit and fits:
            left, taken = left - t, taken + 1
    return out


def test_budget_as_one_row_after_the_other(spark):
    r = random.Random(4)
    shapes = [[1, 100, 1, 99, 1, 98, 1, 97] * 3, [0] * 5 + [101] + [0, 100, 0, 1], [None, 50, None, 50, 1], [51, 50, 49, 1], [100], [], [7] * 40]
    shapes += [[r.choice([0, 1, 2, 30, 60, 90, r.randrange(120)]) for _ in range(r.randint(1, 60))] for _ in range(60)]
    budgets = [100] * len(shapes[:7]) + [r.choice([-1, 0, 1, 7, 100, 1000]) for _ in shapes[7:]]
    rows = [(None if k == 9 else k, i, t, budgets[k]) for k, ts in enumerate(shapes) for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "k int, i int, t long, b long")
    for limit in (1000, 5):
        got = {}
        for x in folds.budgeted(df, "k", [F.col("i")], "t", F.col("b"), limit).orderBy("k", "i").collect():
            got.setdefault(x["k"], []).append(x["verdict"])
        assert got == {None if k == 9 else k: plain_budget(ts, budgets[k], limit) for k, ts in enumerate(shapes) if ts}


def test_budget_of_a_large_key(spark):
    df = spark.range(100_000).selectExpr("1 AS k", "id AS i", "id * 7919 % 1000 + 1 AS t")
    got = [x["verdict"] for x in folds.budgeted(df, "k", [F.col("i")], "t", F.lit(20_000_000), 10**9).orderBy("i").select("verdict").collect()]
    assert got == plain_budget([i * 7919 % 1000 + 1 for i in range(100_000)], 20_000_000, 10**9)


def test_outbox_of_a_large_queue(spark):
    r = random.Random(8)
    sizes = {1: [r.choice([0, 10, 300, 5000]) for _ in range(100_000)], None: [1] * 7, 2: [10**7, 5, None, 10**7]}
    df = spark.createDataFrame([(k, i, s) for k, ss in sizes.items() for i, s in enumerate(ss)], "p int, i int, b long")
    got = {}
    for x in sinks.outbox_batches(df, "p", ["i"], "b", 100, 20_000).orderBy("p", "i").collect():
        got.setdefault(x["p"], []).append(x["batch"])
    for k, ss in sizes.items():
        want, n, total, batch = [], 0, 0, 0
        for s in (x or 0 for x in ss):
            if n >= 100 or (n and total + s > 20_000):
                n, total, batch = 0, 0, batch + 1
            n, total = n + 1, total + s
            want.append(batch)
        assert got[k] == want


def plain_prefix(n, pairs, limit):
    kept = []
    for i in range(n):
        if not any((min(i, j), max(i, j)) in pairs for j in kept):
            kept.append(i)
            if len(kept) > limit:
                return i
    return n


def plain_collapse(rows, pairs):
    kept = []
    for x in rows:
        at = next((i for i, y in enumerate(kept) if (min(x[0], y[0]), max(x[0], y[0])) in pairs), None)
        if at is None:
            kept.append(x)
        elif x[0] in kept[at][3] or (x[1] > kept[at][1] and x[2] <= kept[at][2] and kept[at][0] not in x[3]):
            kept[at] = x
    return [x[0] for x in kept]


def test_similar_rows_in_rounds(spark):
    """Prefixes and collapse of random similarities, against one row after the other; rounds follow the chains, not the rows."""
    r = random.Random(6)
    ranked, pairs, ordered, want, slots = [], [], [], {}, {}
    for k in range(25):
        n = r.randint(1, 25)
        near = {(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < r.choice([0.02, 0.15, 0.5])}
        key = None if k == 3 else k
        rows = [(i, r.randrange(5), r.randrange(2), [j for j in range(n) if r.random() < 0.1]) for i in range(n)]
        ranked += [(key, i, i + 1) for i in range(n)]
        ordered += [(key, i, i + 1, *x[1:]) for i, x in enumerate(rows)]
        pairs += [(key, *(p if r.random() < 0.5 else p[::-1])) for p in near]
        want[key], slots[key] = plain_prefix(n, near, 4), plain_collapse(rows, near)
    pairs = spark.createDataFrame(pairs, "k int, left long, right long")
    ranked = spark.createDataFrame(ranked, "k int, d long, rank int")
    got = dict(rows_ for rows_ in folds.distinct_prefix(ranked, pairs, "k", "d", "rank", 4).groupBy("k").count().collect())
    assert got == {k: n for k, n in want.items() if n}
    ordered = spark.createDataFrame(ordered, "k int, d long, rank int, latest long, secondary int, origins array<long>")
    got = {}
    for x in folds.collapsed(ordered, pairs, "k", "d").orderBy("k", "slot").collect():
        got.setdefault(x["k"], []).append(x["d"])
    assert got == slots
    work = Workspace(spark, "rounds")
    star = spark.createDataFrame([((1,), 1, i) for i in range(2, 500)] + [((1,), i, i + 1) for i in range(2, 499)], "__k struct<k:int>, a long, b long")
    dropped, rounds = folds.repeats(star, work)
    assert dropped.count() == 498 and rounds == 1
    chain = spark.createDataFrame([((1,), i, i + 1) for i in range(1, 9)], "__k struct<k:int>, a long, b long")
    dropped, rounds = folds.repeats(chain, work)
    assert {x["b"] for x in dropped.collect()} == {2, 4, 6, 8} and rounds == 8
    assert "Python" not in folds.distinct_prefix(ranked, pairs, "k", "d", "rank", 4)._jdf.queryExecution().executedPlan().toString()


def test_distinct_prefix(spark):
    ranked = spark.createDataFrame([("q", i, i) for i in range(1, 7)], "k string, d long, rank int")
    pairs = spark.createDataFrame([("q", 1, 2), ("q", 2, 3)], "k string, left long, right long")
    # 2 repeats 1; 3 is like 2 only, which represents nothing, so it counts
    assert [r[1] for r in rows(folds.distinct_prefix(ranked, pairs, "k", "d", "rank", 2), "rank")] == [1, 2, 3]


def test_collapse_takes_the_slot(spark):
    ordered = spark.createDataFrame([("q", 1, 1, 10, 0, []), ("q", 2, 2, 20, 0, []), ("q", 3, 3, 5, 0, []), ("q", 4, 4, 99, 1, [])], "k string, d long, rank int, latest long, secondary int, origins array<long>")
    pairs = spark.createDataFrame([("q", 1, 2), ("q", 2, 3), ("q", 3, 4), ("q", 2, 4)], "k string, left long, right long")
    assert rows(folds.collapsed(ordered, pairs, "k", "d"), "slot") == [("q", 1, 2)]


def test_postings_leave_hot_terms_out(spark):
    """Against all pairs, with a term that every second document has; the hot term's list is never joined."""
    r = random.Random(2)
    sets = {i: sorted({*(["hot"] if i % 2 else []), *(["warm"] if i % 3 == 0 else []), *(f"t{r.randrange(40)}" for _ in range(r.randint(0, 4)))}) for i in range(600)}
    df = spark.createDataFrame([(i, i % 2, ts) for i, ts in sets.items()], "document_id int, p int, terms array<string>")
    asked = df.where("document_id % 10 < 2").selectExpr("document_id AS request_id", "p", "terms")
    for scope, same in (([], lambda a, b: True), (["p"], lambda a, b: a % 2 == b % 2)):
        got = {(x["request_id"], x["document_id"], x["matched_terms"]) for x in postings.sharing(df.select("document_id", *scope, "terms"), asked.select("request_id", *scope, "terms"), scope).collect()}
        want = {(a, b, len({*sets[a]} & {*sets[b]})) for a in sets if a % 10 < 2 for b in sets if same(a, b) and len({*sets[a]} & {*sets[b]}) >= 2}
        assert got == want
    joined = df.select("document_id", "terms").withColumn("n", F.size(F.array_distinct("terms")))
    pairs = sum(1 for a in sets if a % 10 < 2 and a % 2 for b in sets if b % 2)  # what the hot term alone would pair
    freq = joined.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    prefix = lambda d: d.select(F.explode(F.slice("terms", F.lit(1), F.greatest(F.size("terms") - 1, F.lit(0)))).alias("y")).select(F.col("y.term").alias("x"))
    left, right = (prefix(postings.rarest_first(d, freq, [], "terms")) for d in (df.select("document_id", "terms"), asked.select("request_id", "terms")))
    assert left.where("x = 'hot'").count() == 0 and left.join(right, "x").count() < pairs
    docs = df.select("document_id", F.explode("terms").alias("k"))
    got = {}
    for x in postings.first_sharing(docs, docs.where("document_id % 10 < 2").withColumnRenamed("document_id", "request_id"), ["k"], [F.col("document_id")], 7).orderBy("request_id", "rank").collect():
        got.setdefault(x["request_id"], []).append(x["document_id"])
    assert got == {a: [b for b in sets if {*sets[a]} & {*sets[b]}][:7] for a in sets if a % 10 < 2 and sets[a]}
    assert postings.sharing(df.limit(0).select("document_id", "terms"), asked.select("request_id", "terms"), []).collect() == []


def test_previous_rows(spark):
    df = spark.createDataFrame([("a", i, i * 10) for i in (5, 1, 3, 9)] + [("b", 1, 7), (None, 2, None), (None, 1, 4)], "k string, i int, v int")
    got = rows(op.previous(df, ["k"], "i", 2, ["v"]), "k", "i", "rank")
    assert got == [(None, 2, 1, 4), ("a", 3, 1, 10), ("a", 5, 1, 30), ("a", 5, 2, 10), ("a", 9, 1, 50), ("a", 9, 2, 30)]


def test_bfs_cap_and_cycle(spark):
    edges = op.either_end(spark.createDataFrame([(0, i, i) for i in range(1, 12)] + [(1, 2, 20), (11, 50, 30)], "a long, b long, edge_id long"), "a", "b")
    got = graph.bounded_bfs(edges, spark.createDataFrame([(7, 0)], "request_id long, node long"), 3, 10)
    assert sorted(r["node"] for r in got.collect()) == list(range(10))


def test_corrections_cycle(spark):
    rel = spark.createDataFrame([(2, 1, "change"), (3, 2, "change"), (4, 3, "revoke"), (5, 4, "change"), (1, 3, "change"), (9, 1, "accept")], "from_id long, to_id long, relation string")
    got = graph.corrections(rel, spark.createDataFrame([(1,)], "message_id long"))
    assert {(r["message_id"], r["hop"]) for r in got.collect()} == {(2, 1), (3, 2), (4, 3)}


def test_reuse_cycle_has_no_origin(spark):
    r = spark.createDataFrame([(1, 2, True), (2, 1, True), (3, 4, True), (4, None, True), (5, 4, False)], "request_id long, reused_from long, eligible boolean")
    assert dict(rows(graph.reuse_origin(r))) == {1: None, 2: None, 3: 4, 4: 4, 5: None}


def test_asof_takes_nearest_even_if_unfit(spark):
    a = spark.createDataFrame([("s", 5)], "k string, n long")
    b = spark.createDataFrame([("s", 1, "ok", 1), ("s", 4, "bad", 2), ("s", 5, "ok", 3)], "k string, m long, status string, c long")
    got = op.asof_latest(a, b, "k", "n", "m", "c").first()
    assert got["near_status"] == "bad"


def test_outbox_outcomes(spark):
    got = spark.createDataFrame([(202,), (429,), (500,), (404,)], "s int").select(sinks.outcome(F.col("s"))).collect()
    assert [r[0] for r in got] == ["acknowledged", "retry", "retry", "permanent"]
    q = spark.createDataFrame([("p", i, b) for i, b in enumerate([5, 5, 5, 20, 1])], "p string, i long, b long")
    assert [r["batch"] for r in sinks.outbox_batches(q, "p", ["i"], "b", 2, 12).orderBy("i").collect()] == [0, 0, 1, 2, 3]


def test_zstd_stops_at_a_broken_frame(spark, tmp_path):
    c = zstandard.ZstdCompressor()
    (tmp_path / "a.zst").write_bytes(c.compress(b"one\ntwo\n") + c.compress(b"three\nfour") + b"broken")
    assert [r["line"] for r in transcripts.zstd_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == ["one", "two", "three"]


def test_transcript_kinds(spark):
    lines = ["not json", "[]", '{"type": 5}', '{"type":"system"}', '{"type":"user"}', json.dumps({"type": "user", "message": {"content": "hi"}, "sessionId": "s", "uuid": "u", "timestamp": "t", "version": "1"}), json.dumps({"type": "user", "message": {"content": [{"type": "tool_result"}, {"type": "text", "text": "x"}]}, "sessionId": "s", "uuid": "u", "timestamp": "t", "version": "1"})]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = transcripts.parse_claude(df).orderBy("i").select("record.kind", "record.text").collect()
    assert [r["kind"] for r in got] == ["invalid", "unknown", "unknown", "ignored", "unknown", "message", "ignored"]
    assert got[5]["text"] == "hi"


def test_backfill(spark, tmp_path):
    (tmp_path / "x").mkdir()
    good = json.dumps({"type": "user", "message": {"content": "hi"}, "sessionId": "s", "uuid": "u", "timestamp": "t", "version": "1"})
    (tmp_path / "x" / "a.jsonl").write_text(f"{good}\n{{}}\n")
    r = transcripts.backfill(spark, str(tmp_path), transcripts.parse_claude, "one").first()
    assert (r["sessions"], r["candidates"], r["excluded"], r["versions"]) == (1, 1, 1, ["1"])


def test_stream_equals_batch(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "id long, body string").coalesce(1).write.parquet(source)
    for extra in ([(2, "b"), (3, "c")], [(3, "c")]):
        stream = spark.readStream.schema("id long, body string").parquet(source)
        ingest.stream_once(stream, out, f"{tmp_path}/cp", ["id"]).awaitTermination()
        spark.createDataFrame(extra, "id long, body string").coalesce(1).write.mode("append").parquet(source)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


@pytest.mark.parametrize("attempts, after, want", [(0, None, 30), (3, None, 240), (30, None, 3600), (0, 100, 100)])
def test_next_run(spark, attempts, after, want):
    df = spark.createDataFrame([(attempts, after)], "a int, r int")
    assert df.select(ingest.next_run(F.col("a"), F.col("r"))).first()[0] == want


def test_scan_resumes():
    from threadlens.sources.tail import Cursor, scan, still_valid

    content = b"one\n" + b"x" * 50 + b"\ntwo\n\xff\nthr"
    whole, _ = scan(content, Cursor(), longest=20)
    for cut in range(len(content)):
        first, cursor = scan(content[:cut], Cursor(), longest=20)
        rest, _ = scan(content, cursor, longest=20)
        assert first + rest == whole
    assert [(t, p) for _, t, p in whole] == [("one", ""), (None, "too_long"), ("two", ""), (None, "not_utf8")]
    small, cursor = [], Cursor()
    while True:
        part, after = scan(content, cursor, budget=7, longest=5)
        if after == cursor:
            break
        small, cursor = small + part, after
    assert [t for _, t, p in small if not p] == ["one", "two"]
    assert still_valid(cursor, 0, len(content), content) and not still_valid(cursor, 1, len(content), content) and not still_valid(cursor, 0, 3, content[:3])


def test_tail_stream(spark, tmp_path):
    from threadlens.sources.tail import TailSource

    spark.dataSource.register(TailSource)
    log, out = tmp_path / "a.jsonl", f"{tmp_path}/out"
    log.write_bytes(b"one\ntw")
    for more in (b"o\nthree\n", b""):
        q = spark.readStream.format("tail").load(f"{tmp_path}/*.jsonl").writeStream.option("checkpointLocation", f"{tmp_path}/cp").format("parquet").start(out)
        q.processAllAvailable()
        q.stop()
        with log.open("ab") as f:
            f.write(more)
    assert sorted(r["line"] for r in spark.read.parquet(out).collect()) == ["one", "three", "two"]


def test_vector_search(spark):
    """Exact search against plain numpy, with ties, scopes in parts and the input boundary; the approximate one finds nearly the same."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(900, 16)).astype(np.float32)
    v[100:120] = v[99]
    rows = [(i, i % 3, v[i].tolist(), [(i % 20, i // 20 + 1)]) for i in range(900)]
    docs = spark.createDataFrame(rows, "document_id long, project_id int, embedding array<float>, sources array<struct<session_id:int,last_no:int>>")
    asked = docs.where("document_id % 20 = 19").selectExpr("document_id AS query_id", "project_id", "embedding", "sources[0].session_id AS session_id", "sources[0].last_no AS input_no")
    vectors.VECTORS, vectors.QUERIES, before = 64, 7, (vectors.VECTORS, vectors.QUERIES)
    try:
        found = vectors.knn(docs, asked, 10, "project_id").collect()
        near = vectors.approximate_knn(vectors.coded(docs), docs, asked, 10, "project_id").collect()
    finally:
        vectors.VECTORS, vectors.QUERIES = before
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    want = {}
    for q in range(19, 900, 20):
        fits = [(round(1 - float(unit[i] @ unit[q]), 9), i) for i in range(900) if i % 3 == q % 3 and not (i % 20 == q % 20 and i // 20 >= q // 20)]
        want[q] = [i for _, i in sorted(fits)[:10]]
    got = {q: [r["document_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: (round(r["distance"], 9), r["document_id"]))] for q in want}
    assert got == want
    hits = [len(set(want[q]) & {r["document_id"] for r in near if r["query_id"] == q}) / 10 for q in want]
    assert np.mean(hits) >= 0.95 and min(hits) >= 0.8


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_recall_of_the_index(spark):
    r = registry.queries()["an.recall"](spark, "/root/testdata/sf0.01").first()
    assert r["mean_recall"] >= 0.95 and r["min_recall"] >= 0.8 and r["compared"] < r["compared_by_scan"]
    assert r["codes_read"] <= r["requests"] * r["codes"] / 4 and r["codes_read"] <= r["compared_by_scan"]


def clustered(spark, n=6000, clusters=40, d=24, seed=5):
    """Vectors around centres, of which one holds a third of all; three scopes; nulls."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d))
    of = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, clusters, n))
    v = centres[of] + rng.normal(scale=0.25, size=(n, d))
    rows = [(i, i % 3, v[i].astype(np.float32).tolist() if i % 997 else None, [(i % 20, i // 20 + 1)]) for i in range(n)]
    return spark.createDataFrame(rows, "document_id long, project_id int, embedding array<float>, sources array<struct<session_id:int,last_no:int>>")


def asked_of(docs):
    return docs.where("document_id % 100 = 7").selectExpr("document_id AS query_id", "project_id", "embedding", "sources[0].session_id AS session_id", "sources[0].last_no AS input_no")


def test_inverted_file_opens_few_lists(spark, tmp_path):
    """Vectors with structure: high recall from a quarter of the codes at most, and the other lists aren't read."""
    docs = clustered(spark).cache()
    inverted_file.build(docs, f"{tmp_path}/i", "project_id")
    index = inverted_file.opened(spark, f"{tmp_path}/i")
    assert index.codes(spark).count() == docs.where("embedding is not null").count() == index.sizes(spark).agg({"n": "sum"}).first()[0]
    asked = asked_of(docs)
    r = inverted_file.recall(index, docs.where("embedding is not null"), asked, 20).agg(F.avg("recall"), F.min("recall"), F.count("*")).first()
    assert r[0] >= 0.95 and r[1] >= 0.8 and r[2] == asked.count()
    read, scope = inverted_file.reads(index, asked).agg(F.sum("codes_read"), F.sum("codes_in_scope")).first()
    small = inverted_file.reads(index, asked, 0.0)
    assert read <= scope / 4 and 0 < small.agg(F.sum("codes_read")).first()[0] < read
    # a single request's plan names its lists as partition filters
    one = asked.where("query_id = 107")
    lists = [x[0] for x in inverted_file.probed(index, one).select("list").collect()]
    codes = index.codes(spark).where(F.col("list").isin(lists))
    plan = codes._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan or "PartitionFilters: [isnotnull(list" in plan
    codes.collect()
    node = codes._jdf.queryExecution().executedPlan()
    while node.children().size():
        node = node.children().apply(0)
    assert node.metrics().apply("numPartitions").value() == len(lists) < len(index.centroids)  # folders that the scan opened


def test_inverted_file_without_structure_or_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, 0, rng.normal(size=16).tolist(), [(0, 0)]) for i in range(400)]
    kind = "document_id long, project_id int, embedding array<float>, sources array<struct<session_id:int,last_no:int>>"
    docs = spark.createDataFrame(rows, kind)
    index = inverted_file.build(docs, f"{tmp_path}/i", "project_id")
    r = inverted_file.recall(index, docs, asked_of(docs).withColumn("input_no", F.lit(1)), 20).agg(F.avg("recall"), F.min("recall")).first()
    read, scope = inverted_file.reads(index, asked_of(docs)).agg(F.sum("codes_read"), F.sum("codes_in_scope")).first()
    assert r[0] >= 0.9 and r[1] >= 0.8 and read > scope / 2  # the calibration sees that few lists won't do
    none = inverted_file.build(spark.createDataFrame([], kind), f"{tmp_path}/n", "project_id")
    assert inverted_file.search(none, docs.limit(0), asked_of(docs), 5).collect() == []
    same = spark.createDataFrame([(i, 0, [1.0, 0.0], [(0, 0)]) for i in range(300)], kind)
    index = inverted_file.build(same, f"{tmp_path}/s", "project_id")
    assert [r["document_id"] for r in inverted_file.search(index, same, asked_of(same).limit(1).withColumn("session_id", F.lit(9)), 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_reach_is_as_short_as_finds_the_neighbours():
    sample = np.array([[1, 0], [0.99, 0.1], [0.98, 0.2], [0, 1], [0.1, 0.99], [-1, 0.0]], float)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    centroids = np.array([[1, 0], [0, 1], [-1, 0.0]])
    assert inverted_file.reach_for(sample[:5], np.zeros(5), centroids, 1, 1.0, 1.0) == 0
    assert inverted_file.reach_for(sample, np.zeros(6), centroids, 1, 1.0, 1.0) == 1  # the last one's neighbour lies elsewhere
    assert inverted_file.reach_for(sample, np.arange(6), centroids, 1, 1.0, 1.0) == 2  # alone in their scopes: no evidence


def test_judge_inputs(spark):
    prior = lambda n, size: [{"message_id": i, "revision": 1, "role": "user", "occurred_at": i, "text": "é" * size} for i in range(n)]
    target = lambda text, role="user": {"message_id": 99, "revision": 1, "role": role, "occurred_at": 5, "text": text}
    base = len(judging.body_of(target(""), {"offset": 0, "length": 0, "text": ""}, [], None, (0, False, False)).encode())
    (whole,) = judging.plan_inputs(target("short"), prior(3, 10), {"input_text": "before"}, base + 5000)
    assert whole["priors"] == [0, 1, 2] and whole["search"] and (whole["offset"], whole["length"]) == (0, 5)
    (some,) = judging.plan_inputs(target("short"), prior(6, 400), {"input_text": "x" * 6000}, base + 3000)
    assert 0 < len(some["priors"]) < 6 and some["priors"] == list(range(len(some["priors"]))) and not some["search"] and some["bytes"] <= base + 3000
    text = "a😀é\n" * 700
    parts = judging.plan_inputs(target(text, "assistant"), prior(2, 10), None, base + 1000)
    assert len(parts) > 1 and parts[0]["offset"] == 0 and sum(p["length"] for p in parts) == len(text.encode("utf-16-le")) // 2
    assert all(a["offset"] + a["length"] == b["offset"] for a, b in zip(parts, parts[1:])) and all(p["bytes"] <= base + 1000 for p in parts)
    assert judging.plan_inputs(target("text"), [], None, 100)[0]["state_hash"] == "input_budget_exceeded"
    row = [(99, 1, "user", 5, text, [(1, 1, "user", 2, "before")], ("x",)), (98, 1, "user", 5, "", [], None)]
    df = spark.createDataFrame(row, "message_id long, revision int, role string, occurred_at long, text string, priors array<struct<message_id:long,revision:int,role:string,occurred_at:long,text:string>>, prior_search struct<input_text:string>")
    got = judging.judge_inputs(df, base + 1000).collect()
    assert {r["message_id"] for r in got} == {98, 99} and sum(r["length"] for r in got) == len(text.encode("utf-16-le")) // 2


def test_jobs_keep_their_order_in_a_session(spark):
    jobs = [
        (1, "classify_message", 10, "pending", 0, 1, 7, 71, 1), (2, "classify_message", 10, "pending", 0, 0, 7, 72, 1), (3, "classify_message", 10, "failed", 0, 0, 8, 80, 1), (4, "classify_message", 10, "pending", 0, 0, 8, 81, 2), (5, "classify_message", 10, "pending", 0, 0, 8, 81, 1),
        (6, "classify_message", 10, "running", 0, 0, 9, 99, 1), (7, "classify_message", 10, "pending", 0, 0, 9, 90, 1), (8, "route_search", 100, "pending", 0, 5, 9, 90, 1), (9, "route_search", 100, "pending", 50, 0, 9, 90, 1), (10, "classify_message", 10, "blocked_policy", 0, 0, 6, 60, 1), (11, "classify_message", 10, "pending", 0, 0, 6, 61, 1),
    ]
    j = spark.createDataFrame(jobs, "id int, kind string, priority int, status string, next_run_at int, created_at int, session_id int, message_id int, target_revision int")
    m = j.selectExpr("message_id", "message_id % 10 AS sequence_no").distinct()
    assert [r["id"] for r in queue.claimed(j, m, ["classify_message", "route_search"], F.lit(10), 10).collect()] == [8, 5, 1]
    assert queue.claimable(j, m, ["build_documents"], F.lit(10)).count() == 0


def test_retry_delays(spark):
    delay = lambda n, after=None, jitter=0.0: spark.range(1).select(queue.retry_delay(F.lit(n), F.lit(after).cast("double"), jitter)).first()[0]
    assert [delay(0), delay(3), delay(10), delay(50), delay(1, 5000), delay(20, None, 1.0)] == [1, 8, 1024, 1024, 5000, 1024 * 1.1]


def test_results_are_saved_only_for_unchanged_inputs(spark):
    asked = spark.createDataFrame([(1, "running", 1, 1), (2, "running", 2, 1), (3, "queued", 3, 2), (4, "running", 4, 1)], "request_id int, status string, input_id int, input_revision int")
    found = spark.createDataFrame([(1, "matched", "{}"), (2, "matched", "{}"), (3, "matched", "{}"), (4, "no_match", "{}")], "request_id int, outcome string, result string")
    inputs = spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "input_id int, current_revision int")
    got = {r["request_id"]: (r["status"], r["outcome"]) for r in results.saved(asked, found, inputs).collect()}
    assert got == {1: ("completed", "matched"), 2: ("expired", None), 3: ("queued", None), 4: ("expired", None)}


def test_percentiles_of_skewed_groups(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(x)) for x in rng.normal(size=500)] + [("b", 1.0)] * 40 + [("b", 5.0)] + [("c", None), ("c", -2.0)] + [(None, float(x)) for x in range(10)] + [("d", float(10**x)) for x in range(12)]
    df = spark.createDataFrame(rows, "k string, v double")
    for fraction in (0.0, 0.5, 0.95, 1.0):
        got = {r["k"]: r["p"] for r in aggregates.percentiles(df, ["k"], "v", fraction, "p", bins=8).collect()}
        own = {}
        for k, v in rows:
            own.setdefault(k, []).extend([] if v is None else [v])
        assert got == {k: sorted(v)[max(1, math.ceil(fraction * len(v))) - 1] for k, v in own.items()}


def test_tail_reads_on_from_its_cursor(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_bytes(b"one\ntwo\nthr")
    reader = tail.TailReader(str(tmp_path / "*.jsonl"))
    rows, first = reader.read(reader.initialOffset())
    assert [r[1:] for r in rows] == [(0, "one", ""), (4, "two", "")]
    path.write_bytes(b"one\ntwo\nthree\n\xff\nfour\n")
    rows, second = reader.read(first)
    assert [r[1:] for r in rows] == [(8, "three", ""), (14, None, "not_utf8"), (16, "four", "")]
    assert list(reader.readBetweenOffsets(first, second)) == [(str(path), 8, "three", ""), (str(path), 14, None, "not_utf8"), (str(path), 16, "four", "")]
    path.write_bytes(b"new\n")
    assert [r[1:] for r in reader.read(second)[0]] == [(0, "new", "")]
