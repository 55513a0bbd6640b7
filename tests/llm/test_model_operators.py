"""Language model, chat, toxicity, mixing, sharding and the pipeline: plain versions, round trips, held-out accuracy."""

import itertools
import math
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import crc, documents, frame, shingles, words
from pyspark.sql import functions as F

from threadlens.llm import chat, hmm, mixing, sharding, toxicity
from threadlens.llm.common import held
from threadlens.llm.places import placed, stored
from threadlens.work import Workspace


def test_forward_and_counts_by_enumeration():
    rng = np.random.default_rng(1)
    k, c = 2, 3
    start, move, emit = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k).T
    seqs = [np.array(s) for s in ([0], [1, 2, 0], [2, 2, 1, 0], [1, 1])]
    want, moves = [], np.zeros((k, k))
    for s in seqs:
        total, own = 0.0, np.zeros((k, k))
        for path in itertools.product(range(k), repeat=len(s)):
            p = start[path[0]] * emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= move[path[t - 1], path[t]] * emit[s[t], path[t]]
            total += p
            for a, b in zip(path, path[1:]):
                own[a, b] += p
        want.append(math.log(total))
        moves += own / total
    assert np.allclose(hmm.log_likelihood(seqs, start, move, emit), want)
    for window, limit in ((1024, 1000), (2, 1000), (1, 1), (3, 4)):  # windows don't change a thing
        emitted, got, starts, ll = hmm.expected(seqs, start, move, emit, window, limit)
        assert np.allclose(hmm.log_likelihood(seqs, start, move, emit, window, limit), want)
        assert np.allclose(got, moves) and np.isclose(ll, sum(want)) and np.allclose(emitted, hmm.expected(seqs, start, move, emit)[0])
    assert np.allclose(got, moves) and np.isclose(ll, sum(want)) and np.isclose(emitted.sum(), sum(map(len, seqs))) and np.isclose(starts.sum(), len(seqs))


def test_windows_need_few_matrices(monkeypatch):
    """The first and the last window of a text go by vectors; tokens that are as good as impossible don't leave the range of doubles."""
    rng = np.random.default_rng(2)
    start, move = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3)
    emit = rng.dirichlet(np.ones(5), 3).T * 10.0 ** rng.integers(-40, 1, (5, 3))
    seqs = [rng.integers(0, 5, n) for n in (1, 7, 8, 9, 16, 17, 40)]
    made, transfer = [], hmm.Windows._transfer
    monkeypatch.setattr(hmm.Windows, "_transfer", lambda self, pieces: made.extend(pieces) or transfer(self, pieces))
    whole, cut = hmm.expected(seqs, start, move, emit, 100), hmm.expected(seqs, start, move, emit, 8)
    assert all(np.allclose(a, b) for a, b in zip(whole, cut)) and np.isclose(whole[0].sum(), sum(map(len, seqs)))
    assert len(made) == 1 + 3  # of the text of three windows and of that of five
    plain = []
    for s in seqs:
        a, total = start, 0.0
        for t, c in enumerate(s):
            a = (a @ move if t else a) * emit[c]
            total, a = total + math.log(a.sum()), a / a.sum()
        plain.append(total)
    for window in (100, 8):
        assert np.allclose(hmm.log_likelihood(seqs, start, move, emit, window), plain) and np.isclose(whole[3], sum(plain))
    assert len(made) == 2 * (1 + 3)


def test_lookup_finds_what_a_search_finds():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000):
        words = np.unique(np.concatenate([rng.integers(0, 2**64, n, dtype=np.uint64), np.array([2**64 - 1, 0, 1, 2, 3][: min(n, 5)], np.uint64)]))
        h = np.concatenate([words, rng.integers(0, 2**64, 50, dtype=np.uint64), np.arange(9, dtype=np.uint64)])
        at, found = hmm.Lookup(words)(h)
        assert found.tolist() == np.isin(h, words).tolist() and (words[at[found]] == h[found]).all()


def test_first_passes_read_their_rows_alone(spark, monkeypatch):
    seen, step = [], hmm.baum_welch
    monkeypatch.setattr(hmm, "baum_welch", lambda tokens, *a: seen.append((tokens.count(), spark.read.parquet(*tokens.inputFiles()).count())) or step(tokens, *a))
    hmm.score_texts(frame(spark, documents(60)), F.lit(True), states=3, warm=4)
    assert all(rows == stored for rows, stored in seen) and 0 < seen[0][0] < seen[-1][0] == 70


def test_language_model(spark):
    rows = documents(200)
    scored, model = hmm.score_texts(frame(spark, rows), ~held("doc_id", 10, 0), classes=64, lookup=32, iterations=3)
    got = scored.collect()
    counts = Counter()
    for i, t, _, _ in rows:
        if crc(i) % 10:
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for r in got:
        own = [*words(next(t for i, t, _, _ in rows if i == r["doc_id"])), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(own), sum(counts[w] > 0 for w in own), n, crc(r["doc_id"]) % 10 == 0)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
        assert r["score"] < 0
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert np.isclose(model.prior.sum(), 1) and np.allclose(model.emit.sum(0), 1) and np.allclose(model.move.sum(1), 1)


def test_language_model_of_rare_words(spark):
    rng = np.random.default_rng(5)  # words that occur once, in two kinds of text that only their endings tell apart
    text = lambda kind, n: " ".join(f"{rng.integers(10**9)}{kind}" for _ in range(n))
    rows = [(i, text("ing" if i % 2 else "ous", 40), "en", "s") for i in range(300)]
    scored, model = hmm.score_texts(frame(spark, rows), F.col("doc_id") < 250, states=2, classes=64, lookup=32)
    gains = [r["score"] - r["base_score"] for r in scored.where("held_out").collect()]
    assert len(gains) == 50 and min(gains) > 5  # 40 words, of which each but the first is foretold to a factor of nearly two


def test_language_model_grows_with_the_vocabulary(spark):
    counts = spark.range(4_000_000).selectExpr("id AS word", "id % 1000 AS ending", "4000000 div (id + 1) AS n")
    model = hmm.Model(counts, 1, 2, None, 1 << 18, 7)
    assert model.first == 32 * 2000 and len(model.emit) == 48 * 2000 and np.isclose(model.prior.sum(), 1)
    ll = model.update({35: (np.array([5], np.uint16), np.full((1, 2), 1e9)), -1: (np.zeros(1, np.uint16), np.array([1, 1, 1, 1, 1, 1, -3.0]))})
    assert ll == -3 and model.emit[:, 0].argmax() == 35 * hmm.PART + 5


def test_language_model_trains_until_it_settles(spark, monkeypatch):
    seen, step = [], hmm.baum_welch
    monkeypatch.setattr(hmm, "baum_welch", lambda *a: seen.append(step(*a)) or seen[-1])
    hmm.score_texts(frame(spark, documents(60)), F.lit(True), states=3, warm=4)
    turn = max(range(1, len(seen)), key=lambda i: seen[i - 1] - seen[i])  # from a part of the texts to all of them
    for part in (seen[:turn], seen[turn:]):
        assert len(part) > 1 and part[-1] - part[-2] <= 1e-4 * abs(part[-1])
        assert all(b - a > 1e-4 * abs(b) for a, b in zip(part, part[1:-1]))
    assert len(seen[:turn]) > 4


def test_language_model_without_training(spark):
    scored, _ = hmm.score_texts(frame(spark, documents(5)), F.lit(False), iterations=1)
    assert all(r["n_known"] == 0 and r["base_score"] == 0 for r in scored.collect())


def test_reply_trees(spark):
    nodes = [
        ("a", 1, None, "user", "hi", 0.0), ("a", 2, 1, "assistant", "no", 1.0), ("a", 3, 1, "assistant", "yes", 2.0), ("a", 4, 2, "user", "so", 5.0), ("a", 5, 3, "user", "ok", 1.0),
        ("b", 1, 99, "user\n<|nl|>", "\\<|im_end|>\\", None), ("b", 2, 1, None, None, 1.0), ("c", 1, 2, "user", "x", 1.0), ("c", 2, 1, "user", "y", 1.0), (None, 1, None, "assistant", "z<|", 1.0),
    ]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    got = {(r["tree"], r["leaf"]): r for r in chat.format_trees(df, 1).withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    assert set(got) == {("a", 4), ("b", 2), (None, 1)}  # the cycle has no path
    assert [tuple(t) for t in got["a", 4]["turns"]] == [("user", "hi"), ("assistant", "no"), ("user", "so")]
    assert [tuple(t) for t in got["b", 2]["turns"]] == [("user\n<|nl|>", "\\<|im_end|>\\"), ("", "")]
    assert [got["a", 4]["formatted"][s["start"] : s["start"] + s["size"]] for s in got["a", 4]["loss"]] == ["no"]
    assert len(chat.format_trees(df, 2).collect()) == 4
    assert chat.format_trees(df.limit(0)).count() == 0


def test_repeated_nodes(spark):
    nodes = [(1, 1, None, "user", "a", 0.0), (1, 2, 1, "assistant", "b", 1.0), (1, 2, 1, "assistant", "c", 2.0), (1, 2, 1, "assistant", "c", 2.0), (1, None, 1, "user", "d", 9.0), (1, 1, 2, "user", "e", 0.0)]
    df = spark.createDataFrame(nodes, "tree int, node int, parent int, role string, text string, score double").withColumn("first", F.lit("x")).withColumn("leaf", F.lit("x"))
    (got,) = chat.format_trees(df).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    assert [tuple(t) for t in got["turns"]] == [("user", "a"), ("assistant", "c")]


def test_deep_chain(spark):
    df = spark.range(1, 300).select(F.lit(1).alias("tree"), F.col("id").alias("node"), (F.col("id") - 1).alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(1.0).alias("score"))
    r = chat.format_trees(df).withColumn("t", chat.read_back(F.col("formatted"))).first()
    assert [t["text"] for t in r["t"]] == [str(i) for i in range(1, 300)]


def test_escapes_are_reversible(spark):
    strings = ["".join(p) for n in range(6) for p in itertools.product("<|\\n", repeat=n)]
    df = spark.createDataFrame([(s,) for s in strings], "s string").select("s", chat.escaped(F.col("s")).alias("e"))
    for r in df.select("s", "e", chat.unescaped(F.col("e")).alias("u")).collect():
        assert r["u"] == r["s"] and "<|" not in r["e"]


def toxic_rows(n, seed):
    rng = np.random.default_rng(seed)
    common, bad = [f"word{i}" for i in range(300)], [f"vile{i}" for i in range(40)]
    rows = []
    for i in range(n):
        grade = int(rng.integers(0, 3)) if i % 2 else 0
        w = list(rng.choice(common, rng.integers(20, 60))) + list(rng.choice(bad, grade * 3))
        rng.shuffle(w)
        rows.append((i, " ".join(w), grade))
    return rows


def test_toxicity_orders_grades(spark):
    train = spark.createDataFrame(toxic_rows(900, 1), "doc_id long, text string, grade int")
    model = toxicity.trained(train, "text", "grade", 3)
    assert model[1][0] < model[1][1]
    test = spark.createDataFrame(toxic_rows(400, 2) + [(999, None, 0), (1000, "", 0)], "doc_id long, text string, grade int")
    got = toxicity.severity(test, model).collect()
    by = {g: np.mean([r["severity"] for r in got if r["grade"] == g]) for g in (0, 1, 2)}
    assert by[0] < 0.3 < by[1] < by[2]
    assert np.mean([(r["p_any"] >= 0.5) == (r["grade"] > 0) for r in got]) > 0.97
    assert all(r["p_any"] < 0.5 for r in got if not r["text"])


def test_toxicity_of_one_grade(spark):
    train = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "c", None)], "doc_id long, text string, grade int")
    model = toxicity.trained(train, "text", "grade", 3)
    assert all(r["severity"] < 1e-6 for r in toxicity.severity(train, model).collect())
    none = toxicity.trained(train.limit(0), "text", "grade", 3)
    assert toxicity.severity(train, none).count() == 3


def test_toxicity_slopes_by_differences():
    rng = np.random.default_rng(4)
    row, at, x = rng.integers(0, 30, 200), rng.integers(0, 12, 200), rng.normal(size=200)
    grade, w, theta = rng.integers(0, 4, 30), rng.normal(size=12), np.array([-1.0, 0.2, 1.5])
    _, gw, gc = toxicity.loss_and_slopes(w, theta, row, at, x, grade)
    for v, slope in ((w, gw), (theta, gc)):
        for i in range(len(v)):
            v[i] += 1e-6
            up = toxicity.loss_and_slopes(w, theta, row, at, x, grade)[0]
            v[i] -= 2e-6
            down = toxicity.loss_and_slopes(w, theta, row, at, x, grade)[0]
            v[i] += 1e-6
            assert abs((up - down) / 2e-6 - slope[i]) < 1e-6


def test_toxicity_grades_by_evidence(spark):
    """Severity rises with the graded evidence on rows that taught nothing; labels are 0 and 1 only."""
    label = lambda rows: [(i, t, int(g > 0)) for i, t, g in rows]
    train = spark.createDataFrame(label(toxic_rows(1500, 1)), "doc_id long, text string, toxic int")
    model = toxicity.trained(train, "text", "toxic", 3, regrade=toxicity.graded)
    rows = toxic_rows(500, 2)
    test = spark.createDataFrame(rows, "doc_id long, text string, severity int")
    out = toxicity.severity(test.withColumn("__text", F.lit(1)), model)
    assert out.columns == ["doc_id", "text", "__text", "severity", "p_any"]  # the column named like an output is replaced
    got, truth = {r["doc_id"]: r["severity"] for r in out.collect()}, {i: g for i, _, g in rows}
    mean = [np.mean([v for i, v in got.items() if truth[i] == g]) for g in (0, 1, 2)]
    assert mean[0] < 0.3 and mean[0] + 0.5 < mean[1] and mean[1] + 0.2 < mean[2]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "toxic")
    model = toxicity.trained(rows.where(~held("doc_id", 4, 2)), "text", "toxic", 3, regrade=toxicity.graded)
    marks = ["idiot", "moron", "pathetic", "loser", "scum", "trash", "clown", "stupid", "worthless", "disgusting"]
    told = rows.where(held("doc_id", 4, 2)).withColumn("evidence", sum(F.col("text").contains(m).cast("int") for m in marks))
    got = toxicity.severity(told, model).select("toxic", "evidence", "severity", "p_any").collect()
    mean = lambda low, high: np.mean([r["severity"] for r in got if r["toxic"] and low <= r["evidence"] <= high])
    clean = [r for r in got if not r["toxic"]]
    assert mean(0, 0) < mean(1, 2) < mean(3, 10) and np.mean([r["severity"] for r in clean]) < 0.3
    assert np.mean([r["p_any"] >= 0.5 for r in got if r["toxic"] and r["evidence"] >= 3]) > 0.97
    assert np.mean([r["p_any"] >= 0.5 for r in clean]) < 0.03


def mixture(spark, n=600):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(n):
        d = ("good", "poor", "toxic")[int(rng.choice(3, p=[0.6, 0.3, 0.1]))]
        w = [f"w{rng.integers(500)}" for _ in range(60)]
        if d == "poor":
            w = [w[0]] * 60
        if d == "toxic":
            w[5:8] = ["slurred", "slurry", "slurs"]
        rows.append((i, " ".join(w), "en", "s"))
        if i % 2:
            labels.append((i, d))
    rows += [(n, None, "en", "s"), (n + 1, "", None, None), rows[0]]
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, domain string"), len(rows)


def plain_rates(tokens, chances, goal, most=np.inf, steps=20_000):
    """Rates of single documents by projected gradient in double precision, without momentum or groups."""
    a = (tokens[:, None] * chances).T
    weights = np.linalg.pinv(a @ a.T, rcond=1e-12)
    r = np.ones(len(tokens))
    for _ in range(steps):
        r = np.clip(r - a.T @ (weights @ (a @ r - goal)), 0, most)
    return r, a, weights


def test_mixing_meets_targets(spark):
    docs, labels, n = mixture(spark)
    out = mixing.document_rates(docs, labels, {"good": 0.8, "poor": 0.15, "toxic": 0.05}).collect()
    assert len(out) == n
    total = sum(r["tokens"] for r in out)
    for d, share in (("good", 0.8), ("poor", 0.15), ("toxic", 0.05)):
        assert abs(sum(r["rate"] * r["tokens"] * r[f"p_{d}"] for r in out) / total - share) < 1e-5
    assert min(r["rate"] for r in out) >= 0 and out[0]["gap"] <= 1e-6
    assert all(abs(sum(r[f"p_{d}"] for d in mixing.DOMAINS) - 1) < 1e-9 for r in out)
    truth = dict(labels.collect())
    for d in mixing.DOMAINS:
        assert np.mean([r[f"p_{d}"] for r in out if truth.get(r["doc_id"]) == d]) > 0.9


def test_mixing_steps_are_those_of_single_documents(spark):
    rng = np.random.default_rng(2)
    chances = rng.dirichlet([2, 0.5, 0.2], 300)
    tokens = rng.integers(0, 500, 300)
    pick = rng.integers(0, 300, 900)  # documents that are equal in tokens and posteriors
    groups = [(int(tokens[i]), *map(float, chances[i]), int(n)) for i, n in zip(*np.unique(pick, return_counts=True))]
    df = spark.createDataFrame(groups, "tokens int, p_good double, p_poor double, p_toxic double, n long")
    from threadlens.work import Workspace

    a = (tokens[pick, None] * chances[pick]).T
    for shares, most in (({"good": 1.1, "poor": 0.5, "toxic": 0.2}, None), ({"good": 1.0, "poor": 0.2, "toxic": 0.0}, 1.0)):
        found, gap = mixing.rates(df, Workspace(spark, "test"), None, shares, most, flat=1e-6)
        rate = {(r["tokens"], r["p_good"]): r["rate"] for r in found.collect()}
        got = np.array([rate[int(tokens[i]), float(chances[i, 0])] for i in pick])
        goal = a.sum(1) * [shares[d] for d in mixing.DOMAINS]
        want, _, weights = plain_rates(tokens[pick].astype(float), chances[pick], goal, most or np.inf)
        value = lambda r: (a @ r - goal) @ weights @ (a @ r - goal)  # noqa: E731, B023
        assert abs(gap - np.abs(a @ got - goal).max() / a.sum()) < 1e-9
        assert value(got) <= value(want) * 1.001 + 1e-10
        slope = a.T @ (weights @ (a @ got - goal))  # conditions of Karush, Kuhn and Tucker
        for low, high, s in zip(got <= 0, got >= (most or np.inf), slope):
            assert s > -1e-3 if low else s < 1e-3 if high else abs(s) < 1e-3
        assert (gap > 1e-3) == (most == 1.0)  # all good tokens and no toxic one can't be had together


def test_mixing_keeps_good_rows_whole(spark):
    docs, labels, n = mixture(spark)
    clashing = docs
    for name in ("tokens", "__tokens", "rate", "__hits", "__words", "__at", "__file", "p_good", "gap", "n"):
        clashing = clashing.withColumn(name, F.lit("x"))
    out, gap = mixing.thinned(clashing, labels, {"good": 1.0, "poor": 0.1, "toxic": 0.0})
    assert out.columns == clashing.columns and gap < 0.02
    got = {r["doc_id"] for r in out.collect()}
    truth = dict(labels.collect())
    assert np.mean([i in got for i, d in truth.items() if d == "good"]) > 0.98
    assert np.mean([i in got for i, d in truth.items() if d == "poor"]) < 0.3
    assert np.mean([i in got for i, d in truth.items() if d == "toxic"]) < 0.1


def test_rows_of_one_id_are_drawn_apart(spark):
    """Half of the rows without an id, and half of those of one id, stay at a rate of a half."""
    rows = stored(spark.createDataFrame([(None, "a")] * 400 + [(7, "b")] * 400, "doc_id long, text string"), Workspace(spark, "draws"))
    got = placed(rows, "doc_id", "text").where(mixing.draw("mix") < 0.5).groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in got} == {None, 7} and all(150 < r["count"] < 250 for r in got)


def test_mixing_sees_wrong_labels(spark):
    """A twentieth of the labels is wrong; posteriors of texts without a mark are those without wrong labels."""
    rng = np.random.default_rng(7)
    rows = spark.createDataFrame([(i, 2 if i % 10 == 0 else 0, 3, 0, 0, 1) for i in range(4000)], "doc_id int, __hits int, __distinct int, __symbols int, __upper int, __length int")
    truth = ["toxic" if i % 10 == 0 else "good" for i in range(4000)]
    labels = spark.createDataFrame([(i, t if rng.random() > 0.05 else "toxic") for i, t in enumerate(truth)], "doc_id int, domain string")
    got = {r["__hits"]: r["p_toxic"] for r in mixing.posteriors(rows, labels).collect()}
    assert got[0] == 0 and got[2] > 0.99
    assert {r["__hits"]: r["p_toxic"] for r in mixing.posteriors(rows, labels, anchor=10_000).collect()}[0] > 0.03


def test_mixing_without_labels(spark):
    docs, labels, n = mixture(spark, 20)
    out = mixing.document_rates(docs, labels.limit(0), {"good": 1 / 3, "poor": 1 / 3, "toxic": 1 / 3}).collect()
    assert len(out) == n and all(abs(r["rate"] - 1) < 1e-6 for r in out)
    assert mixing.document_rates(docs.limit(0), labels, {"good": 1.0, "poor": 0.0, "toxic": 0.0}).count() == 0


@pytest.mark.parametrize("n, shards", [(1000, 40), (997, 10), (3, 40), (0, 5)])
def test_shards_are_even_and_gapless(spark, n, shards):
    df = spark.range(n).select(F.when(F.col("id") % 50 != 0, F.col("id")).alias("doc_id"), F.lit(1).alias("shard_"))
    got = defaultdict(list)
    for r in sharding.ring_shards(df, "doc_id", shards).collect():
        got[r["shard"]].append(r["slot"])
    assert sum(map(len, got.values())) == n
    assert all(sorted(s) == list(range(len(s))) for s in got.values())
    sizes = [len(got.get(i, [])) for i in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_of_a_hot_key(spark):
    """A third of all rows have a null key, a third of those are the same row: no slot is ranked by one task, and the law holds."""
    rows = spark.range(9000).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 9 != 0, F.col("id")).alias("__at"), F.lit("x").alias("shard"), F.lit(1).alias("__s"))
    out = sharding.ring_shards(rows, "doc_id", 8, ring_bits=6)
    assert out.columns == ["doc_id", "__at", "__s", "shard", "slot"]
    got = defaultdict(list)
    for r in out.collect():
        got[r["shard"]].append(r["slot"])
    assert sorted(map(len, got.values())) == [1125] * 8 and all(sorted(s) == list(range(1125)) for s in got.values())


def test_shards_by_a_plain_ring(spark):
    """Every row stands where a walk over the ring puts it, key by key in the order of slots and hashes."""
    df = spark.range(500).select(F.col("id").alias("doc_id"))
    spot, order = F.shiftrightunsigned(F.xxhash64(F.lit("ring"), "doc_id"), 50), F.xxhash64(F.lit("order"), "doc_id")
    keys = sorted((r["s"], r["o"], r["doc_id"]) for r in df.select("doc_id", spot.alias("s"), order.alias("o")).collect())
    nodes = sharding.ring_nodes(7, 64, 14)
    room, stands, waiting = [500 // 7 + (s < 500 % 7) for s in range(7)], {}, []
    for slot, _, key in keys:
        at = next((i for i, (place, _) in enumerate(nodes) if place >= slot), 0)
        waiting.append((list(dict.fromkeys(s for _, s in nodes[at:] + nodes[:at])), key))
    hop = 0
    while waiting:  # those that find their shard full go on to the next one together
        left = []
        for shards, key in waiting:
            if room[shards[hop]]:
                room[shards[hop]] -= 1
                stands[key] = shards[hop]
            else:
                left.append((shards, key))
        waiting, hop = left, hop + 1
    assert {r["doc_id"]: r["shard"] for r in sharding.ring_shards(df, "doc_id", 7).collect()} == stands


def test_one_more_shard_moves_few_without_slack(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"))
    at = lambda n: {r["doc_id"]: r["shard"] for r in sharding.ring_shards(df, "doc_id", n).collect()}
    a, b = at(40), at(41)
    assert 1 / 41 <= np.mean([a[i] != b[i] for i in a]) < 3 / 41


def test_one_more_shard_moves_few(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"))
    at = lambda n: {r["doc_id"]: r["shard"] for r in sharding.ring_shards(df, "doc_id", n, epsilon=0.25).collect()}
    a, b = at(20), at(21)
    assert max(Counter(a.values()).values()) <= 1.25 * 1000 + 1
    assert np.mean([a[i] != b[i] for i in a]) < 2.5 / 21


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = documents(80)
    frame(spark, rows).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 80, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = [r["text"] for r in out]
    assert all(r["round_trip"] for r in out) and None not in texts and len({"".join(words(t)) for t in texts}) == len(texts)
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    assert sum(near(shingles(t), shingles(rows[1][1])) for t in texts) == 1  # one of the copies and near copies
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clashing = ["score", "lang_pred", "__digest", "__file", "__at", "__bits", "stays", "component_id", "tokens", "rate", "__hits", "ids", "decoded", "n_tokens"]
    for name in clashing:
        docs = docs.withColumn(name, F.concat(F.lit("own "), F.col("doc_id")))
    want = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == want, name
    assert all(r[c] == f"own {r['doc_id']}" for r in docs.collect() for c in clashing)
    last = corpus_pipeline.encoding(spark, docs, str(tmp_path))
    assert last.columns == [c for c in want if c not in ("ids", "n_tokens")] + ["ids", "n_tokens", "round_trip"]
    assert all(r["round_trip"] and r["decoded"] == f"own {r['doc_id']}" for r in last.collect())


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    frame(spark, []).withColumn("n_chars", F.lit(1).cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
