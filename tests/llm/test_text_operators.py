"""Deduplication, encoding, language and quality against plain versions, with all defined cases."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import WORD, documents, frame, sha, shingles, words
from pyspark.sql import functions as F

from threadlens.llm import bloom_dedup, bpe, langid, minhash, quality
from threadlens.llm.common import blocks, text_views, word_hashes, word_spans


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


def test_word_hashes_follow_words():
    import pyarrow as pa

    texts = [t or "" for _, t, _, _ in documents()] + ["Aa aA aa", "b" * 70, "b" * 71, "b" * 70]
    data, offsets = text_views(pa.array(texts))
    seen = {}
    for a, b in blocks(offsets, 500):
        d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        s, e, w = word_spans(d, o)
        h = word_hashes(d, s, e)
        for i in range(b - a):
            assert [d[x:y].tobytes().decode().lower() for x, y in zip(s[w[i] : w[i + 1]], e[w[i] : w[i + 1]])] == [x.lower() for x in WORD.findall(texts[a + i])]
            for word, x in zip(words(texts[a + i]), h[w[i] : w[i + 1]]):
                assert seen.setdefault(word, x) == x
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("max_bits", [1 << 27, 200])
def test_exact_dedup(spark, docs, max_bits):
    got = bloom_dedup.decide(docs, max_bits=max_bits).collect()
    groups = defaultdict(list)
    for i, t, _, _ in documents():
        groups[sha("".join(WORD.findall(t or "")))].append((-len(t or ""), i))
    assert len(got) == len(documents())
    for r in got:
        own = groups[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"]) == (min(own)[1], len(own))
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(groups.keys())


def test_exact_dedup_takes_one_filter_at_a_time(spark, docs, monkeypatch):
    sizes, build = [], bloom_dedup.several
    monkeypatch.setattr(bloom_dedup, "several", lambda part, bits: sizes.append((part.count(), bits)) or build(part, bits))
    got = {(r["doc_id"], r["kept"]) for r in bloom_dedup.decide(docs, max_bits=200).collect()}
    assert sum(n for n, _ in sizes) == len(documents()) and len(sizes) > 3 and max(b for _, b in sizes) <= 200  # each digest in one slice
    assert got == {(r["doc_id"], r["kept"]) for r in bloom_dedup.decide(docs).collect()}
    assert sorted(bloom_dedup.keep_one(docs, max_bits=200).collect(), key=str) == sorted(bloom_dedup.keep_one(docs).collect(), key=str)


def test_exact_dedup_of_odd_ids(spark):
    rows = [(-(2**63), "a b", "en", "s"), (2**63 - 1, "a  b", "en", "s"), (None, "ab", "en", "s"), (None, "c", "en", "s"), (5, "c", "en", "s"), (None, "d", "en", "s"), (None, "d", "en", "s")]
    got = bloom_dedup.decide(frame(spark, rows)).collect()
    assert sorted((r["keep_id"] is None, r["keep_id"], r["group_size"]) for r in got if r["text_sha256"] != sha("d")) == [(False, 5, 2)] * 2 + [(False, 2**63 - 1, 3)] * 3
    assert [(r["keep_id"], r["group_size"]) for r in got if r["text_sha256"] == sha("d")] == [(None, 2)] * 2
    assert sum(r["kept"] for r in got) == 3
    assert sorted(map(str, (r["doc_id"] for r in bloom_dedup.keep_one(frame(spark, rows)).collect()))) == ["5", str(2**63 - 1), "None"]


@pytest.mark.parametrize("limit", [1 << 27, 4096])
def test_rows_are_picked_by_place(spark, tmp_path, limit):
    from threadlens.llm import places
    from threadlens.work import Workspace

    spark.range(100_000).selectExpr("id", "id % 7 AS __file", "1 AS __bits").repartition(3).write.parquet(f"{tmp_path}/t")
    work = Workspace(spark, "test")
    rows = places.stored(spark.read.parquet(f"{tmp_path}/t").where("id <> 5"), work)
    some = places.placed(rows, "id").where("id % 3 = 0").select(places.FILE, places.AT)
    assert {r["id"] for r in places.picked(rows, some, True, work, limit=limit).collect()} == set(range(0, 100_000, 3))
    out = places.picked(rows, some, False, work, limit=limit)
    assert out.columns == ["id", "__file", "__bits"] and {r["id"] for r in out.collect()} == {i for i in range(100_000) if i % 3 and i != 5}
    assert places.picked(rows, some.limit(0), True, work).count() == 0


def test_keep_one_returns_whole_rows(spark, docs):
    clashing = docs
    for name in ("__len", "digest", "__digest", "__maybe", "__length", "__t", "__text", "__file", "__at", "kept", "keep_id"):
        clashing = clashing.withColumn(name, F.lit("x"))
    out = bloom_dedup.keep_one(clashing)
    assert out.columns == clashing.columns
    want = {r["keep_id"] for r in bloom_dedup.decide(docs).collect()}
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(want)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert bloom_dedup.decide(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    names, protos = langid.prototypes(none, "text", "lang")
    assert names == [] and langid.identified(none.select("doc_id", "text"), names, protos).count() == 0
    assert bpe.encoded(none).count() == 0


def test_bpe_agrees_with_the_library(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    for r in bpe.encoded(docs).collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert r["decoded"] == t.decode(ids, skip_special_tokens=False) == (r["text"] or "")


def test_bpe_forgets_and_still_agrees():
    small, large = bpe.Bpe(bpe.vocabulary(), cache=4), bpe.Bpe(bpe.vocabulary())
    text = " ".join(f"wörd{i} it's  \n{i}" for i in range(50))
    assert small.encode(text) == large.encode(text) == small.encode(text)


def test_language(spark, docs):
    names, protos = langid.prototypes(docs, "text", "lang")
    assert names == ["en", "es"]
    got = {r["doc_id"]: r for r in langid.identified(docs, names, protos).collect()}
    for i, t, lang, _ in documents():
        if not t or not any(c.isalpha() for c in t):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
        assert 0 <= got[i]["score"] <= 1
    full = [(i, lang) for i, t, lang, _ in documents() if t and len(t) > 60 and lang and i % 10 not in (1, 2, 3)]
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in full if i < 60]) > 0.95


def test_language_by_brute_force(spark, docs):
    """Prototypes and cosines letter by letter, from the definition; however the rows are partitioned."""
    names, protos = langid.prototypes(docs, "text", "lang")
    again, others = langid.prototypes(docs.repartition(7), "text", "lang")
    assert names == again and (protos == others).all()

    def grams(text):
        s = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        s = "".join(c for i, c in enumerate(s) if i == 0 or c != " " or s[i - 1] != " ")
        return Counter(s[i : i + 3] for i in range(len(s) - 2))

    vector = lambda g: np.roll(*letter(g[0], 2)) * np.roll(*letter(g[1], 1)) * letter(g[2], 0)[0]
    letter = lambda c, n: (langid.letter_vectors(np.array([0 if c == " " else ord(c)]), langid.DIMS)[0].astype(float), n)
    known = {}
    bundle = lambda t: sum((n * known.setdefault(g, vector(g)) for g, n in grams(t).items()), np.zeros(langid.DIMS))
    rows = [r for r in documents() if r[1] and len(r[1]) < 5000]
    frame_ = frame(spark, rows)
    names, protos = langid.prototypes(frame_, "text", "lang")
    sums = {x: np.zeros(langid.DIMS) for x in names}
    for _, t, lang, _ in rows:
        if lang and (n := sum(grams(t).values())):
            sums[lang] += bundle(t) / n
    own = np.stack([sums[x] / np.linalg.norm(sums[x]) for x in names])
    own -= own.mean(0)
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    assert np.abs(own - protos).max() < 1e-4
    out = langid.identified(frame_.withColumn("score", F.lit("x")).withColumn("__text", F.lit(1)), names, protos)
    assert out.columns == ["doc_id", "text", "lang", "source", "__text", "lang_pred", "score"]
    for r in out.collect():
        v = bundle(r["text"])
        if any(c.isalpha() for c in r["text"]):
            cos = own @ v / np.linalg.norm(v)
            assert abs(r["score"] - max(0, cos.max())) < 1e-3 and (r["lang_pred"] == names[int(cos.argmax())] or abs(cos[0] - cos[1]) < 1e-3)
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0)


def test_bpe_replaces_columns_of_its_names(spark):
    out = bpe.encoded(frame(spark, documents()[:3]).withColumn("ids", F.lit(1)).withColumn("__text", F.lit(1)).withColumn("decoded", F.lit(2)))
    assert out.columns == ["doc_id", "text", "lang", "source", "__text", "ids", "decoded"] and all(r["decoded"] == r["text"] for r in out.collect())


def test_hypervectors_by_definition():
    owner, code, kinds = langid.trigrams(["ab1c", "", "aé"])
    got = defaultdict(list)
    for o, c in zip(owner, code):
        got[int(o)].append("".join(chr(x) if x else "_" for x in kinds[c]))
    assert dict(got) == {0: ["_ab", "ab_", "b_c", "_c_"], 2: ["_aé", "aé_"]}
    v = langid.letter_vectors(np.array([0, 97, 98]), 64)
    assert (langid.bound(np.array([[97, 98, 0]]), 64)[0] == np.roll(v[1], 2) * np.roll(v[2], 1) * v[0]).all()


def test_quality_measures():
    import pyarrow as pa

    texts = [t or "" for _, t, _, _ in documents()] + ["a b c d e f a b c d e x", "q\nq\n \nq\n", "w w w w w w w", "#a $b|"]
    data, offsets = text_views(pa.array(texts))
    m = quality.measures(data, offsets)
    for i, t in enumerate(texts):
        w = WORD.findall(t)
        grams = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        n = Counter(grams)
        covered = {k for j, g in enumerate(grams) if n[g] > 1 for k in range(j, j + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert tuple(int(m[k][i]) for k in quality.MEASURES[:5]) == want


def test_binomial_bound():
    for bad, n, delta in ((0, 100, 0.05), (3, 50, 0.01), (10, 1000, 0.001)):
        u = quality.upper_bound(bad, n, delta)
        from math import comb

        tail = sum(comb(n, k) * u**k * (1 - u) ** (n - k) for k in range(bad + 1))
        assert abs(tail - delta) < 1e-9
    assert quality.upper_bound(5, 5, 0.05) == 1.0


def test_quality_certifies_and_keeps(spark):
    n = 4000
    good = spark.range(n).select(F.lit("en").alias("lang"), F.lit(100).alias("n_words"), F.lit(500).alias("word_chars"), F.when(F.col("id") == 0, 200).otherwise(2).alias("n_symbols"), F.lit(0).alias("n_repeat_words"), F.lit(0).alias("n_echoes"), F.lit(0).alias("n_upper"), F.lit(0).alias("n_bangs"))
    cut = quality.certified(good, F.col("lang"))
    assert cut["en"]["symbols"] == 0.02  # one in 4000 is certified, and the lowest cutoff taken
    few = quality.certified(good.limit(50), F.col("lang"))
    assert few == {}
    rejected = quality.judged(good, cut, F.col("lang")).where("rule_failed").count()
    assert rejected == 1
    other = quality.judged(good.withColumn("lang", F.lit("xx")), cut, F.col("lang"))
    assert other.where("rule_failed").count() == 0


def test_quality_certifies_small_strata(spark):
    rows = spark.range(1000).selectExpr(
        "concat('l', id % 4) AS lang", "100 AS n_words", "500 AS word_chars", "if(id >= 920, 12, 2) AS n_symbols",
        "if(id < 28, 9, 0) AS n_repeat_words",
        "0 AS n_echoes", "0 AS n_upper", "0 AS n_bangs", "id >= 920 AS poor", "id < 900 AS good")
    good, others = rows.where("good"), rows.where("NOT good")
    cut = quality.certified(good, F.col("lang"), others=others)  # 225 good rows a stratum, of which 7 are above the last cutoff of repeats
    assert {s: c["symbols"] for s, c in cut.items()} == {f"l{i}": 0.02 for i in range(4)}
    assert all(c["repeats"] == 0.1 for c in cut.values())
    assert quality.judged(others.where("poor"), cut, F.col("lang")).where("NOT rule_failed").count() == 0
    assert quality.judged(good, cut, F.col("lang")).where("rule_failed").count() == 0
    assert quality.certified(good.where("id >= 36"), F.col("lang"), others=others) == {}  # 216 are too few


def test_quality_verdict_by_brute_force(spark, tmp_path):
    """The query's verdict, from plain measures, plain counts along the path and the plain binomial tail."""
    import random
    from math import comb

    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(900):
        lang, w = ("en", "de")[i % 2], [word() for _ in range(r.randint(20, 60))]
        poor = i % 9 == 0
        if poor or i % 200 == 1:
            w = [x + r.choice(["#", "|", "##"]) for x in w]
        if i % 3 == 0:
            w[3] = w[3].upper()
        rows.append((i, " ".join(w), lang, "s"))
        if i % 10 < 8:
            labels.append((i, 0 if poor else 1, 0))
    rows += [(1000 + i, rows[2][1], "en", "s") for i in range(300)] + [(2000, None, None, "s"), (2001, "x " * 30, "fr", "s"), rows[5]]  # copies certify nothing more
    labels += [(1000 + i, 1, 0) for i in range(300)] + [(7, 1, 0), (8, 0, 0), (11, None, 0)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(x["doc_id"], x["kept"], x["base_failed"]) for x in quality.op8_quality(spark, str(tmp_path)).collect()}

    import pyarrow as pa

    data, offsets = text_views(pa.array([t or "" for _, t, _, _ in rows]))
    m = quality.measures(data, offsets)
    plain = {"symbols": "n_symbols word_chars", "repeats": "n_repeat_words n_words", "echoes": "n_echoes n_words", "shouting": "n_upper word_chars", "bangs": "n_bangs n_words"}
    value = {rule: [int(m[a][i]) / max(1, int(m[b][i])) for i in range(len(rows))] for rule, (a, b) in ((k, v.split()) for k, v in plain.items())}
    quality_of = {}
    for i, q, _ in labels:
        if q is not None:
            quality_of[i] = min(q, quality_of.get(i, 1))
    failed = [int(m["n_words"][i]) < 10 or 100 * int(m["n_repeat_words"][i]) > 20 * int(m["n_words"][i]) for i in range(len(rows))]
    cut = {}
    for lang in ("en", "de"):
        own = [i for i, x in enumerate(rows) if x[2] == lang and not failed[i]]
        good = list({tuple(words(rows[i][1])): i for i in own if quality_of.get(rows[i][0]) == 1}.values())
        rest = [i for i in own if quality_of.get(rows[i][0]) != 1]
        above = lambda rows_, rule: [sum(value[rule][i] > c for i in rows_) for c in quality.RULES[rule][1]]
        steps = quality.path({k: above([i for i in rest if quality_of.get(rows[i][0]) == 0], k) for k in quality.RULES}, {k: above([i for i in rest if rows[i][0] not in quality_of], k) for k in quality.RULES}, sum(rows[i][0] not in quality_of for i in rest), 0.02)
        cut[lang], n = {}, len(good)
        for rule, k in steps:
            now = cut[lang] | {rule: quality.RULES[rule][1][k]}
            bad = sum(any(value[x][i] > c for x, c in now.items()) for i in good)
            # the bound is within alpha exactly if so few errors are unlikely at a rate of alpha
            if sum(comb(n, j) * 0.02**j * 0.98 ** (n - j) for j in range(bad + 1)) > 0.05 / 2:
                break
            cut[lang] = now
    assert cut["en"] and cut["de"]
    want = {(x[0], not failed[i] and not any(value[r_][i] > c for r_, c in cut.get(x[2], {}).items()), failed[i]) for i, x in enumerate(rows)}
    assert got == want and any(not k and not b for _, k, b in got)


def brute_components(rows, percent):
    sets = {i: shingles(t) for i, t, _, _ in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, docs, percent):
    want, sizes = brute_components(documents(), percent)
    got = minhash.near_duplicates(docs, percent=percent).collect()
    for r in got:
        assert (r["component_id"], r["n_shingles"]) == (want[r["doc_id"]], sizes[r["doc_id"]])
    blank = [r for r in got if not r["n_shingles"]]
    assert len(blank) == 3 and all(r["stays"] for r in blank)
    assert sorted(r["doc_id"] for r in got if r["stays"]) == sorted(set(want.values()))
    one = minhash.one_of_each(docs.withColumn("__file", F.lit(1)).withColumn("stays", F.lit(1)).withColumn("__bits", F.lit(1)), percent=percent)
    assert one.columns == [*docs.columns, "__file", "stays", "__bits"] and sorted(r["doc_id"] for r in one.collect()) == sorted(set(want.values()))


def test_near_duplicates_of_odd_ids(spark):
    a, b = " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i}" for i in range(81))
    rows = [(None, a, "en", "s"), (None, b, "en", "s"), (None, a, "en", "s"), (None, "x y", "en", "s"), (3, "p q", "en", "s"), (3, "p q", "en", "s"), (None, "p Q", "en", "s"), (-(2**63), "m n", "en", "s")]
    out = minhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r["component_id"] is None, r["component_id"], r["stays"]) for r in out if r["component_id"] is not None) == [(False, -(2**63), True), (False, 3, False), (False, 3, False), (False, 3, True)]
    assert sorted(r["stays"] for r in out if r["component_id"] is None) == [False, False, True, True]


def test_near_duplicates_of_unlinked_texts_in_one_bucket(spark, monkeypatch):
    """5,000 texts share a passage that is half of each, so that their signatures meet, and none is linked; among them some pairs are."""
    monkeypatch.setattr(minhash, "BUCKET", 512)
    monkeypatch.setattr(minhash, "FAMILY", 20_000)
    passage = " ".join(f"common{i}" for i in range(100))
    rows = [(i, passage + " " + " ".join(f"w{i}x{j}" for j in range(60)), "en", "s") for i in range(5000)]
    rows += [(10_000 + i, rows[i][1] + " more", "en", "s") for i in range(0, 5000, 500)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, rows).repartition(8)).collect()}
    assert got == {i: i - 10_000 if i >= 10_000 else i for i, *_ in rows}


@pytest.mark.parametrize("seed", [0, 1])
def test_forest_connects_what_is_near(spark, seed, monkeypatch):
    from threadlens.work import Workspace

    rng = np.random.default_rng(seed)  # numbers are near where they differ by 10 at most: long chains, islands, one dense part
    at = {0: rng.integers(0, 4000, 300), 1: rng.integers(0, 300, 200), 2: np.arange(0, 600, 20), 3: np.array([5, 9])}
    rows = [(k, 1 if k == 3 else 7, 1000 * k + i, int(x)) for k, v in at.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "key long, parts long, member long, size long").withColumn("load", F.lit(b""))
    nearness = lambda size, loads: lambda i, others: np.abs(size[others] - size[i]) <= 10
    edges = [tuple(r) for r in minhash.forest(df, nearness, Workspace(spark, "test"), True).collect()]
    value = {m: (k, x) for k, _, m, x in rows}
    assert all(value[a][0] == value[b][0] and abs(value[a][1] - value[b][1]) <= 10 for a, b in edges)
    names = {m: i for i, m in enumerate(value)}
    of = minhash.roots(len(names), [(names[a], names[b]) for a, b in edges])
    got = Counter(of).values()
    want = []
    for v in at.values():
        cut = np.flatnonzero(np.diff(np.sort(v)) > 10) + 1
        want += [len(x) for x in np.split(np.sort(v), cut)]
    assert sorted(got) == sorted(want)


def test_near_duplicates_in_parts(spark, monkeypatch):
    """A hot family in many parts gives the same components."""
    monkeypatch.setattr(minhash, "BUCKET", 4)
    monkeypatch.setattr(minhash, "FAMILY", 300)
    import random

    r = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(60)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s"))
    want, _ = brute_components(rows, 85)
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == want


def test_pigeonhole():
    chunks, width = minhash.plan(85)
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, chunks * width)
        b = a.copy()
        b[rng.choice(chunks * width, 2 * chunks - 1, replace=False)] += 1
        wrong = (a != b).reshape(chunks, width).sum(1)
        assert wrong.min() <= 1


def test_components_on_chains_and_stars(spark):
    from threadlens.llm.components import components
    from threadlens.work import Workspace

    edges = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 230)] + [(7, 7), (9, 8)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test")).collect()}
    assert got == {**{i: 100 for i in range(101, 141)}, **{i: 200 for i in range(201, 230)}, 9: 8}


@pytest.mark.parametrize("chunk", [3, 100_000])
def test_components_of_random_edges(spark, chunk, monkeypatch):
    from threadlens.llm import components as c
    from threadlens.work import Workspace

    monkeypatch.setattr(c, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    edges = [tuple(int(x) for x in e) for e in rng.integers(0, 400, (260, 2))] + [(500 + i, 501 + i) for i in range(30)] + [(600, 600)] * 2
    edges += [(b, a) for a, b in edges[:50]] + [(700, 700 + i) for i in range(60)]
    of, least = minhash.roots(800, edges), {}
    for x in range(800):
        least.setdefault(of[x], x)
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    got = sorted(tuple(r) for r in c.components(df, Workspace(spark, "test")).collect())
    assert got == [(x, least[of[x]]) for x in range(800) if least[of[x]] != x]
    met = {x for a, b in edges if a != b for x in (a, b)}
    assert sorted(tuple(r) for r in c.members(df, Workspace(spark, "test")).collect()) == [(x, least[of[x]]) for x in sorted(met)]


def test_components_write_no_table_to_see_no_change(spark, monkeypatch):
    """Each table costs a task for each shuffle partition, so chains that a task holds whole cost two, and near copies in parts few."""
    from threadlens.llm.components import components
    from threadlens.work import Workspace

    written, keep = [], Workspace.keep
    monkeypatch.setattr(Workspace, "keep", lambda self, df, name="t", *more: written.append(name) or keep(self, df, name, *more))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long").coalesce(1)
    assert {r["root"] for r in components(edges, Workspace(spark, "test")).collect()} == {0} and len(written) == 2
    monkeypatch.setattr(minhash, "BUCKET", 8)
    monkeypatch.setattr(minhash, "FAMILY", 600)
    written.clear()
    words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*words[: i % 40], f"x{i}", *words[i % 40 :]]), "en", "s") for i in range(60)]
    assert {r["component_id"] for r in minhash.near_duplicates(frame(spark, rows).repartition(8)).collect()} == {0}
    assert len(written) <= 30


def test_steps_without_use_come_last():
    """A cutoff that rejects no poor row, however few others it meets, stands behind one that does, also where junk among the others makes that one dear."""
    cuts = {rule: len(c) for rule, (_, c) in quality.RULES.items()}
    poor = {rule: [22] * n if rule == "symbols" else [0] * n for rule, n in cuts.items()}
    other = {rule: [30] * n if rule == "symbols" else [0] * n for rule, n in cuts.items()}
    steps = quality.path(poor, other, 300, 0.02)
    assert sorted(steps) == sorted((rule, i) for rule, n in cuts.items() for i in range(n))
    assert steps[0][0] == "symbols"
    of = [rule for rule, _ in steps]
    assert all([i for r, i in steps if r == rule] == sorted((i for r, i in steps if r == rule), reverse=True) for rule in set(of))
