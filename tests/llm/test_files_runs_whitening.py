"""Token files, periodic runs and whitening against plain versions."""

import hashlib
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.orc as orc
import pytest

from helpers import SCHEMA, documents, frame
from threadlens.llm import registry
from threadlens.llm.bpe import vocabulary
from threadlens.llm.runs import Extensions, Minima, common_prefixes, maximal_runs, repeated, suffix_array, with_runs
from threadlens.llm.token_files import Words, parts, read_ids, read_span, summed, write_ids
from threadlens.llm.whitening import Moments, eigen, fitted, whitened

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")

# ---------------------------------------------------------------- token files


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def plain_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def crc_of(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ODD = ["don't we'll", "Ａ ﬁ ǅ İI ΣΑΣ σας", "é ́x à", "a b\x85c\x1cd e", "<|endoftext|>x<|startoftext|> <|endoftext", "1234 ½ ²", "日本語 テキスト", "😀👍🏽 x‍y", "가 ᅡ", "x" * 500, "� \x00 \x07", "--- 'S 's's '", "한글　が ゙"]


def test_words_encode_as_whole_texts(tokenizer):
    r, words = random.Random(3), Words(vocabulary("word_bpe_49k.json"), remembered=40)
    bits = [c for s in ODD for c in s] + [" ", "\n", "\t", "'"] * 6
    texts = [*ODD, "", " \t\n", *("".join(r.choice(bits) for _ in range(r.randint(1, 60))) for _ in range(400))]
    for at in range(0, len(texts), 50):
        some = texts[at : at + 50]
        got = [np.frombuffer(x, "<i4").tolist() for x in words.encode([t.encode() for t in some])]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in some]
        assert len(words) < 2500 and max(map(len, words)) <= 64  # the memory is emptied, no long word is in it


def test_letters_go_to_the_model_alone(tokenizer):
    """Words of Latin letters, of any case and between signs, don't go through the library's normalising and splitting; the ids are those of whole texts."""
    words, asked = Words(vocabulary("word_bpe_49k.json")), []

    class Watched:
        def encode_batch(self, given, **_):
            asked.extend(w for g in given for w in g)
            return tokenizer.encode_batch(given, is_pretokenized=True, add_special_tokens=False)

        def encode_batch_fast(self, given, **_):
            asked.extend(given)
            return tokenizer.encode_batch_fast(given, add_special_tokens=False)

    words.tokenizer = Watched()
    texts = ["The house, the HOUSE (the House).", "Niño NIÑO ¡niño! ÀÉÞßÿ casa$$$ CASA###", 'straße STRASSE "Straße"; Ærø & œuvre']
    assert [np.frombuffer(x, "<i4").tolist() for x in words.encode([t.encode() for t in texts])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert sorted(asked) == sorted([",", "(", ").", "¡niño!", "$$$", "###", '"', '";', "&", "œuvre"])


def test_case_where_it_decides(tokenizer):
    """Capitals before combining marks, in strings of added tokens and beyond ASCII: lowered no sooner than the library does."""
    latin = [chr(c) for c in range(0x21, 0x250)]
    texts = ["H\u0331 h\u0331 \u1e96 W\u030a J\u030c T\u0308", "<|ENDOFTEXT|> <|EndOfText|> <|endoftext|> ABC", "A<|startoftext|>B", "İI K\u212a ǅ É\u0301X E\u0301", "I'LL DON'T 'S 'T", "ABC&&& $X X* |Y| Z|", "=\u0338 A=\u0338B"]
    texts += [f"{a}{c}{b} {c} {c}{c}A, A{c}" for c in latin for a, b in (("A", "b"), ("É", "ñ"), (".", "("))]
    got = [np.frombuffer(x, "<i4").tolist() for x in Words(vocabulary("word_bpe_49k.json")).encode([t.encode() for t in texts])]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rows = [(r[0], r[1]) for r in documents(900)] + [(None, "no id"), (-5, "minus"), (7, "seven again"), *[(77, f"hot {i}") for i in range(600)]] + [(i + 10_000, t) for i, t in enumerate(ODD)]
    r = random.Random(2)
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = f"{tmp_path_factory.mktemp('ids')}/t"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_ids(df, path, stripe=8192, stride=1000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return rows, path


def test_files_hold_every_text_in_order(spark, written, tokenizer):
    rows, path = written
    got = sorted(read_ids(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(plain_ids(tokenizer, t))
    have = {}
    for r in got:
        have.setdefault(r["doc_id"], []).append(r["ids"])
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in summed(read_ids(spark, path)).collect()} == {(r["doc_id"], r["start"], r["n_tokens"], crc_of(r["ids"])) for r in got}


def test_hot_id_is_dealt_to_several_files(spark, written):
    assert read_parts_of(spark, written[1], 77) > 1


def read_parts_of(spark, path, doc_id):
    return parts(spark, path).where(f"first_id <= {doc_id} and last_id >= {doc_id}").count()


def test_format(spark, written):
    """Several stripes a file, a row index, Bloom filters, and integers in run-length encoding: few bytes for positions."""
    path = written[1]
    files = [f"{path}/ids/{f}" for f in os.listdir(f"{path}/ids") if f.endswith(".orc")]
    assert len(files) == parts(spark, path).count() > 1
    shapes = [orc.ORCFile(f) for f in files]
    assert max(s.nstripes for s in shapes) > 1 and all(s.row_index_stride == 1000 and str(s.compression).upper().endswith("ZSTD") for s in shapes)
    assert all(s.file_version == "0.12" for s in shapes)  # the version whose writer uses the second run-length encoding


def scanned(df):
    """Its document ids, the rows that the scan of ids gave, and the files it opened."""
    ids, rows, files = {r["doc_id"] for r in df.collect()}, 0, 0

    def walk(node):
        nonlocal rows, files
        name = node.nodeName()
        if name.startswith("Scan orc") and "part#" in node.simpleString(99) and "start#" not in node.simpleString(99):
            rows += node.metrics().apply("numOutputRows").value()
            files += node.metrics().apply("numFiles").value()
        for i in range(node.children().size()):
            walk(node.children().apply(i))
        if name == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        elif "QueryStage" in name:
            walk(node.plan())

    walk(df._jdf.queryExecution().executedPlan())
    return ids, rows, files


def test_metadata_prunes_files_stripes_and_row_groups(spark, written, tmp_path):
    rows, path = written
    ids, _, files = scanned(read_ids(spark, path, wanted=[12]))
    assert ids == {12} and files == 1 < parts(spark, path).count()
    assert scanned(read_ids(spark, path, between=(100, 120)))[0] == set(range(100, 121))
    # one file of many rows: the filter leaves few row groups of 1000 rows
    big = spark.range(30_000).selectExpr("id * 2 AS doc_id", "concat('w', id % 7) AS text").coalesce(1)
    write_ids(big, f"{tmp_path}/big", stripe=1 << 14, stride=1000)
    assert scanned(read_ids(spark, f"{tmp_path}/big", wanted=[20_000])) == ({20_000}, 1000, 1)
    assert scanned(read_ids(spark, f"{tmp_path}/big", wanted=[20_001])) == (set(), 0, 1)  # within the range of a row group, but not in its Bloom filter
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        tasks = {r[0] for r in read_ids(spark, f"{tmp_path}/big").selectExpr("spark_partition_id()").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(tasks) > 1  # a file's stripes are read by several tasks


def test_spans(spark, written):
    path = written[1]
    whole = [x for r in sorted(read_ids(spark, path).collect(), key=lambda r: r["start"]) for x in r["ids"]]
    for first, length in ((0, 1), (5, 300), (1000, 5000), (len(whole) - 3, 50), (len(whole) + 1, 5)):
        got = sorted(read_span(spark, path, first, length).collect(), key=lambda r: r["start"])
        assert [x for r in got for x in r["ids"]] == whole[first : first + length]
        assert not got or got[0]["start"] == first


def test_empty_table_and_clashing_names(spark, tmp_path):
    write_ids(frame(spark, []), f"{tmp_path}/none")
    assert read_ids(spark, f"{tmp_path}/none").collect() == read_ids(spark, f"{tmp_path}/none", wanted=[1]).collect() == []
    odd = spark.createDataFrame([(1, "a b", 2, 3, 4, 5)], "doc_id long, text string, part int, at int, ids int, _metadata int")
    write_ids(odd, f"{tmp_path}/odd")
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in read_ids(spark, f"{tmp_path}/odd").collect()] == [(1, 0, 3)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_op11_whole_table(spark, tokenizer):
    rows = sorted(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    ids = [plain_ids(tokenizer, r["text"]) for r in rows]
    starts = np.cumsum([0, *map(len, ids)])[:-1].tolist()
    got = sorted(map(tuple, registry.queries()["op11_token_files"](spark, DATA).collect()))
    assert got == [(r["doc_id"], s, len(x), crc_of(x)) for r, s, x in zip(rows, starts, ids)]


# ---------------------------------------------------------------- periodic runs


def plain_runs(w, least=24, times=3):
    """(start, length, period) of all runs, by walking every period."""
    got = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i > s and i + p - s >= max(least, times * p):
                got.setdefault((s, i + p), p)
            i += 1
    return sorted((s, e - s, p) for (s, e), p in got.items())


def plain_collapsed(w, runs):
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in dropped)


def plain_repeated(doc_id, text):
    w, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_parts_of_the_index():
    r = random.Random(5)
    for _ in range(40):
        n = r.choice([1, 2, 31, 32, 33, 100, 700])
        a = np.array([r.randrange(r.choice([1, 2, 9])) for _ in range(n)], np.int64)
        sa, rank = suffix_array(a)
        order = sorted(range(n), key=lambda i: a[i:].tolist())
        assert sa.tolist() == order and rank[sa].tolist() == list(range(n))
        lce = lambda i, j: next((k for k in range(n) if max(i, j) + k >= n or a[i + k] != a[j + k]), n - max(i, j))
        assert common_prefixes(a, sa, rank)[1:].tolist() == [lce(i, j) for i, j in zip(order, order[1:])]
        lo = np.array([r.randrange(n) for _ in range(200)])
        hi = np.array([r.randrange(x, n) for x in lo])
        assert Minima(a).between(lo, hi).tolist() == [a[x : y + 1].min() for x, y in zip(lo, hi)]
        if n > 1:
            ext, i = Extensions(a), np.array([r.randrange(n - 1) for _ in range(50)])
            j = np.array([r.randrange(x + 1, n) for x in i])
            assert ext.forward(i, j).tolist() == [lce(x, y) for x, y in zip(i, j)]
            assert ext.backward(i, j).tolist() == [next((k for k in range(x + 1) if k == x or a[x - 1 - k] != a[y - 1 - k])) for x, y in zip(i, j)]


def test_runs_of_many_texts_at_once():
    r = random.Random(1)
    for _ in range(300):
        least, times = r.choice([(24, 3), (4, 2), (6, 3), (1, 2), (10, 4)])
        texts, ids, next_id = [], [], 0
        for _ in range(r.randint(1, 6)):
            k, w = r.choice([1, 2, 3, 5, 50]), []
            for _ in range(r.randint(0, 6)):
                unit = [r.randrange(k) for _ in range(r.randint(1, 7))]
                w += unit * r.randint(1, 9) + unit[: r.randrange(len(unit) + 1)] if r.random() < 0.6 else [r.randrange(k) for _ in range(r.randint(0, 12))]
            texts.append(w)
            ids += [x + next_id for x in w]
            next_id += 50
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
        got = maximal_runs(np.array(ids, np.int64), offsets, least, times)
        assert [tuple(x) for x in got.tolist()] == [(i, *x) for i, w in enumerate(texts) for x in plain_runs(w, least, times)]


def test_runs_operator(spark):
    r = random.Random(9)
    texts = ["a " * 24, "a " * 23, "x\ty\n" * 12 + "tail", "\x0bA a\x1c A\x0c" * 9, None, "", " \n", "😀 ñ 日 " * 20, "w" * 3000, "one two three " * 9 + "zero " + "two three four " * 9, "l " * 30_000]
    texts += [" ".join(r.choice("ab") for _ in range(r.randint(20, 90))) for _ in range(30)]
    rows = [(i, t, "z", 1, "q") for i, t in enumerate(texts)] + [(0, texts[0], "z", 1, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, __text int, words string")
    out = with_runs(df)
    assert out.columns == ["doc_id", "text", "__text", "words", "runs", "collapsed"]
    got = out.collect()
    assert len(got) == len(rows)
    for row in got:
        w = WORD.findall(row["text"] or "")
        want = plain_runs(w) if len(w) < 1000 else [(0, len(w), 1)]
        assert [tuple(x) for x in row["runs"]] == want and row["collapsed"] == plain_collapsed(w, want)
    assert with_runs(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        with_runs(df, times=1)


def test_repeating_rule(spark):
    rows = [(i, t) for i, t, *_ in documents(300)] + [(None, "a b c"), *[(i, "") for i in range(400, 440)], *[(i, None) for i in range(440, 480)]]
    got = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", repeated("doc_id", "text").alias("t")).collect()
    assert all(WORD.findall(r["t"] or "") == (plain_repeated(r["doc_id"], r["text"]) if r["doc_id"] is not None else WORD.findall(r["text"])) for r in got)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_op12_whole_table(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want, met = [], 0
    for row in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        w = plain_repeated(row["doc_id"], row["text"])
        runs = plain_runs(w)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None, None, None)
        met += bool(runs)
        want.append((row["doc_id"], len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(plain_collapsed(w, runs))))
    assert met > 5
    got = registry.queries()["op12_runs"](spark, DATA).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])


# ---------------------------------------------------------------- whitening


def plain_integers(vectors):
    return [[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in vectors]


def test_updates_and_merges_agree_with_the_definition():
    r = np.random.default_rng(4)
    x = r.integers(-300, 300, (257, 9)) + 100_000
    whole, parts_ = Moments(9), [Moments(9) for _ in range(5)]
    whole.add(x)
    for i, part in enumerate(parts_):
        part.add(x[i::5])
    merged = Moments(9)
    for part in [Moments(9), *parts_]:
        row = part.row().to_pylist()[0]
        merged.merge(Moments.of(9, **row))
    want = np.cov(x.T, bias=True)
    for m in (whole, merged):
        assert m.n == 257 and m.sums == x.sum(axis=0).tolist()
        assert np.allclose(m.covariance(), want, rtol=1e-12, atol=1e-9)


def test_eigen_solver():
    r = np.random.default_rng(8)
    cases = [np.zeros((0, 0)), np.zeros((3, 3)), np.eye(5), np.array([[2.0]]), np.diag([1e-12, 5.0, 5.0, -3.0]), np.ones((6, 6)), np.array([[0.0, 1], [1, 0]])]
    for n in (2, 3, 10, 64, 130):
        a = r.normal(size=(n, n)) * 10.0 ** r.integers(-3, 4, n)
        cases += [a + a.T, a @ a.T, np.outer(a[0], a[0])]
    for a in cases:
        values, vectors = eigen(a)
        size = max(1e-300, np.abs(a).max(initial=0))
        assert np.all(np.diff(values) <= 0)
        assert np.allclose(vectors.T @ vectors, np.eye(len(a)), atol=1e-12)
        assert np.allclose(a @ vectors, vectors * values, atol=1e-12 * size * max(1, len(a)))
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * size * max(1, len(a)))


def test_whitening_of_odd_rows(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=12).astype(np.float32).tolist(), 1, "x") for i in range(200)]
    rows += [(None, rows[0][1], 1, "x"), rows[0], *[(999, rows[3][1], 1, "hot")] * 100]
    good = len(rows)
    rows += [(300, None, 1, "x"), (301, [1.0] * 11 + [None], 1, "x"), (302, [1.0] * 11 + [float("nan")], 1, "x"), (303, [1.0] * 11 + [float("inf")], 1, "x"), (304, [1.0] * 11, 1, "x"), (305, [], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, e array<float>, deviation int, vector string").repartition(7)
    model = fitted(df, "e")
    x = np.array(plain_integers([v[1] for v in rows[:good]]))
    assert model.n == good and model.sums == x.sum(axis=0).tolist() and model.identity_error < 1e-10
    cov = np.cov(x.T, bias=True)
    assert np.allclose(model.variances, np.linalg.eigvalsh(cov)[::-1][:8], rtol=1e-12)
    out = whitened(df, model, "e")
    assert out.columns == ["vec_id", "e", "vector", "whitened", "deviation"]
    got = out.collect()
    assert len(got) == good
    y = np.array([g["whitened"] for g in got])
    assert np.allclose(np.cov(y.T, bias=True), np.eye(8), atol=1e-10)
    s = x.sum(axis=0)
    dev = {tuple(v[1]): int(((good * a - s) ** 2).sum()) for v, a in zip(rows, x)}
    assert all(g["deviation"] == dev[tuple(g["e"])] for g in got)


def test_whitening_without_variance_or_rows(spark):
    assert fitted(spark.createDataFrame([], "vec_id long, e array<float>"), "e") is None
    assert fitted(spark.createDataFrame([(1, None)], "vec_id long, e array<float>"), "e") is None
    same = spark.createDataFrame([(i, [1.5, 2.0]) for i in range(5)], "vec_id long, e array<float>")
    model = fitted(same, "e")
    assert model.explained() == [None, None] and model.identity_error is None
    assert [(r["whitened"], r["deviation"]) for r in whitened(same, model, "e").collect()] == [([None, None], 0)] * 5
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, e array<double>")
    model = fitted(line, "e")
    got = whitened(line, model, "e").collect()
    assert all(r["whitened"][1] is None and r["whitened"][0] is not None for r in got) and abs(model.explained()[0] - 1) < 1e-12
    huge = spark.createDataFrame([(i, [1e300 * (i % 2), float(i)]) for i in range(4)], "vec_id long, e array<double>")
    model = fitted(huge, "e")
    assert {r["deviation"] for r in whitened(huge, model, "e").collect()} == {None}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_op13_whole_table(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array(plain_integers([r["embedding"] for r in rows]))
    n, s = x.shape[0], x.sum(axis=0)
    cov = np.cov(x.T, bias=True)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    away = (n * x - s) / n
    at = {r["vec_id"]: i for i, r in enumerate(rows)}
    got = registry.queries()["op13_whitening"](spark, DATA).collect()
    assert len(got) == 8 * n and {r["n"] for r in got} == {n} and all(r["identity_error"] <= 1e-4 for r in got)
    for k in range(1, 9):
        want, mine = away @ vectors[:, k - 1] / np.sqrt(values[k - 1]), np.zeros(n)
        for r in got:
            if r["component"] == k:
                mine[at[r["vec_id"]]] = r["whitened"]
                assert r["deviation"] == int(((n * x[at[r["vec_id"]]] - s) ** 2).sum())
                assert abs(r["explained"] / (values[k - 1] / np.trace(cov)) - 1) < 1e-10
        assert np.allclose(want if want @ mine > 0 else -want, mine, atol=1e-8)
