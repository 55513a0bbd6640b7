"""Queries against their SQL twins on small tables with what the test data lacks: ties, empty and null texts, rare white space, large groups of equal terms."""

import datetime
import random

import duckdb
import pytest

from threadlens import registry
from threadlens.operators import postings


def differences(spark, folder, name, tables):
    """Rows that only SQL and only the query return, over ``tables``: name -> (rows, schema)."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    registry.queries()[name](spark, str(folder)).write.parquet(f"{folder}/out")
    want = con.sql(registry.oracle_sql()[name])
    columns = ", ".join(sorted(want.columns))
    sql, got = f"select {columns} from ({registry.oracle_sql()[name]})", f"select {columns} from '{folder}/out/*.parquet'"
    assert want.fetchall()
    return [con.sql(f"select * from ({a} except all {b})").fetchall() for a, b in ((sql, got), (got, sql))]


def test_late_data_with_equal_numbers(spark, tmp_path):
    """Every 10007th event of a user has the same sequence number."""
    then = datetime.datetime(2024, 1, 1)
    events = [(i + 10007 * k, then, i % 7, "view", 1.0) for k in range(4) for i in range(20)]
    tables = {"events": (events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")}
    assert differences(spark, tmp_path, "stm.late_data", tables) == [[], []]


#: No text, nothing but white space, paragraphs; more than a piece holds of words, and of signs that other engines call white space.
TEXTS = ["", None, " ", "\n", "a", "a. b", "a.\n\nb. ", "one\ntwo", "w " * 1_500, "x\u3000" * 900, "\u00a0\u2028\x1c\x85" * 300, "漢字 é " * 700]


def documents(texts):
    return {"documents": (list(enumerate(texts)), "doc_id long, text string")}


def test_structure_without_text(spark, tmp_path):
    assert differences(spark, tmp_path, "chk.structural", documents(TEXTS)) == [[], []]


def test_lines_without_text(spark, tmp_path):
    tables = documents(TEXTS)
    tables["documents"][0].extend([(3, "\n"), (None, "a\nb"), (None, None)])
    assert differences(spark, tmp_path, "chk.split_lines", tables) == [[], []]


def test_atoms_without_text(spark, tmp_path):
    assert differences(spark, tmp_path, "sp.atoms", documents(TEXTS)) == [[], []]


def joined(df):
    """The rows of ``df``, and the most that one of its joins or windows gave."""
    rows, most = [tuple(r) for r in df.collect()], 0

    def walk(node):
        nonlocal most
        name = node.nodeName()
        if "Join" in name and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))
        if name == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        elif "QueryStage" in name:
            walk(node.plan())

    walk(df._jdf.queryExecution().executedPlan())
    return rows, most


def test_strategy_by_part_names(spark, tmp_path):
    """Names in another order, with repeated words, with many words, none, a part with two names."""
    names = ["red nut", "nut red", "red red", "red  nut", "", None, "red nut big", "a b c d e f g h i red nut", "big  red"]
    parts = [(i, names[i * 7 % len(names)]) for i in range(600)] + [(50, "small nut"), (51, "small")]
    assert differences(spark, tmp_path, "top.strategy", {"part": (parts, "p_partkey long, p_name string")}) == [[], []]


def test_strategy_meets_few_of_equal_parts(spark, tmp_path):
    """Sixty requests and 3000 parts of one name are 180,000 pairs; ten for each request are wanted."""
    spark.createDataFrame([(i, "red nut") for i in range(3000)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got, most = joined(registry.queries()["top.strategy"](spark, str(tmp_path)))
    assert sorted(got) == [(50 * q, i, 2, i + 1) for q in range(60) for i in range(10)]
    assert most <= 60 * 10


@pytest.mark.parametrize("names, shape", [(6, "random"), (6, "rising"), (6, "falling"), (12, "random")])
def test_top_sharing_as_all_pairs(spark, names, shape):
    """Against all pairs; rows of many terms, large sessions, numbers in and against the order of the documents."""
    r = random.Random(names)
    rows = []
    for i in range(500):
        session = 0 if i % 2 else r.randrange(12)
        number = {"random": r.randrange(40), "rising": i, "falling": 500 - i}[shape]
        rows.append((i, session % 2, session, number, [f"t{r.randrange(names)}" for _ in range(r.randint(0, names))]))
    kinds = "document_id int, p int, session int, number int, terms array<string>"
    docs = spark.createDataFrame(rows, kinds)
    asked = docs.where("document_id % 4 = 0").selectExpr("document_id AS request_id", "p", "session AS own", "number AS until", "terms")
    for limit, session in ((3, None), (3, ("session", "number", "own", "until"))):
        want = set()
        for q, p, own, until, mine in rows[::4]:
            hits = [(-len({*mine} & {*ts}), i) for i, p2, s, n, ts in rows if p == p2 and not (session and s == own and n >= until)]
            want |= {(q, i, -n, rank) for rank, (n, i) in enumerate(sorted(h for h in hits if h[0] <= -2)[:limit], 1)}
        d, a = (docs, asked) if session else (docs.drop("session", "number"), asked.drop("own", "until"))
        got = [tuple(x) for x in postings.top_sharing(d, a, ["p"], limit, session=session).collect()]
        assert len(got) == len(want) and {*got} == want


def test_strategy_meets_few_messages_of_a_project(spark, tmp_path):
    """One project, one long conversation among short ones; a request has four sets of two or three terms at most, and each set twenty messages of other conversations."""
    talks = [(5 * c, t, "assistant" if t % 2 else "user", "x") for c in range(1, 601) for t in range(300 if c == 7 else 6)]
    asked = sum(role == "user" and (c * 1000 + t) % 7 == 0 for c, t, role, _ in talks)
    assert differences(spark, tmp_path, "rt.strategy", {"conversations": (talks, "conv_id long, turn long, role string, text string")}) == [[], []]
    assert joined(registry.queries()["rt.strategy"](spark, str(tmp_path)))[1] <= asked * 4 * 20
