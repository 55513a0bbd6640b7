"""Invariants of the chunker: coverage, budgets, overlap, determinism, growth equal to a rebuild."""

from hypothesis import given, settings
from hypothesis import strategies as st

from threadlens.functions import chunking as c

texts = st.lists(st.sampled_from(["word ", "a b c\n", "\n", "```\ncode\n```\n", "  \n", "😀 é\n", "x" * 40 + " "]), max_size=60).map("".join)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_structure_covers(t):
    spans = c.structural(t)
    assert "".join(t[a:b] for a, b in spans) == t
    assert all(a < b for a, b in spans)


def test_structure_by_example():
    t = "one\ntwo\n\n\nthree\n```py\nx\n\ny\n```\nfour"
    assert [t[a:b] for a, b in c.structural(t)] == ["one\ntwo\n\n\n", "three\n", "```py\nx\n\ny\n```\n", "four"]


@settings(max_examples=30, deadline=None)
@given(st.lists(texts, min_size=1, max_size=6), st.integers(1, 40))
def test_plan(messages, times):
    rows = [(i, 1, t * times) for i, t in enumerate(messages)]
    chunks = c.plan(rows)
    assert chunks == c.plan(rows)
    for parts in chunks:
        assert c._cost(parts) <= c.MAXIMUM - c.RESERVE
        assert any(p.kind == "original" for p in parts)
    for i, _, t in rows:
        own = [p for parts in chunks for p in parts if p.message == i and p.kind == "original"]
        assert "".join(p.text for p in own) == t
    tail = []
    for k in range(1, len(rows) + 1):  # message by message, continuing the last chunk
        grown = c.plan(rows[k - 1 : k], tail)
        tail = grown[-1] if grown else tail
    assert (tail or None) == (chunks[-1] if chunks else None)


def test_long_line_and_question():
    line = "wörd " * 5000
    pieces = c.pieces_of(line, 0, len(line), 200, c.words_and_signs)
    assert "".join(line[a:b] for a, b in pieces) == line and max(c.words_and_signs(line[a:b]) for a, b in pieces) <= 200
    assert c.question_chunks("short") == (["short"], False)
    chunks, cut = c.question_chunks(line)
    assert len(chunks) == 5 and cut
    assert sum(n for _, n in c.judge_parts("a😀b" * 50, 10)) == 200
