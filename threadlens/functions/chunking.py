"""Splitting sessions into search documents: structure first, then lines, then code points, packed under token budgets.

Offsets are half-open ranges of UTF-16 units, so that they mean the same to every client; inside, positions are code points.
The token counter is a parameter: any function of a text. The stand-in counts words and single other signs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame

#: Fixed budgets in tokens; the reserve is for what the embedding provider puts in front.
TARGET, MAXIMUM, OVERLAP, RESERVE = 800, 1_200, 100, 32
QUESTION_CHUNKS = 5
VERSION = "m4-1"

Counter = Callable[[str], int]


#: White space as SQL's expressions know it: wider or rarer kinds (no-break, ideographic, vertical) are signs.
_TOKEN = re.compile(r"\w+|[^\w \t\n\f\r]")


def words_and_signs(text: str) -> int:
    return len(_TOKEN.findall(text))


#: A counter that also has ``spans`` is asked once for a text's tokens instead of once for each trial cut.
words_and_signs.spans = lambda text: [m.span() for m in _TOKEN.finditer(text)]


def _lines(text: str, start: int, end: int) -> list[tuple[int, int]]:
    cuts = [start] + [m.end() for m in re.finditer("\n", text[start:end])]
    edges = [start] + [start + c for c in cuts[1:]]
    if edges[-1] < end:
        edges.append(end)
    return list(zip(edges, edges[1:]))


def structural(text: str) -> list[tuple[int, int]]:
    """Segments that cover the text: fenced blocks whole, and paragraphs with the blank lines after them."""
    marks: list[int] = []  # where segments begin
    fence = blank = False
    inside = False  # a paragraph is open
    for start, end in _lines(text, 0, len(text)):
        line = text[start:end].strip()
        if fence:
            fence = not line.startswith("```")
            inside = False
        elif line.startswith("```"):
            marks.append(start)
            fence, blank = True, False
        else:
            if not inside or (blank and line):
                marks.append(start)
            inside, blank = True, not line and inside
            if line:
                blank = False
    return list(zip(marks, [*marks[1:], len(text)]))


def pieces_of(text: str, start: int, end: int, most: int, count: Counter) -> list[tuple[int, int]]:
    """Lines of a segment; a line beyond ``most`` tokens is cut into the longest pieces that fit."""
    out = []
    for a, b in _lines(text, start, end):
        while a < b:
            if count(text[a:b]) <= most:
                out.append((a, b))
                break
            if spans := getattr(count, "spans", None):  # each piece ends where a token too many would begin
                starts = [a + x for x, _ in spans(text[a:b])][most::most]
                out += list(zip([a, *starts], [*starts, b]))
                break
            low, high = a + 1, b - 1
            while low < high:  # the longest prefix within the limit
                mid = (low + high + 1) // 2
                low, high = (mid, high) if count(text[a:mid]) <= most else (low, mid - 1)
            out.append((a, low))
            a = low
    return out


@dataclass(frozen=True)
class Part:
    """A range of a message inside a chunk."""

    message: object
    revision: int
    start: int
    end: int
    text: str
    tokens: int
    kind: str = "original"


def _cost(parts: list[Part]) -> int:
    return sum(p.tokens for p in parts) + max(0, len(parts) - 1)


def atoms_of(messages: list[tuple], count: Counter) -> list[Part]:
    """The smallest ranges that packing moves: segments that fit, else their pieces."""
    most = MAXIMUM - RESERVE - OVERLAP - 1
    out = []
    for message, revision, text in messages:
        for a, b in structural(text):
            fits = count(text[a:b]) <= TARGET - RESERVE
            for x, y in [(a, b)] if fits else pieces_of(text, a, b, most, count):
                out.append(Part(message, revision, x, y, text[x:y], count(text[x:y])))
    return out


def window_of(parts: list[Part], count: Counter) -> list[Part]:
    """The last ``OVERLAP`` tokens of a chunk, separators counted, as the start of the next."""
    out: list[Part] = []
    for part in reversed(parts):
        left = OVERLAP - sum(p.tokens for p in out) - len(out)
        if part.tokens <= left:
            out.insert(0, replace(part, kind="overlap"))
            continue
        if left > 0:
            low, high = 0, len(part.text)
            if spans := getattr(count, "spans", None):
                low = high = spans(part.text)[-left - 1][1]
            while low < high:  # the longest suffix within the limit
                mid = (low + high) // 2
                low, high = (low, mid) if count(part.text[mid:]) <= left else (mid + 1, high)
            if low < len(part.text):
                suffix = part.text[low:]
                out.insert(0, replace(part, start=part.start + low, text=suffix, tokens=count(suffix), kind="overlap"))
        break
    return out


def plan(messages: list[tuple], tail: list[Part] | None = None, count: Counter = words_and_signs) -> list[list[Part]]:
    """Chunks of a session's messages (id, revision, text). With the last chunk as ``tail``, new messages continue it."""
    chunks, now, seeded = [], list(tail or []), False
    for atom in atoms_of(messages, count):
        while True:
            whole = _cost(now) + atom.tokens + 1
            only_window = seeded and all(p.kind == "overlap" for p in now)
            if not now or only_window or whole <= TARGET - RESERVE or (_cost(now) <= OVERLAP and whole <= MAXIMUM - RESERVE):
                now.append(atom)
                seeded = False
                break
            chunks.append(now)
            now = window_of(now, count)
            seeded = bool(now)
    return chunks + ([now] if now else [])


def content_of(parts: list[Part]) -> str:
    """The parts' texts, with a line break where the message changes."""
    out = ""
    for before, part in zip([None, *parts], parts):
        out += ("\n" if before is not None and before.message != part.message else "") + part.text
    return out


def utf16(text: str) -> list[int]:
    """The UTF-16 offset of each code point position."""
    at, out = 0, [0]
    for c in text:
        at += 2 if ord(c) > 0xFFFF else 1
        out.append(at)
    return out


def plan_documents(messages: DataFrame, count: Counter = words_and_signs, through: str | None = None) -> DataFrame:
    """(session_id, chunk, document_key, content, content_hash, sources) of each session; a session is planned in one task.

    ``messages``: session_id, message_id, revision, sequence_no, text. Where the column ``through`` of a session holds a number, its messages up to it are
    built first and the last chunk is continued with the rest, as when new messages arrive; where it is null, all are built at once.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sequence_no")
        session = pdf["session_id"].iloc[0]
        texts = {m: utf16(t) for m, t in zip(pdf["message_id"], pdf["text"])}
        rows = []
        old = pdf["sequence_no"] <= (pdf[through].iloc[0] if through and pd.notna(pdf[through].iloc[0]) else -1)
        of = lambda part: list(zip(part["message_id"], part["revision"], part["text"]))
        before = plan(of(pdf[old]), count=count)
        chunks = [*before[:-1], *plan(of(pdf[~old]), tail=before[-1] if before else None, count=count)]
        for i, parts in enumerate(chunks):
            anchor = next(p for p in parts if p.kind == "original")
            key = "\0".join([str(session), str(anchor.message), str(texts[anchor.message][anchor.start]), VERSION])
            content = content_of(parts)
            sources = [{"message_id": p.message, "message_revision": int(p.revision), "start_offset": texts[p.message][p.start], "end_offset": texts[p.message][p.end], "source_kind": p.kind} for p in parts]
            rows.append((session, i, hashlib.sha256(key.encode()).hexdigest(), content, hashlib.sha256(content.encode()).hexdigest(), _cost(parts), sources))
        return pd.DataFrame(rows, columns=["session_id", "chunk", "document_key", "content", "content_hash", "tokens", "sources"])

    schema = "session_id long, chunk int, document_key string, content string, content_hash string, tokens int, sources array<struct<message_id:long,message_revision:int,start_offset:int,end_offset:int,source_kind:string>>"
    return messages.groupBy("session_id").applyInPandas(run, schema)


def question_chunks(text: str, count: Counter = words_and_signs) -> tuple[list[str], bool]:
    """A question within the maximum whole, a longer one in at most five chunks within the target; and whether some is left out."""
    if count(text) <= MAXIMUM:
        return [text], False
    out, rest = [], text
    for a, b in pieces_of(text.replace("\n", " "), 0, len(text), TARGET, count):
        out.append(rest[a:b])
    return out[:QUESTION_CHUNKS], len(out) > QUESTION_CHUNKS


def judge_parts(text: str, most: int) -> list[tuple[int, int]]:
    """UTF-16 (offset, length) ranges of at most ``most`` UTF-8 bytes that cover a text, no character split."""
    at = utf16(text)
    out, start, size = [], 0, 0
    for i, c in enumerate(text):
        n = len(c.encode())
        if size + n > most and size:
            out.append((at[start], at[i] - at[start]))
            start, size = i, 0
        size += n
    return out + ([(at[start], at[len(text)] - at[start])] if start < len(text) else [])
