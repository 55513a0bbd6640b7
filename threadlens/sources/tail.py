"""Tailing transcripts by byte cursor: a scan that resumes where it stopped, and a streaming source built on it.

A cursor says how far a file has been read and what the file looked like; a file that was replaced or cut is read from its start.
"""

from __future__ import annotations

import glob
import hashlib
import os
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Fixed limits of one scan, one line and a file's fingerprint.
SCAN_BYTES, LINE_BYTES, HEAD_BYTES = 4 << 20, 1 << 20, 4096


@dataclass(frozen=True)
class Cursor:
    """How far a file was read, whether inside an over-long line, and the file's identity then."""

    offset: int = 0
    skipping: bool = False
    inode: int = 0
    head_size: int = 0
    head: str = ""


def fingerprint(content: bytes) -> tuple[int, str]:
    head = content[:HEAD_BYTES]
    return len(head), hashlib.sha256(head).hexdigest()


def still_valid(cursor: Cursor, inode: int, size: int, head: bytes) -> bool:
    """Whether a file is the one the cursor knows: same inode, not shorter than what was read, same beginning."""
    same = hashlib.sha256(head[: cursor.head_size]).hexdigest() == cursor.head
    return cursor.inode == inode and size >= cursor.offset and len(head) >= cursor.head_size and same


def scan(content: bytes, cursor: Cursor, budget: int = SCAN_BYTES, longest: int = LINE_BYTES, base: int = 0, head: bytes | None = None) -> tuple[list[tuple[int, str | None, str]], Cursor]:
    """Finished lines after the cursor as (offset, text, problem) and the new cursor. ``content`` begins at the file's byte ``base``, the file with ``head``.

    A line beyond ``longest`` bytes is skipped and reported once, across scans if need be; bytes that aren't UTF-8 are
    reported without text; a line without its end stays for the next scan. At most ``budget`` bytes are looked at.
    """
    out: list[tuple[int, str | None, str]] = []
    at, skipping = cursor.offset - base, cursor.skipping
    end = min(len(content), at + budget)
    while at < end:
        stop = content.find(b"\n", at, end)
        if stop < 0:
            if skipping or end - at > longest:
                out += [] if skipping else [(at + base, None, "too_long")]
                at, skipping = end, True
            break
        line, start, at = content[at:stop], at, stop + 1
        if skipping:
            skipping = False
        elif len(line) > longest:
            out.append((start + base, None, "too_long"))
        else:
            try:
                out.append((start + base, line.decode("utf-8"), ""))
            except UnicodeDecodeError:
                out.append((start + base, None, "not_utf8"))
    return out, Cursor(at + base, skipping, cursor.inode, *fingerprint(content if head is None else head))


class TailReader(SimpleDataSourceStreamReader):
    """Micro-batches of new lines of local files, at most ``budget`` bytes a file and batch. The offset holds every file's cursor."""

    def __init__(self, pattern: str):
        self.pattern = pattern

    def initialOffset(self) -> dict:
        return {"files": {}}

    def _from(self, start: dict, until: dict | None = None) -> tuple[list[tuple], dict]:
        rows, files = [], dict(start["files"])
        for path in sorted(glob.glob(self.pattern)):
            with open(path, "rb") as f:
                head, state = f.read(HEAD_BYTES), os.fstat(f.fileno())
                cursor = Cursor(**files[path]) if path in files else Cursor(inode=state.st_ino)
                if path in files and not still_valid(cursor, state.st_ino, state.st_size, head):
                    cursor = Cursor(inode=state.st_ino)
                stop = (until or {}).get("files", {}).get(path)
                f.seek(cursor.offset)  # what was read before is not read again
                content = f.read(max(0, min(SCAN_BYTES, stop["offset"] - cursor.offset)) if stop else SCAN_BYTES)
            lines, after = scan(content, cursor, base=cursor.offset, head=head)
            rows += [(path, at, text, problem) for at, text, problem in lines]
            files[path] = asdict(after)
        return rows, {"files": files}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._from(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._from(start, end)[0])


class TailSource(DataSource):
    """``spark.readStream.format("tail").load("/folder/*.jsonl")`` after ``spark.dataSource.register(TailSource)``."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "file string, at long, line string, problem string"

    def simpleStreamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"])
