"""Identifiers named in a text: files, functions, issues and pull requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlens.functions.redaction import EDGE, SPACE

#: Fixed patterns: what counts as a file path with an extension, a call ``name()``, ``Issue #n`` and ``PR #n``, next to letters that aren't ASCII too.
_PART = r"(?:\.[A-Za-z0-9_][A-Za-z0-9_.-]*|[A-Za-z0-9_][A-Za-z0-9_.-]*)"
FILE = rf"(?<![A-Za-z0-9_/.:-])((?:(?:\.\./)+|\./|/)?{_PART}(?:/{_PART})*\.[A-Za-z][A-Za-z0-9]{{0,9}})(?![A-Za-z0-9_/-])(?!\.[A-Za-z0-9_/-])"
FUNCTION = r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*)\(\)"
ISSUE = rf"{EDGE}Issue[{SPACE}]+#([0-9]+){EDGE}"
PULL_REQUEST = rf"{EDGE}PR[{SPACE}]+#([0-9]+){EDGE}"


def extract_entities(text: Column) -> Column:
    """Sorted distinct (entity_type, entity_key) structs of a text."""

    def found(kind: str, pattern: str, before: str = "", after: str = "") -> Column:
        keys = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("entity_type"), F.concat(F.lit(before), k, F.lit(after)).alias("entity_key")))

    return F.array_sort(F.array_distinct(F.concat(found("file", FILE), found("function", FUNCTION, after="()"), found("issue", ISSUE, before="#"), found("pull_request", PULL_REQUEST, before="#"))))
