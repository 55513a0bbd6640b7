"""Small text functions: repository names, excerpts, reports, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _host_path(host: Column, port: Column, path: Column, usual: Column) -> Column:
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "^/+", ""), "/+$", ""), r"\.git$", ""), "/+$", "")
    where = F.concat(F.lower(host), F.when((F.coalesce(port, F.lit("")) != "") & (port != usual), F.concat(F.lit(":"), port)).otherwise(""))
    return F.when((F.length(host) > 0) & (F.length(p) > 0), F.concat(where, F.lit("/"), p))


def canonical_remote(url: Column) -> Column:
    """``host[:port]/path`` of an https, ssh or scp-like repository address; null for local paths and other schemes."""
    v = F.trim(url)
    local = v.rlike(r"^(?:/|\./|\.\./|[A-Za-z]:[\\/])") | (v == "")
    full = r"^(https|ssh)://(?:[^/@?#]*@)?([^/:?#]+)(?::([0-9]+))?(/[^?#]*)?(?:[?#].*)?$"
    part = lambda i: F.regexp_extract(v, "(?i)" + full, i)
    usual = F.when(F.lower(part(1)) == "https", "443").otherwise("22")
    scp = r"^(?:[^@/]+@)?([A-Za-z0-9.-]+)(?::(\d+))?:(.+)$"
    piece = lambda i: F.regexp_extract(v, scp, i)
    by_url = F.when(v.rlike("(?i)" + full), _host_path(part(2), part(3), part(4), usual))
    by_scp = F.when(v.rlike(scp), _host_path(piece(1), piece(2), piece(3), F.lit("22")))
    return F.when(local, None).when(v.contains("://"), by_url).otherwise(by_scp)


def excerpt(text: Column, points: int = 400) -> Column:
    """The first code points of a text."""
    return F.substring(text, 1, points)


def context_lines(rows: Column, points: int = 300) -> Column:
    """``[role] text`` lines of an array of (role, text)."""
    return F.array_join(F.transform(rows, lambda r: F.concat(F.lit("["), r["role"], F.lit("] "), F.substring(r["text"], 1, points))), "\n")


def namespace(company: Column, employee: Column, scope: Column) -> Column:
    """The key under which a source's sessions of one employee are known."""
    return F.concat_ws("|", F.lit("v1"), company, employee, scope)


def case_report(fields: dict[str, Column], longest: int = 600) -> Column:
    """struct(report, too_long): ``label: value`` lines of the fields that are given, in order."""
    report = F.concat_ws("\n", *[F.when(F.length(F.trim(c)) > 0, F.concat(F.lit(f"{label}: "), F.trim(c))) for label, c in fields.items()])
    return F.struct(report.alias("report"), (F.length(report) > longest).alias("too_long"))


def document_key(session: Column, message: Column, offset: Column, version: str) -> Column:
    """A document's identity: session, first original source and its start, chunker version, without the revision."""
    nul = F.lit("\x00")
    return F.sha2(F.concat(session.cast("string"), nul, message.cast("string"), nul, offset.cast("string"), nul, F.lit(version)), 256)
