"""Rows of documents by their place: the file that holds them and their number in it.

A place names a row whatever its ids are, null or repeated. Decisions about rows come back to the documents as bitmaps of
places, a bit a row, which are sent out where they fit ``limit`` bytes and otherwise in waves of files, one after the other. So a
whole document never shuffles because of a decision about it. Files are told apart by a 64-bit hash of their paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.work import Workspace

FILE, AT = "__file", "__at"
#: Rows that one bitmap of Spark's covers, and its bytes.
BITS, BYTES = 32768, 4096
SIMPLE = ("Project", "Filter", "SubqueryAlias", "LogicalRelation")


def unused(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores in front as it takes to differ from all ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def stored(docs: DataFrame, work: Workspace) -> DataFrame:
    """``docs`` itself if it only selects from files, else a copy in a working table: rows with places."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in SIMPLE and plan.children().size() == 1:
        plan = plan.children().head()
    if plan.getClass().getSimpleName() == "LogicalRelation":
        try:
            docs.select("_metadata.row_index")
            return docs
        except Exception:  # noqa: BLE001 - files of a format without row numbers
            pass
    return work.keep(docs, "stored")


def placed(rows: DataFrame, *columns: str | Column) -> DataFrame:
    """Columns of stored rows with ``__file`` and ``__at``."""
    return rows.select(*columns, F.xxhash64("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(AT))


def picked(rows: DataFrame, places: DataFrame, inside: bool, work: Workspace, columns: list | None = None, limit: int = 1 << 27) -> DataFrame:
    """Stored rows whose place is in ``places`` (__file, __at), or, unless ``inside``, the others; ``columns`` of them (all by default)."""
    kept = rows.columns if columns is None else columns
    file, at, bucket, bits = unused(rows.columns, FILE, AT, "__bucket", "__bits")
    places = places.select(F.col(FILE).alias(file), (F.floor(F.col(AT) / BITS)).alias(bucket), (F.col(AT) % BITS + 1).alias(at))
    maps = work.keep(places.groupBy(file, bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(bits)), "bitmaps")
    waves = max(1, -(-maps.count() * BYTES // limit))
    out = None
    for wave in range(waves):
        own, rows_ = maps, rows.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at))
        if waves > 1:
            mine = F.pmod(F.col(file), F.lit(waves)) == wave
            own, rows_ = maps.where(mine), rows_.where(mine)
        met = rows_.withColumn(bucket, F.floor(F.col(at) / BITS)).join(F.broadcast(own), [file, bucket], "left")  # its size was counted
        byte = F.conv(F.hex(F.substring(F.col(bits), (F.col(at) % BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.coalesce(F.getbit(byte, (F.col(at) % 8).cast("int")) == 1, F.lit(False))
        some = met.where(hit == inside)
        some = some.select(*kept, F.col(file).alias(FILE), F.col(at).alias(AT)) if columns is not None else some.select(*kept)
        if waves > 1:
            some = work.keep(some, "wave")
        out = some if out is None else out.unionByName(some)
    return out
