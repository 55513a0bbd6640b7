"""Working tables in the folder that driver and executors share.

Iterative operators cut their lineage by writing a table below ``spark.checkpoint.dir`` and reading it
again, so a lost executor costs a re-read and not a recomputation. Tables are removed with
``Workspace.drop`` when the next one stands, and what is left goes when the driver exits.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from threadlens.session import reach

_left: list[tuple[SparkSession, str]] = []
_local: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only in local mode, where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="threadlens-")
        _left.append((spark, _local[app]))
    return _local[app]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Workspace:
    """The working tables of one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        reach(spark)
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        _left.append((spark, self.path))

    def keep(self, df: DataFrame, name: str = "t", partitions: int | None = None) -> DataFrame:
        """Write ``df`` and read it back: computed once, readable by every executor."""
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{name}"
        out = df.coalesce(partitions) if partitions else df
        out.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(out.schema).parquet(path)
        back.__dict__["_kept_at"] = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that ``keep`` returned and nothing will read again."""
        for t in tables:
            if path := t.__dict__.pop("_kept_at", None):
                remove(self.spark, path)


def kept_at(kept: DataFrame) -> str:
    """The folder of a table that ``Workspace.keep`` returned."""
    return kept.__dict__["_kept_at"]


@atexit.register
def _sweep() -> None:
    for spark, path in _left:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended before us
            pass
