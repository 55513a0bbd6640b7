"""Rules that remember, as stateful streams: what each key has seen lies in the state store, so a stream decides as a batch over everything would.

Each processor is keyed (by idempotency key, by message, by session) and holds a value or a map of bounded entries per key; a
lost executor or a restart reads it back from the checkpoint. Within a micro-batch a key's events are taken in order of ``arrival``, across batches in the order of the
batches. The state store is RocksDB, which keeps state outside the heap.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from threadlens.session import reach

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the state store that these streams need, and workers that find this package."""
    reach(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


class Receipts(StatefulProcessor):
    """The first event of an idempotency key is stored; later ones repeat it if their body is the same, and conflict otherwise.

    ``ttl_ms``: after that long without an event a key is forgotten, and its next event is stored again; None remembers for ever.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "body string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        kept = self.first.get()[0] if self.first.exists() else None
        known = self.first.exists()
        for r in sorted(rows, key=lambda r: r.arrival):
            receipt = "stored" if not known else "repeated" if r.body == kept else "conflict"
            if not known:
                known, kept = True, r.body
                self.first.update((kept,))
            yield Row(arrival=r.arrival, receipt=receipt)

    def close(self) -> None:
        pass


class Revisions(StatefulProcessor):
    """The revision rule of a message: revision 1 of a new one or the one after the current is accepted, an equal stored one repeated, all else conflicts.

    State: the current revision with the message's identity (role and number), and the body of each stored revision.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "revision long, identity string")
        self.bodies = handle.getMapState("bodies", "revision long", "body string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        current, identity = self.current.get() if self.current.exists() else (0, None)
        before = current
        for r in sorted(rows, key=lambda r: r.arrival):
            fits = current == 0 or r.identity == identity
            if fits and r.revision == current + 1:
                current, identity, verdict = r.revision, r.identity, "accepted"
                self.bodies.updateValue((current,), (r.body,))
            elif fits and 0 < r.revision <= current and self.bodies.getValue((r.revision,))[0] == r.body:
                verdict = "repeated"
            else:
                verdict = "conflict"
            yield Row(arrival=r.arrival, verdict=verdict)
        if current != before:
            self.current.update((current, identity))

    def close(self) -> None:
        pass


class Dirty(StatefulProcessor):
    """From where each session has to be built again: told when nothing has changed in it for ``quiet_ms``, by a timer, and then forgotten."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lowest = handle.getValueState("lowest", "sequence long, due long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        lowest = min(r.sequence for r in rows)
        if self.lowest.exists():
            was, due = self.lowest.get()
            lowest = min(lowest, was)
            self.handle.deleteTimer(due)
        due = timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms
        self.handle.registerTimer(due)
        self.lowest.update((lowest, due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.lowest.exists():
            lowest = self.lowest.get()[0]
            self.lowest.clear()
            yield Row(session=key[0], dirty_sequence=lowest)

    def close(self) -> None:
        pass


def receipts(events: DataFrame, keys: list[str], body_hash: str, arrival: str, ttl_ms: int | None = None) -> DataFrame:
    """(arrival, receipt) of a stream of events; as ``ingest.receipts`` over all of them."""
    prepared(events.sparkSession)
    rows = events.select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("key"), F.col(arrival).cast("long").alias("arrival"), F.col(body_hash).cast("string").alias("body"))
    return rows.groupBy("key").transformWithState(Receipts(ttl_ms), "arrival long, receipt string", "append", "None" if ttl_ms is None else "ProcessingTime")


def revisions(events: DataFrame, message: str, revision: str, body_hash: str, arrival: str, identity: list[str] | None = None) -> DataFrame:
    """(arrival, verdict) of a stream of events; as ``ingest.revision_verdicts`` over all of them."""
    prepared(events.sparkSession)
    same = F.to_json(F.struct(*identity), {"ignoreNullFields": "false"}) if identity else F.lit("")
    rows = events.select(F.col(message).cast("string").alias("message"), F.col(revision).cast("long").alias("revision"), F.col(body_hash).cast("string").alias("body"), F.col(arrival).cast("long").alias("arrival"), same.alias("identity"))
    return rows.groupBy("message").transformWithState(Revisions(), "arrival long, verdict string", "append", "None")


def dirty_sessions(changes: DataFrame, session: str, sequence: str, quiet_ms: int = 1000) -> DataFrame:
    """(session, dirty_sequence) of a stream of changed messages, once a session has been quiet; as ``ingest.dirty_from`` over what came since it was told last."""
    prepared(changes.sparkSession)
    rows = changes.select(F.col(session).cast("long").alias("session"), F.col(sequence).cast("long").alias("sequence"))
    return rows.groupBy("session").transformWithState(Dirty(quiet_ms), "session long, dirty_sequence long", "append", "ProcessingTime")
