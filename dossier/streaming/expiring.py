"""A cache as keyed state of a stream: the last entry of each key, until it is too old."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from dossier.operators.graph import ship

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key string, fetched_at timestamp, seq long, body string, state string"
#: In the state times are microseconds.
MOVES, HELD = "key string, at long, seq long, body string, state string", "at long, seq long, body string"


class Latest(StatefulProcessor):
    """Keeps the entry of a key that was fetched last, and a timer for its end."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD)

    def _ends(self, at: int) -> int:
        return (at + self.keep) // 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        old = tuple(self.held.get()) if self.held.exists() else None
        new = max(((r["at"], r["seq"], r["body"]) for r in rows), key=lambda e: e[:2])
        if old is not None and old[:2] >= new[:2]:
            return
        if old is not None:
            self.handle.deleteTimer(self._ends(old[0]))
        self.held.update(new)
        self.handle.registerTimer(self._ends(new[0]))
        yield Row(key=key[0], at=new[0], seq=new[1], body=new[2], state="stored")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        if self.held.exists():
            at, seq, body = self.held.get()
            self.held.clear()
            yield Row(key=key[0], at=at, seq=seq, body=body, state="expired")

    def close(self) -> None:
        pass


def expiring(entries: DataFrame, keep: str, late: str = "0 seconds") -> DataFrame:
    """What happens to a cache: a row when an entry is ``stored``, and one when it has ``expired``, ``keep`` after it was fetched.

    ``entries`` is a stream of ``key``, ``fetched_at``, ``seq`` and ``body``.  Of several entries of a key the one fetched last counts, among
    those of one time the one of largest ``seq``.  Time is that of the entries: those that come more than ``late``
    after the newest are passed over.  State is kept for one entry a key, no longer than ``keep``.  Rows with a
    null key, time or number are passed over.
    """
    ship(entries.sparkSession)
    span = entries.sparkSession.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {keep}")).alias("span")).first()["span"]
    whole = entries.select("key", "fetched_at", F.col("seq").cast("long").alias("seq"), "body").filter("key IS NOT NULL AND fetched_at IS NOT NULL AND seq IS NOT NULL")
    keyed = whole.withColumn("at", F.unix_micros("fetched_at")).withWatermark("fetched_at", late).groupBy("key")
    moved = keyed.transformWithState(statefulProcessor=Latest(span), outputStructType=MOVES, outputMode="Append", timeMode="EventTime")
    return moved.select("key", F.timestamp_micros("at").alias("fetched_at"), "seq", "body", "state")


def keep_cache(entries: DataFrame, keep: str, path: str, checkpoint: str, late: str = "0 seconds") -> StreamingQuery:
    """Write what happens to the cache to ``path``, up to what there is now; a later call with the same ``checkpoint`` goes on from there."""
    entries.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return expiring(entries, keep, late).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def cache_now(spark: SparkSession, path: str) -> DataFrame:
    """``key``, ``fetched_at``, ``seq``, ``body`` of the entries that are stored and haven't expired, from what ``keep_cache`` wrote."""
    happened = spark.read.schema(OUT).parquet(path)
    last = happened.groupBy("key").agg(F.max_by(F.struct("fetched_at", "seq", "body", "state"), F.struct("fetched_at", "seq", (F.col("state") == "expired").alias("e"))).alias("l"))
    return last.filter("l.state = 'stored'").select("key", "l.fetched_at", "l.seq", "l.body")


def cache_of(entries: DataFrame, keep: str) -> DataFrame:
    """The same from a table of all entries, as of the newest one."""
    whole = entries.filter("key IS NOT NULL AND fetched_at IS NOT NULL AND seq IS NOT NULL")
    last = whole.groupBy("key").agg(F.max_by(F.struct("fetched_at", F.col("seq").cast("long").alias("seq"), "body"), F.struct("fetched_at", "seq")).alias("l"))
    newest = F.lit(whole.agg(F.max("fetched_at")).first()[0]).cast("timestamp")
    return last.filter(F.col("l.fetched_at") > newest - F.expr(f"INTERVAL {keep}")).select("key", "l.*")
