"""Streams over event logs: baselines, changes, windows, sessions, joins in time and sinks.

A log has the columns listing_id, event_id, observed_at (a timestamp), price and status. State is kept behind a watermark only;
what a window, a session or a change gives comes out once, when the watermark has passed its end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.shared import dropped, shared_path, shipped

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def hour_dedupe(log: DataFrame, late: str = "2 hours") -> DataFrame:
    """(listing_id, hour, price) once for each, as long as repeats come within the watermark."""
    hours = log.withWatermark("observed_at", late).withColumn("hour", F.date_trunc("hour", "observed_at"))
    return hours.dropDuplicatesWithinWatermark(["listing_id", "hour", "price"]).select("listing_id", "hour", "price")


def daily_baseline(log: DataFrame, late: str = "1 day") -> DataFrame:
    """(listing_id, day, event_id, n) of each closed day."""
    days = log.withWatermark("observed_at", late).groupBy("listing_id", F.window("observed_at", "1 day").alias("w")).agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"))
    return days.select("listing_id", F.col("w.start").alias("day"), "event_id", "n")


def trailing_counts(log: DataFrame, length: str = "7 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    """(listing_id, until, n, mean): counts of the closed windows that end at `until`."""
    windows = log.withWatermark("observed_at", late).groupBy("listing_id", F.window("observed_at", length, step).alias("w")).agg(F.count("*").alias("n"), F.avg("price").alias("mean"))
    return windows.select("listing_id", F.col("w.end").alias("until"), "n", "mean")


def sessions(log: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """(listing_id, start, n): events of a listing with less than `gap` between them, once the session is closed."""
    grouped = log.withWatermark("observed_at", late).groupBy("listing_id", F.session_window("observed_at", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("listing_id", F.col("w.start").alias("start"), "n")


def evidence_in_time(decisions: DataFrame, evidence: DataFrame, hours: int = 24) -> DataFrame:
    """(event_id, evidence_id): decisions with the evidence of their listing that came within the hours after them.

    State of both sides goes once the watermark shows that no partner can come.
    """
    left = decisions.select(F.col("listing_id").alias("d_id"), "event_id", F.col("observed_at").alias("t0")).withWatermark("t0", f"{hours} hours")
    right = evidence.select(F.col("listing_id").alias("e_id"), F.col("event_id").alias("evidence_id"), F.col("observed_at").alias("done_at")).withWatermark("done_at", f"{hours} hours")
    return left.join(right, F.expr(f"d_id = e_id and done_at >= t0 and done_at <= t0 + interval {hours} hours")).select("event_id", "evidence_id")


def flips(idle_ms: int) -> StatefulProcessor:
    """The flag of each key after what the watermark has passed, and the events that it has not.

    Events wait in state until the watermark reaches them and are then taken in the order of time, then id, so that order of
    arrival does not matter. One timer stands at the earliest of them. A key that has been silent for `idle_ms` is forgotten:
    its next event is like a first one.

    What a call to the state costs is far more than what it carries, so the events of a key in a batch wait as one packed
    value, and the flag, its time, the timer and what the timer stands for are one value, too.
    """

    # a class of its own for each call travels with its code: the Python beside the driver that reads it has no files of ours
    class Flips(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.was = handle.getValueState("was", "inactive boolean, at bigint, timer bigint, waits boolean")
            self.waiting = handle.getListState("waiting", "events binary")

        def _wake(self, known: int | None, at: int) -> int:
            if known != at:
                if known is not None:
                    self.handle.deleteTimer(known)
                self.handle.registerTimer(at)
            return at

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            import struct

            new = [(r["at"], r["event_id"], r["inactive"]) for r in rows]
            if new:
                self.waiting.appendValue((b"".join(struct.pack("<qq?", *e) for e in new),))
                first = min(e[0] for e in new) // 1000
                was, last, timer, waits = self.was.get() or (None, None, None, False)
                if not waits or first < timer:
                    self.was.update((was, last, self._wake(timer, first), True))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            import struct

            passed = timerValues.getCurrentWatermarkInMs()
            was, last, _, waits = self.was.get()
            chunks = [bytes(c[0]) for c in self.waiting.get()] if waits else []
            waiting = sorted(e for c in chunks for e in struct.iter_unpack("<qq?", c))
            ready = [e for e in waiting if e[0] // 1000 <= passed]
            rest = waiting[len(ready) :]
            kept = []
            for at, event, flag in ready:
                if last is not None and at // 1000 - last > idle_ms:
                    was = None
                if flag if was is None else flag != was:
                    kept.append(Row(listing_id=key[0], event_id=event, inactive=flag))
                was, last = flag, at // 1000
            if rest:
                self.waiting.put([(b"".join(struct.pack("<qq?", *e) for e in rest),)])
            elif waits:
                self.waiting.clear()
            if not rest and last + idle_ms <= passed:
                self.was.clear()
            else:
                self.was.update((was, last, self._wake(None, rest[0][0] // 1000 if rest else last + idle_ms), bool(rest)))
            return iter(kept)

        def close(self) -> None:
            pass

    return Flips()


def change_log(log: DataFrame, late: str = "1 day", idle_days: int = 365) -> DataFrame:
    """The events at which the flag `inactive` of a listing flips; a first false is no change.

    An event counts once the watermark has passed it, whatever the order in which events came; later ones than that are
    dropped. State is the last flag of each listing and its events of the last while; a listing without events for `idle_days`
    is forgotten. Needs the RocksDB state store (`drained(..., rocks=True)`).
    """
    shipped(log.sparkSession)
    known = log.where("inactive is not null").withWatermark("observed_at", late)
    rows = known.select("listing_id", "event_id", F.unix_micros("observed_at").alias("at"), "observed_at", "inactive")
    return rows.groupBy("listing_id").transformWithState(flips(idle_days * DAY_MS), "listing_id bigint, event_id bigint, inactive boolean", "append", "eventTime")


@contextmanager
def _rocks(spark: SparkSession, wanted: bool):
    before = spark.conf.get(PROVIDER, None)
    try:
        if wanted:
            spark.conf.set(PROVIDER, ROCKS)
        yield
    finally:
        if wanted and before is not None:
            spark.conf.set(PROVIDER, before)
        elif wanted:
            spark.conf.unset(PROVIDER)


def score_touched(log: DataFrame, bands: DataFrame, names: list[str]) -> DataFrame:
    """(event_id, score): each event scored by a static table of (name, value, woe); a value without a band adds nothing."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names])
    long = log.select("event_id", F.explode(pairs).alias("x")).select("event_id", "x.*")
    return long.join(bands, ["name", "value"], "left").select("event_id", F.coalesce("woe", F.lit(0.0)).alias("woe"))


def drained(stream: DataFrame, mode: str = "append", rocks: bool = False, folder: str | None = None) -> DataFrame:
    """All rows that the stream gives for what is there now, written to the shared folder batch by batch.

    A batch writes to a folder of its own number, so one that is run again replaces itself; in complete mode each batch
    holds the whole result and the last one stands. With a folder of its own the stream goes on where it stopped.
    """
    spark, schema = stream.sparkSession, stream.schema
    folder = folder or shared_path(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    with _rocks(spark, rocks):
        running = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    numbers = sorted(int(name.removeprefix("batch=")) for name in _names(spark, f"{folder}/rows") if name.startswith("batch="))
    wanted = numbers[-1:] if mode == "complete" else numbers
    return spark.read.schema(schema).parquet(*[f"{folder}/rows/batch={n}" for n in wanted]) if wanted else spark.createDataFrame([], schema)


def _names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder of the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(place)] if system.exists(place) else []


MANIFEST = "bucket int, version bigint"


class BucketTable:
    """A table in key buckets whose versions share what they have in common.

    A version is a manifest: for each bucket the version that wrote it last. A merge reads and rewrites the buckets that its
    rows touch and leaves the others where they are; its manifest is written last, so that a merge that was cut off has not
    happened, and one of a number that is there already does nothing. Everything lies in the folder, nothing in the driver.
    """

    def __init__(self, spark: SparkSession, folder: str, schema, key: str, buckets: int = 64):
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder, schema, key, buckets

    def versions(self) -> list[int]:
        names = _names(self.spark, f"{self.folder}/manifest")
        return sorted(int(n) for n in names if n.isdigit() and "_SUCCESS" in _names(self.spark, f"{self.folder}/manifest/{n}"))

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """Bucket to the version that wrote it, as of a version (the newest)."""
        known = self.versions()
        version = (known[-1] if known else None) if version is None else version
        if version is None:
            return {}
        return {r["bucket"]: r["version"] for r in self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/{version}").collect()}

    def _files(self, manifest: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/data/{v}/_bucket={b}" for b, v in sorted(manifest.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._files(self.manifest(version))

    def merge(self, batch: DataFrame, number: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Put merge(rows of the touched buckets, batch) in their place, as version `number`."""
        known = self.versions()
        if known and number <= known[-1]:
            return
        place = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        touched = {r["b"] for r in batch.select(place.alias("b")).distinct().collect()}
        before = self.manifest()
        merged = merge(self._files({b: v for b, v in before.items() if b in touched}), batch)
        merged.withColumn("_bucket", place).repartition(max(1, len(touched)), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/data/{number}")
        written = {int(n.removeprefix("_bucket=")) for n in _names(self.spark, f"{self.folder}/data/{number}") if n.startswith("_bucket=")}
        after = {b: v for b, v in before.items() if b not in touched} | dict.fromkeys(written, number)
        self.spark.createDataFrame(sorted(after.items()), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/{number}")

    def vacuum(self, keep: int = 2) -> None:
        """Delete what only versions before the newest `keep` use."""
        known = self.versions()
        used = {v for version in known[-keep:] for v in self.manifest(version).values()}
        for version in known[:-keep]:
            dropped(self.spark, f"{self.folder}/manifest/{version}")
            if version not in used:
                dropped(self.spark, f"{self.folder}/data/{version}")


def upserted(stream: DataFrame, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame], folder: str | None = None, buckets: int = 64) -> DataFrame:
    """The table that merge(rows so far of the touched keys' buckets, batch) leaves after all batches; see `BucketTable`.

    With a folder of its own the stream goes on where it stopped, also after the loss of the driver."""
    spark, schema = stream.sparkSession, stream.schema
    folder = folder or shared_path(spark, "upsert")

    def apply(batch: DataFrame, number: int) -> None:
        BucketTable(batch.sparkSession, folder, schema, key, buckets).merge(batch, number, merge)

    stream.writeStream.foreachBatch(apply).outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return BucketTable(spark, folder, schema, key, buckets).read()
