"""Price changes, cool-down and inactivity per unit as a keyed state over a stream.

Sightings are first reduced to the lowest price per unit and instant with an aggregate, which combines on the map side.
Its rows come out once the watermark has passed them, so the state sees the instants of a unit in order, each once, and
every change between two instants counts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "unit_key bigint, at_us bigint, event string, old_price int, price int, times_seen int, alert boolean"
NAMES = ("unit_key", "at_us", "event", "old_price", "price", "times_seen", "alert")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _events(columns: dict) -> pd.DataFrame:
    prices = {c: pd.array(columns[c], dtype="Int32") for c in ("old_price", "price")}
    return pd.DataFrame({**columns, **prices})


class UnitProcessor(StatefulProcessor):
    """What is kept of a unit: last price, when it was last seen, how often, and when each kind was last told.

    Rows with a ``kind`` are outcomes of sends: a successful one starts the cool-down of its kind. Without a stream of
    outcomes (``trusting``) an event counts as told when it is emitted.
    """

    def __init__(self, cooldown_hours: int, inactive_hours: int, min_dollars: int, min_pct: float, trusting: bool = True):
        self.cooldown, self.inactive = cooldown_hours * 3_600_000_000, inactive_hours * 3_600_000_000
        self.min_dollars, self.min_pct, self.trusting = min_dollars, min_pct, trusting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "price int, last_seen bigint, times_seen int")
        self.told = handle.getMapState("told", "kind string", "at bigint")

    def _last(self, kind: str) -> int | None:
        """When a kind was last told. The state is asked once for each kind a key has rows of, and told once what changed."""
        if kind not in self.known:
            self.known[kind] = self.told.getValue((kind,))[0] if self.told.containsKey((kind,)) else None
        return self.known[kind]

    def _keep(self) -> None:
        for kind in self.changed:
            self.told.updateValue((kind,), (self.known[kind],))

    def _begin(self) -> None:
        self.known, self.changed = {}, set()

    def _tell(self, kind: str, at: int) -> bool:
        last = self._last(kind)
        if last is not None and at - last < self.cooldown:
            return False
        if self.trusting:
            self.known[kind] = at
            self.changed.add(kind)
        return True

    def _sent(self, kind: str, at: int) -> None:
        last = self._last(kind)
        if last is None or at > last:
            self.known[kind] = at
            self.changed.add(kind)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._begin()
        for kind, at in zip(initialState["kind"].tolist(), initialState["at_us"].tolist(), strict=True):
            self._sent(kind, at)
        self._keep()

    def _is_material(self, old: int, new: int) -> bool:
        return old - new >= self.min_dollars and (old - new) / old >= self.min_pct

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        life = before = self.life.get() if self.life.exists() else None
        self._begin()
        batches = list(rows)
        seen = batches[0] if len(batches) == 1 else pd.concat(batches)
        missing = seen["price"].isna().tolist()
        given = list(zip(*(seen[c].tolist() for c in ("at_us", "kind", "price", "n", "ok")), missing, strict=True))
        given.sort(key=lambda row: row[:2])  # at one instant sightings, of no kind, come before outcomes
        out = {c: [] for c in NAMES}
        for at, kind, new, n, ok, unpriced in given:
            if kind:
                if ok:
                    self._sent(kind, at)
                continue
            new = None if unpriced else int(new)
            old = life[0] if life else None
            event, alert = "unchanged", False
            if life is None:
                event, alert = "new", self._tell("new", at)
            elif old is not None and new is not None and new != old:
                event = "price_drop" if new < old else "price_increase"
                alert = event == "price_drop" and self._is_material(old, new) and self._tell(event, at)
            life = (new if new is not None else old, at, (life[2] if life else 0) + n)
            for name, value in zip(NAMES, (key[0], at, event, old, new, life[2], alert), strict=True):
                out[name].append(value)
        self._keep()
        if not out["at_us"]:
            return
        self.life.update(life)
        if before is not None:  # a unit that was never seen has no timer
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self.handle.registerTimer((life[1] + self.inactive) // 1000)  # timers are in milliseconds
        yield _events(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        price, last_seen, times = self.life.get()
        yield _events({name: [value] for name, value in zip(
            NAMES, (key[0], last_seen, "inactive", price, None, times, False), strict=True)})

    def close(self) -> None:
        pass


def unit_instants(sightings: DataFrame, watermark: str, outcomes: DataFrame | None = None) -> DataFrame:
    """Re-delivered rows dropped, then the lowest price per unit and instant. Outcomes go the same way, so that the watermark
    holds both back alike and the state sees them in order."""
    fresh = sightings.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["source_key", "ts"])
    rows = fresh.select("ts", "unit_key", F.lit("").alias("kind"), F.col("price").cast("int").alias("price"), F.lit(False).alias("ok"))
    if outcomes is not None:
        rows = rows.unionByName(outcomes.withWatermark("ts", watermark).select(
            "ts", "unit_key", "kind", F.lit(None).cast("int").alias("price"), F.coalesce("ok", F.lit(False)).alias("ok")))
    each = rows.groupBy("ts", "unit_key", "kind").agg(F.min("price").alias("price"), F.count("*").cast("int").alias("n"), F.max("ok").alias("ok"))
    return each.select("unit_key", "ts", F.unix_micros("ts").alias("at_us"), "kind", "price", "n", "ok")


def unit_events(sightings: DataFrame, watermark: str = "1 hour", cooldown_hours: int = 24, inactive_hours: int = 72,
                min_dollars: int = 100, min_pct: float = 0.02, outcomes: DataFrame | None = None, log: DataFrame | None = None) -> DataFrame:
    """Stream of new, price_drop, price_increase, unchanged and inactive events per unit.

    Needs unit_key, source_key, ts (timestamp) and price; the session must use the RocksDB state store.

    ``outcomes`` is a stream (unit_key, ts, kind, ok) of what became of the alerts: only a send that succeeded within the
    cool-down keeps an event of its kind from being told, so an alert whose send failed is told again. ``log`` is a table
    (unit_key, kind, sent_at, ok) of sends from before the stream: the state of a new query begins with it, so that a
    restart without its checkpoint keeps the cool-down.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package
    before = None if log is None else log.where("ok").groupBy("unit_key", "kind").agg(
        F.max(F.unix_micros(F.col("sent_at").cast("timestamp"))).alias("at_us")).groupBy("unit_key")
    return unit_instants(sightings, watermark, outcomes).groupBy("unit_key").transformWithStateInPandas(
        statefulProcessor=UnitProcessor(cooldown_hours, inactive_hours, min_dollars, min_pct, outcomes is None),
        outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime", initialState=before)


def run_to_table(events: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run over all that is there now into files at ``path`` and read them back."""
    spark: SparkSession = events.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        query = (events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
                 .outputMode("append").trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(OUTPUT).parquet(path).withColumn("seen_at", F.timestamp_micros("at_us")).drop("at_us")
