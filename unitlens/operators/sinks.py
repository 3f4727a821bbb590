"""Sinks: exports and versioned tables. What a batch writes is written once and counts when the batch is committed, so a lost
executor, a failed or a repeated batch leaves no half state."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime
from functools import cache

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from unitlens.operators.derive import display_line

#: Identities are hashes in hexadecimal digits, which the default codec does not shorten.
COMPRESSION = "zstd"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for written state. Only a local session without that setting gets its own: on a
    cluster each executor would write to a disk of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = _local_folder(spark.sparkContext.applicationId)
    return named.rstrip("/")


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"unitlens-{application}-")


def free_shuffles(spark: SparkSession) -> None:
    """Behind a written table its shuffle files are of no more use, but Spark deletes them only when the driver collects its
    garbage, by default every 30 minutes. So it is told to."""
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what is costly to derive and read more than once is derived once,
    and a lost executor costs a re-read."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", COMPRESSION).parquet(path)
    free_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export_rows(units: DataFrame) -> DataFrame:
    """The fourteen columns of an export."""
    have = set(units.columns)

    def maybe(name: str, kind: str, source: str | None = None):
        return (F.col(source or name) if (source or name) in have else F.lit(None)).cast(kind).alias(name)

    return units.select(
        display_line().alias("address"), "price", "beds", "baths", "sqft", "year_built",
        F.col("lease_term_text").alias("lease_term"), "miles_from_ocean",
        F.array_join(F.array_sort(F.map_keys("amenity_matches")), "; ").alias("amenities"),
        maybe("rent_estimate", "int"), maybe("avm_verdict", "string", "price_verdict"), maybe("county_sqft", "int"),
        "source", "url")


def write_export(units: DataFrame, path: str) -> None:
    """CSV with a header or JSON lines, by the ending of ``path``. Without rows a CSV holds the lone header
    ``address``."""
    rows, counted = export_rows(units), Observation()
    if not path.lower().endswith(".csv"):
        rows.write.mode("overwrite").json(path)
        return
    rows.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("header", True).csv(path)
    if not counted.get["n"]:
        units.sparkSession.createDataFrame([("address",)], "value string").write.mode("overwrite").text(path)


class Store:
    """Tables under one folder. A batch counts once its row stands in ``commits``: what batches wrote that failed before is
    read by no one.

    * A log has one part per batch.
    * A state table is cut into ``buckets`` by the hash of its key. A batch writes the buckets it touches; its commit row says
      which batch wrote each bucket last, so untouched buckets keep their files and are not read to be merged.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._written: dict[str, tuple[list[int], dict[int, int]]] = {}

    def _read(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(path)
        except Exception as error:  # no such path yet, or nothing in it
            if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
                return None
            raise

    def committed(self) -> DataFrame | None:
        """The batches that count: (batch_id, at, versions, oldest)."""
        return self._read(f"{self.root}/commits")

    def _last(self, batch: int | None = None) -> Row | None:
        """The last commit, or the last one up to ``batch``. One row comes to the driver."""
        commits = self.committed()
        if commits is None:
            return None
        return (commits if batch is None else commits.where(F.col("batch_id") <= batch)).orderBy(F.desc("batch_id")).first()

    def latest(self) -> int | None:
        """The last committed batch."""
        last = self._last()
        return None if last is None else last["batch_id"]

    # --- logs ---

    def log(self, name: str, batch: int | None = None) -> DataFrame | None:
        """The rows of all committed batches up to ``batch``, with their batch_id."""
        commits, rows = self.committed(), self._read(f"{self.root}/{name}")
        if commits is None or rows is None:
            return None
        mine = commits.select(F.col("batch_id").cast(rows.schema["batch_id"].dataType).alias("batch_id"))
        return rows.join(mine if batch is None else mine.where(F.col("batch_id") <= batch), "batch_id", "left_semi")

    def part(self, name: str, batch_id: int) -> DataFrame | None:
        """What one batch wrote, if it is committed."""
        commits = self.committed()
        if commits is None or commits.where(F.col("batch_id") == batch_id).isEmpty():
            return None
        return self._read(f"{self.root}/{name}/batch_id={batch_id}")

    def put(self, name: str, df: DataFrame, batch_id: int) -> DataFrame:
        """Write this batch's part and read it back: the lineage ends here. Writing it again replaces it."""
        path = f"{self.root}/{name}/batch_id={batch_id}"
        df.write.mode("overwrite").option("compression", COMPRESSION).parquet(path)
        free_shuffles(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, batch_id: int, *names: str) -> None:
        """Delete what a batch put down under ``names`` for its own use, once nothing reads it any more."""
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/batch_id={batch_id}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def filed(self, name: str) -> DataFrame | None:
        """What was put beside the batches, whether they are committed or not: ``failures``, ``failed_rows``, ``landed_again``."""
        return self._read(f"{self.root}/{name}")

    def delivered(self, batch_id: int, error: str | None) -> None:
        """Record that a committed batch was handed on, or what kept it from that."""
        self.put("deliveries", self.spark.createDataFrame([(error is None, error)], "ok boolean, error string"), batch_id)

    def deliveries(self) -> DataFrame | None:
        """(batch_id, ok, error) of each committed batch that was tried, the last try."""
        return self.filed("deliveries")

    # --- states ---

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def state(self, name: str, batch: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """A state table as of the last commit up to ``batch``; of it only ``buckets``, where named."""
        last = self._last(batch)
        versions = (last["versions"].get(name) if last else None) or []
        paths = [f"{self.root}/{name}/batch_id={version}/bucket={b}" for b, version in enumerate(versions)
                 if version >= 0 and (buckets is None or b in buckets)]
        return self.spark.read.parquet(*paths) if paths else None

    def of_key(self, name: str, key: str, value) -> DataFrame | None:
        """The rows of a state table with one key: one bucket is read."""
        bucket = self.spark.range(1).select(self._bucket(F.lit(value))).first()[0]
        rows = self.state(name, buckets=[bucket])
        return None if rows is None else rows.where(F.col(key) == value)

    def touched(self, keys: DataFrame, name: str, since: datetime | None = None) -> list[int]:
        """The buckets that hold one of ``keys`` (one column), or a row older than ``since`` by the age it was written with."""
        mine = {r[0] for r in keys.toDF("key").select(self._bucket(F.col("key"))).distinct().collect()}  # at most ``buckets`` rows
        last = self._last()
        if since is not None and last is not None:
            limit = self.spark.range(1).select(F.unix_micros(F.lit(since).cast("timestamp"))).first()[0]
            mine |= {b for b, age in (last["oldest"].get(name) or {}).items() if age < limit}
        return sorted(mine)

    def put_state(self, name: str, df: DataFrame, batch_id: int, key: str, age: Column | None = None) -> DataFrame:
        """Write the buckets that hold rows of ``df``, which must be whole, and read them back. ``age`` is a timestamp; the
        oldest of a bucket goes to the commit row."""
        path = f"{self.root}/{name}/batch_id={batch_id}"
        df.withColumn("bucket", self._bucket(F.col(key))).hint("rebalance", "bucket").write.mode("overwrite").option(
            "compression", COMPRESSION).partitionBy("bucket").parquet(path)
        free_shuffles(self.spark)
        rows = self.spark.read.schema(StructType([*df.schema.fields, StructField("bucket", IntegerType())])).parquet(path)
        found = rows.groupBy("bucket").agg(F.min(F.unix_micros(F.lit(None).cast("timestamp") if age is None else age))).collect()
        self._written[name] = ([b for b, _ in found], {b: oldest for b, oldest in found if oldest is not None})
        return rows.drop("bucket")

    def commit(self, batch_id: int) -> None:
        """From here on the batch counts."""
        last = self._last()
        versions = dict(last["versions"]) if last else {}
        oldest = dict(last["oldest"]) if last else {}
        for name, (mine, ages) in self._written.items():
            now = list(versions.get(name) or [-1] * self.buckets)
            for b in mine:
                now[b] = batch_id
            versions[name] = now
            oldest[name] = {b: age for b, age in (oldest.get(name) or {}).items() if b not in mine} | ages
        row = self.spark.createDataFrame([(batch_id, versions, oldest)],
                                         "batch_id bigint, versions map<string,array<bigint>>, oldest map<string,map<int,bigint>>")
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/part={batch_id}")
        self._written = {}
