"""The store: which batches count, which files a batch writes, and the loop around it."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from unitlens.operators.sinks import Store
from unitlens.plans.run_pass import PassSettings, run_pass, stored_units, unit_changes
from unitlens.schema import SIGHTING_FIELDS, SIGHTING_SCHEMA
from unitlens.streaming import passes

START = datetime(2024, 3, 1)
SCHEMA = SIGHTING_SCHEMA + ", ingest_seq bigint"
UNIT = dict(source="p", property_type="Condo", beds=2.0, baths=2.0, sqft=1300, year_built=2015, price=7000, description="Annual lease.")


def sightings(spark, numbers, at=START, **more):
    rows = [{**UNIT, **more, "source_id": f"s{n}", "url": f"https://p/{n}", "address": f"{n} Palm Way #{n % 9 + 1}A, Surfside, FL 33154", "fetched_at": at}
            for n in numbers]
    return spark.createDataFrame([tuple(r.get(f) for f in SIGHTING_FIELDS) + (i,) for i, r in enumerate(rows)], SCHEMA)


def test_uncommitted_parts_are_not_read(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.log("alerts") is None and store.part("alerts", 0) is None and store.latest() is None and store.state("units") is None
    for batch in (0, 1, 2):
        store.put("alerts", spark.range(batch + 1), batch)
        if batch != 1:
            store.commit(batch)
    assert {r.batch_id for r in store.log("alerts").collect()} == {0, 2} and store.log("alerts").count() == 4
    assert store.log("alerts", 1).count() == 1 and store.part("alerts", 1) is None and store.part("alerts", 2).count() == 3


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=16)
    run_pass(spark, store, sightings(spark, range(100, 140)), START, 0, PassSettings(prefilter=False))
    first = {p.name for p in Path(tmp_path / "s/units/batch_id=0").glob("bucket=*")}
    run_pass(spark, store, sightings(spark, [105], START + timedelta(hours=30), price=6500), START + timedelta(hours=30), 1, PassSettings(prefilter=False))
    second = {p.name for p in Path(tmp_path / "s/units/batch_id=1").glob("bucket=*")}
    assert len(first) > 8 and len(second) == 1 and second < first
    assert len({p.name for p in Path(tmp_path / "s/sightings/batch_id=1").glob("bucket=*")}) == 1
    units = {r.address.split()[0]: (r.price, r.times_seen) for r in stored_units(store).collect()}
    assert len(units) == 40 and units["105"] == (6500, 2) and units["106"] == (7000, 1)
    assert [r.old_price for r in unit_changes(store, 1).collect()] == [7000]
    key = stored_units(store).where("price = 6500").first().dedupe_key
    one = store.of_key("units", "dedupe_key", key)
    assert [r.price for r in one.collect()] == [6500] and all("/bucket=" in f and f.split("/bucket=")[0].endswith("batch_id=1") for f in one.inputFiles())
    assert {r.price for r in store.state("units", 0).collect()} == {7000}  # as of the first batch
    # a bucket with a unit that expires is touched without an incoming unit
    run_pass(spark, store, sightings(spark, [105], START + timedelta(hours=80), price=6500), START + timedelta(hours=80), 2, PassSettings(prefilter=False))
    assert {p.name for p in Path(tmp_path / "s/units/batch_id=2").glob("bucket=*")} == first
    assert stored_units(store).where("is_active").count() == 1 and store.log("runs").where("batch_id = 2").first().marked_inactive == 39


def test_a_pass_is_tried_again_and_given_up(spark, tmp_path):
    landing, tries, sent = str(tmp_path / "landing"), [], []

    def check(store, batch_id):
        tries.append(batch_id)
        if tries.count(batch_id) == 1 or batch_id == 1 and len(tries) < 5:
            raise ValueError("not yet")

    def channel(store, batch_id):
        sent.append(batch_id)
        if len(sent) == 1:
            raise ConnectionError("down")

    def run():
        stream = passes.read_sightings(spark, landing, SCHEMA)
        passes.watch(stream, str(tmp_path / "store"), str(tmp_path / "cp"), PassSettings(prefilter=False), after_pass=channel, attempts=2,
                     before_commit=check).awaitTermination()

    store = Store(spark, str(tmp_path / "store"))
    for n, at in enumerate((START, START + timedelta(days=1))):
        sightings(spark, [200 + n], at).write.mode("append").parquet(landing)
        run()
    assert tries == [0, 0, 1, 1] and [r.batch_id for r in store.committed().collect()] == [0]
    assert [r.error for r in store.filed("failures").collect()] == ["ValueError: not yet"] and store.filed("failed_rows").count() == 1
    assert sent == [0, 0] and [(r.batch_id, r.ok) for r in store.deliveries().collect()] == [(0, True)]  # down in batch 0, sent in batch 1
    assert passes.land_again(store, landing) == [1] and passes.land_again(store, landing) == []
    run()
    assert [r.batch_id for r in store.committed().orderBy("batch_id").collect()] == [0, 2] and sent == [0, 0, 2]
    assert stored_units(store).agg(F.sum("times_seen")).first()[0] == 2 and store.log("price_history").count() == 2


def test_a_batch_must_say_when_it_was_fetched(spark, tmp_path):
    landing = str(tmp_path / "landing")
    sightings(spark, [300]).withColumn("fetched_at", F.lit(None).cast("timestamp")).write.parquet(landing)
    stream = spark.readStream.schema(SCHEMA).parquet(landing)
    with pytest.raises(Exception, match="none of the 1 sightings"):
        passes.watch(stream, str(tmp_path / "s"), str(tmp_path / "c"), stop_on_error=True, attempts=1).awaitTermination()
