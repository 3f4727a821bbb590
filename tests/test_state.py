import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from unitlens.criteria import AlertCriteria
from unitlens.operators import alerts, enrich, merge, resolve, state, stats
from unitlens.operators.sinks import Store, write_export
from unitlens.plans.run_pass import PassSettings, alert_payloads, run_pass
from unitlens.schema import SIGHTING_FIELDS, SIGHTING_SCHEMA

START = datetime(2024, 1, 1)


def brute_changes(rows):
    out, last = {}, {}
    for unit, ts, seq, price in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        old = last.get(unit)
        if price is not None:
            out[seq] = (old, "first" if old is None else "drop" if price < old else "increase" if price > old else "unchanged")
            last[unit] = price
        else:
            out[seq] = (old, None)
    return out


@pytest.mark.parametrize("width,parts", [("1 hour", 1), ("1 day", 7), ("30 days", 3)])
def test_sliced_changes_equal_a_replay_with_one_hot_unit(spark, width, parts):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.6 else rng.randint(1, 9), START + timedelta(minutes=rng.randint(0, 9000)), i,
             None if rng.random() < 0.2 else rng.randint(1, 4)) for i in range(1500)]
    df = spark.createDataFrame(rows, "unit_key int, ts timestamp, seq int, price int").repartition(parts)
    got = {r["seq"]: (r["old_price"], r["change"]) for r in state.price_changes(df, width=width).collect()}
    assert got == brute_changes(rows)


def test_running_life_counts_across_slices(spark):
    rows = [(1, START + timedelta(hours=7 * i), i) for i in range(20)]
    df = spark.createDataFrame(rows, "unit_key int, ts timestamp, seq int").repartition(4)
    got = state.running_life(df).orderBy("seq").collect()
    assert [r["times_seen"] for r in got] == list(range(1, 21)) and {r["first_seen_at"] for r in got} == {START}


def test_as_of_cooldown_equals_brute_force(spark):
    rng = random.Random(5)
    log = [(rng.randint(0, 2), "new", START + timedelta(minutes=rng.randint(0, 9000)), rng.random() < 0.7) for _ in range(40)]
    events = [(i, rng.randint(0, 2), "new", START + timedelta(minutes=rng.randint(0, 9000))) for i in range(300)]
    kept = alerts.suppress_recent_as_of(
        spark.createDataFrame(events, "id int, dedupe_key int, kind string, ts timestamp"),
        spark.createDataFrame(log, "dedupe_key int, kind string, sent_at timestamp, ok boolean"), 24)
    want = {i for i, k, _, ts in events
            if not any(ok and k == lk and ts - timedelta(hours=24) <= at <= ts for lk, _, at, ok in log)}
    assert {r["id"] for r in kept.collect()} == want


def test_material_drops(spark):
    df = spark.createDataFrame([(8400, 7700), (8400, 8360), (8400, 9000), (40000, 39900), (None, 5)], "old_price int, new_price int")
    assert [r[0] for r in df.select(alerts.is_material_drop(AlertCriteria())).collect()] == [True, False, False, False, False]


def test_register_match_order(spark):
    register = spark.createDataFrame([
        ("F1", "421 SEAGRAPE BLVD", "807E", 910, 3), ("F2", "421 SEAGRAPE BLVD", "806E", 1240, 2), ("F3", "421 SEAGRAPE BLVD PH9", None, 1020, 1)],
        "folio string, site_address string, unit string, sqft int, reg_seq int").withColumns({
            "street_key": F.lit("421 seagrape blvd"), "year_built": F.lit(2016), "beds": F.lit(2.0), "baths": F.lit(None).cast("double"),
            "use_code": F.lit(None).cast("string"), "source": F.lit("r")})
    units = spark.createDataFrame([(1, "806e"), (2, "ph9"), (3, "77"), (4, None)], "i int, unit string").withColumn(
        "street_key", F.when(F.col("i") < 4, "421 seagrape blvd"))
    got = enrich.match_register(units, register).orderBy("i").select("reg.folio", "reg_match").collect()
    assert [tuple(r) for r in got] == [("F2", "unit"), ("F3", "address"), ("F3", "street"), (None, None)]


def test_register_overlay(spark):
    rows = [(1650, 2010, 1180, 2016), (1200, 2015, 1180, 2016), (None, None, 1450, 2018), (1000, 2000, None, None)]
    df = spark.createDataFrame(rows, "sqft int, year_built int, rs int, ry int").withColumns({
        "beds": F.lit(None).cast("double"), "baths": F.lit(2.0),
        "reg": F.struct(F.lit("F").alias("folio"), F.lit("a").alias("site_address"), F.lit("u").alias("unit"), F.col("rs").alias("sqft"),
                        F.col("ry").alias("year_built"), F.lit(3.0).alias("beds"), F.lit(3.0).alias("baths"),
                        F.lit("c").alias("use_code"), F.lit("s").alias("source"))})
    got = enrich.validate_against_register(df).collect()
    assert [(r["sqft"], r["year_built"], r["county_conflict"], r["beds"]) for r in got] == [
        (1180, 2016, True, 3.0), (1200, 2015, False, 3.0), (1450, 2018, False, 3.0), (1000, 2000, False, None)]


def test_resolution_needs_agreeing_bedrooms(spark):
    snap = spark.createDataFrame([("A", None, "b", "1", 2.0, START), ("B", "g", "b", "2", None, START)],
                                 "dedupe_key string, geo_hash string, building_hash string, unit string, beds double, first_seen_at timestamp")
    seen = spark.createDataFrame([("p", "id9", "A", START)], "source string, source_id string, dedupe_key string, first_seen_at timestamp")
    rows = [("n1", None, "b", "1", 2.0, "q", "x"), ("n2", None, "b", "1", 3.0, "q", "y"), ("n3", None, "b", "1", None, "q", "z"),
            ("n4", None, "b", "2", 5.0, "q", "v"), ("n5", "g", None, None, 1.0, "q", "w"), ("n6", None, None, None, None, "p", "id9"),
            ("A", "g", None, None, None, "q", "t")]
    inc = spark.createDataFrame(rows, "dedupe_key string, geo_hash string, building_hash string, unit string, beds double, source string, source_id string")
    got = {r[0]: (r[1], r[2]) for r in resolve.resolve_units(inc, snap, seen).select("dedupe_key", "resolved_key", "resolved_by").collect()}
    assert got == {"n1": ("A", 3), "n2": ("n2", None), "n3": ("A", 3), "n4": ("B", 3), "n5": ("B", 2), "n6": ("A", 4), "A": ("A", 1)}


def test_staleness_matrix(spark):
    def reason(*rows):
        df = spark.createDataFrame(list(rows), "source string, records bigint, ok boolean, skipped boolean")
        r = stats.staleness(df).first()
        return r["use_fallback"], r["reason"]

    assert reason(("a", 6, True, False)) == (False, "")
    assert reason(("a", 0, False, False)) == (True, "1/1 primary sources failed (a)")
    assert reason(("a", 1, True, False)) == (True, "only 1 candidates from primary APIs (expected at least 5)")
    assert reason(("a", 0, True, True)) == (True, "no primary source was configured")


BASE = dict(source="z", source_id="z1", url="https://z/1", address="421 Seagrape Blvd #806E, Bal Harbour, FL 33154", beds=3.0, baths=2.0,
            sqft=1400, year_built=2012, price=8400, latitude=25.8905, longitude=-80.1226, property_type="Condo",
            title="Corner home on the oceanfront", description="Let for 8-12 months. A doorman, valet, a lap pool and a sauna.",
            photos=["806.jpg"], amenities=[], fetched_at=START)


def sightings(spark, *overrides):
    rows = [tuple(({**BASE, **o}).get(f) for f in SIGHTING_FIELDS) + (i,) for i, o in enumerate(overrides)]
    return spark.createDataFrame(rows, SIGHTING_SCHEMA + ", ingest_seq bigint")


def test_two_passes_over_a_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    other = {"address": "421 Seagrape Blvd #1106E, Bal Harbour, FL 33154", "source_id": "z2"}
    first = run_pass(spark, store, sightings(spark, {}, other), START, 0, PassSettings())
    assert first.select("fetched", "deduped", "matched", "new_listings", "alerts_sent").first() == (2, 2, 2, 2, 2)
    assert run_pass(spark, store, sightings(spark, {}), START, 0) is None           # committed batches are not run again
    thin = {"source": "r", "source_id": "r9", "price": 7700, "sqft": None, "year_built": None, "photos": [], "description": None,
            "address": "421 Seagrape Boulevard APT 806-E, Bal Harbour, FL 33154-1107", "title": BASE["title"]}
    second = run_pass(spark, store, sightings(spark, thin), START + timedelta(days=4), 1, PassSettings())
    assert second.select("new_listings", "price_drops", "alerts_sent", "marked_inactive").first() == (0, 1, 1, 1)
    unit = store.state("units").where("unit = '806e'").first()
    assert (unit["sqft"], unit["year_built"], unit["photos"], unit["times_seen"], unit["price"]) == (1400, 2012, ["806.jpg"], 2, 7700)
    assert unit["description"] == BASE["description"]
    history = store.log("price_history").where("old_price is not null").collect()
    assert [(h["old_price"], h["new_price"], h["delta"]) for h in history] == [(8400, 7700, -700)]
    assert stats.multi_source_units(store.state("sightings")).count() == 1
    message = alert_payloads(store, 1).first()["events"][0]
    assert message["headline"].startswith("Price drop: 421 Seagrape Blvd #806E")
    assert message["subheadline"] == "$8,400 → $7,700 (−$700, −8.3%)"
    matches = stats.top_matches(store.state("units"), 10)
    from unitlens.functions.address import standardize_addresses
    write_export(standardize_addresses(matches), str(tmp_path / "m.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m.csv")).count() == 1
