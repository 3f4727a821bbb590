"""An address line is parsed once in a pass; its parts go along with it and give what parsing it again would give."""

from datetime import datetime

from unitlens.functions import address as ad
from unitlens.operators import derive, merge
from unitlens.plans import run_pass

ADDRESSES = ["100 Collins Ave #3C, Surfside, FL 33154", "100 Collins Ave", "100 collins avenue apt 3c surfside FL", "", " ", None, "#4", "9 N 1st St W Unit PH",
             "9 North First Street, Bal Harbour, Florida", "12 Ocean Dr, , 33139", "FL 33154", "44 Via 5"]
SCHEMA = ("source string, source_id string, address string, unit string, city string, state string, zip_code string, latitude double, "
          "longitude double, fetched_at timestamp, ingest_seq bigint")


def _keyed(spark):
    rows = [(f"s{n % 2}", str(n % 13), a, unit, city, None, None, place, place, datetime(2024, 1, 1), n * 100 + i)
            for n, a in enumerate(ADDRESSES) for i, (unit, city, place) in enumerate(
                [(None, None, None), ("3c", None, 25.0), ("none", "surf side", 25.0), ("", "", None)])]
    return run_pass.keyed_batch(spark.createDataFrame(rows, SCHEMA), run_pass.PassSettings(prefilter=False))


def _same(got, want):
    columns = sorted(set(want.columns) - {"address_line"})
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_units_have_the_identities_that_their_lines_give_when_parsed_again(spark):
    keyed = _keyed(spark)
    units = run_pass.unit_batch(keyed)
    _same(units, derive.derive_identity(merge.merge_units(keyed.drop("address_line"))))
    resolved = run_pass.resolved_batch(units, None, None).withColumn("resolved_key", units.source)
    _same(run_pass.merged_batch(resolved), derive.derive_identity(merge.merge_units(resolved.drop("address_line"), "resolved_key")))


def test_a_merge_does_not_parse_lines_again(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        keyed = _keyed(spark)
        stored = spark.createDataFrame([], keyed.schema)  # as read back from the store
        plans = {n: df._jdf.queryExecution().optimizedPlan().toString() for n, df in (("keyed", keyed), ("units", run_pass.unit_batch(stored)))}
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert ad._MARKED_UNIT in plans["keyed"] and ad._MARKED_UNIT not in plans["units"]
