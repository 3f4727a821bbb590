"""What keeps the cost of a row low: plans, not times."""

import pytest
from pyspark.sql import functions as F

from unitlens.functions import text as tx
from unitlens.functions import variant as vt
from unitlens.functions.keywords import tag_categories
from unitlens.operators import verdicts
from unitlens.plans import driver_views as v
from unitlens.plans import scan_checks
from unitlens.schema import conform


@pytest.fixture
def whole_plans(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    yield lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")


def _inside_filters(plan):
    """The texts of the arrays that higher-order filters run over."""
    for start in (i for i in range(len(plan)) if plan.startswith("filter(array(", i)):
        depth, end = 0, start
        while True:
            depth += {"(": 1, ")": -1}.get(plan[end], 0)
            end += 1
            if depth == 0 and plan[end - 1] == ")":
                break
        yield plan[start:end]


def test_messages_are_worked_out_before_the_missing_ones_are_dropped(spark, whole_plans):
    row = spark.createDataFrame([(1, "Penthouse boat")], "id int, property_type string")
    facts = conform(row).select("*", *[F.lit(None).cast(t).alias(n) for n, t in (
        ("search_text", "string"), ("lease_term", "struct<min_months:int,max_months:int>"), ("miles_from_ocean", "double"),
        ("has_prose", "boolean"))])
    plan = whole_plans(verdicts.evaluate(facts).select("failures", "warnings"))
    found = list(_inside_filters(plan))
    assert found
    assert not [f for f in found if "regexp_replace" in f or "format_number" in f]


def test_a_walk_holds_its_loop_once():
    assert vt.find_result_array_sql("doc").count("flatten(") == 1


@pytest.mark.parametrize("depth", [1, 5, 6, 7, 20, 21, 101, 300])
def test_a_list_is_found_at_any_depth(spark, depth):
    text = '{"a":' * depth + '[{"price": 1, "address": "x", "beds": 2}]' + "}" * depth
    row = spark.createDataFrame([(text,)], "t string").select(F.parse_json("t").alias("doc"))
    assert row.select(F.size(vt.find_result_array("doc"))).first()[0] == 1


def test_costly_rows_are_spread_over_the_cores(spark, tmp_path):
    orders = spark.range(1).selectExpr("id as o_orderkey", "id as o_custkey", "1000D as o_totalprice", "timestamp_ntz'2024-01-01 00:00:00' as o_orderdate")
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1).selectExpr("id as event_id", "'view' as event_type").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert v.order_units(spark, str(tmp_path)).rdd.getNumPartitions() == cores
    assert v.event_payloads(spark, str(tmp_path)).rdd.getNumPartitions() == cores


def test_phrases_are_found_as_by_their_patterns(spark):
    phrases = ("24-hour desk", "24/7 concierge", "pool", "door man", "ocean front", "oceanfront")
    texts = ["24 hour desk", "a 24hourdesk", "24 7 concierge", "whirlpool", "pools", "pool", "doorman", "door-man", "the ocean_front", "oceanfront pool", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("b", F.coalesce(tx.match_form(F.col("t")), F.lit("")))
    same = rows.select(*[(tx.has_phrase(F.col("b"), p) == F.col("b").rlike(tx.phrase_pattern(p))).alias(p) for p in phrases])
    assert all(all(r) for r in same.collect())
    found = tag_categories(rows, "t", {"x": phrases[:3], "none": ("absent",)}).select("amenity_matches").collect()
    assert [sorted(r[0]) for r in found][:6] == [["x"], ["x"], ["x"], [], [], ["x"]]


def test_parcel_lookup_derives_addresses_once(spark, sf_dir, whole_plans):
    assert "l_linenumber" not in whole_plans(scan_checks.verify_with_parcels(spark, sf_dir))
