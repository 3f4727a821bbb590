"""Sources by name."""

import pytest

from pyspark.sql import functions as F

from unitlens.sources import registry


@pytest.fixture
def numbers(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(100).select(F.col("id").alias("rent"), F.expr("concat(id, ' Quay')").alias("address"),
                            F.expr("cast(id as string)").alias("source_id"), F.col("id").cast("int").alias("price")).write.parquet(path)
    registry.register_source(registry.Source("numbers", lambda s, p: s.read.parquet(p), ranges={"price": "rent"}), replace=True)
    return path


def test_a_range_reaches_the_scan(spark, numbers):
    rows, outcomes = registry.read_source(spark, "numbers", numbers, {"price": (10, 20)})
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(rent,10)" in plan and "LessThanOrEqual(rent,20)" in plan
    assert rows.count() == 11 and outcomes.count() == 0
    assert rows.select("source").distinct().collect()[0][0] == "numbers"


def test_what_cannot_be_asked_is_told(spark, numbers):
    rows, outcomes = registry.read_source(spark, "numbers", numbers, {"price": (500, None), "beds": (1, None)})
    assert rows.count() == 100
    assert [tuple(r) for r in outcomes.collect()] == [
        ("numbers", None, "note", "range filters matched nothing; read unfiltered"),
        ("numbers", None, "note", "cannot be asked by range: beds")]
    open_range, none = registry.read_source(spark, "numbers", numbers, {"price": (None, None)})
    assert open_range.count() == 100 and none.count() == 0


def test_names(spark, numbers):
    assert "numbers" in registry.registered()
    with pytest.raises(ValueError):
        registry.register_source(registry.Source("numbers", lambda s, p: s.read.parquet(p)))
    with pytest.raises(ValueError):
        registry.read_source(spark, "unheard", numbers)
    with pytest.raises(ValueError):
        registry.read_sources(spark, {})
    both, _ = registry.read_sources(spark, {"numbers": numbers})
    assert both.count() == 100
