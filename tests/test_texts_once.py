"""Verdicts over texts that repeat: each different set of texts is read once, rows come out as if each were read."""

import pytest
from pyspark.sql import functions as F

from unitlens.functions import text as tx
from unitlens.operators import derive, verdicts
from unitlens.plans import checks
from unitlens.schema import SIGHTING_SCHEMA, conform

TEXTS = [
    (None, None, None, None, None),
    ("Flat", "Annual lease, 6-12 months. Pool, valet and spa.", ["Gym", None], "Active", "Condo"),
    ("Flat", "No short term rentals. Twelve month lease.", [], "", "Townhouse"),
    ("Flat", None, ["Gym"], None, "Boat"),
    ("", "<b>seasonal</b> rental", None, "x", None),
]


@pytest.fixture
def rows(spark):
    names = ("title", "description", "amenities", "status", "property_type")
    given = [dict(zip(names, t)) | {"price": 5000 + i, "address": f"{100 + i} Collins Ave #{i}, Surfside, FL 33154", "source": "s",
                                    "source_id": str(i % 7)} for i, t in enumerate(TEXTS * 6)]
    kinds = SIGHTING_SCHEMA.split(", ")
    return conform(spark.createDataFrame([tuple(g.get(k.split()[0]) for k in kinds) for g in given], SIGHTING_SCHEMA))


def test_verdicts_are_those_of_every_row(rows):
    names = ("source_id", "price", "passed", "failures", "warnings", "score", "reason", "lease_term", "has_prose", "search_text",
             F.map_entries("amenity_matches").alias("m"), "keyword_scan")
    one, each = verdicts.judge(rows), verdicts.evaluate(derive.derive(rows))
    assert set(one.columns) == set(each.columns)
    found, wanted = ([tuple(r) for r in df.select(*names).orderBy("price").collect()] for df in (one, each))
    assert found == wanted and len(found) == 6 * len(TEXTS)


def test_values_are_derived_once(spark, rows):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(title):
        seen.add(1)
        return f"<{title}>"

    out = tx.once_per_value(rows.localCheckpoint(), ("title", "amenities"), lambda t: t.withColumn("told", told("title")))
    got = out.select("title", "told").collect()
    assert len(got) == 6 * len(TEXTS) and all(r.told == f"<{r.title}>" for r in got)
    assert seen.value == len({(t[0] or None, tuple(t[2]) if t[2] is not None else None) for t in TEXTS})


def test_rows_with_one_text_are_not_moved_to_one_task(spark, sf_dir):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    execution = checks._judged(spark, sf_dir)._jdf.queryExecution()
    plan, joins = execution.optimizedPlan().toString(), execution.executedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "__lease_blob" not in plan
    assert "BroadcastHashJoin" in joins and "hashpartitioning" not in joins
