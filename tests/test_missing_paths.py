"""Paths that a record lacks."""

from pyspark.sql import functions as F

from unitlens.functions import variant as vt


def test_a_path_that_a_record_lacks_is_not_looked_at_further(spark):
    assert "v is null or schema_of_variant(v)" in vt.scalar_text("doc", "a")
    row = spark.createDataFrame([('{"a": null, "b": {}, "c": " x ", "d": "", "e": 5, "f": true}',)], "t string").select(F.parse_json("t").alias("doc"))
    found = row.select(*[F.expr(vt.scalar_text("doc", p)).alias(p) for p in "abcdefg"]).first()
    assert tuple(found) == (None, None, "x", None, "5", "true", None)
    number = [vt.first_parsed("doc", paths, lambda t: F.length(t).cast("double"), lambda n: n + 1).alias(f"n{i}") for i, paths in enumerate(
        [("g",), ("g", "e"), ("a", "c"), ("b",)])]
    assert tuple(row.select(*number).first()) == (None, 6.0, 3.0, None)
