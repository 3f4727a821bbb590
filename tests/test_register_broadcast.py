"""No side of a register or parcel lookup that grows with the register is sent whole to every executor."""

from pyspark.sql import functions as F

from unitlens.operators import enrich

FACTS = ("cast(null as string) unit", "cast(900 as int) sqft", "cast(1999 as int) year_built", "cast(null as double) beds",
         "cast(null as double) baths", "cast(null as string) use_code", "'p' source")


def _joins(df):
    return [line for line in df._jdf.queryExecution().executedPlan().treeString().splitlines() if "Join" in line or "CartesianProduct" in line]


def test_exploded_parcels_are_not_broadcast(spark):
    parcels = spark.range(1000).selectExpr("concat('P', id) folio", "concat(id, ' OCEAN DRIVE ', id % 7) site_address", "id reg_seq", *FACTS)
    streets = spark.range(40).select(F.concat("id", F.lit(" Ocean Dr")).alias("street_key"))
    found = enrich.street_candidates(streets, parcels)
    assert all("Broadcast" not in j for j in _joins(found)) and _joins(found)
    assert found.count() == sum(f"{n} OCEAN DR" in f"{i} OCEAN DRIVE" for n in range(40) for i in range(1000))


def test_rows_of_the_register_are_not_broadcast(spark):
    register = spark.range(300).selectExpr(
        "concat('F', id) folio", "concat(id % 3, ' Palm Way ', id, 'B') site_address", "id reg_seq", "concat(id % 3, ' palm way') street_key", *FACTS)
    units = spark.range(6).selectExpr("id n", "concat(id % 3, ' palm way') street_key", "concat(id * 3, 'b') unit")
    matched = enrich.match_register(units, register)
    reading = [j for j in _joins(matched) if "reg_seq" in j or "Inner" in j]
    assert reading and all("Broadcast" not in j for j in reading)
    got = {r.n: (r.reg.folio, r.reg_match) for r in matched.collect()}
    assert got[0] == ("F0", "address") and got[5] == ("F215", "address") and got[3] == ("F9", "address")
