"""The register lookups against brute force, with a hot street, long words and repeated rows."""

import random

from pyspark.sql import functions as F

from unitlens.operators import enrich

FACTS = {"sqft": "900", "year_built": "2000", "beds": "cast(null as double)", "baths": "cast(null as double)",
         "use_code": "cast(null as string)", "source": "'r'"}
REGISTER = "street_key string, folio string, site_address string, unit string, reg_seq int"


def brute_match(unit, street, rows):
    """(folio, how) of one unit, from all rows of its street."""
    here = sorted((r for r in rows if r[0] == street), key=lambda r: r[4]) if street else []
    own = [r for r in here if unit and r[3] and r[3] == unit]
    held = [r for r in here if unit and unit in r[2].split(" ")[-1].lower()]
    for found, how in ((own, "unit"), (held, "address"), (here, "street")):
        if found:
            return found[0][1], how
    return None, None


def test_match_register_against_brute_force(spark):
    rng = random.Random(3)
    streets = ["1 a st"] * 6 + ["2 b st", "3 c st", "4 d st"]
    register = []
    for i in range(400):
        street, word = rng.choice(streets), "".join(rng.choices("12a", k=rng.choice((1, 2, 3, 60))))
        register.append((street, f"F{i}", f"{street.upper()} {word.upper()}", rng.choice([None, "".join(rng.choices("12a", k=2))]), i))
    register.append((None, "F-none", "9 NOWHERE", "1", 9_000))
    asked = [(i, rng.choice([*streets, "5 e st", None, ""]), rng.choice([None, "", *("".join(rng.choices("12a", k=k)) for k in (1, 2, 3, 7))]))
             for i in range(300)]
    table = spark.createDataFrame(register, REGISTER).withColumns({c: F.expr(e) for c, e in FACTS.items()})
    units = spark.createDataFrame(asked, "i int, street_key string, unit string")
    got = {r.i: (r.folio, r.reg_match) for r in enrich.match_register(units, table).select("i", "reg.folio", "reg_match").collect()}
    assert got == {i: brute_match(unit, street, register) for i, street, unit in asked}
    assert enrich.match_register(units, table.where("false")).where("reg is not null").count() == 0
    twice = enrich.match_register(units, table.unionByName(table))
    assert {r.i: (r.folio, r.reg_match) for r in twice.select("i", "reg.folio", "reg_match").collect()} == got and twice.count() == len(got)


def test_parcels_holding_a_street_line_against_brute_force(spark):
    rng = random.Random(4)
    numbers = ["1", "12", "112", "99999", "123456", "1234567", "91234567", "0"]
    words = ["OCEAN", "OC", "O", "OCE", "BAY"]
    addresses = [None, "", "12", " 12  OCEAN DR", "TOWER", "9" * 200 + " OCEAN"] + [
        " ".join(filter(None, [rng.choice(["", "TOWER", "X7"]), rng.choice(["", "A"]) + rng.choice(numbers), rng.choice(words),
                               rng.choice(["", "DR", "DRIVE", "AVE"])])) for _ in range(150)]
    lines = [None, "", "12"] + sorted({f"{n} {w.lower()}{s}" for n in numbers for w in words for s in ("", " dr", " drive")})
    parcels = spark.createDataFrame(list(enumerate(addresses)), "reg_seq int, site_address string")
    streets = spark.createDataFrame([(x,) for x in lines * 2], "street_key string")
    got = sorted((r.street_key, r.reg_seq) for r in enrich.street_candidates(streets, parcels).collect())
    assert got == sorted((x, i) for x in lines for i, a in enumerate(addresses) if x and " " in x and a and x.upper() in a)


def test_a_long_word_makes_few_keys(spark):
    parcels = spark.createDataFrame([(1, "1" * 200 + " " + "2" * 200)], "reg_seq int, site_address string")
    streets = spark.createDataFrame([("1 2",)], "street_key string")
    assert enrich.parcel_keys(parcels).count() <= 24
    assert enrich.street_candidates(streets, parcels).count() == 1
