from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from unitlens.criteria import BuildingCriteria, CriteriaError, SearchCriteria
from unitlens.operators import derive, merge, verdicts
from unitlens.schema import SIGHTING_FIELDS, SIGHTING_SCHEMA

BASE = dict(
    source="hand", source_id="h806", url="https://listings.invalid/806",
    address="421 Seagrape Blvd #806E, Bal Harbour, FL 33154", beds=3.0, baths=2.0, sqft=1400, year_built=2012,
    price=8400, latitude=25.8905, longitude=-80.1226, property_type="Condo", title="Corner home on the oceanfront",
    description="Let for 8-12 months. A doorman, valet, a lap pool and a sauna.",
    photos=["https://listings.invalid/806.jpg"], amenities=[],
)


def sightings(spark, *overrides):
    rows = [tuple(({**BASE, **o}).get(f) for f in SIGHTING_FIELDS) + (i,) for i, o in enumerate(overrides)]
    return spark.createDataFrame(rows, SIGHTING_SCHEMA + ", ingest_seq bigint")


def judged(spark, *overrides, criteria=None):
    df = derive.derive(sightings(spark, *overrides))
    return verdicts.evaluate(df, criteria).orderBy("ingest_seq").collect()


GOOD = "The house has a gym, a doorman, a pool and valet."
TABLE = [
    # overrides, passed, start of the failure (or part of a warning)
    ({}, True, None),
    ({"price": 4999}, False, "price: $4,999 below $5,000 floor"), ({"price": 12001}, False, "price: $12,001 above $12,000 ceiling"),
    ({"price": 5000}, True, None), ({"price": 12000}, True, None), ({"price": None}, False, "price: no rent published"),
    ({"beds": 1.0}, False, "size: 1 beds < 2 required"), ({"baths": 1.5}, False, "size: 1.5 baths < 2 required"),
    ({"sqft": 1199}, False, "size: 1,199 sqft < 1,200 required"), ({"sqft": None}, True, "size: square footage unverified"),
    ({"address": "75 Mangrove Rd #2203, Miami Beach, FL 33139", "latitude": 25.7900, "longitude": -80.1450},
     False, "location: 1."),
    ({"address": "615 SW Cedar St #5, Miami, FL 33130", "city": "Miami", "latitude": 25.77, "longitude": -80.2},
     False, "location: city 'Miami' is not a monitored municipality"),
    ({"latitude": 25.77, "longitude": -80.2}, False, "location: coordinates fall outside"),
    ({"address": "9 Dogwood Ct #2, Aventura, GA 33180", "state": "GA"}, False, "location: state GA is outside FL"),
    ({"address": "12 Coral Way #31, Miami, FL 33140", "city": "Miami", "latitude": 25.8385, "longitude": -80.1205},
     True, "location: city 'Miami' not whitelisted but ZIP 33140 is"),
    ({"latitude": None, "longitude": None}, True, "location: ocean distance unverified"),
    ({"description": f"A seasonal let. {GOOD}"}, False, "lease_terms: excluded keyword(s) seasonal"),
    ({"description": f"Stay short term if you like. {GOOD}"}, False, "lease_terms: excluded keyword(s) short term, short-term"),
    ({"description": f"Guests of Airbnb come here. {GOOD}"}, False, "lease_terms: excluded keyword(s) air bnb, airbnb"),
    ({"description": f"Paid weekly, or daily. {GOOD}"}, False, "lease_terms: excluded keyword(s) daily, weekly"),
    ({"description": f"We ask for a 24 month minimum. {GOOD}"}, False, "lease_terms: requires at least 24 months"),
    ({"description": f"To let for up to 3 months. {GOOD}"}, False, "lease_terms: caps out at 3 months"),
    ({"description": f"To let for up to 18 months. {GOOD}"}, True, "lease_terms: advertised up to 18 months"),
    ({"description": f"No short term stays; an annual lease is asked for. {GOOD}"}, True,
     "lease_terms: 'short term' present but negated"),
    ({"description": GOOD}, True, "lease_terms: not stated"),
    ({"description": f"Our annual offer. {GOOD}"}, True, "lease_terms: term inferred from 'annual'"),
    ({"property_type": "Single Family"}, False, "property_type: 'Single Family' is not a condo"),
    ({"property_type": "TOWNHOUSE"}, False, "property_type: 'TOWNHOUSE' is not a condo"),
    ({"property_type": "Boat"}, False, "property_type: 'Boat' is not an accepted type"),
    ({"property_type": "CONDOMINIUM"}, True, None), ({"property_type": "Apartment"}, True, None),
    ({"property_type": None}, True, "property_type: not stated"),
    ({"property_type": None, "title": "A condo on the oceanfront"}, True, "property_type: inferred"),
    ({"description": "Annual lease and one garage space."}, False, "building: only 1 luxury"),
    ({"year_built": 1972}, False, "building: built 1972 < 2005 and no renovation stated"),
    ({"year_built": 1972, "description": f"Renovated throughout, annual lease. {GOOD}"},
     True, "building: built 1972 but described as renovated"),
    ({"title": "Home above the park", "description": f"Annual lease, looks west over the park. {GOOD}"},
     False, "building: missing required amenity/amenities ocean view"),
    ({"title": None, "description": None, "amenities": []}, True, "building: source published no description -- ocean view unverified"),
]


def test_constraints(spark):
    got = judged(spark, *[o for o, _, _ in TABLE])
    for (overrides, passed, text), row in zip(TABLE, got):
        assert row["passed"] == passed, (overrides, row["reason"])
        if text:
            messages = row["failures"] if not passed else row["warnings"]
            assert any(m.startswith(text) for m in messages), (overrides, messages)


@pytest.mark.parametrize("change,override,text", [
    (dict(require_known_sqft=True), {"sqft": None}, "size: square footage unknown"),
    (dict(require_coordinates=True), {"latitude": None}, "location: no coordinates"),
    (dict(require_explicit_lease_term=True), {"description": GOOD}, "lease_terms: no lease term"),
    (dict(building=BuildingCriteria(require_amenity_evidence=True)), {"title": None, "description": None}, "building: missing"),
])
def test_strict_switches(spark, change, override, text):
    row = judged(spark, override, criteria=replace(SearchCriteria(), **change))[0]
    assert not row["passed"] and any(f.startswith(text) for f in row["failures"])


def test_ocean_vocabulary(spark):
    phrases = ["ocean view", "ocean views", "oceanfront", "direct ocean access", "sea views", "panoramic ocean vistas",
               "unobstructed ocean", "beach view", "ocean facing"]
    rows = judged(spark, *[{"description": f"Annual lease; {p} from each room. {GOOD}"} for p in phrases])
    assert all(r["passed"] and "ocean_view" in r["amenity_matches"] for r in rows)


def test_scores(spark):
    near, far, cheap, dear, failing = judged(
        spark, {"latitude": 25.8385, "longitude": -80.1202}, {"latitude": 25.8385, "longitude": -80.1270},
        {"price": 5500}, {"price": 11800}, {"price": 1})
    assert near["score"] > far["score"] and cheap["score"] > dear["score"] and failing["score"] == 0.0


def test_prefilter_is_lenient(spark):
    df = derive.derive(sightings(spark, {}, {"price": None, "beds": None, "sqft": None, "latitude": None}, {"beds": 1.0},
                                 {"price": 20000}, {"latitude": 25.77, "longitude": -80.2}))
    kept = [r[0] for r in df.where(verdicts.passes_prefilter(SearchCriteria())).select("ingest_seq").collect()]
    assert sorted(kept) == [0, 1]


def test_explanations_are_long(spark):
    df = verdicts.evaluate(derive.derive(sightings(spark, {"price": 1, "beds": 1.0})))
    got = verdicts.explain_verdicts(df, "ingest_seq").where("kind = 'failure'").orderBy("pos").collect()
    assert [r["message"].split(":")[0] for r in got] == ["size", "price"]


def test_criteria_are_checked():
    with pytest.raises(CriteriaError):
        SearchCriteria(min_price=2, max_price=1)
    with pytest.raises(CriteriaError):
        SearchCriteria(building=BuildingCriteria(required_amenities=("moat",)))


def test_derived_values(spark):
    r = judged(spark, {})[0]
    assert (r["city"], r["zip_code"], r["unit"], r["lease_min_months"]) == ("Bal Harbour", "33154", "806e", 8)
    df = derive.derive(sightings(spark, {}))
    a, b = df.select(derive.price_per_sqft(), derive.summary_line()).first()
    assert a == 6.0
    assert b == "421 Seagrape Blvd #806E, Bal Harbour, FL 33154 | $8,400/mo | 3bd/2ba | 1,400 sqft | 8-12 months"


def test_prose_flag(spark):
    rows = judged(spark, {"title": None, "description": None}, {"description": None},
                  {"title": None, "description": "A home for a year, above the sea, with a sauna"},
                  {"title": "Three rooms over the beach at Surfside, with a doorman", "description": None})
    assert [r["has_prose"] for r in rows] == [False, False, True, True]


@pytest.mark.parametrize("parts", [1, 8])
def test_merge_fills_and_unions(spark, parts):
    df = sightings(
        spark,
        {"source": "z", "sqft": 1400, "year_built": None, "photos": ["a", "b"], "amenities": ["Pool"], "broker": None},
        {"source": "r", "address": "421 Seagrape Boulevard APT 806-E, Bal Harbour, FL 33154-1107", "sqft": None, "beds": 9.0,
         "price": 8150, "photos": ["b", "c"], "amenities": ["pool", "Spa"], "broker": "B"},
        {"source": "q", "address": "1 Other St, Surfside, FL", "price": None, "photos": None, "amenities": None},
    ).repartition(parts)
    keyed = derive.derive_identity(df)
    rows = merge.merge_units(keyed).orderBy("ingest_seq").collect()
    assert len(rows) == 2
    u = rows[0]
    assert (u["source"], u["sqft"], u["year_built"], u["price"], u["beds"], u["broker"]) == ("z", 1400, 2012, 8150, 3.0, "B")
    assert u["photos"] == ["a", "b", "c"] and u["amenities"] == ["Pool", "Spa"]
    assert u["sources"] == ["r", "z"] and u["n_sightings"] == 2 and rows[1]["photos"] is None
    assert merge.contributing_sightings(keyed).select("source").collect()[0][0] == "r"
    assert merge.dedupe_within_source(keyed).count() == 3
