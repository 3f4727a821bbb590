"""Registered queries against their SQL twins, on the smallest tables."""

import math

import pytest

import __spark_entry__ as contract

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = (
    "address_components", "resolve_priority", "lease_terms", "keyword_scan", "keyword_scan_documents", "category_matches", "parsed_specs",
    "geo_distance_band", "verdicts", "prefilter", "register_contains_join", "price_history", "price_history_strict", "price_drops",
    "running_life", "sighting_state", "snapshot_merge", "inactive_units", "cooldown_suppress", "cooldown_as_of", "also_listed_on",
    "store_stats", "source_coverage", "source_coverage_sample", "coverage_gaps", "source_staleness", "health_json", "detail_budget",
    "first_per_source", "discover_arrays", "scattered_text", "truncation_notes", "source_health", "feed_titles", "stream_changes",
    "scan_search_pages", "scan_structured_feed", "scan_feed", "scan_card_pages", "scan_canonical", "mapped_with_casts",
    "scan_register_folios", "scan_register_parcels", "scan_property_records", "scan_valuations", "fallback_union",
    "configured_health", "union_sightings", "ranged_scan", "pass_units", "pass_sightings", "pass_history", "pass_events",
    "pass_alerts", "pass_runs", "page_text", "stream_sends", "stream_redelivered", "verify_with_parcels",
    "explained_messages", "display_lines", "valuation_requests", "register_validate", "registered_source", "page_outcomes", "outcome_health",
)


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return tuple(plain(x) for x in value) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_its_sql(spark, con, sf_dir, name):
    df = contract.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    answer = con.execute(contract.oracle_sql()[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in answer.fetchall())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
