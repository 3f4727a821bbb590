"""The registered queries: every operator over whole driver tables."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitlens.criteria import AlertCriteria, SearchCriteria
from unitlens.functions import geo
from unitlens.functions import text as tx
from unitlens.functions import variant as vt
from unitlens.functions.keywords import scan_keywords, tag_categories
from unitlens.functions.lease import extract_lease_terms
from unitlens import fixed_values as fv
from unitlens.operators import alerts, derive, enrich, merge, resolve, state, stats, verdicts
from unitlens.operators.sinks import Store, export_rows, shared_folder, written
from unitlens.plans import driver_views as v
from unitlens.plans.run_pass import PassSettings, run_pass
from unitlens.sources import field_maps as fm
from unitlens.sources import landed, mapping
from unitlens.streaming import changes
from unitlens.schema import conform

def _unit_no():
    return (F.col("address_parts.number").cast("bigint") - 100).alias("unit_no")


def _identified(spark, d) -> DataFrame:
    return derive.derive_identity(conform(v.sightings(spark, d)))


# --- identity and merge ------------------------------------------------------------------------------------

def best_units(spark: SparkSession, d: str) -> DataFrame:
    """Parse, resolve, judge by size, price and place, rank: the flagship."""
    units = merge.merge_units(_identified(spark, d), order_by=v.LINE_ORDER, lists=False)
    units = units.withColumn("amenities", F.array().cast("array<string>"))
    judged = verdicts.evaluate(derive.derive(units), SearchCriteria(min_price=500, max_price=2500))
    ranked = judged.withColumns({"matched": F.col("passed"), "is_active": F.lit(True), "match_score": F.col("score"),
                                 "last_seen_at": F.col("n_sightings")})
    return stats.top_matches(ranked, 50).select(_unit_no(), "unit", "city", "price", "n_sightings", "score", "reason")


def resolve_units(spark, d):
    units = merge.merge_units(_identified(spark, d), order_by=v.LINE_ORDER, lists=False)
    units = derive.derive_identity(units)
    return units.select(_unit_no(), "unit", "city", "zip_code", "price", "n_sightings", F.size("sources").alias("n_sources"))


def address_components(spark, d):
    p = [F.col(f"address_parts.{n}").alias(n) for n in ("number", "street", "suffix", "unit", "city", "state", "zip5")]
    return _identified(spark, d).groupBy(*p).agg(F.count("*").alias("n"))


def multi_source_units(spark, d):
    return stats.multi_source_units(_identified(spark, d).withColumn("unit_no", _unit_no()), "unit_no")


def first_wins_merge(spark, d):
    # written without what the merge does not read: a column that is written is worked out
    stated = ("source", "source_id", "url", "broker", "status", "beds", "baths", "sqft", "year_built", "days_on_market", "latitude",
              "price", "photos", "amenities")
    rows = written(_identified(spark, d).select(_unit_no(), *stated, *v.LINE_ORDER), "identified")
    units = merge.merge_units(rows, "unit_no", v.LINE_ORDER)
    return units.select(
        "unit_no", "source", "source_id", "url", "broker", "status", "beds", "baths", "sqft", "year_built",
        "days_on_market", "latitude", "price", F.array_join("photos", ",").alias("photos"),
        F.array_join("amenities", ",").alias("amenities"), F.array_join("sources", ",").alias("sources"))


def contributing_sightings(spark, d):
    keyed = written(_identified(spark, d).select(_unit_no(), "source", "source_id", "url", *v.LINE_ORDER), "identified")
    rows = merge.contributing_sightings(keyed, "unit_no", v.LINE_ORDER)
    return rows.groupBy("unit_no", "source").agg(F.count("*").alias("n"))


def dedupe_within_source(spark, d):
    rows = merge.dedupe_within_source(_identified(spark, d), v.LINE_ORDER)
    return derive.derive_identity(rows).select(_unit_no(), "source", "price")


def resolve_priority(spark, d):
    start = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    snapshot = v.table(spark, d, "part").select(
        F.expr("concat('K', p_partkey)").alias("dedupe_key"),
        F.expr("if(p_partkey % 3 = 0, concat('G', p_partkey div 3), null)").alias("geo_hash"),
        F.expr("concat('B', p_partkey div 10)").alias("building_hash"), F.expr("cast(p_partkey % 7 as string)").alias("unit"),
        F.expr("if(p_partkey % 4 = 0, null, cast(p_size % 3 as double))").alias("beds"),
        (start + F.expr("make_dt_interval(0, cast(p_partkey % 50 as int))")).alias("first_seen_at"))
    sightings = v.table(spark, d, "supplier").select(
        F.lit("portal").alias("source"), F.expr("concat('S', s_suppkey)").alias("source_id"),
        F.expr("concat('K', s_suppkey)").alias("dedupe_key"), start.alias("first_seen_at"))
    incoming = v.table(spark, d, "orders").select(
        F.expr("if(o_orderkey % 5 = 0, concat('K', o_orderkey), concat('N', o_orderkey))").alias("dedupe_key"),
        F.expr("if(o_orderkey % 3 = 1, concat('G', o_orderkey % 900), null)").alias("geo_hash"),
        F.expr("if(o_orderkey % 2 = 0, concat('B', o_orderkey % 300), null)").alias("building_hash"),
        F.expr("cast(o_orderkey % 7 as string)").alias("unit"),
        F.expr("if(o_orderkey % 6 = 0, null, cast(o_orderkey % 3 as double))").alias("beds"), F.lit("portal").alias("source"),
        F.expr("if(o_orderkey % 4 = 1, concat('S', o_orderkey % 150), concat('T', o_orderkey))").alias("source_id"))
    return resolve.resolve_units(incoming, snapshot, sightings).select("dedupe_key", "resolved_key", "resolved_by")


# --- text, numbers, distance -------------------------------------------------------------------------------

def _lease(df: DataFrame, key: str) -> DataFrame:
    return extract_lease_terms(df, "note").select(
        key, "lease_term.min_months", "lease_term.max_months",
        F.split_part(F.get("lease_term.evidence", 0), F.lit(":"), F.lit(1)).alias("evidence"))


def lease_terms(spark, d):
    return _lease(v.order_notes(spark, d), "o_orderkey")


def lease_terms_documents(spark, d):
    return _lease(tx.fold_unicode(v.document_notes(spark, d), "note"), "doc_id")


def _scan(df: DataFrame, key: str) -> DataFrame:
    return scan_keywords(df, "note", fv.DEFAULT_EXCLUDED_KEYWORDS).select(
        key, F.array_join("keyword_scan.hits", "|").alias("hits"), F.array_join("keyword_scan.negated", "|").alias("negated"))


def keyword_scan(spark, d):
    return _scan(v.order_notes(spark, d), "o_orderkey")


def keyword_scan_documents(spark, d):
    return _scan(tx.fold_unicode(v.document_notes(spark, d), "note"), "doc_id")


def _categories(df: DataFrame, key: str) -> DataFrame:
    tagged = tag_categories(df, "note", fv.DEFAULT_AMENITIES)
    shown = F.transform(F.map_entries("amenity_matches"), lambda e: F.concat_ws("=", e["key"], F.array_join(e["value"], "|")))
    return tagged.select(key, F.array_join(F.array_sort(shown), ";").alias("categories"))


def category_matches(spark, d):
    return _categories(v.order_notes(spark, d), "o_orderkey")


def category_matches_documents(spark, d):
    return _categories(tx.fold_unicode(v.document_notes(spark, d), "note"), "doc_id")


def page_text(spark, d):
    pages = tx.fold_unicode(v.table(spark, d, "pages"), "html")
    return pages.select("page_id", tx.match_form(F.col("html")).alias("text"))


def parsed_specs(spark, d):
    k = "o_orderkey"
    raw = v.table(spark, d, "orders").select(
        k, v.one_of(k, "concat('$', format_number(1000 + o_orderkey, 0), '/mo')", "cast(1000 + o_orderkey as string)", "'call us'").alias("p"),
        v.one_of(k, "'Studio'", "concat(1 + o_orderkey % 5, ' Beds')", "'three bedroom'", "'2+Den'", "'none'").alias("b"),
        v.one_of(k, "concat(1 + o_orderkey % 3, '.5 Baths')", "'2 full 1 half'", "'n/a'").alias("t"),
        F.expr(f"concat(format_number(150 + {k} % 2000, 0), ' sq ft')").alias("s"),
        F.expr(f"concat('Built in ', 1790 + {k} % 300)").alias("y"))
    return tx.standardize_specs(raw, {"price": "p", "beds": "b", "baths": "t", "sqft": "s", "year_built": "y"}).drop("p", "b", "t", "s", "y")


def geo_distance_band(spark, d):
    points = v.table(spark, d, "events").select(
        "event_id", F.expr("case when event_id % 97 = 0 then null when event_id % 89 = 0 then 0.0D "
                           "else 25.75D + (event_id % 2300) * 0.0001D end").alias("latitude"),
        F.expr("if(event_id % 89 = 0, 0.0D, -80.17D + (user_id % 70) * 0.001D)").alias("longitude"))
    return geo.measure_distance(points).select("event_id", F.floor(F.col("miles") * 100).alias("band"), "is_near", "within_box")


# --- constraints -------------------------------------------------------------------------------------------

def _judged(spark, d) -> DataFrame:
    return verdicts.judge(conform(v.order_units(spark, d)))


def verdict_rows(spark, d):
    return _judged(spark, d).select("unit_no", "passed", "reason", "score")


def explained_verdicts(spark, d):
    return verdicts.explain_verdicts(_judged(spark, d), "unit_no").where("kind = 'failure'").select("unit_no", "pos", "message")


def explained_messages(spark, d):
    """Failures and warnings of every unit, passed or not."""
    return verdicts.explain_verdicts(_judged(spark, d), "unit_no")


def display_lines(spark, d):
    units = derive.derive(conform(v.order_units(spark, d)))
    return units.select("unit_no", derive.summary_line().alias("summary"), geo.describe_distance(F.col("miles_from_ocean")).alias("distance"))


def rejection_histogram(spark, d):
    return stats.rejection_histogram(_judged(spark, d))


def top_rejections(spark, d):
    return stats.top_rejections(_judged(spark, d))


def pass_totals(spark, d):
    return stats.pass_totals(_judged(spark, d))


def prefilter(spark, d):
    rows = v.sightings(spark, d).withColumn("miles_from_ocean", F.expr("(l_partkey % 120) / 100.0D"))
    kept = rows.where(verdicts.passes_prefilter(SearchCriteria(min_price=1000, max_price=3000, min_sqft=1000)))
    return kept.groupBy("l_partkey").agg(F.count("*").alias("n"))


def _stored(spark, d) -> DataFrame:
    return _judged(spark, d).withColumns({
        "matched": F.col("passed"), "is_active": F.expr("unit_no % 10 <> 0"), "match_score": F.col("score"),
        "last_seen_at": F.col("fetched_at")})


def top_matches(spark, d):
    return stats.top_matches(_stored(spark, d), 100, tie=("unit_no",)).select("unit_no", "score")


def export_matches(spark, d):
    best = stats.top_matches(_stored(spark, d), 100, tie=("unit_no",))
    return export_rows(best).drop("miles_from_ocean")


# --- register and models -----------------------------------------------------------------------------------

def _verified(spark, d) -> DataFrame:
    rows = _identified(spark, d).select("source", "source_id", "url", "address_parts", "unit", "sqft", "year_built", "beds", "baths")
    return enrich.verify_units(written(rows, "identified"), v.register(spark, d))


def register_validate(spark, d):
    return _verified(spark, d).select(
        _unit_no(), "source_id", "sqft", "year_built", "beds", "baths", "county_folio", "county_conflict", "reg_match")


def register_contains_join(spark, d):
    streets = v.table(spark, d, "lineitem").select(
        F.expr("concat(l_suppkey % 40, if(l_linenumber % 2 = 0, ' ocean dr', ' oce'))").alias("street_key"))
    return enrich.street_candidates(streets, v.parcels(spark, d)).select("street_key", "folio")


def _priced(spark, d) -> DataFrame:
    units = v.table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", F.expr("concat(100 + o_custkey, ' Main St #7, Surfside, FL 33154')").alias("address"),
        F.expr("if(o_orderkey % 11 = 0, null, cast(floor(o_totalprice / 100) as int))").alias("price"))
    return enrich.price_against_models(derive.derive_identity(conform(units)), v.valuations(spark, d))


def valuation_verdict(spark, d):
    return _priced(spark, d).select(
        "o_orderkey", "rent_estimate", "rent_estimate_low", "rent_estimate_high", "rent_estimate_source", "value_estimate", "value_estimate_source",
        "price_to_estimate_ratio", "price_verdict", "gross_yield_pct")


def valuation_requests(spark, d):
    units = v.table(spark, d, "orders").select(
        F.expr("concat(100 + o_custkey, ' Main St #7, Surfside, FL 33154')").alias("address"), F.col("o_orderkey").alias("ingest_seq"),
        v.one_of("o_orderkey", "' CO-OP '", "'Condominium'", "'Boat'", "null", "'townhouse'").alias("property_type"),
        F.expr("if(o_orderkey % 3 = 0, null, cast(o_orderkey % 4 as double))").alias("beds"), F.expr("cast(1 as double)").alias("baths"),
        F.expr("if(o_orderkey % 2 = 0, null, cast(600 + o_orderkey % 900 as int))").alias("sqft"))
    return enrich.valuation_requests(derive.derive_identity(conform(units)))


def enrichment_counters(spark, d):
    return enrich.enrichment_counters(_verified(spark, d).withColumn("enrichment_attempted", F.lit(True)))


# --- state -------------------------------------------------------------------------------------------------

def price_history(spark, d):
    rows = state.price_history(v.event_sightings(spark, d))
    return rows.select("unit_key", "event_id", "old_price", "price", "change", "delta")


def price_history_strict(spark, d):
    rows = state.price_history(v.event_sightings(spark, d), strict=True)
    return rows.select("unit_key", "event_id", "old_price", "price", "change")


def price_drops(spark, d):
    rows = state.price_changes(v.event_sightings(spark, d))
    return rows.where(alerts.is_material_drop(AlertCriteria(), "old_price", "price")).select("unit_key", "event_id", "old_price", "price")


def running_life(spark, d):
    return state.running_life(v.event_sightings(spark, d)).select("unit_key", "event_id", "first_seen_at", "last_seen_at", "times_seen")


def sighting_state(spark, d):
    rows = v.event_sightings(spark, d).select(
        F.concat_ws(":", "source", "unit_key").alias("source_key"), F.concat(F.lit("U"), "unit_key").alias("dedupe_key"), "source",
        F.col("unit_key").cast("string").alias("source_id"), "price",
        F.expr("if(event_id % 5 = 0, '', concat('u', event_id))").alias("url"),
        F.col("ts").alias("first_seen_at"), F.col("ts").alias("last_seen_at"))
    return state.fold_sightings(rows)


_HALF = "timestamp_ntz'2024-01-15 00:00:00'"


def snapshot_merge(spark, d):
    rows = v.event_sightings(spark, d)
    key = F.expr("concat('U', unit_key)").alias("dedupe_key")
    old = rows.where(f"ts < {_HALF} and unit_key % 4 <> 0").groupBy(key).agg(
        F.min("price").alias("price"), F.max(F.expr("if(unit_key % 2 = 0, 'old title', '')")).alias("title"),
        F.max(F.expr("cast(400 + unit_key as int)")).alias("sqft"), F.max(F.lit("S1")).alias("status"),
        F.array(F.lit("p1")).alias("photos"), F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"),
        F.count("*").cast("int").alias("times_seen"), F.expr("max(unit_key) % 3 = 0").alias("is_active"))
    new = rows.where(f"ts >= {_HALF} and unit_key % 5 <> 0").groupBy(key).agg(
        F.max("price").alias("price"), F.max(F.expr("if(unit_key % 3 = 0, '', 'new title')")).alias("title"),
        F.max(F.expr("if(unit_key % 2 = 0, null, cast(500 + unit_key as int))")).alias("sqft"),
        F.max(F.expr("if(unit_key % 2 = 0, null, 'S2')")).alias("status"),
        F.expr("if(max(unit_key) % 3 = 1, array(), array('p2'))").cast("array<string>").alias("photos"))
    merged = state.upsert_units(new.withColumn("resolved_key", F.col("dedupe_key")), old, F.expr(_HALF))
    return merged.select(
        "dedupe_key", "price", "title", "sqft", "status", F.array_join("photos", ",").alias("photos"), "times_seen", "is_active",
        "seen", "is_new", "old_price", "new_price", "delta", "price_drop", "price_increase", "last_seen_at")


_RUN = "timestamp_ntz'2024-01-31 00:00:00'"


def inactive_units(spark, d):
    units = v.event_sightings(spark, d).groupBy("unit_key").agg(F.max("ts").alias("last_seen_at")).withColumn("is_active", F.expr("unit_key % 7 <> 0"))
    return state.expire_units(units, F.expr(_RUN), hours=8).select("unit_key", "is_active", "expired")


# --- alerts ------------------------------------------------------------------------------------------------

def _alert_log(spark, d) -> DataFrame:
    return v.table(spark, d, "events").where("event_id % 2 = 1").select(
        F.col("user_id").alias("dedupe_key"), F.expr("if(event_id % 3 = 0, 'new', 'price_drop')").alias("kind"),
        F.col("ts").alias("sent_at"), F.expr("event_id % 5 <> 0").alias("ok"))


def cooldown_suppress(spark, d):
    units = v.table(spark, d, "events").select(F.col("user_id").alias("dedupe_key")).distinct()
    events = units.withColumn("kind", F.explode(F.array(F.lit("new"), F.lit("price_drop"))))
    return alerts.suppress_recent(events, _alert_log(spark, d), F.expr("timestamp_ntz'2024-01-31 00:00:00'"), 24)


def cooldown_as_of(spark, d):
    events = v.table(spark, d, "events").where("event_id % 2 = 0").select(
        "event_id", F.col("user_id").alias("dedupe_key"), F.expr("if(event_id % 3 = 0, 'new', 'price_drop')").alias("kind"), "ts")
    return alerts.suppress_recent_as_of(events, _alert_log(spark, d), 24).select("event_id", "dedupe_key", "kind")


def also_listed_on(spark, d):
    sightings = v.event_sightings(spark, d).select(F.col("unit_key").alias("dedupe_key"), "source")
    events = sightings.distinct()
    return alerts.other_sources(events, sightings).select("dedupe_key", "source", F.array_join("extra_sources", ",").alias("extra_sources"))


def _events(spark, d) -> DataFrame:
    changes = _judged(spark, d).withColumns({
        "is_new": F.expr("unit_no % 3 = 0"), "new_price": F.col("price"), "old_price": F.expr("price + cast(unit_no % 900 as int)")})
    return alerts.alert_events(changes).withColumn("old_price", F.expr("if(is_new, null, old_price)"))


def alert_events(spark, d):
    return _events(spark, d).select("unit_no", "kind", "old_price", "price", "score")


def alert_topk(spark, d):
    return alerts.top_alerts(_events(spark, d), 25, ("unit_no",)).select("unit_no", "kind", "score")


def alert_chunks(spark, d):
    top = alerts.top_alerts(_events(spark, d), 25, ("unit_no",))
    return alerts.alert_chunks(top, 10, ("unit_no",)).select("unit_no", "rank", "chunk_id")


def alert_digest(spark, d):
    return alerts.alert_digest(_events(spark, d))


def alert_content(spark, d):
    events = _events(spark, d).withColumns({
        "extra_sources": F.expr("if(unit_no % 2 = 0, array('b', 'a', 'b'), array())").cast("array<string>"),
        "rent_estimate": F.expr("if(unit_no % 4 = 0, null, cast(5000 + unit_no as int))"),
        "rent_estimate_low": F.expr("if(unit_no % 4 = 1, 4000, null)"), "rent_estimate_high": F.lit(9000),
        "rent_estimate_source": F.lit("rentcast"), "price_verdict": F.lit("at market"),
        "county_sqft": F.expr("if(unit_no % 5 = 0, 1300, null)"), "county_year_built": F.col("year_built"),
        "county_conflict": F.expr("unit_no % 10 = 0")})
    shown = F.array_join(F.transform("fields", lambda f: F.concat_ws("=", f["name"], f["value"])), "|")
    return alerts.alert_content(events).select("unit_no", "headline", "subheadline", "footer", shown.alias("fields"), "summary")


# --- counts ------------------------------------------------------------------------------------------------

def store_stats(spark, d):
    t = {n: v.table(spark, d, n) for n in ("customer", "events", "orders", "lineitem", "supplier")}
    return stats.store_stats(
        t["customer"].select(F.expr("c_custkey % 3 <> 0").alias("is_active"), F.expr("c_custkey % 2 = 0").alias("matched")),
        t["events"].select(F.col("user_id").alias("dedupe_key"), F.col("event_type").alias("source")),
        t["orders"].select(F.expr("if(o_orderkey % 4 = 0, null, 1)").alias("old_price")),
        t["lineitem"].select(F.expr("l_linenumber <> 3").alias("ok")), t["supplier"])


def _portal_rows(spark, d) -> DataFrame:
    rows = conform(v.sightings(spark, d)).withColumn("has_prose", F.expr("l_partkey % 6 <> 5"))
    return rows.withColumns({
        "url": F.expr("if(source = 'portal_3', null, url)"), "price": F.expr("if(source = 'portal_2', 0, price)"),
        "has_prose": F.expr("has_prose and source <> 'portal_3'")})


def source_coverage(spark, d):
    return stats.source_coverage(_portal_rows(spark, d), sample=None)


def source_coverage_sample(spark, d):
    rows = _portal_rows(spark, d).withColumn("ingest_seq", F.struct(*v.LINE_ORDER, "l_partkey"))
    return stats.source_coverage(rows, sample=10)


def coverage_gaps(spark, d):
    return stats.coverage_gaps(stats.source_coverage(_portal_rows(spark, d), sample=None))


def _health(spark, d) -> DataFrame:
    per = v.table(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("records"))
    return per.withColumns({"ok": F.expr("records % 2 = 0"), "skipped": F.lit(False)})


def source_staleness(spark, d):
    return stats.staleness(_health(spark, d))


def health_json(spark, d):
    errors = v.table(spark, d, "events").select(
        F.col("event_type").alias("source"), F.col("event_id").alias("seq"), F.expr("concat('error ', event_id)").alias("error"))
    return stats.health_json(_health(spark, d), errors)


def detail_budget(spark, d):
    return stats.detail_budget(v.event_sightings(spark, d), 40)


def first_per_source(spark, d):
    return stats.first_per_source(v.event_sightings(spark, d), 40, "seq").select("source", "event_id", "rank_in_source")


# --- payloads ----------------------------------------------------------------------------------------------

def map_payloads(spark, d):
    items = landed.aggregator_records(v.event_payloads(spark, d))
    rows = mapping.map_payloads(items, fm.AGGREGATOR, "realtyapi", need_both_coordinates=False)
    return rows.select("event_id", F.col("ingest_seq.pos").alias("pos"), "source_id", "address", "price", "beds", "description",
                       F.array_join("amenities", ",").alias("amenities"), "state")


def discover_arrays(spark, d):
    pages = v.event_payloads(spark, d)
    found = pages.withColumn("r", vt.find_result_array("doc"))
    return found.select("event_id", F.size("r").alias("n"), F.expr(vt.scalar_text("get(r, 1)", "id")).alias("second"))


def scattered_text(spark, d):
    return v.event_payloads(spark, d).select("event_id", vt.scattered_text("doc", ("remarks", "id")).alias("text"))


def truncation_notes(spark, d):
    pages = v.event_payloads(spark, d)
    return landed.truncation_notes(pages, landed.aggregator_records(pages), "total")


def source_health(spark, d):
    pages = v.event_payloads(spark, d).withColumn("doc", F.expr("if(event_id % 6 = 0, null, doc)"))
    records = landed.aggregator_records(pages.withColumn("portal", F.col("source"))).withColumnRenamed("portal", "source")
    return landed.source_health(pages, records)


def embedded_state(spark, d):
    rows = landed.html_records(v.html_payloads(spark, d))
    mapped = mapping.map_payloads(rows, fm.scraped(fm.ZILLOW), "scrapingbee_zillow", need_both_coordinates=False)
    return mapped.select("page_id", F.col("ingest_seq.pos").alias("pos"), "source_id", "price", "address")


def feed_titles(spark, d):
    return mapping.map_feed_items(v.feed_items(spark, d)).select(
        "o_orderkey", "price", "beds", "sqft", "city", "title", "source_id", "zip_code")


def card_fields(spark, d):
    orders = v.spread(v.table(spark, d, "orders").select("o_orderkey", "o_custkey"))
    cards = orders.select("o_orderkey", F.parse_json(F.to_json(F.struct(
        F.expr("concat(1 + o_orderkey, ' Collins Ave')").alias("address"), F.expr("concat('$', format_number(1000 + o_custkey, 0), '/mo')").alias("price"),
        F.expr("array(concat(1 + o_orderkey % 4, ' bds'), concat(1 + o_orderkey % 3, '.5 ba'), concat(format_number(500 + o_orderkey % 3000, 0), ' sqft'))").alias("details"),
        F.expr("concat('/home/', o_orderkey)").alias("url")))).alias("card"))
    rows = mapping.map_payloads(mapping.card_records(cards, site="https://www.redfin.com"), fm.scraped(fm.REDFIN), "scrapingbee_redfin", need_both_coordinates=False)
    return rows.select("o_orderkey", "address", "price", "beds", "baths", "sqft", "url", "property_type")


def detail_overlay(spark, d):
    rows = v.event_sightings(spark, d).select(
        "event_id", F.lit("p").alias("source"), F.expr("cast(event_id as string)").alias("source_id"), "price",
        F.expr("if(event_id % 2 = 0, 'a longer text than the detail', 'x')").alias("description"),
        F.expr("if(event_id % 3 = 0, 900, null)").alias("sqft"), F.array(F.lit("A"), F.lit("b")).alias("amenities"))
    details = v.table(spark, d, "events").where("event_id % 5 <> 0").select(
        F.lit("p").alias("source"), F.expr("cast(event_id as string)").alias("source_id"),
        F.parse_json(F.to_json(F.expr("named_struct('description', concat('detail ', event_id), 'livingArea', 500 + event_id % 1000, "
                                      "'price', 7, 'resoFacts', named_struct('view', array('a', 'C')))"))).alias("detail"))
    out = mapping.overlay_details(conform(rows).select("event_id", *[c for c in conform(rows).columns if c != "event_id"]), details, fm.ZILLOW)
    return out.select("event_id", "price", "description", "sqft", F.array_join("amenities", ",").alias("amenities"))


QUERIES = {
    "best_units": best_units, "resolve_units": resolve_units, "address_components": address_components,
    "multi_source_units": multi_source_units, "first_wins_merge": first_wins_merge,
    "contributing_sightings": contributing_sightings, "dedupe_within_source": dedupe_within_source,
    "resolve_priority": resolve_priority, "lease_terms": lease_terms, "lease_terms_documents": lease_terms_documents,
    "keyword_scan": keyword_scan, "keyword_scan_documents": keyword_scan_documents, "category_matches": category_matches,
    "category_matches_documents": category_matches_documents, "page_text": page_text, "parsed_specs": parsed_specs,
    "geo_distance_band": geo_distance_band, "verdicts": verdict_rows, "explained_verdicts": explained_verdicts,
    "rejection_histogram": rejection_histogram, "top_rejections": top_rejections, "pass_totals": pass_totals,
    "prefilter": prefilter, "top_matches": top_matches, "export_matches": export_matches,
    "register_validate": register_validate, "register_contains_join": register_contains_join,
    "valuation_verdict": valuation_verdict, "enrichment_counters": enrichment_counters, "price_history": price_history,
    "price_history_strict": price_history_strict, "price_drops": price_drops, "running_life": running_life,
    "sighting_state": sighting_state, "snapshot_merge": snapshot_merge, "inactive_units": inactive_units,
    "cooldown_suppress": cooldown_suppress, "cooldown_as_of": cooldown_as_of, "also_listed_on": also_listed_on,
    "alert_events": alert_events, "alert_topk": alert_topk, "alert_chunks": alert_chunks, "alert_digest": alert_digest,
    "alert_content": alert_content, "store_stats": store_stats, "source_coverage": source_coverage,
    "source_coverage_sample": source_coverage_sample, "coverage_gaps": coverage_gaps, "source_staleness": source_staleness,
    "health_json": health_json, "detail_budget": detail_budget, "first_per_source": first_per_source,
    "map_payloads": map_payloads, "discover_arrays": discover_arrays, "scattered_text": scattered_text,
    "truncation_notes": truncation_notes, "source_health": source_health, "embedded_state": embedded_state,
    "feed_titles": feed_titles, "card_fields": card_fields, "detail_overlay": detail_overlay,
}


# --- streams -----------------------------------------------------------------------------------------------

def _event_stream(spark, d) -> DataFrame:
    return spark.readStream.schema(v.table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _unit_stream(events) -> DataFrame:
    return events.select(
        F.col("user_id").alias("unit_key"), F.concat_ws(":", "event_type", "event_id").alias("source_key"),
        F.col("ts").cast("timestamp").alias("ts"), F.expr("if(event_id % 13 = 0, null, cast(floor(value * 100) as int))").alias("price"))


def _streamed(spark, d, stream=None, **more) -> DataFrame:
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = changes.unit_events(_unit_stream(_event_stream(spark, d) if stream is None else stream), inactive_hours=8, **more)
    return changes.run_to_table(events, f"{folder}/out", f"{folder}/state").withColumn("seen_at", F.col("seen_at").cast("timestamp_ntz"))


def stream_changes(spark, d):
    return _streamed(spark, d).where("event <> 'inactive'").select("unit_key", "seen_at", "event", "old_price", "price", "times_seen")


def stream_cooldown(spark, d):
    return _streamed(spark, d).where("alert").select("unit_key", "seen_at", "event")


def stream_inactive(spark, d):
    return _streamed(spark, d).where("event = 'inactive'").select("unit_key", "seen_at", "times_seen")


def stream_sends(spark, d):
    """What is told when only successful sends count: every fifth event row is the outcome of a send, two of three succeed,
    and the log from before the stream holds a send for every fourth unit, half of them successful. The watermark is that of
    the slower of the two streams."""
    outcomes = _event_stream(spark, d).where("event_id % 5 = 0").select(
        F.col("user_id").alias("unit_key"), F.col("ts").cast("timestamp").alias("ts"),
        F.expr("if(event_id % 2 = 0, 'new', 'price_drop')").alias("kind"), F.expr("event_id % 3 <> 0").alias("ok"))
    log = v.table(spark, d, "events").where("user_id % 4 = 0").groupBy(F.col("user_id").alias("unit_key")).agg(
        (F.min("ts") - F.expr("interval 30 minutes")).alias("sent_at")).select(
        "unit_key", F.lit("new").alias("kind"), "sent_at", F.expr("unit_key % 8 = 0").alias("ok"))
    return _streamed(spark, d, outcomes=outcomes, log=log).where("alert").select("unit_key", "seen_at", "event")


def stream_redelivered(spark, d):
    """The events land in three files, each with all rows of the one before; a micro-batch reads one file."""
    landing = f"{shared_folder(spark)}/landing-{uuid.uuid4().hex}"
    events = v.table(spark, d, "events")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    cuts = [low + (high - low) * k / 3 for k in (1, 2)] + [high]
    for k, cut in enumerate(cuts):
        since = cuts[k - 2] if k == 2 else None
        rows = events.where(F.col("ts") <= F.lit(cut)) if since is None else events.where(F.col("ts") > F.lit(since)).unionByName(
            events.where(F.col("ts") <= F.lit(cuts[1])))
        rows.coalesce(1).write.mode("append").parquet(landing)  # one file is one delivery
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    return _streamed(spark, d, stream).where("event <> 'inactive'").select("unit_key", "seen_at", "event", "old_price", "price", "times_seen")


def full_pass(spark, d):
    """Two passes over order units split by key: the second sees lower prices for some."""
    rows = v.order_units(spark, d).withColumn("city", F.lit("Surfside"))
    store = Store(spark, f"{shared_folder(spark)}/pass-{uuid.uuid4().hex}")
    register = v.table(spark, d, "part").select(
        F.expr("concat('F', p_partkey)").alias("folio"), F.expr("concat(100 + p_partkey, ' COLLINS AVE')").alias("site_address"),
        F.lit(None).cast("string").alias("unit"), F.lit(1500).alias("sqft"), F.lit(2016).alias("year_built"),
        F.lit(None).cast("double").alias("beds"), F.lit(None).cast("double").alias("baths"), F.lit(None).cast("string").alias("use_code"),
        F.lit("register").alias("source"), F.col("p_partkey").alias("reg_seq"))
    settings = PassSettings(prefilter=False)
    run_pass(spark, store, rows.where("unit_no % 4 <> 1"), datetime(2024, 1, 1), 0, settings, register=register)
    second = rows.withColumn("price", F.expr("if(unit_no % 3 = 0, price - 400, price)"))
    run_pass(spark, store, second.where("unit_no % 4 <> 2"), datetime(2024, 1, 10), 1, settings, register=register)
    return store.log("runs").select(
        F.col("started_at").cast("timestamp_ntz").alias("started_at"), "fetched", "deduped", "matched", "new_listings", "price_drops",
        "alerts_sent", "marked_inactive")


QUERIES.update({
    "stream_changes": stream_changes, "stream_cooldown": stream_cooldown, "stream_inactive": stream_inactive,
    "explained_messages": explained_messages, "display_lines": display_lines, "valuation_requests": valuation_requests,
    "stream_sends": stream_sends, "stream_redelivered": stream_redelivered,
    "full_pass": full_pass,
})
