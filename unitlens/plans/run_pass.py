"""One pass: sightings in, snapshot, history, alerts and counts out.

The plan is lazy up to the written tables, the keyed batch, its units, the stored units found for them, the merged units, the verdicts
and the touched units, which are read several times.
Reading them back ends the lineage, so a lost executor costs a scan and not a rerun. Those that serve the pass alone are deleted as soon
as it has read them for the last time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitlens import fixed_values as fv
from unitlens.criteria import AlertCriteria, EnrichmentCriteria, SearchCriteria
from unitlens.functions import geo
from unitlens.functions.address import parse_lines, standardize_addresses
from unitlens.functions.text import fold_unicode
from unitlens.operators import alerts, derive, enrich, merge, resolve, state, stats, verdicts
from unitlens.operators.sinks import Store
from unitlens.schema import SIGHTING_FIELDS, conform

UNIT_COLUMNS = (
    "dedupe_key", "unit_hash", "building_hash", "geo_hash", "source", "source_id", "url", "address", "unit", "city", "state",
    "zip_code", "latitude", "longitude", "property_type", "beds", "baths", "sqft", "year_built", "price", "available_date",
    "days_on_market", "status", "title", "description", "amenities", "photos", "broker", "lease_min_months",
    "lease_max_months", "lease_term_text", "miles_from_ocean", "is_near", "amenity_matches", "enrichment", "matched",
    "match_score", "match_warnings", "fetched_at",
)
TEXT_COLUMNS = ("address", "unit", "city", "title", "description")
#: Tables that a pass writes for itself.
WORKING_TABLES = ("keyed", "incoming", "resolved", "merged", "judged")


@dataclass(frozen=True)
class PassSettings:
    search: SearchCriteria = field(default_factory=SearchCriteria)
    enrichment: EnrichmentCriteria = field(default_factory=EnrichmentCriteria)
    alerts: AlertCriteria = field(default_factory=AlertCriteria)
    channel: str = "table"
    prefilter: bool = True


def _empty_like(df: DataFrame, extra: str = "") -> DataFrame:
    schema = ", ".join([f"{n} {t}" for n, t in df.dtypes] + ([extra] if extra else []))
    return df.sparkSession.createDataFrame([], schema)


def keyed_batch(sightings: DataFrame, settings: PassSettings) -> DataFrame:
    """Sightings with their identities, without those that state a violation of a numeric limit. What their address lines say
    goes along, so a line is parsed once in a pass."""
    keyed = derive.derive_identity(parse_lines(fold_unicode(conform(sightings), *TEXT_COLUMNS)))
    if settings.prefilter:
        measured = geo.measure_distance(keyed).withColumnRenamed("miles", "miles_from_ocean")
        keyed = measured.where(verdicts.passes_prefilter(settings.search)).drop("miles_from_ocean", "is_near", "within_box")
    return keyed.select(*SIGHTING_FIELDS, "ingest_seq", "dedupe_key", "source_key", "address_line")


def unit_batch(keyed: DataFrame) -> DataFrame:
    """One row per unit of the batch."""
    return derive.derive_identity(merge.merge_units(keyed))


def resolved_batch(units: DataFrame, snapshot: DataFrame | None, found: DataFrame | None) -> DataFrame:
    """The units of the batch with the stored unit each belongs to (``resolved_key``), by ``resolve.found_units``."""
    if snapshot is None:
        return units.withColumns({"resolved_key": F.col("dedupe_key"), "resolved_by": F.lit(None).cast("int")})
    return resolve.with_found(units, found)


def merged_batch(resolved: DataFrame) -> DataFrame:
    """One row per stored unit: two units of the batch may belong to the same one."""
    return derive.derive_identity(merge.merge_units(resolved, "resolved_key"))


def judged_batch(units: DataFrame, settings: PassSettings, register=None, valuations=None, parcels=None) -> DataFrame:
    """Judge, enrich, judge again: the register may change what the constraints look at."""
    judged = verdicts.evaluate(derive.derive_place(verdicts.read_texts_once(units, settings.search)), settings.search)
    if register is not None or valuations is not None:
        enriched = enrich.enrich(judged, register, valuations, parcels, settings.enrichment)
        judged = verdicts.evaluate(enriched, settings.search)
    have = set(judged.columns)
    kinds = {"gross_yield_pct": "double", "price_to_estimate_ratio": "double", "county_conflict": "boolean"}
    texts = {"rent_estimate_source", "value_estimate_source", "price_verdict", "county_folio", "county_source"}
    facts = [
        (F.col(n) if n in have else F.lit(None)).cast(kinds.get(n, "string" if n in texts else "int")).alias(n)
        for n in enrich.ENRICHMENT_FIELDS
    ]
    return judged.withColumns({
        "enrichment": F.struct(*facts), "matched": F.col("passed"), "match_score": F.col("score"), "match_warnings": F.col("warnings"),
        "lease_term_text": F.nullif(F.col("lease_term_text"), F.lit("unspecified")),
    })


def run_pass(spark: SparkSession, store: Store, sightings: DataFrame, run_ts: datetime, batch_id: int,
             settings: PassSettings | None = None, register=None, valuations=None, parcels=None, health=None, errors=None,
             notes: str | None = None, before_commit: Callable[[Store, int], None] | None = None) -> DataFrame | None:
    """Run one pass and commit it; returns its run row. A batch that is already committed is not run again.

    The buckets of the stored units and sightings that hold a unit or sighting of the batch, or a unit that expires now,
    are merged and written; the others keep their files. ``health`` (source, records, ok) and ``errors`` (source, seq, error) are
    told in the run row as JSON. ``before_commit`` may look at what the batch wrote and raise, so that it does not count.
    """
    s = settings or PassSettings()
    done = store.latest()
    if done is not None and done >= batch_id:
        return None
    now = F.lit(run_ts).cast("timestamp")
    snapshot, seen = stored_units(store, done), store.state("sightings", done)
    keyed = store.put("keyed", keyed_batch(sightings, s), batch_id)
    units = store.put("incoming", unit_batch(keyed), batch_id)
    found = None if snapshot is None else store.put("resolved", resolve.found_units(units, snapshot, seen), batch_id)
    units = store.put("merged", merged_batch(resolved_batch(units, snapshot, found)), batch_id)
    store.drop(batch_id, "incoming")
    judged = judged_batch(units, s, register, valuations, parcels).select(*UNIT_COLUMNS, "resolved_key", "failures")
    judged = store.put("judged", judged, batch_id)
    store.drop(batch_id, "merged")

    incoming = judged.drop("failures")
    mine = store.touched(incoming.select(F.coalesce("resolved_key", "dedupe_key")), "units",
                         run_ts - timedelta(hours=fv.INACTIVE_AFTER_HOURS))
    snapshot = stored_units(store, done, mine)
    if snapshot is None:
        life = "first_seen_at timestamp, last_seen_at timestamp, times_seen int, is_active boolean"
        snapshot = _empty_like(judged.select(*UNIT_COLUMNS), life)
    merged = state.expire_units(state.upsert_units(incoming, snapshot, now), now)
    written = store.put_state("units", merged, batch_id, "dedupe_key", F.when(F.col("is_active"), F.col("last_seen_at")))
    changes = written.where("seen")

    rows = keyed.withColumn("resolved_key", F.col("dedupe_key"))
    if found is not None:
        rows = keyed.join(found, "dedupe_key", "left").withColumn("resolved_key", F.coalesce("found", "dedupe_key"))
    seen = store.state("sightings", done, store.touched(rows.select("source_key"), "sightings"))
    if seen is None:
        seen = spark.createDataFrame([], "source_key string, dedupe_key string, source string, source_id string, url string, "
                                         "price int, first_seen_at timestamp, last_seen_at timestamp")
    store.put_state("sightings", state.upsert_sightings(rows, seen, now), batch_id, "source_key")
    store.put("price_history", state.history_rows(changes, now), batch_id)

    flagged = changes.withColumns({"passed": F.col("matched"), "score": F.col("match_score"), "warnings": F.col("match_warnings")})
    events = alerts.alert_events(flagged, s.alerts)
    log = store.log("alerts")
    if log is not None:
        events = alerts.suppress_recent(events, log, now, s.alerts.cooldown_hours)
    # every event is stored; those within the cap have a rank and are told
    ranked = store.put("alert_events", alerts.ranked_alerts(events, s.alerts.max_alerts), batch_id)
    told = ranked.where("rank is not null")
    store.put("alerts", alerts.alert_log(told, s.channel, now), batch_id)

    gone = written.agg(F.count_if(F.col("expired")).alias("marked_inactive")).withColumn("started_at", now)
    counts = stats.run_summary(keyed, judged, flagged, told).withColumn("started_at", now)
    run = gone.join(counts, "started_at")
    if health is not None:
        none = spark.createDataFrame([], "source string, seq bigint, error string")
        told_health = stats.health_json(health, errors if errors is not None else none).withColumn("started_at", now)
        run = run.join(told_health, "started_at")
    else:
        run = run.withColumn("source_health", F.lit(None).cast("string"))
    run = run.withColumns({"notes": F.lit(notes).cast("string"), "finished_at": F.current_timestamp()})
    run = store.put("runs", run, batch_id)
    if before_commit:
        before_commit(store, batch_id)
    store.commit(batch_id)
    store.drop(batch_id, *WORKING_TABLES)
    return run


def stored_units(store: Store, batch: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The stored units, without what the batches that wrote them changed."""
    units = store.state("units", batch, buckets)
    return None if units is None else units.drop(*state.CHANGE_COLUMNS, "expired")


def unit_changes(store: Store, batch_id: int) -> DataFrame | None:
    """The units that a committed batch saw or marked inactive, with what changed."""
    units = store.part("units", batch_id)
    return None if units is None else units.where("seen or expired").drop("bucket")


def alert_payloads(store: Store, batch_id: int, size: int = 10) -> DataFrame:
    """The messages of a batch, ready for a channel writer: one row per message."""
    events = store.part("alert_events", batch_id)
    if events is None:
        raise ValueError(f"batch {batch_id} is not committed")
    events = events.where("rank is not null").drop("rank")
    told = alerts.other_sources(events, store.state("sightings"))
    told = standardize_addresses(told.select("*", *[f"enrichment.{f}" for f in enrich.ENRICHMENT_FIELDS]))
    content = alerts.alert_content(alerts.alert_chunks(told, size))
    return alerts.chunk_payloads(content, "kind", "headline", "subheadline", "url", "photo", "fields", "footer", "summary", "score")
