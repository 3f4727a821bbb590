"""Which changes are worth telling, in what order, and what to say. Sending is left to a batch writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitlens.criteria import AlertCriteria
from unitlens.functions import text as tx
from unitlens.operators.derive import display_line, price_per_sqft


def is_material_drop(c: AlertCriteria, old: str = "old_price", new: str = "new_price") -> Column:
    """A drop that clears both the dollar and the share floor."""
    drop = F.col(old) - F.col(new)
    big = (drop > 0) & (drop >= c.drop_min_dollars) & (drop / F.nullif(F.col(old), F.lit(0)) >= c.drop_min_pct)
    return F.coalesce(big, F.lit(False))


def alert_events(changes: DataFrame, criteria: AlertCriteria | None = None) -> DataFrame:
    """Passing units that are new or dropped materially, with ``kind``."""
    c = criteria or AlertCriteria()
    passed = F.col("passed") if c.include_warned else F.col("passed") & (F.size("warnings") == 0)
    kind = F.when(F.col("is_new"), "new").when(is_material_drop(c), "price_drop")
    return changes.where(passed).withColumn("kind", kind).where("kind is not null")


def suppress_recent(events: DataFrame, alerts: DataFrame, now: Column, hours: int = 24, key: str = "dedupe_key") -> DataFrame:
    """Drop events whose (unit, kind) was told successfully within the window before ``now``.

    The time limit goes down to the log's scan; a unit told very often stays one row.
    """
    cutoff = now - F.make_dt_interval(F.lit(0), F.lit(hours))
    recent = alerts.where("ok").where(F.col("sent_at") >= cutoff).select(key, "kind").distinct()
    return events.join(recent, [key, "kind"], "left_anti")


def suppress_recent_as_of(events: DataFrame, alerts: DataFrame, hours: int = 24, key: str = "dedupe_key",
                          ts: str = "ts") -> DataFrame:
    """The same for events with times of their own: drop an event if a success lies in the ``hours`` up to it.

    Time is cut into buckets as wide as the window. A success in the event's bucket counts if it is not later, one
    in the bucket before if it is not older than the window; the first and the last of a bucket answer both, so
    the join is many-to-one and no range of pairs is built.
    """
    width = hours * 3600 * 1000000

    def bucket(c: Column) -> Column:
        return F.floor(F.unix_micros(c.cast("timestamp")) / width)

    ends = alerts.where("ok").groupBy(key, "kind", bucket(F.col("sent_at")).alias("__b")).agg(
        F.min("sent_at").alias("__first"), F.max("sent_at").alias("__last"))
    probes = ends.select(key, "kind", "__b", F.col("__first").alias("__here"), F.lit(None).cast("timestamp").alias("__prev")).unionByName(
        ends.select(key, "kind", (F.col("__b") + 1).alias("__b"), F.lit(None).cast("timestamp").alias("__here"), F.col("__last").alias("__prev")))
    probes = probes.groupBy(key, "kind", "__b").agg(F.min("__here").alias("__here"), F.max("__prev").alias("__prev"))
    joined = events.withColumn("__b", bucket(F.col(ts))).join(probes, [key, "kind", "__b"], "left")
    since = F.col(ts) - F.make_dt_interval(F.lit(0), F.lit(hours))
    recent = (F.col("__here") <= F.col(ts)) | (F.col("__prev") >= since)
    return joined.where(~F.coalesce(recent, F.lit(False))).drop("__b", "__here", "__prev")


def other_sources(events: DataFrame, sightings: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """Add ``extra_sources``: the other sources that carry the unit, sorted."""
    seen = sightings.groupBy(key).agg(F.array_sort(F.collect_set("source")).alias("__all"))
    none = F.array().cast("array<string>")
    out = events.join(seen, key, "left")
    return out.withColumn("extra_sources", F.coalesce(F.array_remove("__all", F.col("source")), none)).drop("__all")


def top_alerts(events: DataFrame, limit: int = 25, tie: tuple = ("dedupe_key",)) -> DataFrame:
    """The report's own cap: price drops first, then the best scores."""
    return events.orderBy(F.col("kind") != "price_drop", F.desc("score"), *tie).limit(limit)


def ranked_alerts(events: DataFrame, limit: int = 25, tie: tuple = ("dedupe_key",)) -> DataFrame:
    """All events, with ``rank`` for those within the report's cap and NULL beyond it. A channel writer cuts; nothing is
    lost. Only the capped rows are ranked, so no order over all events is needed."""
    order = Window.orderBy(F.col("kind") != "price_drop", F.desc("score"), *tie)
    best = top_alerts(events, limit, tie).select(*tie, "kind", F.row_number().over(order).alias("rank"))
    return events.join(best, [*tie, "kind"], "left")


def alert_content(events: DataFrame) -> DataFrame:
    """Headline, ordered name/value fields and footer of every event."""
    price, old, sqft = F.col("price"), F.col("old_price"), F.nullif(F.col("sqft"), F.lit(0))
    shown = F.coalesce(F.concat(tx.dollars(F.nullif(price, F.lit(0))), F.lit("/mo")), F.lit("price on request"))
    size = F.coalesce(F.concat(F.format_number(sqft, 0), F.lit(" sqft")), F.lit("sqft n/a"))
    specs = F.concat_ws(" · ", F.concat(tx.plain_number(F.col("beds")), F.lit(" bd")),
                        F.concat(tx.plain_number(F.col("baths")), F.lit(" ba")), size)
    where = F.col("__display")
    delta = old - price
    dropped = (F.col("kind") == "price_drop") & (F.coalesce(old, F.lit(0)) != 0) & (F.coalesce(price, F.lit(0)) != 0)
    miles = F.col("miles_from_ocean")
    ocean = (
        F.when(miles.isNull(), "distance unverified").when(F.col("is_near"), "oceanfront (<0.1 mi)")
        .otherwise(F.format_string("%.2f mi to the beach", miles)))
    year = F.nullif(F.col("year_built"), F.lit(0))
    verified = F.when(F.col("county_year_built") == year, " (county-verified)").otherwise("")
    cats = F.array_sort(F.map_keys("amenity_matches"))
    rent, low, high = (F.nullif(F.col(c), F.lit(0)) for c in ("rent_estimate", "rent_estimate_low", "rent_estimate_high"))
    band = F.coalesce(F.concat(F.lit(" (range "), tx.dollars(low), F.lit("–"), tx.dollars(high), F.lit(")")), F.lit(""))
    verdict = F.coalesce(F.concat(F.lit(" — "), F.col("price_verdict")), F.lit(""))
    note = F.when(F.col("county_conflict"), " ⚠️ conflicts with the listing").otherwise("")
    extras, warned = F.col("extra_sources"), F.col("warnings")

    def field(name, value: Column, when: Column | None = None) -> Column:
        pair = F.struct((name if isinstance(name, Column) else F.lit(name)).alias("name"), value.alias("value"))
        return F.when(value.isNotNull() if when is None else when, pair)

    fields = F.array_compact(F.array(
        field("Price", shown), field("Layout", specs), field("Lease term", F.coalesce("lease_term_text", F.lit("unspecified"))),
        field("Ocean", ocean), field("Built", F.concat(year.cast("string"), verified)),
        field("Price / sqft", F.concat(F.lit("$"), F.format_number(F.col("__per_sqft"), 2))),
        field(F.concat(F.lit("Amenities ("), F.size(cats).cast("string"), F.lit(")")),
              F.replace(F.array_join(F.slice(cats, 1, 8), ", "), F.lit("_"), F.lit(" ")), F.size(cats) > 0),
        field(F.concat(F.lit("Rent AVM · "), F.coalesce("rent_estimate_source", F.lit("avm"))),
              F.concat(tx.dollars(rent), band, verdict), rent.isNotNull()),
        field("County record", F.concat(F.format_number(F.nullif(F.col("county_sqft"), F.lit(0)), 0), F.lit(" sqft"), note)),
        field("Listed by", F.nullif(F.col("broker"), F.lit(""))),
        field("Available", F.nullif(F.col("available_date"), F.lit(""))),
        field("Also listed on", F.array_join(F.array_sort(F.array_distinct(extras)), ", "), F.size(extras) > 0),
        field("Needs confirming", F.array_join(F.slice(warned, 1, 4), "; "), F.size(warned) > 0),
    ))
    score = F.when(F.col("score") > 0, F.concat(F.lit("score "), F.bround("score").cast("int").cast("string"), F.lit("/100")))
    days = F.concat(F.col("days_on_market").cast("string"), F.lit(" days on market"))
    return events.withColumns({"__display": display_line(), "__per_sqft": price_per_sqft()}).withColumns({
        "headline": F.when(dropped, F.concat(F.lit("Price drop: "), where)).otherwise(where),
        "subheadline": F.when(dropped, F.concat(
            tx.dollars(old), F.lit(" → "), tx.dollars(price), F.lit(" (−"), tx.dollars(delta), F.lit(", −"),
            F.format_string("%.1f%%", delta / old * 100), F.lit(")"))).otherwise(F.concat_ws(" · ", shown, specs)),
        "fields": fields, "photo": F.try_element_at("photos", F.lit(1)),
        "footer": F.concat_ws(" · ", F.concat(F.lit("source: "), F.col("source")), score, days),
        "summary": tx.truncate(F.col("description"), 320),
    }).drop("__display", "__per_sqft")


def alert_chunks(capped: DataFrame, size: int = 10, tie: tuple = ("dedupe_key",)) -> DataFrame:
    """Number the capped events into messages of ``size``. Only the capped rows come here, so one order is enough."""
    rank = F.row_number().over(Window.orderBy(F.col("kind") != "price_drop", F.desc("score"), *tie))
    return capped.withColumn("rank", rank).withColumn("chunk_id", F.floor((F.col("rank") - 1) / size).cast("int"))


def chunk_payloads(chunked: DataFrame, *columns: str) -> DataFrame:
    """One row per message with its events in order."""
    item = F.struct("rank", *columns)
    return chunked.groupBy("chunk_id").agg(F.array_sort(F.collect_list(item)).alias("events"))


def alert_digest(events: DataFrame) -> DataFrame:
    """One row: how many new, how many drops, and the line that says so."""
    drops, total = F.count_if(F.col("kind") == "price_drop"), F.count("*")
    counts = events.agg(total.alias("total"), drops.alias("drops")).withColumn("new", F.col("total") - F.col("drops"))
    new = F.when(F.col("new") > 0, F.concat(F.col("new").cast("string"), F.lit(" new")))
    said = F.when(F.col("drops") > 0, F.concat(
        F.col("drops").cast("string"), F.lit(" price drop"), F.when(F.col("drops") != 1, "s").otherwise("")))
    return counts.withColumn("line", F.concat_ws(", ", new, said))


def alert_log(sent: DataFrame, channel: str, sent_at: Column, ok: bool = True, detail: str = "") -> DataFrame:
    """Rows for the log of what was told."""
    return sent.select(
        "dedupe_key", "kind", F.lit(channel).alias("channel"), "price", sent_at.alias("sent_at"), F.lit(ok).alias("ok"),
        F.lit(detail).alias("detail"))
