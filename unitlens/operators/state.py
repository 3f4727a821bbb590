"""Stored state: the unit snapshot, the sightings, price history, expiry. Each step is one DataFrame to another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitlens import fixed_values as fv

_LIFE = ("first_seen_at", "last_seen_at", "times_seen", "is_active")


def _merged_value(name: str, kind: str, strict: bool) -> Column:
    """New value over the stored one. In the keep-when-blank columns an empty value keeps what is stored."""
    new, old = F.col(f"n.{name}"), F.col(f"o.{name}")
    seen = F.col("n.__key").isNotNull()
    if name in fv.KEEP_WHEN_BLANK:
        if kind == "string":
            new = F.when(new != "", new)
        elif kind.startswith("array"):
            new = F.when(F.size(new) > 0, new)
        elif kind.startswith("map"):
            new = F.when(F.size(F.map_keys(new)) > 0, new)
        elif name == "enrichment":
            said = [new[f] for f in ("rent_estimate", "value_estimate", "county_sqft", "county_year_built", "county_folio")]
            new = F.when(F.coalesce(*[s.cast("string") for s in said]).isNotNull(), new)
        return F.coalesce(new, old)
    if name == "price" and not strict:
        return F.coalesce(new, old)
    return F.when(seen, new).otherwise(old)


def upsert_units(incoming: DataFrame, snapshot: DataFrame, run_ts: Column, key: str = "dedupe_key",
                 strict: bool = False) -> DataFrame:
    """Full outer merge of a batch (one row per unit, column ``resolved_key``) into the snapshot.

    The result is the new snapshot plus the change columns of ``change_columns``; rows the batch did not mention
    come through unchanged with ``seen`` false. ``strict`` lets a missing price erase the stored one.
    """
    kinds = {**dict(snapshot.dtypes), **dict(incoming.dtypes)}
    fixed = {key, "resolved_key", "resolved_by", *_LIFE}
    names = [c for c in snapshot.columns if c not in fixed]
    n = incoming.withColumn("__key", F.coalesce("resolved_key", key))
    n = n.withColumns({c: F.lit(None).cast(kinds[c]) for c in names if c not in n.columns}).alias("n")
    o = snapshot.alias("o")
    joined = n.join(o, F.col("n.__key") == F.col(f"o.{key}"), "full_outer")
    seen, stored = F.col("n.__key").isNotNull(), F.col(f"o.{key}").isNotNull()
    old_price, new_price = F.col("o.price"), F.col("n.price")
    out = [
        F.coalesce(F.col(f"o.{key}"), F.col("n.__key")).alias(key),
        *[_merged_value(c, kinds[c], strict).alias(c) for c in names],
        F.when(stored, F.col("o.first_seen_at")).otherwise(run_ts).alias("first_seen_at"),
        F.when(seen, run_ts).otherwise(F.col("o.last_seen_at")).alias("last_seen_at"),
        (F.coalesce(F.col("o.times_seen"), F.lit(0)) + seen.cast("int")).alias("times_seen"),
        (seen | F.coalesce(F.col("o.is_active"), F.lit(False))).alias("is_active"),
        seen.alias("seen"), (seen & ~stored).alias("is_new"),
        F.when(seen & stored, old_price).alias("old_price"), F.when(seen, new_price).alias("new_price"),
        (seen & stored & (F.col(f"n.{key}") != F.col(f"o.{key}"))).alias("merged_with_existing"),
    ]
    return joined.select(*out).withColumns(change_columns())


def change_columns(old: str = "old_price", new: str = "new_price") -> dict[str, Column]:
    delta = F.col(new) - F.col(old)
    return {
        "delta": delta,
        "drop_pct": F.abs(delta) / F.nullif(F.col(old), F.lit(0)),
        "price_drop": F.coalesce(delta < 0, F.lit(False)),
        "price_increase": F.coalesce(delta > 0, F.lit(False)),
    }


CHANGE_COLUMNS = ("seen", "is_new", "old_price", "new_price", "merged_with_existing", "delta", "drop_pct",
                  "price_drop", "price_increase")


def history_rows(changes: DataFrame, run_ts: Column, key: str = "dedupe_key") -> DataFrame:
    """What a pass adds to the price history: first prices and real changes."""
    first = F.col("is_new") & F.col("new_price").isNotNull()
    return changes.where(first | F.col("price_drop") | F.col("price_increase")).select(
        key, "old_price", "new_price", "delta", run_ts.alias("changed_at"), "source")


def upsert_sightings(incoming: DataFrame, stored: DataFrame, run_ts: Column) -> DataFrame:
    """One row per source_key: first and last seen, the latest price and link, the unit it belongs to now."""
    new = incoming.select(
        "source_key", F.coalesce("resolved_key", "dedupe_key").alias("dedupe_key"), "source", "source_id", "url", "price",
        run_ts.alias("first_seen_at"), run_ts.alias("last_seen_at"))
    turns = stored.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)))
    return fold_sightings(turns, "turn")  # of passes dated alike the later one


def unit_history(history: DataFrame, *keys: str, key: str = "dedupe_key") -> DataFrame:
    """The price changes of some units (of all without ``keys``), oldest first within a unit."""
    rows = history.where(F.col(key).isin(*keys)) if keys else history
    return rows.orderBy(key, "changed_at", "old_price", "new_price")


def unit_sightings(sightings: DataFrame, *keys: str, key: str = "dedupe_key") -> DataFrame:
    """The sightings of some units (of all without ``keys``), newest first within a unit."""
    rows = sightings.where(F.col(key).isin(*keys)) if keys else sightings
    return rows.orderBy(key, F.desc("last_seen_at"), "source_key")


def fold_sightings(rows: DataFrame, *then: str) -> DataFrame:
    """One row per source_key with its latest facts, by last_seen_at and the columns ``then``."""
    at = F.struct("last_seen_at", *then, "dedupe_key", "price", "url")
    return rows.groupBy("source_key").agg(
        F.max_by("dedupe_key", at).alias("dedupe_key"), F.max_by("source", at).alias("source"),
        F.max_by("source_id", at).alias("source_id"),
        F.max_by("url", F.when(F.coalesce("url", F.lit("")) != "", at)).alias("url"), F.max_by("price", at).alias("price"),
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))


def expire_units(units: DataFrame, run_ts: Column, hours: int = fv.INACTIVE_AFTER_HOURS) -> DataFrame:
    """Switch off units not seen since the cut-off; ``expired`` marks those it switched off now."""
    cutoff = run_ts - F.make_dt_interval(F.lit(0), F.lit(hours))
    gone = F.col("is_active") & (F.col("last_seen_at") < cutoff)
    return units.withColumn("expired", gone).withColumn("is_active", F.col("is_active") & ~F.col("expired"))


# --- replay of a unit's sightings in time order ------------------------------------------------------------

def _sliced(df: DataFrame, ts: str, width: str) -> DataFrame:
    return df.withColumn("__slice", F.window(F.col(ts).cast("timestamp"), width)["start"])


def price_changes(df: DataFrame, unit: str = "unit_key", ts: str = "ts", seq: str = "seq", price: str = "price",
                  width: str = "1 day", strict: bool = False) -> DataFrame:
    """Add ``old_price``, ``change`` (first, drop, increase, unchanged), ``delta`` and ``drop_pct`` to every sighting.

    The previous price is the last one stated before, by (ts, seq). A unit may hold a large part of all rows, so
    the window runs over (unit, time slice), and only one price per slice is carried across slices.
    ``strict`` takes the row before as it is, also when it states no price.
    """
    sliced = _sliced(df, ts, width)
    within = Window.partitionBy(unit, "__slice").orderBy(ts, seq)
    boxed = F.struct(F.col(price).alias("v"))
    stated = boxed if strict else F.when(F.col(price).isNotNull(), boxed)
    order = F.struct(ts, seq)
    carried = sliced.groupBy(unit, "__slice").agg(
        F.max_by(boxed, order if strict else F.when(F.col(price).isNotNull(), order)).alias("__end"))
    earlier = Window.partitionBy(unit).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.withColumn("__carry", F.last("__end", ignorenulls=True).over(earlier)).drop("__end")
    before = F.last(stated, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1))
    out = sliced.withColumn("__before", before).join(carried, [unit, "__slice"], "left")
    out = out.withColumn("old_price", F.coalesce("__before", "__carry")["v"])
    new, old = F.col(price), F.col("old_price")
    return out.withColumns({
        "change": F.when(new.isNull(), F.lit(None)).when(old.isNull(), "first").when(new < old, "drop")
        .when(new > old, "increase").otherwise("unchanged"),
        "delta": new - old, "drop_pct": F.abs(new - old) / F.nullif(old, F.lit(0)),
    }).drop("__slice", "__before", "__carry")


def price_history(df: DataFrame, unit: str = "unit_key", ts: str = "ts", seq: str = "seq", price: str = "price",
                  width: str = "1 day", strict: bool = False) -> DataFrame:
    return price_changes(df, unit, ts, seq, price, width, strict).where("change in ('first', 'drop', 'increase')")


def running_life(df: DataFrame, unit: str = "unit_key", ts: str = "ts", seq: str = "seq", width: str = "1 day") -> DataFrame:
    """Add running ``first_seen_at``, ``last_seen_at`` and ``times_seen`` to every sighting, by time slices."""
    sliced = _sliced(df, ts, width)
    within = Window.partitionBy(unit, "__slice").orderBy(ts, seq)
    per = sliced.groupBy(unit, "__slice").agg(F.count("*").alias("__n"), F.min(ts).alias("__min"))
    earlier = Window.partitionBy(unit).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy(unit).orderBy("__slice").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumns({
        "__prior": F.coalesce(F.sum("__n").over(earlier), F.lit(0)), "first_seen_at": F.min("__min").over(up_to),
    }).drop("__n", "__min")
    out = sliced.withColumn("__rn", F.row_number().over(within)).join(per, [unit, "__slice"])
    return out.withColumns({
        "last_seen_at": F.col(ts), "times_seen": F.col("__prior") + F.col("__rn"),
    }).drop("__slice", "__rn", "__prior")
