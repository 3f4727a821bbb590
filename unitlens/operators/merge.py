"""Collapsing sightings of one unit into one row.

A unit may hold a large part of all sightings, so nothing here gathers a group: the scalar fields are plain
aggregates with partial sums on the map side, and list items are made distinct before any list is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_FIELDS = ("source_id", "url", "address", "unit", "city", "zip_code", "property_type", "title", "description",
               "broker", "status", "available_date")
NUMBER_FIELDS = ("beds", "baths", "sqft", "year_built", "latitude", "longitude", "days_on_market")
INCUMBENT_FIELDS = ("source", "state", "fetched_at", "raw")
LIST_FIELDS = {"photos": lambda c: c, "amenities": F.lower}


def _first_said(name: str, order: Column, blank: Column | None = None) -> Column:
    """The value of the earliest sighting that states it."""
    said = F.col(name).isNotNull() if blank is None else F.col(name).isNotNull() & (F.col(name) != blank)
    return F.min_by(F.col(name), F.when(said, order)).alias(name)


def merge_units(df: DataFrame, key: str = "dedupe_key", order_by: tuple = ("ingest_seq",), lists: bool = True) -> DataFrame:
    """One row per ``key``: the earliest statement wins each text, numbers fill gaps, the lowest price stays.

    ``order_by`` must order the sightings of a unit totally. Photos and amenities become ordered unions. The
    contributing sightings are a table of their own, see ``contributing_sightings``.
    """
    order = F.struct(*order_by)
    have = set(df.columns)
    parsed = "address_line" in have  # goes with its address
    if parsed:
        df = df.withColumn("__place", F.when(F.col("address") != "", F.struct("address", "address_line")))
    aggs = [_first_said(n, order, F.lit("")) for n in TEXT_FIELDS if n in have and not (parsed and n == "address")]
    aggs += [_first_said("__place", order)] if parsed else []
    aggs += [_first_said(n, order, F.lit(0)) for n in NUMBER_FIELDS if n in have]
    aggs += [F.min_by(n, order).alias(n) for n in INCUMBENT_FIELDS if n in have]
    if "price" in have:
        aggs.append(F.min(F.nullif(F.col("price"), F.lit(0))).alias("price"))
    if "source" in have:
        aggs.append(F.array_sort(F.collect_set("source")).alias("sources"))
    aggs += [F.count("*").alias("n_sightings"), F.min(order).alias("first_order")]
    merged = df.groupBy(key).agg(*aggs)
    if parsed:
        merged = merged.select("*", "__place.address", "__place.address_line").drop("__place")
    if len(order_by) == 1:
        merged = merged.withColumn(order_by[0], F.col(f"first_order.{order_by[0]}")).drop("first_order")
    names = [n for n in LIST_FIELDS if n in have] if lists else []
    return merged.join(_merged_lists(df, key, order, names), key, "left") if names else merged


def list_items(df: DataFrame, key: str, order: Column, names) -> DataFrame:
    """The distinct items of the list fields per unit, long: field, item and where it was first seen."""
    empty = F.array().cast("array<string>")

    def entries(name: str) -> Column:  # one pass over the input for all fields
        return F.transform(F.coalesce(name, empty), lambda x, i: F.struct(
            F.lit(name).alias("field"), i.alias("idx"), x.alias("item"), LIST_FIELDS[name](x).alias("same_as")))

    items = df.select(F.col(key), order.alias("ord"), F.inline(F.concat(*[entries(n) for n in names])))
    first = F.min(F.struct("ord", "idx", "item")).alias("first")
    return items.where("coalesce(item, '') <> ''").groupBy(key, "field", "same_as").agg(first)


def _merged_lists(df: DataFrame, key: str, order: Column, names) -> DataFrame:
    lists = [
        F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == n, F.col("first")))), lambda x: x["item"]).alias(n)
        for n in names
    ]
    return list_items(df, key, order, names).groupBy(key).agg(*lists)


def contributing_sightings(df: DataFrame, key: str = "dedupe_key", order_by: tuple = ("ingest_seq",)) -> DataFrame:
    """Which sightings went into a unit besides the first: one row each, never an array."""
    order = F.struct(*order_by)
    firsts = df.groupBy(key).agg(F.min(order).alias("__first"))
    rows = df.select(key, "source", "source_id", "url", order.alias("__ord"))
    return rows.join(firsts, key).where("__ord > __first").drop("__ord", "__first")


def dedupe_within_source(df: DataFrame, order_by: tuple = ("ingest_seq",)) -> DataFrame:
    """Repeats inside one source's own pages become one sighting."""
    merged = merge_units(df.withColumn("__key", F.struct("source", "dedupe_key")), "__key", order_by)
    return merged.withColumn("dedupe_key", F.col("__key.dedupe_key")).drop("__key", "sources", "n_sightings")


def union_sources(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name over the sources of a pass."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
