"""Columns worked out from a sighting: address parts, identities, lease window, distance, display texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitlens import fixed_values as fv
from unitlens.functions import address as ad
from unitlens.functions import geo
from unitlens.functions import text as tx
from unitlens.functions.lease import describe_lease, extract_lease_terms


def search_text() -> Column:
    """Everything a keyword test looks at: title . description . amenities . status . type."""
    chunks = ["title", "description", None, "status", "property_type"]
    amenities = F.nullif(F.array_join("amenities", " "), F.lit(""))
    return F.concat_ws(" . ", *[tx.clean_text(amenities if c is None else F.col(c)) for c in chunks])


def has_prose() -> Column:
    """Whether title, description and amenities together say enough to be judged on."""
    cleaned = F.transform(F.coalesce("amenities", F.array().cast("array<string>")), lambda a: tx.clean_text(a))
    prose = F.concat_ws(" ", *[F.coalesce(tx.clean_text(F.col(c)), F.lit("")) for c in ("title", "description")], cleaned)
    return F.length(F.btrim(prose)) >= fv.PROSE_MIN_CHARS


def derive_identity(df: DataFrame) -> DataFrame:
    """Address parts, the three hashes and the two keys. Place columns take their canonical form. With a column
    ``address_line`` (``address.parse_lines``) the line is not parsed again."""
    df = ad.standardize_addresses(df, line="address_line" if "address_line" in df.columns else None)
    p = F.col("address_parts")

    def canonical(part: str, column: str) -> Column:
        return F.coalesce(F.nullif(p[part], F.lit("")), F.col(column))

    df = df.withColumns({
        "unit_hash": ad.unit_hash(p), "building_hash": ad.building_hash(p),
        "geo_hash": ad.geo_hash(F.col("latitude"), F.col("longitude"), p["unit"]),
        "city": tx.apart(canonical("city", "city")), "zip_code": canonical("zip5", "zip_code"), "unit": canonical("unit", "unit"),
        "state": F.coalesce(canonical("state", "state"), F.lit(fv.DEFAULT_STATE)),
    })
    own = F.concat_ws(":", F.lit("s"), F.col("source"), F.coalesce("source_id", "url", F.lit("")))
    df = df.withColumn("dedupe_key", F.coalesce(
        F.concat(F.lit("u:"), F.col("unit_hash")), F.concat(F.lit("g:"), F.col("geo_hash")), own))
    return df.withColumns({
        "source_key": F.concat_ws(":", "source", F.coalesce("source_id", "url", "dedupe_key")),
        # no unit number: every sighting of the building shares this key
        "low_confidence": F.col("unit_hash").isNotNull() & (p["unit"] == ""),
    })


#: The columns that ``read_texts`` reads.
TEXTS = ("title", "description", "amenities", "status", "property_type")


def read_texts(df: DataFrame) -> DataFrame:
    """Search text, lease window and whether there is prose to judge by."""
    df = extract_lease_terms(df.withColumn("search_text", search_text()), "title", "description", "search_text")
    return df.withColumns({
        "lease_min_months": F.col("lease_term.min_months"), "lease_max_months": F.col("lease_term.max_months"),
        "lease_term_text": describe_lease(F.col("lease_term")), "has_prose": has_prose(),
    })


def derive_place(df: DataFrame) -> DataFrame:
    """Distance and nearness."""
    return geo.measure_distance(df).withColumnRenamed("miles", "miles_from_ocean")


def derive_facts(df: DataFrame) -> DataFrame:
    """Search text, lease window, distance and nearness."""
    return derive_place(read_texts(df))


def derive(df: DataFrame) -> DataFrame:
    return derive_facts(derive_identity(df))


def price_per_sqft() -> Column:
    return tx.half_up(F.nullif(F.col("price"), F.lit(0)) / F.nullif(F.col("sqft"), F.lit(0)), 2)


def display_line() -> Column:
    p = F.col("address_parts")
    plain = F.coalesce(F.nullif(tx.clean_text(F.col("address")), F.lit("")), F.lit("(address unavailable)"))
    return F.when(ad.is_usable(p), ad.display_address(p)).otherwise(plain)


def summary_line() -> Column:
    return F.concat_ws(
        " | ", display_line(),
        F.coalesce(F.concat(tx.dollars(F.nullif(F.col("price"), F.lit(0))), F.lit("/mo")), F.lit("price n/a")),
        F.concat(tx.plain_number(F.col("beds")), F.lit("bd/"), tx.plain_number(F.col("baths")), F.lit("ba")),
        F.coalesce(F.concat(F.format_number(F.nullif(F.col("sqft"), F.lit(0)), 0), F.lit(" sqft")), F.lit("sqft n/a")),
        F.coalesce("lease_term_text", F.lit("term n/a")),
    )
