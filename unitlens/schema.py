"""The canonical sighting and the order in which sightings count as seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGHTING_FIELDS = {
    "source": "string", "source_id": "string", "url": "string", "address": "string", "unit": "string",
    "city": "string", "state": "string", "zip_code": "string", "latitude": "double", "longitude": "double",
    "property_type": "string", "beds": "double", "baths": "double", "sqft": "int", "year_built": "int",
    "price": "int", "available_date": "string", "days_on_market": "int", "status": "string", "title": "string",
    "description": "string", "broker": "string", "amenities": "array<string>", "photos": "array<string>",
    "fetched_at": "timestamp",
}
SIGHTING_SCHEMA = ", ".join(f"{n} {t}" for n, t in SIGHTING_FIELDS.items())
INGEST_ORDER = "struct<priority:int,file:string,pos:int>"


def conform(df: DataFrame) -> DataFrame:
    """Cast to the canonical fields; missing ones become NULL and blank strings too. Other columns stay."""
    have = dict(df.dtypes)
    out = {}
    for name, kind in SIGHTING_FIELDS.items():
        c = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        out[name] = F.nullif(c, F.lit("")) if kind == "string" else c
    return df.withColumns(out)
