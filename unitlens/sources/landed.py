"""Scans over landed files: JSON response pages, feeds, HTML pages, register and valuation payloads.

One file is one response, read whole. ``ingest_seq`` is (source priority, file, position): it is the same on every
read, so every first-wins rule gives the same answer however the data is partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitlens import fixed_values as fv
from unitlens.functions import text as tx
from unitlens.functions import variant as vt
from unitlens.schema import SIGHTING_SCHEMA

_JSON_START = r"^[\{\[]"
FEED_SCHEMA = "title string, link string, description string, `dc:date` string, pubDate string"


def read_bodies(spark: SparkSession, path: str, source: str, priority: int = 0) -> DataFrame:
    """One row per file: source, priority, file, body."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path)
    return files.select(
        F.lit(source).alias("source"), F.lit(priority).alias("priority"),
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"),
    )


def read_pages(spark: SparkSession, path: str, source: str, priority: int = 0) -> DataFrame:
    """JSON response pages: ``doc`` is NULL where the body is not JSON."""
    return read_bodies(spark, path, source, priority).withColumn("doc", F.try_parse_json("body")).drop("body")


def explode_records(pages: DataFrame, records: Column, out: str = "item") -> DataFrame:
    """One row per record of an array<variant>, with its place in the scan."""
    rest = [c for c in pages.columns if c not in ("doc", "body", "priority", "file", "source")]
    return pages.select(
        *rest, "priority", "file", F.posexplode(records).alias("pos", out)
    ).select(*rest, F.struct("priority", "file", "pos").alias("ingest_seq"), out)


def search_records(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Records of a search page: the array at ``path`` if it holds any, else the array found by shape."""
    found = vt.find_result_array("doc")
    if path:
        declared = F.expr(vt.objects_in(vt.items_of(vt.dig("doc", path))))
        found = F.when(F.size(declared) > 0, declared).otherwise(found)
    return explode_records(pages, found)


def aggregator_records(pages: DataFrame) -> DataFrame:
    return explode_records(pages, vt.enveloped_records("doc"))


def structured_feed_records(pages: DataFrame) -> DataFrame:
    """A bare array, or one under ``listings`` or ``data``; anything else holds nothing."""
    arrays = [vt.items_of("doc"), vt.items_of(vt.dig("doc", "listings")), vt.items_of(vt.dig("doc", "data"))]
    return explode_records(pages, F.expr(f"coalesce({', '.join(vt.objects_in(a) for a in arrays)})"))


def feed_items(bodies: DataFrame) -> DataFrame:
    """(file, priority, pos, item) of feed bodies, RSS 1.0/RDF and 2.0 alike, in the order of the file. A body that is not
    well-formed XML gives no items; see ``source_health`` for their count."""
    broken = F.from_xml("body", "broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})["broken"]
    whole = bodies.where(broken.isNull())
    items = F.regexp_extract_all("body", F.lit(r"(?s)<item\b.*?</item>"), 0)
    return whole.select("priority", "file", F.posexplode(items).alias("pos", "xml")).select(
        "priority", "file", "pos", F.from_xml("xml", FEED_SCHEMA).alias("item"))


def read_feed(spark: SparkSession, path: str, scan_zip: str, priority: int = 0) -> DataFrame:
    """The items of landed feed files, with their places."""
    items = feed_items(read_bodies(spark, path, "feed", priority))
    text = {c: F.btrim(F.col(f"item.`{c}`")) for c in ("title", "link", "description", "dc:date", "pubDate")}
    return items.select(
        text["title"].alias("title"), text["link"].alias("link"), text["description"].alias("description"),
        F.coalesce(text["dc:date"], text["pubDate"]).alias("date"), F.lit(scan_zip).alias("scan_zip"),
        F.struct("priority", "file", "pos").alias("ingest_seq"),
    ).where("coalesce(title, '') <> '' or coalesce(link, '') <> ''")


def embedded_records(html: str) -> Column:
    """Records inside a page: its embedded state JSON, the first kind that holds any; failing that its JSON-LD."""
    none = "cast(array() as array<variant>)"
    shaped = f"coalesce({vt.find_result_array_sql('b')}, {none})"

    def parsed(pattern: str) -> str:
        found = f"regexp_extract_all({html}, {tx.sql_text(pattern)}, 1)"
        return f"filter(transform({found}, m -> try_parse_json(trim(m))), b -> b is not null)"

    by_kind = []
    for pattern in fv.STATE_PATTERNS:
        arrays = f"transform({parsed(pattern)}, b -> {shaped})"
        largest = f"aggregate({arrays}, {none}, (best, r) -> if(size(r) > size(best), r, best))"
        by_kind.append(F.expr(f"get(filter(array({largest}), r -> size(r) > 0), 0)"))
    objects = f"flatten(transform({parsed(fv.JSON_LD_PATTERN)}, q -> coalesce({vt.as_objects('q')}, {none})))"
    linked = F.expr(f"flatten(transform(transform({objects}, b -> named_struct('b', b, 'r', {shaped})), "
                    f"s -> if(size(s.r) > 0, s.r, array(s.b))))")
    is_json = f"ltrim({html}) rlike {tx.sql_text(_JSON_START)}"
    whole = F.expr(
        f"get(filter(transform(array(if({is_json}, try_parse_json({html}), null)), b -> {shaped}), r -> size(r) > 0), 0)")
    return F.coalesce(whole, *by_kind, linked)


def html_records(pages: DataFrame, html: str = "body") -> DataFrame:
    return explode_records(pages, embedded_records(html))


def card_pages(pages: DataFrame) -> DataFrame:
    """Cards of a pre-extracted page, under ``listings`` or as a bare array."""
    arrays = [vt.items_of(vt.dig("doc", "listings")), vt.items_of("doc")]
    return explode_records(pages, F.expr(f"coalesce({', '.join(vt.objects_in(a) for a in arrays)})"), out="card")


# --- register -----------------------------------------------------------------------------------------

def _register_fields(doc: str, sqft, year, beds, baths, use) -> dict[str, Column]:
    def number(names):
        n = F.expr(vt.pick(doc, *names)).try_cast("double")
        return F.when(n > 0, n)

    return {
        "sqft": tx.sqft_from_text(F.expr(vt.pick(doc, *sqft))),
        "year_built": tx.year_from_text(F.expr(vt.pick(doc, *year))),
        "beds": number(beds), "baths": number(baths), "use_code": F.expr(vt.pick(doc, *use)),
    }


def register_from_search(search_pages: DataFrame, detail_pages: DataFrame) -> DataFrame:
    """Folio search hits left-joined to folio details (one row per folio), as register rows."""
    names = ("MinimumPropertyInfos", "PropertyInfos", "Results", "results")
    hits = explode_records(
        search_pages, F.expr("coalesce(" + ", ".join(vt.as_objects(vt.dig("doc", n)) for n in names) + ")"))
    hits = hits.select(
        F.regexp_replace(F.expr(vt.pick("item", "Folio", "FolioNumber", "strapNumber")), "-", "").alias("folio"),
        F.expr(vt.pick("item", "SiteAddress", "Address")).alias("site_address"),
        F.expr(vt.pick("item", "Unit", "UnitNo")).alias("unit"), F.col("ingest_seq").alias("reg_seq"),
    ).where("folio is not null")
    info = F.coalesce(F.expr(vt.dig("doc", "PropertyInfo")), F.col("doc"))
    facts = _register_fields(
        "info",
        ("BuildingHeatedArea", "AdjustedSquareFeet", "BuildingEffectiveArea", "BuildingGrossArea", "FloorArea"),
        ("YearBuilt", "ActualYearBuilt", "EffectiveYearBuilt"), ("BedroomCount", "Bedrooms"),
        ("BathroomCount", "Bathrooms", "FullBathroomCount"), ("DORDescription", "DORCode", "UseCode"),
    )
    details = detail_pages.withColumn("info", info).select(
        F.regexp_replace(F.expr(vt.pick("info", "Folio", "FolioNumber")), "-", "").alias("folio"), "file",
        F.expr(vt.pick("info", "SiteAddress", "Address")).alias("d_address"),
        F.expr(vt.pick("info", "UnitNo", "Unit")).alias("d_unit"), *[c.alias(n) for n, c in facts.items()],
    ).where("folio is not null")
    cols = [F.col(c) for c in details.columns if c not in ("folio", "file")]
    one = details.groupBy("folio").agg(F.min_by(F.struct(*cols), "file").alias("f"))
    return hits.join(one, "folio", "left").select(
        "folio", F.coalesce("site_address", "f.d_address").alias("site_address"),
        F.coalesce("unit", "f.d_unit").alias("unit"), "f.sqft", "f.year_built", "f.beds", "f.baths", "f.use_code",
        F.lit("miamidade_pa_proxy").alias("source"), "reg_seq",
    )


def register_from_parcels(pages: DataFrame) -> DataFrame:
    """Parcel features, the second layout of the same facts."""
    rows = explode_records(pages, F.expr(vt.as_objects(vt.dig("doc", "features"))))
    rows = rows.withColumn("attr", F.expr(vt.dig("item", "attributes")))
    facts = _register_fields(
        "attr", ("BLDG_EFFECTIVE_AREA", "FLOOR_AREA", "LIVING_AREA", "SQFT"),
        ("YEAR_BUILT", "ACT_YR_BLT", "EFF_YR_BLT"), ("BEDROOM_COUNT", "BEDROOMS"),
        ("BATHROOM_COUNT", "BATHROOMS"), ("DOR_CODE", "USE_CODE", "LAND_USE"),
    )
    out = rows.select(
        F.expr(vt.pick("attr", "FOLIO", "PARCELNO")).alias("folio"),
        F.expr(vt.pick("attr", "TRUE_SITE_ADDR", "SITE_ADDR", "ADDRESS")).alias("site_address"),
        F.expr(vt.pick("attr", "TRUE_SITE_UNIT", "UNIT", "SITE_UNIT")).alias("unit"),
        *[c.alias(n) for n, c in facts.items()], F.lit("miamidade_gis").alias("source"),
        F.col("ingest_seq").alias("reg_seq"),
    )
    return out.where("folio is not null or sqft is not null or year_built is not null")


def register_from_property_records(pages: DataFrame) -> DataFrame:
    """A second opinion on size and year, as register rows."""
    rows = explode_records(pages, F.expr(vt.as_objects("doc")))
    facts = _register_fields(
        "item", ("squareFootage",), ("yearBuilt",), ("bedrooms",), ("bathrooms",), ("propertyType",))
    return rows.select(
        F.expr(vt.pick("item", "assessorID", "id")).alias("folio"),
        F.expr(vt.pick("item", "addressLine1", "formattedAddress")).alias("site_address"),
        F.expr(vt.pick("item", "addressLine2")).alias("unit"),
        *[c.alias(n) for n, c in facts.items()], F.lit("rentcast").alias("source"), F.col("ingest_seq").alias("reg_seq"),
    )


# --- valuations ---------------------------------------------------------------------------------------

def _positive(doc: str, *paths: str) -> Column:
    n = F.coalesce(*[F.expr(vt.scalar_text(doc, p)).try_cast("double") for p in paths])
    return F.when(n > 0, F.bround(n).try_cast("int"))


def _asked(pages: DataFrame) -> Column:
    """The order in which answers count as given."""
    have = [c for c in ("priority", "file") if c in pages.columns]
    return F.struct(*have).alias("val_seq") if have else F.lit(0).alias("val_seq")


def valuations_from_models(pages: DataFrame, address_key: str = "address_key") -> DataFrame:
    """Rent and value model answers; a page carries the address it was asked with."""
    comps = F.expr(f"coalesce(size({vt.items_of(vt.dig('doc', 'comparables'))}), 0)")
    is_rent = F.expr(vt.scalar_text("doc", "rent")).isNotNull()
    return pages.select(
        F.lit("rentcast").alias("provider"), F.col(address_key).alias("address_key"), _asked(pages),
        _positive("doc", "rent").alias("rent"), _positive("doc", "rentRangeLow").alias("rent_low"),
        _positive("doc", "rentRangeHigh").alias("rent_high"), comps.alias("n_comps"),
        F.when(~is_rent, _positive("doc", "price")).alias("value"),
    )


def valuations_from_components(pages: DataFrame, address_key: str = "address_key") -> DataFrame:
    """Two components in one envelope; a component whose code is not zero says nothing."""
    first = F.coalesce(F.expr(f"get({vt.items_of('doc')}, 0)"), F.col("doc"))
    staged = pages.withColumn("env", first)
    parts = {}
    for name, member in (("rental", "property/value_rental"), ("sale", "property/value")):
        code = F.expr(vt.scalar_text("env", f"{member}.api_code")).try_cast("int")
        parts[name] = F.when(code.isNull() | (code == 0), F.expr(vt.dig("env", f"{member}.result.value")))
    staged = staged.withColumns(parts)
    return staged.select(
        F.lit("housecanary").alias("provider"), F.col(address_key).alias("address_key"), _asked(pages),
        _positive("rental", "price", "value").alias("rent"),
        _positive("rental", "price_lower", "value_lower").alias("rent_low"),
        _positive("rental", "price_upper", "value_upper").alias("rent_high"), F.lit(0).alias("n_comps"),
        _positive("sale", "price", "value").alias("value"),
    )


# --- other scans --------------------------------------------------------------------------------------

def one_document_files(lines: DataFrame) -> list[str]:
    """Of files read by lines, those that hold one document over several lines or an array, told by the first line that is
    not blank: it opens an array, or an object that it does not close. The names are metadata of the listing."""
    begin = F.btrim("value", F.lit(" \t\r"))
    opens = begin.startswith("[") | (begin.startswith("{") & ~begin.endswith("}"))
    heads = lines.where(F.col("_metadata.file_block_start") == 0).where(begin != "")
    first = heads.select(  # the first block of a file is read in order by one task
        F.col("_metadata.file_path").alias("file"), opens.alias("opens"), F.monotonically_increasing_id().alias("at"))
    kinds = first.groupBy("file").agg(F.min_by("opens", "at").alias("opens"))
    return [r.file for r in kinds.where("opens").select("file").collect()]


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """Hand-made sightings: one JSON document per file, an object or an array, or JSON lines; unknown members are dropped,
    and so are lines that are no JSON object. A file of lines is split like any text, whatever its size; only a file
    that is one document is one cell. One that cannot be read as a document is read by its lines."""
    def scan(whole: bool) -> DataFrame:
        return spark.read.format("text").option("wholetext", whole).option("recursiveFileLookup", True).load(path)

    files = one_document_files(scan(False))
    listed = F.col("_metadata.file_path").isin(files)  # names prune the listing: no file is read both ways
    lines = scan(False).where(~listed).select(F.expr("try_parse_json(value)").alias("item"))
    by_line = "filter(transform(split(value, '\\\\r?\\\\n'), x -> try_parse_json(x)), x -> x is not null)"
    records = f"coalesce({vt.as_objects('try_parse_json(value)')}, {by_line})"
    documents = scan(True).where(listed).select(F.explode(F.expr(records)).alias("item"))
    rows = lines.unionByName(documents).where("schema_of_variant(item) like 'OBJECT%'")
    return rows.select(F.from_json(F.to_json("item"), SIGHTING_SCHEMA).alias("r")).select("r.*")


def ranged_or_all(df: DataFrame, predicate: Column) -> tuple[DataFrame, str | None]:
    """The rows in range, or all of them with a note where the range finds none. One existence check on the driver."""
    ranged = df.where(predicate)
    if ranged.isEmpty():
        return df, "range filters matched nothing; read unfiltered"
    return ranged, None


def truncation_notes(pages: DataFrame, records: DataFrame, total_path: str) -> DataFrame:
    """Pages which declare more records than they returned."""
    declared = pages.select("source", "file", F.expr(vt.scalar_text("doc", total_path)).try_cast("bigint").alias("declared"))
    returned = records.groupBy(F.col("ingest_seq.file").alias("file")).agg(F.count("*").alias("returned"))
    short = declared.join(returned, "file", "left").fillna(0, ["returned"]).where("declared > returned")
    note = F.format_string("%d listings matched but %d returned", "declared", "returned")
    return short.select("source", "file", "declared", "returned", note.alias("note"))


def source_health(pages: DataFrame, records: DataFrame) -> DataFrame:
    """Per source: pages read, pages that could not be parsed, records; ``ok`` if every page could be."""
    by_page = pages.groupBy("source").agg(
        F.count("*").alias("pages"), F.count_if(F.col("doc").isNull()).alias("failed_pages"))
    by_record = records.groupBy("source").agg(F.count("*").alias("records"))
    joined = by_page.join(by_record, "source", "left").fillna(0, ["records"])
    return joined.withColumn("ok", F.col("failed_pages") == 0)


def page_outcomes(pages: DataFrame, records: DataFrame, sightings: DataFrame | None = None, total_path: str | None = None) -> DataFrame:
    """(source, file, kind, message): what went wrong on each page, long; a page without a fault has no row.

    ``unreadable``: the body is not JSON. ``empty``: it is, but holds no record. ``truncated``: it declares more records at
    ``total_path`` than it returned. ``unplaced``: records that the mapping dropped, as ``sightings`` lack them. Per page only
    counts are joined, never bodies.
    """
    declared = F.expr(vt.scalar_text("doc", total_path)).try_cast("bigint") if total_path else F.lit(None).cast("bigint")
    by_page = pages.select("source", "file", F.col("doc").isNull().alias("bad"), declared.alias("declared"))
    place = F.col("ingest_seq.file").alias("file")
    by_page = by_page.join(records.groupBy(place).agg(F.count("*").alias("returned")), "file", "left")
    if sightings is not None:
        by_page = by_page.join(sightings.groupBy(place).agg(F.count("*").alias("placed")), "file", "left")
    else:
        by_page = by_page.withColumn("placed", F.col("returned"))
    n, placed = F.coalesce("returned", F.lit(0)), F.coalesce("placed", F.lit(0))
    good = ~F.col("bad")
    faults = {
        "unreadable": (F.col("bad"), F.lit("the body is not JSON")),
        "empty": (good & (n == 0), F.lit("the page holds no record")),
        "truncated": (good & (F.col("declared") > n), F.format_string("%d listings matched but %d returned", "declared", n)),
        "unplaced": (good & (placed < n), F.format_string("%d of %d records have no address and no position", n - placed, n)),
    }
    each = [F.when(test, F.struct(F.lit(kind).alias("kind"), message.alias("message"))) for kind, (test, message) in faults.items()]
    return by_page.select("source", "file", F.inline(F.array_compact(F.array(*each))))


def outcome_health(pages: DataFrame, records: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per source: requests (pages), records, pages at fault by kind of outcome, and ``ok`` if every page could be read."""
    kinds = outcomes.groupBy("source").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("unreadable", "empty", "truncated", "unplaced")],
        F.count_if(F.col("kind") == "note").alias("notes"))
    asked = pages.groupBy("source").agg(F.count("*").alias("requests"))
    found = records.groupBy("source").agg(F.count("*").alias("records"))
    joined = asked.join(found, "source", "left").join(kinds, "source", "left")
    joined = joined.fillna(0, ["records", "unreadable", "empty", "truncated", "unplaced", "notes"])
    return joined.withColumn("ok", F.col("unreadable") == 0)
