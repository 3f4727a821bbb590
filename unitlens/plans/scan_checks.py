"""Registered queries over the real readers: the driver's tables are landed as JSON, XML and HTML files in the shared
folder and read back by the scans."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitlens.criteria import FallbackCriteria
from unitlens.operators import derive, enrich, merge, stats
from unitlens.operators.sinks import shared_folder, written
from unitlens.plans import driver_views as v
from unitlens.schema import conform
from unitlens.sources import field_maps as fm, registry
from unitlens.sources import landed, mapping

PER_PAGE = 100


def _land(spark: SparkSession, pages: DataFrame) -> str:
    """Write (page, body) as one file per page."""
    path = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    pages.select("page", F.col("body").alias("value")).repartition("page").write.partitionBy("page").text(path)
    return path


def _paged(rows: DataFrame, key: str, record: str, separator: str = ",") -> DataFrame:
    """(page, items): the records of each page as text, in the order of ``key``."""
    item = F.struct(F.col(key).alias("k"), F.expr(record).alias("r"))
    return rows.groupBy(F.expr(f"{key} div {PER_PAGE}").alias("page")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["r"]), separator).alias("items"))


def _body(pages: DataFrame, *forms: str) -> DataFrame:
    """``body`` from ``items`` in the form picked by the page's number."""
    return pages.select("page", v.one_of("page", *forms).alias("body"))


# --- listings ----------------------------------------------------------------------------------------------

def scan_search_pages(spark: SparkSession, d: str) -> DataFrame:
    """Search pages of a portal, with broken ones among them."""
    record = """to_json(named_struct('zpid', concat('z', c_custkey), 'address', concat(c_custkey, ' Bay Rd'),
        'unformattedPrice', 1000 + c_custkey, 'bedrooms', c_custkey % 5, 'latLong', named_struct('latitude', 25.5D, 'longitude', -80.25D)))"""
    pages = _body(_paged(v.table(spark, d, "customer"), "c_custkey", record),
                  """concat('{"props":[', items, '],"totalResultCount":5}')""", """concat('{"odd":{"list":[', items, ']}}')""",
                  "concat('<html>', items)")
    rows = landed.search_records(landed.read_pages(spark, _land(spark, pages), "rapidapi_zillow"), "props")
    mapped = mapping.map_payloads(rows, fm.ZILLOW, "rapidapi_zillow")
    return mapped.select("source_id", F.col("ingest_seq.pos").alias("pos"), "address", "price", "beds", "latitude", "longitude", "state")


def scan_structured_feed(spark: SparkSession, d: str) -> DataFrame:
    record = """to_json(named_struct('id', concat('f', c_custkey), 'addressLine1', concat(c_custkey, ' Bay Rd'), 'city', 'Surfside',
        'zipCode', '33154', 'bedrooms', c_custkey % 4, 'squareFootage', 500 + c_custkey % 900, 'price', 900 + c_custkey,
        'mlsNumber', concat('M', c_custkey), 'listingOffice', if(c_custkey % 2 = 0, named_struct('name', 'Office'), null)))"""
    pages = _body(_paged(v.table(spark, d, "customer"), "c_custkey", record),
                  "concat('[', items, ']')", """concat('{"listings":[', items, ']}')""", """concat('{"data":[', items, ',7]}')""")
    rows = mapping.map_structured_feed(landed.structured_feed_records(landed.read_pages(spark, _land(spark, pages), "feed")))
    return rows.select("source_id", F.col("ingest_seq.pos").alias("pos"), "address", "city", "zip_code", "beds", "sqft", "price", "broker")


def scan_feed(spark: SparkSession, d: str) -> DataFrame:
    """RSS files, one of four of them broken off in the middle."""
    record = """concat('<item rdf:about="x"><title>$', 1000 + p_partkey, ' / ', 1 + p_partkey % 4, 'br - ', 400 + p_partkey,
        'ft2 - Flat &amp; view (surfside)</title><link>https://s/x/', 1000000 + p_partkey, '.html</link><description>Nice</description>',
        '<dc:date>2026-01-01</dc:date></item>')"""
    head = """'<?xml version="1.0"?><rdf:RDF xmlns:rdf="r" xmlns:dc="d" xmlns="p"><channel><title>all</title></channel>'"""
    whole = f"concat({head}, items, '</rdf:RDF>')"
    pages = _body(_paged(v.table(spark, d, "part"), "p_partkey", record, ""), whole, whole, whole, f"concat({head}, items, '<item><title>x')")
    feed = landed.read_feed(spark, _land(spark, pages), "33154")
    rows = mapping.map_feed_items(feed)
    return rows.select("source_id", F.col("ingest_seq.pos").alias("pos"), "price", "beds", "sqft", "title", "city", "zip_code", "available_date")


def scan_card_pages(spark: SparkSession, d: str) -> DataFrame:
    """Cards with the spaces that portals use: U+00A0 and U+202F between number and unit."""
    record = """to_json(named_struct('address', concat(s_suppkey, ' Collins Ave'), 'price', concat('$', 1000 + s_suppkey, '/mo'),
        'details', array(concat(1 + s_suppkey % 4, ' bds'), concat(500 + s_suppkey, ' sqft')), 'url', concat('/h/', s_suppkey)))"""
    pages = _body(_paged(v.table(spark, d, "supplier"), "s_suppkey", record), """concat('{"listings":[', items, ']}')""", "concat('[', items, ']')")
    cards = landed.card_pages(landed.read_pages(spark, _land(spark, pages), "cards"))
    rows = mapping.map_payloads(mapping.card_records(cards, site="https://www.redfin.com"), fm.scraped(fm.REDFIN), "cards", need_both_coordinates=False)
    return rows.select("url", "address", "price", "beds", "sqft")


def scan_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Hand-made sightings: JSON lines, one array, and lines that are no JSON among them."""
    record = "to_json(named_struct('source', 'hand', 'source_id', cast(s_suppkey as string), 'price', s_suppkey, 'odd', 1))"
    table = v.table(spark, d, "supplier")
    lines = _body(_paged(table, "s_suppkey", record, "\n"), "concat(items, '\n', 'not json')", "items")
    arrays = _body(_paged(table, "s_suppkey", record.replace("'hand'", "'array'")), "concat('[', items, ']')")
    both = landed.read_canonical(spark, _land(spark, lines)).unionByName(landed.read_canonical(spark, _land(spark, arrays)))
    return both.select("source", "source_id", "price")


def mapped_with_casts(spark: SparkSession, d: str) -> DataFrame:
    """A field map of one's own, with parsers of one's own."""
    doc = F.parse_json(F.to_json(F.expr("named_struct('no', s_suppkey, 'where', concat(s_suppkey, ' Quay'), 'weekly', concat(s_suppkey, ' per week'))")))
    rows = v.table(spark, d, "supplier").select(doc.alias("item"))

    def weekly(said: Column) -> Column:
        return (F.regexp_extract(said, r"(\d+)", 1).cast("int") * 52 / 12).cast("int")

    mapped = mapping.map_payloads(rows, dict(source_id=("no",), address=("where",), price=("weekly",)), "own", need_both_coordinates=False,
                                  casts={"price": weekly, "status": lambda c: F.lit("open")})
    return mapped.select("source_id", "address", "price", "status", "source")


# --- register and models -----------------------------------------------------------------------------------

def scan_register_folios(spark: SparkSession, d: str) -> DataFrame:
    """Folio search hits and details, with members in any casing."""
    part = v.table(spark, d, "part")
    hit = """to_json(named_struct('Strap', 1, 'FOLIO', concat('30-', p_partkey), 'siteaddress', concat(p_partkey, ' COLLINS AVE'),
        'UNIT', if(p_partkey % 3 = 0, null, concat('#', p_partkey % 40))))"""
    hits = _body(_paged(part, "p_partkey", hit), """concat('{"MinimumPropertyInfos":[', items, ']}')""", """concat('{"results":[', items, ']}')""")
    detail = part.where("p_partkey % 4 <> 0").select(F.expr(f"p_partkey div {PER_PAGE}").alias("page"), F.expr("""to_json(named_struct('PropertyInfo',
        named_struct('FolioNumber', concat('30-', p_partkey), 'buildingheatedarea', 800 + p_size, 'YearBuilt', 1980 + p_size, 'Bedrooms', 2, 'UnitNo', 'D1')))""").alias("body"))
    # a detail is a response of its own; several are landed in a file of lines and read apart
    details = spark.read.text(_land(spark, detail)).select(F.input_file_name().alias("file"), F.try_parse_json("value").alias("doc"))
    rows = landed.register_from_search(landed.read_pages(spark, _land(spark, hits), "register"), details)
    return rows.select("folio", "site_address", "unit", "sqft", "year_built", "beds")


def scan_register_parcels(spark: SparkSession, d: str) -> DataFrame:
    record = """to_json(named_struct('attributes', named_struct('FOLIO', concat('P', p_partkey), 'TRUE_SITE_ADDR', concat(p_partkey, ' OCEAN DR'),
        'true_site_unit', cast(p_partkey % 7 as string), 'LIVING_AREA', 700 + p_size, 'YEAR_BUILT', 1975 + p_size, 'BEDROOMS', p_size % 4)))"""
    pages = _body(_paged(v.table(spark, d, "part"), "p_partkey", record), """concat('{"features":[', items, ']}')""")
    rows = landed.register_from_parcels(landed.read_pages(spark, _land(spark, pages), "parcels"))
    return rows.select("folio", "site_address", "unit", "sqft", "year_built", "beds", "source")


def scan_property_records(spark: SparkSession, d: str) -> DataFrame:
    record = """to_json(named_struct('id', concat('R', p_partkey), 'addressLine1', concat(p_partkey, ' Quay'), 'squareFootage', 600 + p_size,
        'yearBuilt', 1960 + p_size, 'bathrooms', 1.5D, 'propertyType', 'Condo'))"""
    pages = _body(_paged(v.table(spark, d, "part"), "p_partkey", record), "concat('[', items, ']')")
    rows = landed.register_from_property_records(landed.read_pages(spark, _land(spark, pages), "records"))
    return rows.select("folio", "site_address", "sqft", "year_built", "baths", "use_code")


def scan_valuations(spark: SparkSession, d: str) -> DataFrame:
    """Answers of both models; an answer whose code is not zero says nothing."""
    customers = v.table(spark, d, "customer")
    first = customers.select(F.expr(f"c_custkey div {PER_PAGE}").alias("page"), F.expr("""to_json(named_struct('key', concat('A', c_custkey),
        'rent', if(c_custkey % 3 = 0, null, 1000.4D + c_custkey), 'rentRangeLow', 900, 'price', 5000 + c_custkey, 'comparables', array(1, 2)))""").alias("body"))
    second = customers.select(F.expr(f"c_custkey div {PER_PAGE}").alias("page"), F.expr("""to_json(array(named_struct('key', concat('A', c_custkey),
        'property/value_rental', named_struct('api_code', if(c_custkey % 5 = 0, 204, 0), 'result', named_struct('value', named_struct('price_mean', 1, 'price', 2000 + c_custkey, 'price_upper', 9000))),
        'property/value', named_struct('api_code', 0, 'result', named_struct('value', named_struct('value', 300000 + c_custkey))))))""").alias("body"))

    def answers(pages: DataFrame, key: str) -> DataFrame:
        docs = spark.read.text(_land(spark, pages)).select(F.input_file_name().alias("file"), F.try_parse_json("value").alias("doc"))
        return docs.withColumn("address_key", F.expr(f"try_variant_get(doc, '{key}', 'string')"))

    rows = landed.valuations_from_models(answers(first, "$.key")).unionByName(landed.valuations_from_components(answers(second, "$[0].key")))
    return rows.select("provider", "address_key", "rent", "rent_low", "rent_high", "n_comps", "value")


def verify_with_parcels(spark: SparkSession, d: str) -> DataFrame:
    """Sighted units (so keys repeat) that the register does not know, looked up among parcels."""
    units = v.table(spark, d, "lineitem").select(
        F.expr("cast(l_orderkey * 10 + l_linenumber as string)").alias("source_id"), F.lit("p").alias("source"),
        F.expr("concat(l_suppkey % 40, ' Ocean Dr #', l_suppkey % 7, ', Surfside, FL 33154')").alias("address"),
        F.expr("if(l_linenumber % 2 = 0, 5000, null)").alias("sqft"))
    none = v.register(spark, d).where("false")
    identified = written(derive.derive_identity(conform(units)), "identified")
    rows = enrich.verify_units(identified, none, v.parcels(spark, d))
    return rows.select("source_id", "sqft", "county_folio", "county_sqft", "reg_match", "sqft_conflict", "sqft_filled")


# --- union, health, fallback -------------------------------------------------------------------------------

def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sightings of a primary and a fallback source, and the health of the configured ones, one of them skipped."""
    orders = v.table(spark, d, "orders")
    primary = conform(orders.where("o_orderkey % 2 = 0").select(F.lit("primary").alias("source"), F.expr("cast(o_orderkey as string)").alias("source_id")))
    fallback = conform(orders.where("o_orderkey % 2 = 1").select(F.lit("scraper").alias("source"), F.expr("cast(o_orderkey as string)").alias("source_id")))
    counted = primary.groupBy("source").agg(F.count("*").alias("records")).withColumns({"ok": F.lit(True), "skipped": F.lit(False)})
    failed = v.table(spark, d, "region").where("r_regionkey = 0").select(F.lit("portal").alias("source"), F.lit(0).cast("long").alias("records"),
                                                                         F.lit(False).alias("ok"), F.lit(False).alias("skipped"))
    skipped = stats.skipped_sources(spark, counted, ("primary", "no_key"))
    return primary, fallback, counted.unionByName(failed).unionByName(skipped)


def fallback_union(spark: SparkSession, d: str) -> DataFrame:
    """Half of the sources tried have failed, so the fallback's sightings join the pass."""
    primary, fallback, health = _sources(spark, d)
    rows = stats.with_fallback(primary, fallback, health, FallbackCriteria())
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("ids"))


def configured_health(spark: SparkSession, d: str) -> DataFrame:
    return _sources(spark, d)[2].select("source", "records", "ok", "skipped")


def union_sightings(spark: SparkSession, d: str) -> DataFrame:
    primary, fallback, _ = _sources(spark, d)
    return merge.union_sources(primary, fallback.drop("price")).select("source", "source_id", "price")


def ranged_scan(spark: SparkSession, d: str) -> DataFrame:
    """A range that holds rows, and one that holds none and is read unfiltered, with the note."""
    orders = v.table(spark, d, "orders")
    out = []
    for name, predicate in (("some", F.col("o_totalprice") > 1000), ("none", F.col("o_totalprice") < 0)):
        rows, note = landed.ranged_or_all(orders, predicate)
        out.append(rows.select(F.lit(name).alias("range"), "o_orderkey", F.lit(note).cast("string").alias("note")))
    return out[0].unionByName(out[1])


def registered_source(spark: SparkSession, d: str) -> DataFrame:
    """Two sources of one's own, read together by a range that one of them can be asked by, and by one that finds nothing."""
    def listed(rows: DataFrame) -> DataFrame:
        doc = "named_struct('no', p_partkey, 'where', concat(p_partkey, ' Quay'), 'rent', p_retailprice, 'rooms', p_size % 5)"
        return rows.select(F.parse_json(F.to_json(F.expr(doc))).alias("item"))

    registry.register_source(registry.Source(
        "quay", lambda s, path: v.table(s, path, "part"), dict(source_id=("no",), address=("where",), price=("rent",), beds=("rooms",)),
        listed, {"price": "p_retailprice"}), replace=True)
    registry.register_source(registry.Source(
        "desk", lambda s, path: v.table(s, path, "supplier").select(
            F.expr("cast(s_suppkey as string)").alias("source_id"), F.expr("concat(s_suppkey, ' Desk Row')").alias("address"))), replace=True)
    out = []
    for name, low in (("some", 910), ("none", 10_000_000)):
        rows, outcomes = registry.read_sources(spark, {"quay": d, "desk": d}, {"price": (low, None), "beds": (1, 3)})
        notes = outcomes.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("message")), "; ").alias("notes"))
        out.append(rows.join(notes, "source", "left").select(F.lit(name).alias("range"), "source", "source_id", "address", "price", "beds", "notes"))
    return out[0].unionByName(out[1])


def _faulty_pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, records and outcomes: some pages cut off, some that are no JSON, hold nothing, or records without a place."""
    doc = F.expr("""case when event_id % 6 = 0 then null when event_id % 10 = 5 then parse_json('{"total": 0}')
        when event_id % 10 = 3 then parse_json('[{"id": "x", "price": 5, "beds": 2}]') else doc end""")
    pages = v.event_payloads(spark, d).withColumn("doc", doc).drop("event_id")
    records = landed.aggregator_records(pages.withColumn("portal", F.col("source")))
    mapped = mapping.map_payloads(records, dict(source_id=("id",), address=("address",)), "any", need_both_coordinates=False)
    return pages, records.withColumnRenamed("portal", "source"), landed.page_outcomes(pages, records, mapped, "total")


def page_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _faulty_pages(spark, d)[2]


def outcome_health(spark: SparkSession, d: str) -> DataFrame:
    return landed.outcome_health(*_faulty_pages(spark, d))


QUERIES = {f.__name__: f for f in (
    scan_search_pages, scan_structured_feed, scan_feed, scan_card_pages, scan_canonical, mapped_with_casts, scan_register_folios,
    scan_register_parcels, scan_property_records, scan_valuations, verify_with_parcels, fallback_union, configured_health,
    union_sightings, ranged_scan, registered_source, page_outcomes, outcome_health)}
