import json

import pytest
from pyspark.sql import functions as F

from unitlens.functions import variant as vt
from unitlens.sources import field_maps as fm
from unitlens.sources import landed, mapping

SEARCH = {"props": [
    {"zpid": "1", "detailUrl": "/homedetails/1_zpid/", "address": "418 Heron Quay #7B, Port Linden, FL 34001",
     "price": "$4,275/mo", "bedrooms": 3, "bathrooms": 1.5, "livingArea": 1130, "propertyType": "CONDO",
     "latitude": 26.4310, "longitude": -80.0712, "imgSrc": "https://p/a.jpg"},
    {"zpid": "2", "address": "22 Tern Walk #3, Port Linden, FL 34002", "price": -5, "bedrooms": "Studio"},
    {"zpid": "3", "price": 1}], "totalPages": 1, "totalResultCount": 5}
DETAIL = {"zpid": "1", "yearBuilt": 1993, "description": "Eight rooms on two floors.",
          "resoFacts": {"leaseTerm": "Spring", "associationAmenities": ["Bicycle Room", "Library", "library"]},
          "photos": [{"mixedSources": {"jpeg": [{"url": "https://p/d1.jpg"}]}}]}
REALTOR = {"data": {"home_search": {"results": [{
    "property_id": "M4", "permalink": "418-Heron", "list_price": 4275,
    "description": {"beds": 2, "baths": 2.5, "sqft": 1130, "type": "condos", "year_built": 1993, "text": "Stairs, no lift."},
    "location": {"address": {"line": "418 Heron Quay", "unit": "7B", "city": "Port Linden", "state_code": "FL",
                             "postal_code": "34001", "coordinate": {"lat": 26.431, "lon": -80.0712}}},
    "primary_photo": {"href": "https://r/x.jpg"}, "tags": ["corner_flat", "garage"],
    "branding": [{"name": "Lark & Sons"}]}]}}}


def docs(spark, *values):
    rows = [(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, j string").repartition(3)
    return df.select("i", F.try_parse_json("j").alias("doc"))


def one(spark, value, column):
    return docs(spark, value).select(column).first()[0]


def test_paths(spark):
    payload = {"a": {"b": [{"c": 1}, {"c": 2}]}, "beds": 2, "x": "", "y": []}
    assert one(spark, payload, F.expr(vt.scalar_text("doc", "a.b[1].c"))) == "2"
    assert one(spark, payload, F.expr(vt.scalar_text("doc", "a.b[9].c"))) is None
    assert one(spark, payload, F.expr(vt.scalar_text("doc", "a.missing.c"))) is None
    assert one(spark, payload, vt.first_text("doc", ["x", "y", "a", "beds"])) == "2"


def test_array_discovery_by_shape(spark):
    records = REALTOR["data"]["home_search"]["results"]
    listing = {"id": "1", "address": "418 Heron Quay", "price": 3300}
    table = [
        ({"status": "ok", "payload": {"v9": {"listingResults": records}}}, 1),
        ({"odd": {"shape": {"x": [listing]}}}, 1),
        ({"small": [listing], "big": [listing, listing], "noise": [{"k": 1}] * 9}, 2),
        ({"a": {"b": [1, 2, [listing]]}}, 1),
        ({"nothing": [1, 2]}, 0),
    ]
    got = docs(spark, *[t for t, _ in table]).orderBy("i").select(F.size(vt.find_result_array("doc"))).collect()
    assert [r[0] for r in got] == [n for _, n in table]


def test_envelopes(spark):
    listing = {"id": "1", "address": "418 Heron Quay", "price": 3300}
    shapes = [{"listings": [listing]}, {"data": {"results": [listing]}}, [listing],
              {"odd": {"shape": {"x": [listing]}}}, {"listings": []}, "not json"]
    got = docs(spark, *shapes).orderBy("i").select(F.size(vt.enveloped_records("doc"))).collect()
    assert [r[0] for r in got][:5] == [1, 1, 1, 1, 0] and got[5][0] in (None, 0, -1)


def test_scattered_text_and_strings(spark):
    text = one(spark, DETAIL, vt.scattered_text("doc", ["description", "leaseTerm"]))
    assert text == "Eight rooms on two floors. . Spring"
    assert one(spark, DETAIL, vt.collect_strings("doc", fm.ZILLOW["photos"])) == ["https://p/d1.jpg"]
    assert one(spark, DETAIL, vt.collect_strings("doc", fm.ZILLOW["amenities"])) == ["Bicycle Room", "Library"]


def test_nothing_is_cut(spark):
    deep = {"description": {"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": "far down"}}}}}}}}}
    assert one(spark, deep, vt.scattered_text("doc", ["description"])) == "far down"
    nested = {"description": "x"}
    for _ in range(40):
        nested = {"k": [nested]}
    assert one(spark, nested, vt.scattered_text("doc", ["description"])) == "x"
    assert one(spark, {"description": "y" * 9000}, F.length(vt.scattered_text("doc", ["description"]))) == 9000
    photos = {"imgSrc": [f"p{i}" for i in range(60)]}
    assert len(one(spark, photos, vt.collect_strings("doc", ["imgSrc"]))) == 60
    plain = [{"k": 1}] * 6 + [{"price": 1, "address": "a", "beds": 2}]
    assert one(spark, {"l": plain}, F.size(vt.find_result_array("doc"))) == 7


def test_portal_mapping(spark):
    items = docs(spark, SEARCH).select(F.explode(vt.find_result_array("doc")).alias("item"))
    rows = mapping.map_payloads(items, fm.ZILLOW, "rapidapi_zillow", site="https://www.zillow.com").orderBy("source_id").collect()
    assert len(rows) == 2                       # the third has neither an address nor a position
    a, b = rows
    assert (a["price"], a["beds"], a["baths"], a["sqft"]) == (4275, 3.0, 1.5, 1130)
    assert a["url"] == "https://www.zillow.com/homedetails/1_zpid/" and a["photos"] == ["https://p/a.jpg"]
    assert (b["price"], b["beds"], b["state"]) == (None, 0.0, "FL")


def test_nested_portal_mapping(spark):
    items = docs(spark, REALTOR).select(F.explode(vt.find_result_array("doc")).alias("item"))
    r = mapping.map_payloads(items, fm.REALTOR, "rapidapi_realtor").first()
    assert (r["price"], r["city"], r["unit"], r["broker"], r["zip_code"]) == (4275, "Port Linden", "7B", "Lark & Sons", "34001")
    assert r["amenities"] == ["corner_flat", "garage"] and r["description"] == "Stairs, no lift."


def test_detail_overlay(spark):
    items = docs(spark, SEARCH).select(F.explode(vt.find_result_array("doc")).alias("item"))
    rows = mapping.map_payloads(items, fm.ZILLOW, "rapidapi_zillow")
    details = docs(spark, DETAIL).select(F.lit("rapidapi_zillow").alias("source"), F.lit("1").alias("source_id"), F.col("doc").alias("detail"))
    a = mapping.overlay_details(rows, details, fm.ZILLOW).where("source_id = '1'").first()
    assert a["year_built"] == 1993 and "Eight rooms" in a["description"]
    assert a["photos"] == ["https://p/a.jpg", "https://p/d1.jpg"] and a["amenities"] == ["Bicycle Room", "Library"]


@pytest.fixture
def land(tmp_path):
    def write(name, body):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(body if isinstance(body, str) else json.dumps(body))
        return str(target.parent)
    return write


def test_landed_pages_and_truncation(spark, land):
    land("z/a.json", SEARCH)
    path = land("z/b.json", "<html>blocked</html>")
    pages = landed.read_pages(spark, path, "rapidapi_zillow")
    records = landed.search_records(pages, "props")
    assert records.count() == 3
    note = landed.truncation_notes(pages, records, "totalResultCount").first()
    assert note["note"] == "5 listings matched but 3 returned"
    health = landed.source_health(pages, records.withColumn("source", F.lit("rapidapi_zillow"))).first()
    assert (health["pages"], health["failed_pages"], health["records"], health["ok"]) == (2, 1, 3, False)


RSS1 = """<?xml version="1.0" encoding="UTF-8"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"
         xmlns:dc="http://purl.org/dc/elements/1.1/">
  <item rdf:about="https://s/d/x/8830021457.html">
    <title>$4,275 / 3br - 1130ft2 - Two balconies over the canal (port linden)</title>
    <link>https://s/d/x/8830021457.html</link>
    <description>Quiet house, ask for the key.</description>
    <dc:date>2025-03-02T17:40:00-05:00</dc:date>
  </item></rdf:RDF>"""
RSS2 = """<?xml version="1.0"?><rss version="2.0"><channel><item>
    <title>$2,960 / 1br - 615ft2 - Loft by the old mill (marsh end)</title>
    <link>https://s/d/z/page</link><description>Nine windows.</description>
    <pubDate>Sun, 02 Mar 2025 18:00:00 -0500</pubDate></item></channel></rss>"""


def test_feeds(spark, land):
    land("f/1.xml", RSS1)
    land("f/2.xml", RSS2)
    path = land("f/3.xml", "<not xml at all")
    rows = mapping.map_feed_items(landed.read_feed(spark, path, "34001")).orderBy("source_id").collect()
    assert [(r["price"], r["beds"], r["sqft"], r["source_id"], r["city"], r["zip_code"]) for r in rows] == [
        (4275, 3.0, 1130, "8830021457", "port linden", "34001"),
        (2960, 1.0, 615, "https://s/d/z/page", "marsh end", "34001")]
    assert rows[0]["title"] == "Two balconies over the canal"
    assert rows[0]["available_date"].startswith("2025-03-02") and rows[1]["available_date"].startswith("Sun")


LATER = """<html><script>window.__INITIAL_STATE__ = {"a": [{"zpid": "1", "price": 5, "address": "9 A St"}]};(function(){run();}());</script></html>"""
HTML = """<!doctype html><html><body><script id="__NEXT_DATA__" type="application/json">
{"props":{"s":{"listResults":[{"zpid":"5507","address":"1650 Plover Pier #40, Marsh End, FL 34004",
 "unformattedPrice":6140,"beds":2,"baths":2.5,"area":1380,"detailUrl":"/homedetails/5507_zpid/",
 "hdpData":{"homeInfo":{"livingArea":1380,"homeType":"CONDO","zipcode":"34004","city":"Marsh End"}}}]}}}
</script></body></html>"""
LD = """<html><script type="application/ld+json">[{"@type":"Apartment","address":"1 A St","price":5},{"x":1}]</script></html>"""


def test_embedded_state(spark, land):
    land("h/1.html", HTML)
    land("h/2.html", LD)
    land("h/3.html", "<html>nothing</html>")
    land("h/5.html", LATER)
    path = land("h/4.html", json.dumps(SEARCH))
    recs = landed.html_records(landed.read_bodies(spark, path, "s"))
    by_file = {r[0].rsplit("/", 1)[1]: r[1] for r in recs.groupBy("ingest_seq.file").count().collect()}
    assert by_file == {"1.html": 1, "2.html": 2, "4.html": 3, "5.html": 1}
    r = mapping.map_payloads(
        recs.where("ingest_seq.file like '%1.html'"), fm.scraped(fm.ZILLOW), "scrapingbee_zillow",
        site="https://www.zillow.com", need_both_coordinates=False).first()
    assert (r["price"], r["sqft"], r["city"]) == (6140, 1380, "Marsh End")


def test_cards(spark, land):
    path = land("c/1.json", {"listings": [{
        "address": "77 Gull Row #12, Marsh End, FL 34003", "price": "$2,960/mo",
        "details": ["4 bds", "3 ba", "2,015 sqft"], "url": "/FL/y/home/889", "photo": "https://p/x.jpg"}]})
    cards = landed.card_pages(landed.read_pages(spark, path, "scrapingbee_redfin"))
    items = mapping.card_records(cards, site="https://www.redfin.com")
    r = mapping.map_payloads(items, fm.scraped(fm.REDFIN), "scrapingbee_redfin", need_both_coordinates=False).first()
    assert (r["price"], r["beds"], r["baths"], r["sqft"]) == (2960, 4.0, 3.0, 2015)
    assert r["url"] == "https://www.redfin.com/FL/y/home/889" and r["photos"] == ["https://p/x.jpg"]


def test_structured_feed(spark, land):
    path = land("r/1.json", [{
        "id": "a", "addressLine1": "418 Heron Quay", "addressLine2": "Apt 7B", "city": "Port Linden", "state": "FL",
        "zipCode": "34001", "latitude": 26.431, "longitude": -80.0712, "propertyType": "Condo", "bedrooms": 2,
        "bathrooms": 1.5, "squareFootage": 1130, "yearBuilt": 1993, "price": 4275, "daysOnMarket": 6,
        "listingOffice": {"name": "Lark & Sons"}, "mlsNumber": "Q58"}, {"id": "b"}])
    rows = mapping.map_structured_feed(landed.structured_feed_records(landed.read_pages(spark, path, "x"))).collect()
    assert len(rows) == 1 and rows[0]["broker"] == "Lark & Sons (MLS Q58)" and rows[0]["baths"] == 1.5


def test_register_and_valuation_scans(spark, land):
    s = land("s/1.json", {"MinimumPropertyInfos": [
        {"Folio": "40-1198-007-0310", "SiteAddress": "418 HERON QUAY", "Unit": "7B"},
        {"folio": "40-1198-007-0320", "siteaddress": "418 HERON QUAY", "UNIT": "7C"}]})
    d = land("d/1.json", {"PropertyInfo": {"Folio": "4011980070310", "BuildingHeatedArea": 905,
                                           "BuildingEffectiveArea": 1260, "YearBuilt": 1988, "BedroomCount": 2}})
    reg = landed.register_from_search(landed.read_pages(spark, s, "r"), landed.read_pages(spark, d, "r"))
    rows = reg.orderBy("folio").collect()
    assert [(r["folio"], r["unit"], r["sqft"], r["year_built"]) for r in rows] == [
        ("4011980070310", "7B", 905, 1988), ("4011980070320", "7C", None, None)]
    g = land("g/1.json", {"features": [{"attributes": {"FOLIO": "1", "TRUE_SITE_ADDR": "418 HERON QUAY",
                                                       "TRUE_SITE_UNIT": "7B", "BLDG_EFFECTIVE_AREA": 1015, "YEAR_BUILT": 1988}}]})
    r = landed.register_from_parcels(landed.read_pages(spark, g, "g")).first()
    assert (r["sqft"], r["unit"], r["source"]) == (1015, "7B", "miamidade_gis")
    v = docs(spark, {"rent": 3725, "rentRangeLow": 3400, "rentRangeHigh": 4050, "comparables": [{}, {}, {}]},
             {"price": 612000}).withColumn("address_key", F.lit("k"))
    got = landed.valuations_from_models(v).orderBy("value").collect()
    assert (got[0]["rent"], got[0]["n_comps"], got[0]["value"], got[1]["value"]) == (3725, 3, None, 612000)
    m = docs(spark, [{"property/value_rental": {"api_code": 0, "result": {"value": {"price": 3810}}},
                      "property/value": {"api_code": 204, "result": {"value": {"price": 1}}}}]).withColumn("address_key", F.lit("k"))
    r = landed.valuations_from_components(m).first()
    assert (r["rent"], r["value"]) == (3810, None)


def test_range_falls_back_to_all(spark):
    df = spark.range(5)
    assert landed.ranged_or_all(df, F.col("id") > 2)[0].count() == 2
    all_rows, note = landed.ranged_or_all(df, F.col("id") > 20)
    assert all_rows.count() == 5 and note


def test_hand_made_files_of_every_layout(spark, tmp_path):
    files = {
        "lines.json": '{"source": "a", "price": 1}\r\n\n not json\n7\n{"source": "b", "price": 2}',
        "spread.json": ' \n{\n  "source": "c",\n  "price": 3,\n  "photos": [\n    "x"\n  ]\n}\n',
        "array.json": '\t[{"source": "d"},\n {"source": "e"}]',
        "one.json": '{"source": "f", "odd": {"k": 1}}',
        "torn.json": '{"source": "g", \n{"source": "h"}\n',
        "remark.json": '# by hand\n{"source": "i"}\n',
        "empty.json": "", "blank.json": "\n \n",
    }
    for name, body in files.items():
        (tmp_path / name).write_bytes(body.encode())
    rows = landed.read_canonical(spark, str(tmp_path)).collect()
    assert sorted((r.source, r.price) for r in rows if r.price) == [("a", 1), ("b", 2), ("c", 3)]
    assert sorted(r.source for r in rows) == ["a", "b", "c", "d", "e", "f", "h", "i"]
    assert [r.photos for r in rows if r.source == "c"] == [["x"]]


def test_a_long_file_of_lines_is_many_tasks(spark, tmp_path):
    (tmp_path / "long.json").write_text("".join(f'{{"source": "s", "price": {i}}}\n' for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = landed.read_canonical(spark, str(tmp_path))
        tasks = rows.select(F.spark_partition_id().alias("task"), "price").groupBy("task").agg(F.count("*").alias("n"), F.sum("price").alias("s")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(tasks) > 4 and sum(t.n for t in tasks) == 20_000 and sum(t.s for t in tasks) == sum(range(20_000))
