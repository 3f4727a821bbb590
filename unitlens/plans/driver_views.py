"""Sightings, notes, payloads, register and valuations rendered from the driver's tables.

The tables hold no listings. Each view writes noisy inputs from clean keys with a fixed expression over the whole
table, so that what an operator should find is known from the keys alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores: a table comes in few row groups, and what is derived of a row costs far more than moving it."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, 1))


def one_of(key: str, *choices: str) -> Column:
    """The choice picked by ``key`` modulo their number. Choices are SQL expressions."""
    cases = " ".join(f"when {i} then {c}" for i, c in enumerate(choices))
    return F.expr(f"case ({key}) % {len(choices)} {cases} end")


LINE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")

DESCRIPTIONS = (
    "Annual lease, 6-12 months. Valet parking, concierge, oceanfront pool, spa and fitness center.",
    "NO short term rentals. Twelve month lease. Ocean views, gym, valet.",
    "Seasonal rental welcome. Direct ocean, pool, spa, concierge.",
    "Fully renovated. 24 month minimum. Sea view, sauna, doorman, terrace.",
    "Yearly only. City view, pool, valet, tennis court.",
    "",
)


def sightings(spark: SparkSession, d: str) -> DataFrame:
    """lineitem and part as sightings of the unit l_partkey by four portals."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    unit = "concat(1 + l_partkey % 40, 'B')"
    spelled = one_of("l_orderkey", f"concat('#', {unit})", f"concat('Apt ', {unit})",
                     "concat('Unit ', 1 + l_partkey % 40, '-B')", "concat('APT ', 1 + l_partkey % 40, ' b')")
    line = F.concat_ws(" ", F.expr("100 + l_partkey"), F.lit("Collins"),
                       one_of("l_linenumber", "'Ave'", "'Avenue'", "'AVE'"), spelled)
    city = one_of("l_suppkey", "'Bal Harbour'", "'bal harbor'", "'BALHARBOUR'")
    region = one_of("l_orderkey + l_linenumber", "'FL 33154'", "'FL 33154-2932'", "'florida 33154'")
    texts = ", ".join("'" + t + "'" for t in DESCRIPTIONS)
    return rows.select(
        F.expr("concat('portal_', l_suppkey % 4)").alias("source"),
        F.expr("concat(l_orderkey, '-', l_linenumber)").alias("source_id"),
        F.expr("concat('https://p', l_suppkey % 4, '/', l_orderkey)").alias("url"),
        F.concat_ws(", ", line, city, region).alias("address"),
        F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("city"),
        F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("zip_code"),
        F.expr("if(l_partkey % 11 = 0, null, 25.765D + (l_partkey % 200) * 0.001D)").alias("latitude"),
        F.expr("if(l_partkey % 11 = 0, null, -80.12D - (l_partkey % 7) * 0.002D)").alias("longitude"),
        one_of("l_partkey", "'Condo'", "'Apartment'", "''", "'Townhouse'").alias("property_type"),
        F.expr("if(l_linenumber = 7, null, cast(p_size % 5 as double))").alias("beds"),
        F.expr("cast(1 + p_size % 3 as double)").alias("baths"),
        F.expr("if(l_linenumber % 4 = 0, null, 600 + p_size * 40)").alias("sqft"),
        F.expr("if(l_linenumber = 5, null, 1985 + p_size)").alias("year_built"),
        F.expr("cast(floor(l_extendedprice / l_quantity) as int)").alias("price"),
        F.lit(None).cast("string").alias("available_date"), F.expr("cast(l_linenumber as int)").alias("days_on_market"),
        F.expr("if(l_suppkey % 4 = 0, 'Active', '')").alias("status"), F.lit("").alias("title"),
        F.expr(f"array({texts})[cast(l_partkey % {len(DESCRIPTIONS)} as int)]").alias("description"),
        F.expr("if(l_linenumber % 2 = 0, '', concat('broker ', l_suppkey))").alias("broker"),
        F.expr("array(concat('amenity ', l_linenumber), concat('Amenity ', l_suppkey % 3))").alias("amenities"),
        F.expr("array(concat('photo', l_linenumber % 4), concat('photo', l_suppkey % 4))").alias("photos"),
        "l_partkey", *LINE_ORDER)


def event_sightings(spark: SparkSession, d: str) -> DataFrame:
    """events as sightings of the unit user_id; some state no price."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("unit_key"), "event_id", F.col("event_id").alias("seq"), "ts",
        F.col("event_type").alias("source"),
        F.expr("if(event_id % 13 = 0, null, cast(floor(value * 100) as int))").alias("price"))


NOTE_SENTENCES = (
    "Available for a 6-12 month lease today", "rented six to twelve months at a time", "minimum 6 months maximum 12 months here",
    "annual lease only please", "strictly no short term stays", "seasonal rentals not permitted",
    "great vacation getaway with a pool", "daily and weekly rates", "24 month minimum with rooftop pool",
    "up to 12 months near the beach club", "two year lease and valet parking", "a quiet home with ocean views",
    "short-term ok but no airbnb", "lease term 8 months and a sauna",
)


def _sentence(key: str) -> Column:
    texts = ", ".join("'" + s + "'" for s in NOTE_SENTENCES)
    return F.expr(f"array({texts})[cast({key} % {len(NOTE_SENTENCES)} as int)]")


def order_notes(spark: SparkSession, d: str) -> DataFrame:
    """A sentence per order, in one of four spellings of case and spacing."""
    s = _sentence("o_orderkey")
    body = F.concat(F.lit("The host writes as follows. "), s, F.lit(". Come and see the lovely quiet place soon."))
    spelled = F.expr("o_orderkey % 4")
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.when(spelled == 0, body).when(spelled == 1, F.upper(body)).when(spelled == 2, F.replace(body, F.lit(" "), F.lit("  ")))
        .otherwise(F.concat(F.lit("<p>"), F.replace(body, F.lit(". "), F.lit(".</p><p>")))).alias("note"))


def document_notes(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents with a sentence put before and the text left as it is."""
    body = F.concat(F.lit("The host writes as follows. "), _sentence("doc_id"), F.lit(". Come and see the lovely quiet place soon. "), "text")
    return table(spark, d, "documents").select("doc_id", body.alias("note"))


def event_payloads(spark: SparkSession, d: str) -> DataFrame:
    """One response page per event, its two records in one of four envelopes."""
    r = ("named_struct('id', concat('r', event_id, '{n}'), 'price', {price}, 'address', concat(100 + event_id, ' Ocean Dr'), "
         "'details', named_struct('bedrooms', event_id % 5), 'remarks', concat('note ', event_id), 'tags', "
         "array(concat('Tag', event_id % 3), concat('tag', event_id % 2)))")
    recs = f"array({r.format(n='a', price='event_id + 1000')}, {r.format(n='b', price='event_id + 2000')})"
    page = one_of("event_id", f"to_json(named_struct('listings', {recs}, 'total', 5))",
                  f"to_json(named_struct('data', named_struct('results', {recs})))", f"to_json({recs})",
                  f"to_json(named_struct('odd', named_struct('noise', array(1, 2, 3), 'deep', named_struct('x', {recs}))))")
    return spread(table(spark, d, "events").select("event_id", "event_type")).select(
        "event_id", F.col("event_type").alias("source"), F.lit(0).alias("priority"),
        F.expr("concat('page-', event_id)").alias("file"), page.alias("body")).withColumn("doc", F.try_parse_json("body"))


def html_payloads(spark: SparkSession, d: str) -> DataFrame:
    """The raw pages with a state script put into them, by page_id one of three kinds or none."""
    rec = "named_struct('zpid', concat('z', page_id), 'price', page_id + 5000, 'address', concat(page_id + 1, ' Bay Rd'))"
    state = f"to_json(named_struct('a', named_struct('list', array_repeat({rec}, cast(1 + page_id % 3 as int)))))"
    script = one_of("page_id", f"""concat('<script id="__NEXT_DATA__" type="application/json">', {state}, '</script>')""",
                    f"concat('<script>window.__INITIAL_STATE__ = ', {state}, ';</script>')",
                    f"""concat('<script type="application/ld+json">', {state}, '</script>')""", "''")
    return table(spark, d, "pages").select(
        "page_id", F.lit("scraped").alias("source"), F.lit(0).alias("priority"),
        F.expr("concat('html-', page_id)").alias("file"), F.concat("html", script).alias("body"))


def feed_items(spark: SparkSession, d: str) -> DataFrame:
    """Feed titles from orders in four forms of the title grammar."""
    price, beds, sqft = "1000 + o_custkey", "1 + o_orderkey % 4", "300 + o_orderkey % 2000"
    title = one_of("o_orderkey", f"concat('$', format_number({price}, 0), ' / ', {beds}, 'br - ', {sqft}, 'ft2 - Sunny flat (surfside)')",
                   f"concat('$', {price}, ' - Sunny flat')", f"concat({beds}, 'br - Sunny flat (bal harbour)')", "'Sunny flat'")
    return table(spark, d, "orders").select(
        "o_orderkey", title.alias("title"), F.expr("concat('https://s/x/', 1000000 + o_orderkey, '.html')").alias("link"),
        F.lit("Nice place").alias("description"), F.lit("2026-01-01").alias("date"), F.lit("33154").alias("scan_zip"))


def order_units(spark: SparkSession, d: str) -> DataFrame:
    """orders as resolved units: every attribute is arithmetic on the key."""
    texts = ", ".join("'" + t + "'" for t in DESCRIPTIONS)
    k = "o_orderkey"
    return spread(table(spark, d, "orders").select(k, "o_custkey", "o_totalprice", "o_orderdate")).select(
        F.col(k).alias("unit_no"), F.lit("orders").alias("source"), F.expr(f"cast({k} as string)").alias("source_id"),
        F.lit(None).cast("string").alias("url"), F.expr(f"concat(100 + {k}, ' Collins Ave #', 1 + {k} % 9, 'C')").alias("address"),
        F.lit(None).cast("string").alias("unit"),
        one_of(k, "'Surfside'", "'Miami Beach'", "'Bal Harbour'", "'Miami'", "'Aventura'").alias("city"),
        F.expr(f"if({k} % 17 = 0, 'GA', 'FL')").alias("state"),
        F.expr(f"if({k} % 2 = 0, '33140', '33180')").alias("zip_code"),
        F.expr(f"if({k} % 13 = 0, null, 25.75D + ({k} % 230) * 0.001D)").alias("latitude"),
        F.expr(f"if({k} % 13 = 0, null, -80.118D - ({k} % 9) * 0.003D)").alias("longitude"),
        one_of(k, "'Condo'", "'Apartment'", "'Townhouse'", "'Boat'", "''", "'condominium'", "'Condo'").alias("property_type"),
        F.expr(f"if({k} % 19 = 0, null, cast(1 + {k} % 4 as double))").alias("beds"),
        F.expr(f"if({k} % 23 = 0, null, 1 + ({k} % 5) * 0.5D)").alias("baths"),
        F.expr(f"if({k} % 29 = 0, null, cast(900 + ({k} % 40) * 50 as int))").alias("sqft"),
        F.expr(f"if({k} % 31 = 0, null, cast(1990 + {k} % 35 as int))").alias("year_built"),
        F.expr(f"if({k} % 37 = 0, null, cast(floor(4000 + o_totalprice / 50) as int))").alias("price"),
        F.lit(None).cast("string").alias("available_date"), F.expr(f"cast({k} % 60 as int)").alias("days_on_market"),
        F.lit("").alias("status"), F.lit("").alias("title"),
        F.expr(f"array({texts})[cast({k} % {len(DESCRIPTIONS)} as int)]").alias("description"),
        F.expr(f"if({k} % 3 = 0, '', concat('Broker ', o_custkey))").alias("broker"),
        F.array().cast("array<string>").alias("amenities"), F.array().cast("array<string>").alias("photos"),
        F.col("o_orderdate").cast("timestamp").alias("fetched_at"), "o_custkey", F.col(k).alias("ingest_seq"))


def register(spark: SparkSession, d: str) -> DataFrame:
    """part as register rows: per street the unit's own row, a neighbour, or a row with the unit in its address."""
    rows = table(spark, d, "part").withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    own = F.expr("i = 1 and p_partkey % 3 = 0")
    folded = F.expr("i = 2 and p_partkey % 3 = 1")
    return rows.select(
        F.expr("concat('F', p_partkey, '-', i)").alias("folio"),
        F.when(folded, F.expr("concat(100 + p_partkey, ' COLLINS AVE ', 1 + p_partkey % 40, 'B')"))
        .otherwise(F.expr("concat(100 + p_partkey, ' COLLINS AVE')")).alias("site_address"),
        F.when(own, F.expr("concat(1 + p_partkey % 40, ' B')")).when(folded, F.lit(None)).otherwise(F.expr("concat('X', i)")).alias("unit"),
        F.expr("cast(700 + p_size * 30 + i * 100 as int)").alias("sqft"),
        F.expr("if(p_partkey % 5 = 0, null, cast(1980 + p_size + i as int))").alias("year_built"),
        F.expr("cast(i + 1 as double)").alias("beds"), F.lit(1.0).alias("baths"), F.lit("condo").alias("use_code"),
        F.lit("register").alias("source"), F.expr("p_partkey * 3 + i").alias("reg_seq"))


def parcels(spark: SparkSession, d: str) -> DataFrame:
    """supplier as parcels whose address holds a street line somewhere."""
    return table(spark, d, "supplier").select(
        F.expr("concat('P', s_suppkey)").alias("folio"),
        F.expr("concat(if(s_suppkey % 2 = 0, 'TOWER ', ''), s_suppkey, ' OCEAN DRIVE ', s_suppkey % 7)").alias("site_address"),
        F.expr("cast(s_suppkey % 7 as string)").alias("unit"), F.expr("cast(800 + s_suppkey as int)").alias("sqft"),
        F.expr("cast(1990 + s_suppkey % 30 as int)").alias("year_built"), F.lit(None).cast("double").alias("beds"),
        F.lit(None).cast("double").alias("baths"), F.lit(None).cast("string").alias("use_code"),
        F.lit("parcels").alias("source"), F.col("s_suppkey").alias("reg_seq"))


def valuations(spark: SparkSession, d: str) -> DataFrame:
    """customer as model answers for the address of order units, keyed as each provider is asked."""
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    first = rows.where("c_custkey % 3 <> 0").select(
        F.lit("rentcast").alias("provider"), F.expr("concat(100 + c_custkey, ' Main St #7, Surfside, FL, 33154')").alias("address_key"),
        F.expr("cast(floor(c_acctbal) as int)").alias("rent"), F.expr("cast(floor(c_acctbal * 0.9D) as int)").alias("rent_low"),
        F.expr("cast(floor(c_acctbal * 1.1D) as int)").alias("rent_high"), F.lit(0).alias("n_comps"),
        F.expr("if(c_custkey % 5 = 0, null, cast(floor(c_acctbal * 200) as int))").alias("value"))
    second = rows.where("c_custkey % 2 = 0").select(
        F.lit("housecanary").alias("provider"), F.expr("concat(100 + c_custkey, ' Main St Unit 7|33154')").alias("address_key"),
        F.expr("cast(floor(c_acctbal) + 500 as int)").alias("rent"), F.lit(None).cast("int").alias("rent_low"),
        F.lit(None).cast("int").alias("rent_high"), F.lit(0).alias("n_comps"),
        F.expr("cast(floor(c_acctbal * 150) as int)").alias("value"))
    return first.unionByName(second)
