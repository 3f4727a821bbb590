"""The same answers in plain SQL, worked out from the clean keys and never by parsing.

A query renders noisy text from keys and reads it back; the SQL here starts from the keys, so a wrong parser shows
as a difference.
"""

from __future__ import annotations

from unitlens import fixed_values as fv
from unitlens.plans import driver_views as v


def _haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (f"pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * "
         f"pow(sin(radians({lon2} - ({lon1})) / 2), 2)")
    return f"asin(sqrt({a})) * {2 * fv.EARTH_RADIUS_MILES}"


_SEGMENTS = "segments(la, oa, lb, ob) AS (VALUES " + ", ".join(
    f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(fv.SHORELINE, fv.SHORELINE[1:])) + ")"


def _with_miles(source: str, key: str) -> str:
    """CTEs: segments and ``miles(key, miles)`` for a relation with latitude and longitude."""
    legs = f"""legs AS (
        SELECT {key}, latitude, longitude, la, oa, lb, ob, cos(radians((la + lb) / 2)) AS sc FROM {source}, segments
        WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND NOT (latitude = 0 AND longitude = 0)),
    feet AS (SELECT *, greatest(0.0, least(1.0, ((longitude * sc - oa * sc) * (ob * sc - oa * sc) + (latitude - la) * (lb - la))
             / ((ob * sc - oa * sc) * (ob * sc - oa * sc) + (lb - la) * (lb - la)))) AS f FROM legs),
    miles AS (SELECT {key}, min({_haversine('latitude', 'longitude', '(f * (lb - la) + la)', '((f * (ob * sc - oa * sc) + oa * sc) / sc)')})
              AS miles FROM feet GROUP BY {key})"""
    return f"{_SEGMENTS}, {legs}"


_LINES = f"""lines AS (
    SELECT l.*, p_size, row_number() OVER (ORDER BY {', '.join(v.LINE_ORDER)}) AS seq,
           dense_rank() OVER (PARTITION BY l_partkey ORDER BY {', '.join(v.LINE_ORDER)}) AS place,
           'portal_' || (l_suppkey % 4) AS source, l_orderkey || '-' || l_linenumber AS source_id,
           'https://p' || (l_suppkey % 4) || '/' || l_orderkey AS url,
           CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE 'broker ' || l_suppkey END AS broker,
           CASE WHEN l_suppkey % 4 = 0 THEN 'Active' END AS status,
           CASE WHEN l_linenumber <> 7 THEN (p_size % 5)::DOUBLE END AS beds, (1 + p_size % 3)::DOUBLE AS baths,
           CASE WHEN l_linenumber % 4 <> 0 THEN 600 + p_size * 40 END AS sqft,
           CASE WHEN l_linenumber <> 5 THEN 1985 + p_size END AS year_built, l_linenumber AS days_on_market,
           CASE WHEN l_partkey % 11 <> 0 THEN 25.765::DOUBLE + (l_partkey % 200) * 0.001::DOUBLE END AS latitude,
           CAST(floor(l_extendedprice / l_quantity) AS INTEGER) AS price
    FROM lineitem l JOIN part ON l_partkey = p_partkey)"""

_TEMPLATES = len(v.NOTE_SENTENCES)


def _by_template(key: str, table: dict[int, str], other: str = "NULL") -> str:
    return f"CASE {key} % {_TEMPLATES} " + " ".join(f"WHEN {k} THEN {x}" for k, x in table.items()) + f" ELSE {other} END"


def _lease(table: str, key: str) -> str:
    low = {0: "6", 1: "6", 2: "6", 3: "12", 8: "24", 10: "24", 13: "8"}
    high = {0: "12", 1: "12", 2: "12", 3: "12", 9: "12", 10: "24", 13: "8"}
    how = {0: "'range'", 1: "'range'", 2: "'range'", 3: "'phrase'", 8: "'min'", 9: "'max'", 10: "'years'", 13: "'exact'"}
    return (f"SELECT {key}, {_by_template(key, low)} AS min_months, {_by_template(key, high)} AS max_months, "
            f"{_by_template(key, how)} AS evidence FROM {table}")


def _scan(table: str, key: str) -> str:
    hits = {6: "'vacation'", 7: "'daily|weekly'"}
    negated = {4: "'short term|short-term'", 5: "'seasonal'", 12: "'short term|short-term|airbnb|air bnb'"}
    return (f"SELECT {key}, {_by_template(key, hits, chr(39) * 2)} AS hits, "
            f"{_by_template(key, negated, chr(39) * 2)} AS negated FROM {table}")


def _categories(table: str, key: str) -> str:
    found = {6: "'pool=pool'", 8: "'pool=pool|rooftop pool'", 9: "'beach_service=beach club'", 10: "'valet=valet|valet parking'",
             11: "'ocean_view=ocean views'", 13: "'spa=sauna'"}
    return f"SELECT {key}, {_by_template(key, found, chr(39) * 2)} AS categories FROM {table}"


# --- constraints over order units ------------------------------------------------------------------------------

_K = "o_orderkey"
_UNITS = f"""units AS (
    SELECT {_K} AS unit_no, o_custkey, o_orderdate, {_K} % 6 AS t,
           CASE {_K} % 5 WHEN 0 THEN 'Surfside' WHEN 1 THEN 'Miami Beach' WHEN 2 THEN 'Bal Harbour' WHEN 3 THEN 'Miami' ELSE 'Aventura' END AS city,
           CASE WHEN {_K} % 17 = 0 THEN 'GA' ELSE 'FL' END AS state, CASE WHEN {_K} % 2 = 0 THEN '33140' ELSE '33180' END AS zip_code,
           CASE WHEN {_K} % 13 <> 0 THEN 25.75::DOUBLE + ({_K} % 230) * 0.001::DOUBLE END AS latitude,
           CASE WHEN {_K} % 13 <> 0 THEN -80.118::DOUBLE - ({_K} % 9) * 0.003::DOUBLE END AS longitude,
           CASE {_K} % 7 WHEN 1 THEN 'Apartment' WHEN 2 THEN 'Townhouse' WHEN 3 THEN 'Boat' WHEN 4 THEN NULL WHEN 5 THEN 'condominium' ELSE 'Condo' END AS ptype,
           CASE WHEN {_K} % 19 <> 0 THEN (1 + {_K} % 4)::DOUBLE END AS beds, CASE WHEN {_K} % 23 <> 0 THEN 1 + ({_K} % 5) * 0.5::DOUBLE END AS baths,
           CASE WHEN {_K} % 29 <> 0 THEN CAST(900 + ({_K} % 40) * 50 AS INTEGER) END AS sqft,
           CASE WHEN {_K} % 31 <> 0 THEN CAST(1990 + {_K} % 35 AS INTEGER) END AS year_built,
           CASE WHEN {_K} % 37 <> 0 THEN CAST(floor(4000 + o_totalprice / 50) AS INTEGER) END AS price
    FROM orders)"""


def _num(c: str) -> str:
    return f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"


def _group(c: str) -> str:
    return f"format('{{:,}}', CAST({c} AS BIGINT))"


_IN_BOX = "coalesce(latitude BETWEEN 25.75 AND 25.975 AND longitude BETWEEN -80.16 AND -80.11, false)"
_JUDGED = f"""{_UNITS}, {_with_miles('units', 'unit_no')},
placed AS (SELECT u.*, m.miles, (city IN ('Miami', 'Aventura')) AS off_list, zip_code = '33140' AS zip_ok, t IN (3) AS renovated, t <> 5 AS prose,
           CASE t WHEN 0 THEN 6 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 4 WHEN 4 THEN 3 ELSE 0 END AS cats,
           t IN (0, 1, 2, 3) AS sees_ocean FROM units u LEFT JOIN miles m USING (unit_no)),
said AS (SELECT *, list_filter([
    CASE WHEN state = 'GA' THEN 'location: state GA is outside FL'
         WHEN off_list AND NOT zip_ok THEN 'location: city ''' || city || ''' is not a monitored municipality'
         WHEN miles IS NULL THEN NULL
         WHEN NOT {_IN_BOX} THEN 'location: coordinates fall outside the coastal corridor'
         WHEN miles > 0.6 THEN 'location: ' || printf('%.2f', miles) || ' mi from ocean (max 0.6)' END,
    CASE WHEN ptype = 'Townhouse' THEN 'property_type: ''Townhouse'' is not a condo'
         WHEN ptype = 'Boat' THEN 'property_type: ''Boat'' is not an accepted type' END,
    CASE WHEN beds < 2 THEN 'size: ' || {_num('beds')} || ' beds < 2 required' END,
    CASE WHEN baths < 2 THEN 'size: ' || {_num('baths')} || ' baths < 2 required' END,
    CASE WHEN sqft < 1200 THEN 'size: ' || {_group('sqft')} || ' sqft < 1,200 required' END,
    CASE WHEN price IS NULL THEN 'price: no rent published'
         WHEN price < 5000 THEN 'price: $' || {_group('price')} || ' below $5,000 floor'
         WHEN price > 12000 THEN 'price: $' || {_group('price')} || ' above $12,000 ceiling' END,
    CASE t WHEN 2 THEN 'lease_terms: excluded keyword(s) seasonal'
           WHEN 3 THEN 'lease_terms: requires at least 24 months (maximum 12 acceptable)' END,
    CASE WHEN year_built < 2005 AND NOT renovated THEN 'building: built ' || year_built || ' < 2005 and no renovation stated'
         WHEN NOT prose THEN NULL
         WHEN NOT sees_ocean THEN 'building: missing required amenity/amenities ocean view' END
  ], lambda x: x IS NOT NULL) AS failures,
  list_filter([
    CASE WHEN state <> 'GA' AND off_list AND zip_ok THEN 'location: city ''' || city || ''' not whitelisted but ZIP 33140 is' END,
    CASE WHEN state <> 'GA' AND NOT (off_list AND NOT zip_ok) AND miles IS NULL THEN 'location: ocean distance unverified (no coordinates)' END,
    CASE WHEN ptype IS NULL THEN 'property_type: not stated by source' END,
    CASE WHEN beds IS NULL THEN 'size: bedroom count missing' END, CASE WHEN baths IS NULL THEN 'size: bathroom count missing' END,
    CASE WHEN sqft IS NULL THEN 'size: square footage unverified (pending county lookup)' END,
    CASE WHEN t = 1 THEN 'lease_terms: ''short term'' present but negated in the copy' END,
    CASE WHEN t = 4 THEN 'lease_terms: term inferred from ''yearly'''
         WHEN t = 5 THEN 'lease_terms: not stated -- confirm 6-12 months with the agent' END,
    CASE WHEN year_built IS NULL THEN 'building: year built unknown (pending county lookup)'
         WHEN year_built < 2005 AND renovated THEN 'building: built ' || year_built || ' but described as renovated' END,
    CASE WHEN NOT prose AND NOT coalesce(year_built < 2005, false) THEN 'building: source published no description -- ocean view unverified' END
  ], lambda x: x IS NOT NULL) AS warnings FROM placed),
judged AS (SELECT *, len(failures) = 0 AS passed,
    CASE WHEN len(failures) = 0 THEN floor(least(
        CASE WHEN miles IS NOT NULL THEN (1.0::DOUBLE - least(miles / 0.6::DOUBLE, 1.0::DOUBLE)) * 30 ELSE 10 END
        + coalesce((1.0::DOUBLE - least(greatest((price - 5000) / 7000.0::DOUBLE, 0), 1)) * 20, 0)
        + CASE WHEN sqft IS NOT NULL THEN least(greatest((sqft - 1200) / 1200.0::DOUBLE, 0), 1) * 20 ELSE 0 END
        + least(cats / 6.0::DOUBLE, 1) * 15
        + CASE WHEN year_built IS NULL THEN 0 WHEN year_built >= 2015 THEN 10 WHEN year_built >= 2005 THEN 6 ELSE 2 END, 100.0::DOUBLE)
        * 10 + 0.5) / 10 ELSE 0 END AS score,
    CASE WHEN len(failures) > 0 THEN array_to_string(failures, '; ')
         WHEN len(warnings) > 0 THEN array_to_string(warnings, '; ') ELSE 'all constraints met' END AS reason FROM said)"""

_ALERTS = f"""{_JUDGED}, alerts AS (
    SELECT * EXCLUDE (old_price), CASE WHEN kind = 'new' THEN NULL ELSE old_price END AS old_price FROM (
        SELECT *, price + CAST(unit_no % 900 AS INTEGER) AS old_price,
               CASE WHEN unit_no % 3 = 0 THEN 'new' WHEN unit_no % 900 >= 100 AND (unit_no % 900) / (price + unit_no % 900)::DOUBLE >= 0.02
                    THEN 'price_drop' END AS kind FROM judged WHERE passed) WHERE kind IS NOT NULL)"""
_TOP = f"""{_ALERTS}, top AS (SELECT *, row_number() OVER (ORDER BY kind <> 'price_drop', score DESC, unit_no) AS rank FROM alerts
    QUALIFY rank <= 25)"""
_MATCHES = f"""{_JUDGED}, best AS (SELECT * FROM judged WHERE passed AND unit_no % 10 <> 0
    ORDER BY score DESC, o_orderdate DESC, unit_no LIMIT 100)"""
_SHOWN = "(100 + unit_no) || ' Collins Ave #' || (1 + unit_no % 9) || 'C, ' || city || ', FL ' || zip_code"
_LEASE_TEXT = "CASE t WHEN 0 THEN '6-12 months' WHEN 1 THEN '12 months' ELSE 'unspecified' END"
_CATS = "CASE t WHEN 0 THEN 'concierge{s}gym{s}ocean_view{s}pool{s}spa{s}valet' WHEN 1 THEN 'gym{s}ocean_view{s}valet' ELSE '' END"
_SPECS = (f"coalesce({_num('beds')}, '?') || ' bd · ' || coalesce({_num('baths')}, '?') || ' ba · ' || "
          f"coalesce({_group('sqft')} || ' sqft', 'sqft n/a')")
_DESCRIPTION = "CASE t " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(v.DESCRIPTIONS) if x) + " END"

_EVENTS = """ev AS (SELECT user_id AS unit_key, event_id, ts, event_type AS source,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(floor(value * 100) AS INTEGER) END AS price FROM events)"""
_CHANGES = f"""{_EVENTS}, ch AS (SELECT *, last_value(price IGNORE NULLS) OVER (PARTITION BY unit_key ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old_price FROM ev)"""
_LOG = """log AS (SELECT user_id AS dedupe_key, CASE WHEN event_id % 3 = 0 THEN 'new' ELSE 'price_drop' END AS kind, ts AS sent_at
    FROM events WHERE event_id % 2 = 1 AND event_id % 5 <> 0)"""
_COVER = f"""{_LINES}, rows AS (SELECT *, CASE WHEN source = 'portal_3' THEN NULL ELSE url END AS url2,
    CASE WHEN source = 'portal_2' THEN 0 ELSE price END AS price2, l_partkey % 6 <> 5 AND source <> 'portal_3' AS prose FROM lines)"""
_COVER_COUNTS = """count(*) AS sampled, count(*) FILTER (WHERE price2 <> 0) AS price, count(*) FILTER (WHERE beds <> 0) AS beds,
    count(*) FILTER (WHERE baths <> 0) AS baths, count(*) FILTER (WHERE sqft <> 0) AS sqft, count(*) FILTER (WHERE prose) AS description,
    count(*) FILTER (WHERE latitude <> 0) AS latitude, count(url2) AS url"""
_FACTS = f"""{_LINES}, reg AS (SELECT p_partkey, p_size AS z, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS i FROM part),
facts AS (SELECT l.*, z, i, 700 + z * 30 + i * 100 AS r_sqft, CASE WHEN l_partkey % 5 <> 0 THEN 1980 + z + i END AS r_year
          FROM lines l JOIN reg ON l_partkey = p_partkey),
checked AS (SELECT *, coalesce(abs(sqft - r_sqft) / r_sqft::DOUBLE > 0.15, false) AS sqft_off,
            coalesce(abs(year_built - r_year) > 2, false) AS year_off FROM facts)"""


def _first(c: str, blank: str | None = None) -> str:
    extra = "" if blank is None else f" AND {c} <> {blank}"
    return f"arg_min({c}, seq) FILTER (WHERE {c} IS NOT NULL{extra}) AS {c}"


def _union_list(name: str, items: str, same: str) -> str:
    """CTE: the ordered union of a two-item list per unit."""
    return (f"{name}_items AS (SELECT l_partkey, unnest({items}) AS item, unnest([0, 1]) AS idx, seq FROM lines), "
            f"{name}_first AS (SELECT l_partkey, arg_min(item, seq * 2 + idx) AS item, min(seq * 2 + idx) AS ord FROM {name}_items GROUP BY l_partkey, {same}), "
            f"{name} AS (SELECT l_partkey, string_agg(item, ',' ORDER BY ord) AS {name} FROM {name}_first GROUP BY l_partkey)")


_HALF = "TIMESTAMP '2024-01-15 00:00:00'"

ORACLES = {
    "resolve_units": f"""WITH {_LINES} SELECT l_partkey AS unit_no, (1 + l_partkey % 40) || 'b' AS unit, 'Bal Harbour' AS city, '33154' AS zip_code,
        min(price) AS price, count(*) AS n_sightings, count(DISTINCT source) AS n_sources FROM lines GROUP BY l_partkey""",
    "address_components": """SELECT CAST(100 + l_partkey AS VARCHAR) AS number, 'collins' AS street, 'ave' AS suffix,
        (1 + l_partkey % 40) || 'b' AS unit, 'Bal Harbour' AS city, 'FL' AS state, '33154' AS zip5, count(*) AS n
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey""",
    "multi_source_units": f"""WITH {_LINES} SELECT l_partkey AS unit_no, count(DISTINCT source) AS n_sources FROM lines
        GROUP BY 1 HAVING count(DISTINCT source) > 1""",
    "first_wins_merge": f"""WITH {_LINES}, {_union_list('photos', "['photo' || (l_linenumber % 4), 'photo' || (l_suppkey % 4)]", 'item')},
        {_union_list('amenities', "['amenity ' || l_linenumber, 'Amenity ' || (l_suppkey % 3)]", 'lower(item)')},
        one AS (SELECT l_partkey, {_first('source_id')}, {_first('url')}, {_first('broker')}, {_first('status')}, {_first('beds', '0')},
        {_first('baths', '0')}, {_first('sqft', '0')}, {_first('year_built', '0')}, {_first('days_on_market', '0')}, {_first('latitude', '0')},
        {_first('source')}, min(price) AS price, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM lines GROUP BY 1)
        SELECT * EXCLUDE (l_partkey), l_partkey AS unit_no FROM one JOIN photos USING (l_partkey) JOIN amenities USING (l_partkey)""",
    "contributing_sightings": f"WITH {_LINES} SELECT l_partkey AS unit_no, source, count(*) AS n FROM lines WHERE place > 1 GROUP BY 1, 2",
    "dedupe_within_source": f"WITH {_LINES} SELECT l_partkey AS unit_no, source, min(price) AS price FROM lines GROUP BY 1, 2",
    "resolve_priority": """WITH snap AS (SELECT 'K' || p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'G' || (p_partkey // 3) END AS g,
          'B' || (p_partkey // 10) AS b, CAST(p_partkey % 7 AS VARCHAR) AS u, CASE WHEN p_partkey % 4 <> 0 THEN (p_size % 3)::DOUBLE END AS beds,
          TIMESTAMP '2024-01-01' + to_hours(CAST(p_partkey % 50 AS INTEGER)) AS f FROM part),
        inc AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'K' || o_orderkey ELSE 'N' || o_orderkey END AS k,
          CASE WHEN o_orderkey % 3 = 1 THEN 'G' || (o_orderkey % 900) END AS g, CASE WHEN o_orderkey % 2 = 0 THEN 'B' || (o_orderkey % 300) END AS b,
          CAST(o_orderkey % 7 AS VARCHAR) AS u, CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey % 3)::DOUBLE END AS beds,
          CASE WHEN o_orderkey % 4 = 1 THEN 'S' || (o_orderkey % 150) ELSE 'T' || o_orderkey END AS s FROM orders),
        found AS (SELECT inc.k, 1 AS r, f, snap.k AS c FROM inc JOIN snap ON inc.k = snap.k
          UNION ALL SELECT inc.k, 2, f, snap.k FROM inc JOIN snap ON inc.g = snap.g
          UNION ALL SELECT inc.k, 3, f, snap.k FROM inc JOIN snap ON inc.b = snap.b AND inc.u = snap.u
            AND (inc.beds IS NULL OR snap.beds IS NULL OR inc.beds = snap.beds)
          UNION ALL SELECT inc.k, 4, TIMESTAMP '2024-01-01', 'K' || s_suppkey FROM inc JOIN supplier ON inc.s = 'S' || s_suppkey),
        best AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r, f, c) AS rn FROM found)
        SELECT inc.k AS dedupe_key, coalesce(best.c, inc.k) AS resolved_key, best.r AS resolved_by
        FROM inc LEFT JOIN best ON inc.k = best.k AND rn = 1""",
    "lease_terms": _lease("orders", "o_orderkey"),
    "lease_terms_documents": _lease("documents", "doc_id"),
    "keyword_scan": _scan("orders", "o_orderkey"),
    "keyword_scan_documents": _scan("documents", "doc_id"),
    "category_matches": _categories("orders", "o_orderkey"),
    "category_matches_documents": _categories("documents", "doc_id"),
    "parsed_specs": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN 1000 + o_orderkey END AS price,
        CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 + o_orderkey % 5 WHEN 2 THEN 3 WHEN 3 THEN 2 END::DOUBLE AS beds,
        CASE o_orderkey % 3 WHEN 0 THEN 1 + o_orderkey % 3 + 0.5 WHEN 1 THEN 2.5 END::DOUBLE AS baths,
        CASE WHEN 150 + o_orderkey % 2000 >= 200 THEN 150 + o_orderkey % 2000 END AS sqft,
        CASE WHEN 1790 + o_orderkey % 300 BETWEEN 1880 AND 2089 THEN 1790 + o_orderkey % 300 END AS year_built FROM orders""",
    "geo_distance_band": f"""WITH pts AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN 0
          ELSE 25.75::DOUBLE + (event_id % 2300) * 0.0001::DOUBLE END AS latitude,
          CASE WHEN event_id % 89 = 0 THEN 0 ELSE -80.17::DOUBLE + (user_id % 70) * 0.001::DOUBLE END AS longitude FROM events), {_with_miles('pts', 'event_id')}
        SELECT event_id, CAST(floor(miles * 100) AS BIGINT) AS band, coalesce(miles <= 0.1, false) AS is_near, {_IN_BOX} AS within_box
        FROM pts LEFT JOIN miles USING (event_id)""",
    "verdicts": f"WITH {_JUDGED} SELECT unit_no, passed, reason, score FROM judged",
    "explained_verdicts": f"""WITH {_JUDGED} SELECT unit_no, unnest(range(1, len(failures) + 1)) AS pos, unnest(failures) AS message FROM judged""",
    "explained_messages": f"""WITH {_JUDGED} SELECT unit_no, passed, 'failure' AS kind, unnest(range(1, len(failures) + 1)) AS pos, unnest(failures) AS message FROM judged
        UNION ALL SELECT unit_no, passed, 'warning', unnest(range(1, len(warnings) + 1)), unnest(warnings) FROM judged""",
    "display_lines": f"""WITH {_UNITS}, {_with_miles('units', 'unit_no')} SELECT unit_no, (100 + unit_no) || ' Collins Ave #' || (1 + unit_no % 9) || 'C, ' || city || ', ' || state || ' ' || zip_code
          || ' | ' || coalesce('$' || {_group('price')} || '/mo', 'price n/a') || ' | ' || coalesce({_num('beds')}, '?') || 'bd/' || coalesce({_num('baths')}, '?') || 'ba | '
          || coalesce({_group('sqft')} || ' sqft', 'sqft n/a') || ' | ' || CASE t WHEN 0 THEN '6-12 months' WHEN 1 THEN '12 months' WHEN 3 THEN '24+ months' ELSE 'unspecified' END AS summary,
          CASE WHEN miles IS NULL THEN 'distance unknown' WHEN miles < 0.06 THEN 'oceanfront (<0.1 mi)' ELSE printf('%.2f', miles) || ' mi from ocean' END AS distance
        FROM units LEFT JOIN miles USING (unit_no)""",
    "valuation_requests": """SELECT (100 + o_custkey) || ' Main St #7, Surfside, FL, 33154' AS address_key, (100 + o_custkey) || ' Main St Unit 7|33154' AS zip_key,
          arg_min(CASE o_orderkey % 5 WHEN 0 THEN 'Condo' WHEN 1 THEN 'Condo' WHEN 4 THEN 'Townhouse' END, o_orderkey) FILTER (o_orderkey % 5 IN (0, 1, 4)) AS property_type,
          arg_min((o_orderkey % 4)::DOUBLE, o_orderkey) FILTER (o_orderkey % 3 <> 0) AS beds, 1::DOUBLE AS baths,
          arg_min(CAST(600 + o_orderkey % 900 AS INTEGER), o_orderkey) FILTER (o_orderkey % 2 <> 0) AS sqft FROM orders GROUP BY o_custkey""",
    "rejection_histogram": f"""WITH {_JUDGED}, f AS (SELECT unnest(failures) AS failure FROM judged)
        SELECT split_part(failure, ':', 1) AS reason, count(*) AS n FROM f GROUP BY 1""",
    "top_rejections": f"""WITH {_JUDGED}, f AS (SELECT unnest(failures) AS failure FROM judged)
        SELECT split_part(failure, ':', 1) AS reason, count(*) AS n FROM f GROUP BY 1 ORDER BY n DESC, 1 LIMIT 8""",
    "pass_totals": f"WITH {_JUDGED} SELECT count(*) AS evaluated, count(*) FILTER (WHERE passed) AS passed FROM judged",
    "prefilter": f"""WITH {_LINES} SELECT l_partkey, count(*) AS n FROM lines WHERE (price BETWEEN 1000 AND 3000) AND (beds IS NULL OR beds >= 2)
        AND baths >= 2 AND (sqft IS NULL OR sqft >= 1000) AND (l_partkey % 120) / 100.0::DOUBLE <= 0.6::DOUBLE * 1.5 GROUP BY 1""",
    "top_matches": f"WITH {_MATCHES} SELECT unit_no, score FROM best",
    "export_matches": f"""WITH {_MATCHES} SELECT {_SHOWN} AS address, price, beds, baths, sqft, year_built, {_LEASE_TEXT} AS lease_term,
        {_CATS.format(s='; ')} AS amenities, CAST(NULL AS INTEGER) AS rent_estimate, CAST(NULL AS VARCHAR) AS avm_verdict,
        CAST(NULL AS INTEGER) AS county_sqft, 'orders' AS source, CAST(NULL AS VARCHAR) AS url FROM best""",
    "register_validate": f"""WITH {_FACTS} SELECT l_partkey AS unit_no, source_id,
        CASE WHEN sqft IS NULL OR sqft_off THEN r_sqft ELSE sqft END AS sqft,
        CASE WHEN year_built IS NULL OR year_off THEN coalesce(r_year, year_built) ELSE year_built END AS year_built,
        coalesce(beds, i + 1) AS beds, baths, 'F' || l_partkey || '-' || i AS county_folio, sqft_off OR year_off AS county_conflict,
        CASE i WHEN 1 THEN 'unit' WHEN 2 THEN 'address' ELSE 'street' END AS reg_match FROM checked""",
    "enrichment_counters": f"""WITH {_FACTS} SELECT count(*) AS attempted, count(*) AS county_hits, count(*) FILTER (WHERE sqft_off) AS sqft_conflicts,
        count(*) FILTER (WHERE year_off) AS year_conflicts, count(*) FILTER (WHERE sqft IS NULL) AS sqft_filled,
        count(*) FILTER (WHERE year_built IS NULL AND r_year IS NOT NULL) AS year_filled FROM checked""",
    "register_contains_join": """WITH s AS (SELECT DISTINCT (l_suppkey % 40) || CASE WHEN l_linenumber % 2 = 0 THEN ' ocean dr' ELSE ' oce' END AS street_key FROM lineitem),
        p AS (SELECT 'P' || s_suppkey AS folio, CASE WHEN s_suppkey % 2 = 0 THEN 'TOWER ' ELSE '' END || s_suppkey || ' OCEAN DRIVE ' || (s_suppkey % 7) AS addr FROM supplier)
        SELECT street_key, folio FROM s JOIN p ON contains(addr, upper(street_key))""",
    "valuation_verdict": """WITH u AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 100) AS INTEGER) END AS price FROM orders),
        a AS (SELECT c_custkey, CAST(floor(c_acctbal) AS INTEGER) AS rent, CAST(floor(c_acctbal * 0.9::DOUBLE) AS INTEGER) AS low,
              CAST(floor(c_acctbal * 1.1::DOUBLE) AS INTEGER) AS high,
              CASE WHEN c_custkey % 5 <> 0 THEN CAST(floor(c_acctbal * 200) AS INTEGER) END AS val FROM customer WHERE c_custkey % 3 <> 0),
        b AS (SELECT c_custkey, CAST(floor(c_acctbal) AS INTEGER) + 500 AS rent, CAST(floor(c_acctbal * 150) AS INTEGER) AS val FROM customer WHERE c_custkey % 2 = 0),
        x AS (SELECT o_orderkey, nullif(price, 0) AS price, CASE WHEN a.rent > 0 THEN a.rent WHEN b.rent > 0 THEN b.rent END AS rent,
              CASE WHEN a.rent > 0 THEN a.low END AS low, CASE WHEN a.rent > 0 THEN a.high END AS high, CASE WHEN a.rent > 0 THEN 'rentcast' WHEN b.rent > 0 THEN 'housecanary' END AS rs,
              CASE WHEN a.val > 0 THEN a.val WHEN b.val > 0 THEN b.val END AS val, CASE WHEN a.val > 0 THEN 'rentcast' WHEN b.val > 0 THEN 'housecanary' END AS vs
              FROM u LEFT JOIN a ON o_custkey = a.c_custkey LEFT JOIN b ON o_custkey = b.c_custkey)
        SELECT o_orderkey, rent AS rent_estimate, low AS rent_estimate_low, high AS rent_estimate_high, rs AS rent_estimate_source, val AS value_estimate, vs AS value_estimate_source,
          floor(price / rent::DOUBLE * 1000 + 0.5) / 1000 AS price_to_estimate_ratio,
          CASE WHEN price / rent::DOUBLE >= 1.15::DOUBLE THEN 'above market' WHEN price / rent::DOUBLE <= 0.9::DOUBLE THEN 'below market'
               WHEN price / rent::DOUBLE IS NOT NULL THEN 'at market' END AS price_verdict,
          floor(price * 12 / val::DOUBLE * 100 * 100 + 0.5) / 100 AS gross_yield_pct FROM x""",
    "price_history": f"""WITH {_CHANGES} SELECT unit_key, event_id, old_price, price, price - old_price AS delta,
        CASE WHEN old_price IS NULL THEN 'first' WHEN price < old_price THEN 'drop' ELSE 'increase' END AS change
        FROM ch WHERE price IS NOT NULL AND (old_price IS NULL OR price <> old_price)""",
    "price_history_strict": f"""WITH {_EVENTS}, ch AS (SELECT *, lag(price) OVER (PARTITION BY unit_key ORDER BY ts, event_id) AS old_price FROM ev)
        SELECT unit_key, event_id, old_price, price, CASE WHEN old_price IS NULL THEN 'first' WHEN price < old_price THEN 'drop' ELSE 'increase' END AS change
        FROM ch WHERE price IS NOT NULL AND (old_price IS NULL OR price <> old_price)""",
    "price_drops": f"""WITH {_CHANGES} SELECT unit_key, event_id, old_price, price FROM ch
        WHERE old_price - price >= 100 AND (old_price - price) / old_price::DOUBLE >= 0.02""",
    "running_life": f"""WITH {_EVENTS} SELECT unit_key, event_id, min(ts) OVER (PARTITION BY unit_key) AS first_seen_at, ts AS last_seen_at,
        row_number() OVER (PARTITION BY unit_key ORDER BY ts, event_id) AS times_seen FROM ev""",
    "sighting_state": f"""WITH {_EVENTS}, s AS (SELECT *, source || ':' || unit_key AS source_key FROM ev)
        SELECT source_key, any_value('U' || unit_key) AS dedupe_key, any_value(source) AS source, any_value(CAST(unit_key AS VARCHAR)) AS source_id,
        arg_max('u' || event_id, ts) FILTER (WHERE event_id % 5 <> 0) AS url, max(struct_pack(ts := ts, price := price)).price AS price,
        min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM s GROUP BY source_key""",
    "snapshot_merge": f"""WITH {_EVENTS}, o AS (SELECT 'U' || unit_key AS k, min(price) AS price, CASE WHEN unit_key % 2 = 0 THEN 'old title' ELSE '' END AS title,
          400 + unit_key AS sqft, 'S1' AS status, max(ts) AS last, count(*) AS times, unit_key % 3 = 0 AS active FROM ev WHERE ts < {_HALF} AND unit_key % 4 <> 0 GROUP BY unit_key),
        n AS (SELECT 'U' || unit_key AS k, max(price) AS price, CASE WHEN unit_key % 3 <> 0 THEN 'new title' END AS title,
          CASE WHEN unit_key % 2 <> 0 THEN 500 + unit_key END AS sqft, CASE WHEN unit_key % 2 <> 0 THEN 'S2' END AS status,
          CASE WHEN unit_key % 3 <> 1 THEN 'p2' END AS photos FROM ev WHERE ts >= {_HALF} AND unit_key % 5 <> 0 GROUP BY unit_key)
        SELECT coalesce(o.k, n.k) AS dedupe_key, coalesce(n.price, o.price) AS price, coalesce(n.title, o.title) AS title, coalesce(n.sqft, o.sqft) AS sqft,
          CASE WHEN n.k IS NOT NULL THEN n.status ELSE o.status END AS status, coalesce(n.photos, CASE WHEN o.k IS NOT NULL THEN 'p1' END) AS photos,
          CAST(coalesce(o.times, 0) + CASE WHEN n.k IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS times_seen, n.k IS NOT NULL OR coalesce(o.active, false) AS is_active,
          n.k IS NOT NULL AS seen, o.k IS NULL AS is_new, CASE WHEN n.k IS NOT NULL THEN o.price END AS old_price, n.price AS new_price,
          n.price - o.price AS delta, coalesce(n.price < o.price, false) AS price_drop, coalesce(n.price > o.price, false) AS price_increase,
          CASE WHEN n.k IS NOT NULL THEN {_HALF} ELSE o.last END AS last_seen_at FROM o FULL JOIN n ON o.k = n.k""",
    "inactive_units": f"""WITH {_EVENTS}, u AS (SELECT unit_key, max(ts) AS last, unit_key % 7 <> 0 AS act FROM ev GROUP BY unit_key)
        SELECT unit_key, act AND last >= TIMESTAMP '2024-01-30 16:00:00' AS is_active, act AND last < TIMESTAMP '2024-01-30 16:00:00' AS expired FROM u""",
    "cooldown_suppress": f"""WITH {_LOG}, e AS (SELECT DISTINCT user_id AS dedupe_key, unnest(['new', 'price_drop']) AS kind FROM events)
        SELECT dedupe_key, kind FROM e WHERE NOT EXISTS (SELECT 1 FROM log WHERE log.dedupe_key = e.dedupe_key AND log.kind = e.kind
          AND sent_at >= TIMESTAMP '2024-01-30 00:00:00')""",
    "cooldown_as_of": f"""WITH {_LOG}, e AS (SELECT event_id, user_id AS dedupe_key, CASE WHEN event_id % 3 = 0 THEN 'new' ELSE 'price_drop' END AS kind, ts
          FROM events WHERE event_id % 2 = 0)
        SELECT event_id, dedupe_key, kind FROM e WHERE NOT EXISTS (SELECT 1 FROM log WHERE log.dedupe_key = e.dedupe_key AND log.kind = e.kind
          AND sent_at <= ts AND sent_at >= ts - INTERVAL 24 HOUR)""",
    "also_listed_on": f"""WITH {_EVENTS}, s AS (SELECT DISTINCT unit_key, source FROM ev)
        SELECT a.unit_key AS dedupe_key, a.source, coalesce(string_agg(b.source, ',' ORDER BY b.source), '') AS extra_sources
        FROM s a LEFT JOIN s b ON a.unit_key = b.unit_key AND a.source <> b.source GROUP BY 1, 2""",
    "alert_events": f"WITH {_ALERTS} SELECT unit_no, kind, old_price, price, score FROM alerts",
    "alert_topk": f"WITH {_TOP} SELECT unit_no, kind, score FROM top",
    "alert_chunks": f"WITH {_TOP} SELECT unit_no, rank, CAST((rank - 1) // 10 AS INTEGER) AS chunk_id FROM top",
    "alert_digest": f"""WITH {_ALERTS}, c AS (SELECT count(*) AS total, count(*) FILTER (WHERE kind = 'price_drop') AS drops FROM alerts)
        SELECT total, drops, total - drops AS new, concat_ws(', ', CASE WHEN total > drops THEN (total - drops) || ' new' END,
          CASE WHEN drops > 0 THEN drops || ' price drop' || CASE WHEN drops <> 1 THEN 's' ELSE '' END END) AS line FROM c""",
    "alert_content": f"""WITH {_ALERTS} SELECT unit_no, CASE WHEN kind = 'price_drop' THEN 'Price drop: ' ELSE '' END || {_SHOWN} AS headline,
        CASE WHEN kind = 'price_drop' THEN '$' || {_group('old_price')} || ' → $' || {_group('price')} || ' (−$' || {_group('old_price - price')} || ', −'
             || printf('%.1f%%', (old_price - price) / old_price::DOUBLE * 100) || ')'
             ELSE '$' || {_group('price')} || '/mo · ' || {_SPECS} END AS subheadline,
        'source: orders · score ' || CAST(round_even(score, 0) AS INTEGER) || '/100 · ' || (unit_no % 60) || ' days on market' AS footer,
        concat_ws('|', 'Price=$' || {_group('price')} || '/mo', 'Layout=' || {_SPECS}, 'Lease term=' || {_LEASE_TEXT},
          'Ocean=' || CASE WHEN miles IS NULL THEN 'distance unverified' WHEN miles <= 0.1 THEN 'oceanfront (<0.1 mi)' ELSE printf('%.2f', miles) || ' mi to the beach' END,
          'Built=' || year_built || ' (county-verified)',
          'Price / sqft=$' || format('{{:,.2f}}', floor(price / sqft::DOUBLE * 100 + 0.5) / 100),
          CASE WHEN cats > 0 THEN 'Amenities (' || cats || ')=' || replace({_CATS.format(s=', ')}, '_', ' ') END,
          CASE WHEN unit_no % 4 <> 0 THEN 'Rent AVM · rentcast=$' || {_group('5000 + unit_no')} || CASE WHEN unit_no % 4 = 1 THEN ' (range $4,000–$9,000)' ELSE '' END || ' — at market' END,
          CASE WHEN unit_no % 5 = 0 THEN 'County record=1,300 sqft' || CASE WHEN unit_no % 10 = 0 THEN ' ⚠️ conflicts with the listing' ELSE '' END END,
          CASE WHEN unit_no % 3 <> 0 THEN 'Listed by=Broker ' || o_custkey END, CASE WHEN unit_no % 2 = 0 THEN 'Also listed on=a, b' END,
          CASE WHEN len(warnings) > 0 THEN 'Needs confirming=' || array_to_string(warnings[1:4], '; ') END) AS fields,
        {_DESCRIPTION} AS summary FROM alerts""",
    "store_stats": """SELECT (SELECT count(*) FROM customer) AS listings_total, (SELECT count(*) FROM customer WHERE c_custkey % 3 <> 0) AS listings_active,
        (SELECT count(*) FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 0) AS listings_matched, (SELECT count(*) FROM events) AS sightings,
        (SELECT count(*) FROM (SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1)) AS multi_portal_units,
        (SELECT count(*) FROM orders WHERE o_orderkey % 4 <> 0) AS price_changes, (SELECT count(*) FROM lineitem WHERE l_linenumber <> 3) AS alerts_sent,
        (SELECT count(*) FROM supplier) AS runs""",
    "source_coverage": f"WITH {_COVER} SELECT source, {_COVER_COUNTS} FROM rows GROUP BY source",
    "source_coverage_sample": f"""WITH {_COVER}, few AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY source ORDER BY {', '.join(v.LINE_ORDER)}, l_partkey) <= 10)
        SELECT source, {_COVER_COUNTS} FROM few GROUP BY source""",
    "coverage_gaps": f"""WITH {_COVER}, c AS (SELECT source, {_COVER_COUNTS} FROM rows GROUP BY source),
        long AS (UNPIVOT c ON {', '.join(fv.COVERAGE_CONSEQUENCES)} INTO NAME field VALUE n)
        SELECT source, field, CASE field {' '.join(f"WHEN '{k}' THEN '{x}'" for k, x in fv.COVERAGE_CONSEQUENCES.items())} END AS consequence
        FROM long WHERE n = 0""",
    "source_staleness": """WITH h AS (SELECT event_type AS s, count(*) AS n, count(*) % 2 = 0 AS ok FROM events GROUP BY 1),
        a AS (SELECT count(*) AS attempted, count(*) FILTER (WHERE NOT ok) AS failed, CAST(sum(n) AS BIGINT) AS records,
              string_agg(s, ', ' ORDER BY s) FILTER (WHERE NOT ok) AS names FROM h),
        r AS (SELECT *, CASE WHEN failed / attempted >= 0.5 THEN failed || '/' || attempted || ' primary sources failed (' || names || ')'
              WHEN records < 5 THEN 'only ' || records || ' candidates from primary APIs (expected at least 5)' ELSE '' END AS reason FROM a)
        SELECT attempted, failed, records, reason, reason <> '' AS use_fallback FROM r""",
    "health_json": """WITH h AS (SELECT event_type AS s, count(*) AS n FROM events GROUP BY 1),
        e AS (SELECT event_type AS s, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events),
        f AS (SELECT s, string_agg('"error ' || event_id || '"', ',' ORDER BY event_id) AS errs FROM e WHERE rn <= 3 GROUP BY s)
        SELECT '{' || string_agg('"' || h.s || '":{"count":' || n || ',"ok":' || CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END || ',"errors":['
          || coalesce(errs, '') || ']}', ',' ORDER BY h.s) || '}' AS source_health FROM h LEFT JOIN f ON h.s = f.s""",
    "detail_budget": "SELECT event_type AS source, count(*) - 40 AS not_detailed FROM events GROUP BY 1 HAVING count(*) > 40",
    "first_per_source": """SELECT event_type AS source, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rank_in_source FROM events
        QUALIFY rank_in_source <= 40""",
    "map_payloads": """WITH r AS (SELECT event_id, unnest([0, 1]) AS pos, unnest(['a', 'b']) AS w FROM events)
        SELECT event_id, pos, 'r' || event_id || w AS source_id, (100 + event_id) || ' Ocean Dr' AS address, CAST(event_id + 1000 * (pos + 1) AS INTEGER) AS price,
        (event_id % 5)::DOUBLE AS beds, 'note ' || event_id AS description,
        'Tag' || (event_id % 3) || CASE WHEN event_id % 3 <> event_id % 2 THEN ',tag' || (event_id % 2) ELSE '' END AS amenities, 'FL' AS state FROM r""",
    "discover_arrays": "SELECT event_id, 2 AS n, 'r' || event_id || 'b' AS second FROM events",
    "scattered_text": "SELECT event_id, 'r' || event_id || 'a . note ' || event_id || ' . r' || event_id || 'b' AS text FROM events",
    "truncation_notes": "SELECT event_type AS source, 'page-' || event_id AS file, 5 AS declared, 2 AS returned, '5 listings matched but 2 returned' AS note FROM events WHERE event_id % 4 = 0",
    "source_health": """SELECT event_type AS source, count(*) AS pages, count(*) FILTER (WHERE event_id % 6 = 0) AS failed_pages,
        2 * count(*) FILTER (WHERE event_id % 6 <> 0) AS records, count(*) FILTER (WHERE event_id % 6 = 0) = 0 AS ok FROM events GROUP BY 1""",
    "embedded_state": """SELECT page_id, unnest(range(0, 1 + page_id % 3)) AS pos, 'z' || page_id AS source_id, CAST(page_id + 5000 AS INTEGER) AS price,
        (page_id + 1) || ' Bay Rd' AS address FROM pages WHERE page_id % 4 <> 3""",
    "feed_titles": """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN CAST(1000 + o_custkey AS INTEGER) END AS price,
        CASE WHEN o_orderkey % 4 IN (0, 2) THEN (1 + o_orderkey % 4)::DOUBLE END AS beds,
        CASE WHEN o_orderkey % 4 = 0 THEN CAST(300 + o_orderkey % 2000 AS INTEGER) END AS sqft,
        CASE o_orderkey % 4 WHEN 0 THEN 'surfside' WHEN 2 THEN 'bal harbour' END AS city, 'Sunny flat' AS title,
        CAST(1000000 + o_orderkey AS VARCHAR) AS source_id, '33154' AS zip_code FROM orders""",
    "card_fields": """SELECT o_orderkey, (1 + o_orderkey) || ' Collins Ave' AS address, CAST(1000 + o_custkey AS INTEGER) AS price, (1 + o_orderkey % 4)::DOUBLE AS beds,
        (1 + o_orderkey % 3) + 0.5::DOUBLE AS baths, CAST(500 + o_orderkey % 3000 AS INTEGER) AS sqft, 'https://www.redfin.com/home/' || o_orderkey AS url,
        'condo' AS property_type FROM orders""",
    "detail_overlay": """WITH e AS (SELECT *, event_id % 5 <> 0 AS has, CASE WHEN event_id % 13 <> 0 THEN CAST(floor(value * 100) AS INTEGER) END AS price FROM events)
        SELECT event_id, coalesce(price, CASE WHEN has THEN 7 END) AS price,
        CASE WHEN event_id % 2 = 0 THEN 'a longer text than the detail' WHEN has THEN 'detail ' || event_id ELSE 'x' END AS description,
        CASE WHEN event_id % 3 = 0 THEN 900 WHEN has THEN CAST(500 + event_id % 1000 AS INTEGER) END AS sqft,
        CASE WHEN has THEN 'A,b,C' ELSE 'A,b' END AS amenities FROM e""",
}

_INSTANTS = f"""{_EVENTS}, instants AS (SELECT unit_key, ts AS seen_at, min(price) AS price, CAST(count(*) AS INTEGER) AS n FROM ev GROUP BY 1, 2),
closed AS (SELECT * FROM instants WHERE seen_at <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR),
seen AS (SELECT unit_key, seen_at, price, CAST(sum(n) OVER w AS INTEGER) AS times_seen, row_number() OVER w AS rn,
    last_value(price IGNORE NULLS) OVER (PARTITION BY unit_key ORDER BY seen_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old_price
    FROM closed WINDOW w AS (PARTITION BY unit_key ORDER BY seen_at)),
told AS (SELECT *, CASE WHEN rn = 1 THEN 'new' WHEN price < old_price THEN 'price_drop' WHEN price > old_price THEN 'price_increase' ELSE 'unchanged' END AS event FROM seen)"""

ORACLES.update({
    "stream_changes": f"WITH {_INSTANTS} SELECT unit_key, seen_at, event, old_price, price, times_seen FROM told",
    "stream_cooldown": f"""WITH RECURSIVE {_INSTANTS}, mat AS (SELECT unit_key, seen_at, event FROM told WHERE event = 'new'
          OR (event = 'price_drop' AND old_price - price >= 100 AND (old_price - price) / old_price::DOUBLE >= 0.02)),
        sent(unit_key, seen_at, event) AS (SELECT unit_key, min(seen_at), event FROM mat GROUP BY unit_key, event
          UNION ALL SELECT m.unit_key, m.seen_at, m.event FROM sent s, LATERAL (SELECT unit_key, event, min(mat.seen_at) AS seen_at FROM mat
            WHERE mat.unit_key = s.unit_key AND mat.event = s.event AND mat.seen_at >= s.seen_at + INTERVAL 24 HOUR GROUP BY 1, 2) m)
        SELECT unit_key, seen_at, event FROM sent""",
    "stream_inactive": f"""WITH {_INSTANTS}, last AS (SELECT unit_key, max(seen_at) AS seen_at, max(times_seen) AS times_seen FROM told GROUP BY 1)
        SELECT unit_key, seen_at, times_seen FROM last WHERE seen_at + INTERVAL 8 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
})
ORACLES.update({
    "stream_redelivered": ORACLES["stream_changes"],
    "stream_sends": f"""WITH {_INSTANTS}, mat AS (SELECT unit_key, seen_at, event FROM told WHERE event = 'new'
          OR (event = 'price_drop' AND old_price - price >= 100 AND (old_price - price) / old_price::DOUBLE >= 0.02)),
        sent AS (SELECT user_id AS unit_key, ts, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'price_drop' END AS kind FROM events
            WHERE event_id % 5 = 0 AND event_id % 3 <> 0
          UNION ALL SELECT user_id, min(ts) - INTERVAL 30 MINUTE, 'new' FROM events WHERE user_id % 8 = 0 GROUP BY user_id)
        SELECT unit_key, seen_at, event FROM mat m WHERE seen_at <= (SELECT max(ts) FROM events WHERE event_id % 5 = 0) - INTERVAL 1 HOUR
          AND NOT EXISTS (SELECT 1 FROM sent s WHERE s.unit_key = m.unit_key AND s.kind = m.event
            AND s.ts < m.seen_at AND m.seen_at < s.ts + INTERVAL 24 HOUR)""",
})
