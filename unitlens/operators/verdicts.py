"""Constraints with reasons, as columns.

Each check gives at most a few messages, so a verdict is two flat arrays built from CASE expressions in the order
of the checks. A stated violation is a failure; what is not said is a warning. The message texts are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitlens import fixed_values as fv
from unitlens.criteria import SearchCriteria
from unitlens.functions import geo
from unitlens.functions import text as tx
from unitlens.functions.keywords import category_map, scan_keywords
from unitlens.functions.lease import lease_known
from unitlens.operators import derive
from unitlens.operators.sinks import written


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def passes_prefilter(c: SearchCriteria) -> Column:
    """Numeric gate before costly joins: unknown passes, only a stated violation drops a row."""
    rules = [
        F.col("price").between(c.min_price, c.max_price), F.col("beds") >= c.min_beds, F.col("baths") >= c.min_baths,
        F.col("sqft") >= c.min_sqft, F.col("miles_from_ocean") <= c.max_miles * fv.PREFILTER_DISTANCE_SLACK,
    ]
    out = F.lit(True)
    for rule in rules:
        out = out & F.coalesce(rule, F.lit(True))
    return out


def _location(c: SearchCriteria):
    state, city, zip_code, miles = (F.col(n) for n in ("state", "city", "zip_code", "miles_from_ocean"))
    wrong_state = F.coalesce(F.upper(state) != c.state.upper(), F.lit(False)) if c.state else F.lit(False)
    known = F.col("__known_city")
    listed = known.isin(*[x.strip().lower() for x in c.cities])
    rescued = F.coalesce(zip_code.isin(*c.zip_codes), F.lit(False))
    checked = F.lit(c.enforce_city_whitelist)
    wrong_city = checked & (known != "") & ~listed & ~rescued
    stop = wrong_state | wrong_city
    unplaced = F.lit("location: no coordinates, cannot verify ocean proximity") if c.require_coordinates else F.lit(None)
    failure = (
        F.when(wrong_state, _say("location: state ", state, f" is outside {c.state}"))
        .when(wrong_city, _say("location: city '", city, "' is not a monitored municipality"))
        .when(miles.isNull(), unplaced)
        .when(~geo.in_box(F.col("latitude"), F.col("longitude")), "location: coordinates fall outside the coastal corridor")
        .when(miles > c.max_miles,
              _say("location: ", F.format_string("%.2f", miles), f" mi from ocean (max {c.max_miles})"))
    )
    warnings = [
        F.when(~wrong_state & checked & (known == ""), "location: city missing from source data")
        .when(~wrong_state & checked & ~listed & rescued,
              _say("location: city '", city, "' not whitelisted but ZIP ", zip_code, " is")),
    ]
    if not c.require_coordinates:
        warnings.append(F.when(~stop & miles.isNull(), "location: ocean distance unverified (no coordinates)"))
    return [failure], warnings


def _accepted(text: Column, c: SearchCriteria) -> Column:
    out = F.lit(False)
    for t in sorted({t.strip().lower() for t in c.property_types}):
        out = out | F.contains(text, F.lit(t))
    return out


def _property_type(c: SearchCriteria):
    stated = F.col("__declared") != ""
    failure = F.when(stated & F.col("__denied"), _say("property_type: '", F.col("property_type"), "' is not a condo")).when(
        stated & ~F.col("__accepted"), _say("property_type: '", F.col("property_type"), "' is not an accepted type"))
    warning = F.when(~stated & F.col("__inferred"), "property_type: inferred from listing text").when(
        ~stated, "property_type: not stated by source")
    return [failure], [warning]


def _count(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else str(x)


def _size(c: SearchCriteria):
    beds, baths, sqft = F.col("beds"), F.col("baths"), F.col("sqft")
    no_sqft = "size: square footage unknown" if c.require_known_sqft else None
    failures = [
        F.when(beds < c.min_beds, _say("size: ", tx.plain_number(beds), f" beds < {_count(c.min_beds)} required")),
        F.when(baths < c.min_baths, _say("size: ", tx.plain_number(baths), f" baths < {_count(c.min_baths)} required")),
        F.when(sqft < c.min_sqft, _say("size: ", F.format_number(sqft, 0), f" sqft < {c.min_sqft:,} required"))
        .when(sqft.isNull(), F.lit(no_sqft)),
    ]
    warnings = [F.when(beds.isNull(), "size: bedroom count missing"), F.when(baths.isNull(), "size: bathroom count missing")]
    if not c.require_known_sqft:
        warnings.append(F.when(sqft.isNull(), "size: square footage unverified (pending county lookup)"))
    return failures, warnings


def _price(c: SearchCriteria):
    price = F.col("price")
    return [
        F.when(price.isNull(), "price: no rent published")
        .when(price < c.min_price, _say("price: ", tx.dollars(price), f" below ${c.min_price:,} floor"))
        .when(price > c.max_price, _say("price: ", tx.dollars(price), f" above ${c.max_price:,} ceiling"))
    ], []


def _lease(c: SearchCriteria):
    hits, negated = F.col("keyword_scan.hits"), F.col("keyword_scan.negated")
    term = F.col("lease_term")
    low, high = term["min_months"], term["max_months"]
    excluded, unknown = F.size(hits) > 0, ~lease_known(term)
    rescued = F.col("__rescued")
    silent = "lease_terms: no lease term stated" if c.require_explicit_lease_term else None
    lo, hi = c.min_lease_months, c.max_lease_months
    failure = (
        F.when(excluded, _say("lease_terms: excluded keyword(s) ", F.array_join(F.array_sort(hits), ", ")))
        .when(unknown, F.when(rescued.isNull(), F.lit(silent)))
        .when(low < lo, _say("lease_terms: accepts terms as short as ", low.cast("string"), f" months (minimum {lo} required)"))
        .when(low > hi, _say("lease_terms: requires at least ", low.cast("string"), f" months (maximum {hi} acceptable)"))
        .when(high < lo, _say("lease_terms: caps out at ", high.cast("string"), f" months (minimum {lo} required)"))
    )
    unsaid = F.when(rescued.isNotNull(), _say("lease_terms: term inferred from '", rescued, "'"))
    if not c.require_explicit_lease_term:
        unsaid = unsaid.otherwise("lease_terms: not stated -- confirm 6-12 months with the agent")
    warnings = [
        F.when(~excluded & (F.size(negated) > 0),
               _say("lease_terms: '", F.get(negated, 0), "' present but negated in the copy")),
        F.when(~excluded & unknown, unsaid).when(
            ~excluded & low.isNull() & (high > hi),
            _say("lease_terms: advertised up to ", high.cast("string"), " months; confirm a 6-12 term")),
    ]
    return [failure], warnings


def _building(c: SearchCriteria):
    b = c.building
    year, found = F.col("year_built"), F.map_keys("amenity_matches")
    count = F.size(found)
    old = F.coalesce(year < b.min_year_built, F.lit(False))
    renovated = F.col("__renovated")
    too_old = old & ~renovated
    required = F.array(*[F.lit(n) for n in b.required_amenities]).cast("array<string>")
    missing = F.array_except(required, found)
    spoken = F.array_join(F.transform(missing, lambda n: F.replace(n, F.lit("_"), F.lit(" "))), ", ")
    lenient = ~F.col("has_prose") & F.lit(not b.require_amenity_evidence)
    lacking, few = F.size(missing) > 0, count < b.min_amenity_matches
    failure = (
        F.when(too_old, _say("building: built ", year.cast("string"), f" < {b.min_year_built} and no renovation stated"))
        .when(lenient, F.lit(None))
        .when(lacking, _say("building: missing required amenity/amenities ", spoken))
        .when(few, _say("building: only ", count.cast("string"),
                        f" luxury amenities detected ({b.min_amenity_matches} required)"))
    )
    warnings = [
        F.when(year.isNull(), "building: year built unknown (pending county lookup)")
        .when(old & renovated, _say("building: built ", year.cast("string"), " but described as renovated")),
        F.when(~too_old & lenient & (lacking | few), _say(
            "building: source published no description -- ",
            F.when(lacking, spoken).otherwise("luxury amenities"), " unverified")),
    ]
    return [failure], warnings


def score_column(c: SearchCriteria) -> Column:
    """0 to 100: distance 30, price 20, space 20, categories 15, age 10, valuation 5. Rounded half up to 0.1."""
    miles, price, sqft, year = (F.col(n) for n in ("miles_from_ocean", "price", "sqft", "year_built"))
    ratio = F.col("price_to_estimate_ratio")
    zero, one = F.lit(0.0), F.lit(1.0)

    def unit(x: Column) -> Column:
        return F.least(F.greatest(x, zero), one)

    span, floor = float(max(c.max_price - c.min_price, 1)), float(max(c.min_sqft, 1))
    wanted = float(max(c.building.min_amenity_matches, 1) * 2)
    points = (
        F.when(miles.isNotNull(), (one - F.least(miles / max(c.max_miles, 1e-6), one)) * 30.0).otherwise(10.0)
        + F.coalesce((one - unit((price - c.min_price) / span)) * 20.0, zero)
        + F.when(F.coalesce(sqft, F.lit(0)) != 0, unit((sqft - c.min_sqft) / floor) * 20.0).otherwise(0.0)
        + F.least(F.size(F.map_keys("amenity_matches")) / wanted, one) * 15.0
        + F.when(F.coalesce(year, F.lit(0)) == 0, 0.0).when(year >= fv.NEW_BUILD_YEAR, 10.0)
        .when(year >= c.building.min_year_built, 6.0).otherwise(2.0)
        + F.when(ratio.isNull(), 0.0).when(ratio <= 1.0, 5.0)
        .otherwise(F.greatest(zero, F.lit(5.0) - (ratio - 1.0) * 25.0))
    )
    return tx.half_up(F.least(points, F.lit(100.0)), 1)


def _looked_up(df: DataFrame, c: SearchCriteria) -> DataFrame:
    """What several checks ask of the texts, each a column of its own, so it is worked out once."""
    blob, declared, b = F.col("__blob"), F.col("__declared"), c.building
    staged = df.withColumns({
        "__blob": F.coalesce(tx.match_form(F.col("search_text")), F.lit("")),
        "__declared": tx.match_form(F.coalesce("property_type", F.lit(""))),
    })
    staged = staged.withColumns({
        "__denied": tx.any_contains(declared, fv.DENIED_TYPES), "__accepted": _accepted(declared, c), "__inferred": _accepted(blob, c),
        "__rescued": tx.first_contained(blob, c.positive_keywords),
        "__renovated": tx.any_contains(blob, b.renovation_keywords) if b.allow_older_if_renovated else F.lit(False),
        "amenity_matches": category_map(blob, b.amenities),
    })
    return scan_keywords(staged, "__blob", c.excluded_keywords, normalized=True).drop("__blob")


_SAID = {n: f"__{n}" for n in ("declared", "denied", "accepted", "inferred", "rescued", "renovated")} | {
    n: n for n in ("amenity_matches", "keyword_scan")}


def read_texts_once(df: DataFrame, criteria: SearchCriteria | None = None) -> DataFrame:
    """Add the facts of ``derive.read_texts``, and as ``text_facts`` what ``evaluate`` asks of the texts by these criteria, both worked
    out once for each different set of texts: they cost most of a verdict, and all sightings of a unit repeat them."""
    c = criteria or SearchCriteria()

    def facts(texts: DataFrame) -> DataFrame:
        found = _looked_up(derive.read_texts(texts), c)
        said = F.struct(*[F.col(made).alias(n) for n, made in _SAID.items()])
        # written, so that the planner knows how few they are: joined by shuffle, all rows with one text would be one task's
        return written(found.withColumn("text_facts", said).drop(*_SAID.values()), "texts")

    return tx.once_per_value(df, derive.TEXTS, facts)


def judge(df: DataFrame, criteria: SearchCriteria | None = None) -> DataFrame:
    """``evaluate`` for sightings as they come, with their identities and facts; texts that repeat are read once."""
    known = derive.derive_identity(read_texts_once(df, criteria))
    return evaluate(derive.derive_place(known), criteria).drop("text_facts")


def evaluate(df: DataFrame, criteria: SearchCriteria | None = None) -> DataFrame:
    """Add ``amenity_matches``, ``keyword_scan``, ``failures``, ``warnings``, ``passed``, ``score`` and ``reason``.

    Row by row, no shuffle; the searched text is brought to match form once, or not at all for rows that have ``text_facts`` by
    the same criteria, see ``read_texts_once``. Messages are columns before they are an array:
    a higher-order function, which drops the missing ones, is interpreted with all that stands inside it.
    """
    c = criteria or SearchCriteria()
    df = df.drop("amenity_matches", "keyword_scan", "failures", "warnings", "passed", "score", "reason")
    if "price_to_estimate_ratio" not in df.columns:
        df = df.withColumn("price_to_estimate_ratio", F.lit(None).cast("double"))
    if "text_facts" in df.columns:
        staged = df.withColumns({made: F.col(f"text_facts.{n}") for n, made in _SAID.items()})
    else:
        staged = _looked_up(df, c)
    staged = staged.withColumn("__known_city", F.lower(F.btrim(F.coalesce("city", F.lit("")))))
    checks = [check(c) for check in (_location, _property_type, _size, _price, _lease, _building)]
    said = {kind: [m.cast("string") for pair in checks for m in pair[which]] for which, kind in enumerate(("failures", "warnings"))}
    staged = staged.withColumns({f"__{kind}_{i}": m for kind, messages in said.items() for i, m in enumerate(messages)})

    def flat(kind: str) -> Column:
        each = [F.col(f"__{kind}_{i}") for i in range(len(said[kind]))]
        # read twice, a message is not moved into the array again
        return F.array_compact(F.array(*[F.when(m.isNotNull(), m) for m in each]))

    staged = staged.withColumns({kind: flat(kind) for kind in said})
    made = [x for x in staged.columns if x.startswith(("__failures_", "__warnings_"))]
    made += ["__known_city", *[x for x in _SAID.values() if x.startswith("__")]]
    staged = tx.settle(staged.drop(*made), "amenity_matches", "failures", "warnings").withColumn("passed", F.size("failures") == 0)
    return staged.withColumns({"score": F.when(F.col("passed"), score_column(c)).otherwise(0.0), "reason": reason()})


def reason() -> Column:
    said = F.nullif(F.array_join("warnings", "; "), F.lit(""))
    return F.when(F.col("passed"), F.coalesce(said, F.lit("all constraints met"))).otherwise(F.array_join("failures", "; "))


def explain_verdicts(df: DataFrame, *keys: str) -> DataFrame:
    """Long form: one row per failure or warning of the given rows."""
    return df.select(
        *keys, "passed",
        F.explode(F.concat(
            F.transform("failures", lambda m, i: F.struct(F.lit("failure").alias("kind"), (i + 1).alias("pos"), m.alias("message"))),
            F.transform("warnings", lambda m, i: F.struct(F.lit("warning").alias("kind"), (i + 1).alias("pos"), m.alias("message"))),
        )).alias("m"),
    ).select(*keys, "passed", "m.*")
