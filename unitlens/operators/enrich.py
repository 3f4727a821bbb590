"""Checking units against a register and against price models.

Both sides of every lookup are reduced to one candidate per key before the join, so a tower with many units never
meets its register rows pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitlens import fixed_values as fv
from unitlens.criteria import EnrichmentCriteria
from unitlens.functions import address as ad
from unitlens.functions import text as tx
from unitlens.operators.sinks import written

_FACTS = ("folio", "site_address", "unit", "sqft", "year_built", "beds", "baths", "use_code", "source")


def with_street_key(register: DataFrame) -> DataFrame:
    """Register rows with the canonical street line of their address."""
    blank = F.lit(None).cast("string")
    staged = register.withColumns({f"__r_{c}": blank for c in ("city", "state", "zip", "unit")})
    staged = ad.standardize_addresses(staged, "site_address", "__r_city", "__r_state", "__r_zip", "__r_unit", out="__r_parts")
    return staged.withColumn("street_key", ad.street_line(F.col("__r_parts"))).drop(
        "__r_parts", *[f"__r_{c}" for c in ("city", "state", "zip", "unit")])


def _substrings(c: Column, length: Column) -> Column:
    """The substrings of a text that have the given length; none if it is shorter."""
    starts = F.when(F.length(c) >= length, F.sequence(F.lit(1), F.length(c) - length + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, length)))


def _spread_nulls(key: Column, *by: str) -> Column:
    """``key``, or a text of its own that no key equals: rows without a key do not meet in one partition."""
    return F.coalesce(key, F.concat(F.lit("\0"), F.xxhash64(*by).cast("string")))


def match_register(units: DataFrame, register: DataFrame, street: str = "street_key", unit: str = "unit") -> DataFrame:
    """Left join each unit to its best register row (columns ``reg``): the row of the same unit, else one whose
    address ends in a word holding the unit, else the first of the street.

    ``register`` has ``street_key``, ``reg_seq`` and the facts. "Holding" is answered without a join of all
    pairs: of its last word the register lists the substrings that are as long as a unit of that street, and only those
    that are a unit asked for there go on. The search carries ``reg_seq`` alone; the facts are fetched for the winners.
    Units are read twice, so write them down first if they are costly to derive.
    """
    known = register.where("street_key is not null")
    record = F.struct("reg_seq", *[F.col(c) for c in _FACTS]).alias("rec")
    last_word = ad.normalize_unit(F.element_at(F.split(F.btrim("site_address"), r"\s+"), -1))
    words = known.select("street_key", "reg_seq", ad.normalize_unit(F.col("unit")).alias("u"), last_word.alias("w"))
    u = units.withColumns({"__street": _spread_nulls(F.nullif(F.col(street), F.lit("")), *units.columns[:3]),
                           "__unit": ad.normalize_unit(F.col(unit))})
    asked = u.where(F.col(street).isNotNull() & (F.col("__unit") != "")).select(
        F.col("__street").alias("street_key"), F.col("__unit").alias("probe")).distinct()
    lengths = asked.select("street_key", F.length("probe").alias("n")).distinct()
    exact = words.where("u <> ''").select("street_key", F.col("u").alias("probe"), F.lit(0).alias("rank"), "reg_seq")
    # rows of the register are many on few streets and small in their file: a size that is judged by the file would broadcast them
    held = words.where("w <> ''").hint("merge").join(lengths, "street_key").select(
        "street_key", F.explode(_substrings(F.col("w"), F.col("n"))).alias("probe"), F.lit(1).alias("rank"), "reg_seq")
    best = exact.unionByName(held).join(asked, ["street_key", "probe"], "left_semi").groupBy("street_key", "probe").agg(
        F.min(F.struct("rank", "reg_seq")).alias("best")).select("street_key", "probe", "best.*")
    # rows of a street that repeat a reg_seq count as one, the least
    by_unit = best.join(known.select("street_key", "reg_seq", record).hint("merge"), ["street_key", "reg_seq"]).groupBy(
        F.col("street_key").alias("__s1"), F.col("probe").alias("__p1")).agg(F.min(F.struct("rank", "rec")).alias("hit"))
    by_street = known.groupBy(F.col("street_key").alias("__s2")).agg(F.min(record).alias("first"))
    u = u.join(by_unit, (F.col("__street") == F.col("__s1")) & (F.col("__unit") == F.col("__p1")), "left")
    u = u.join(by_street, F.col("__street") == F.col("__s2"), "left")
    return u.withColumns({
        "reg": F.coalesce(F.col("hit.rec"), F.col("first")),
        "reg_match": F.when(F.col("hit").isNotNull(), F.when(F.col("hit.rank") == 0, "unit").otherwise("address"))
        .when(F.col("first").isNotNull(), "street"),
    }).drop("hit", "first", "__street", "__unit", "__s1", "__p1", "__s2")


_NUMBER_TAIL, _WORD_HEAD = 6, 3  # characters of a house number and of a word that make a key


def street_candidates(streets: DataFrame, parcels: DataFrame, street: str = "street_key") -> DataFrame:
    """Parcels whose address contains a street line, as register rows of that street; a parcel given twice stays twice.

    A contained line starts with a house number, so its first word ends a word of the address and its second word
    starts the next. Both sides are keyed by the last characters of the former and the first of the latter (the whole
    word where the line goes on behind it), and only rows with equal keys are compared. Exact: the key is implied by
    containment. A parcel has many keys and its table is judged by what it is before them, so it must not be broadcast.
    """
    wanted = streets.select(F.upper(tx.title_case(F.col(street))).alias("line"), F.col(street).alias("street_key")).where(
        "street_key rlike '^[0-9]'").distinct()
    words = F.split("line", " ")
    second = F.get(words, 1)
    wanted = wanted.withColumn("block", F.concat(
        F.when(F.size(words) > 2, F.lit("=")).otherwise(F.lit("~")), F.right(F.get(words, 0), F.lit(_NUMBER_TAIL)), F.lit(" "),
        F.when(F.size(words) > 2, second).otherwise(F.left(second, F.lit(_WORD_HEAD)))))
    return parcel_keys(parcels).hint("merge").join(wanted, "block").where(F.contains("__addr", "line")).drop("block", "line", "__addr")


def parcel_keys(parcels: DataFrame) -> DataFrame:
    """Parcels with ``block``, one row per key a street line in their address may have: at most
    ``_NUMBER_TAIL * (1 + _WORD_HEAD)`` for each two neighbouring words, however long they are."""
    # a tail shorter than the limit is a whole house number, one of full length may be the end of a longer one
    blocks = F.expr(f"""
        array_distinct(flatten(transform(sequence(0, greatest(size(__w) - 2, 0)), i -> flatten(transform(
            filter(transform(sequence(1, greatest(least(length(__w[i]), {_NUMBER_TAIL}), 1)), n -> right(__w[i], n)),
                   t -> t rlike '^[0-9]' or length(t) = {_NUMBER_TAIL}),
            t -> concat(
                array(concat('=', t, ' ', coalesce(get(__w, i + 1), ''))),
                transform(sequence(1, greatest(least(length(coalesce(get(__w, i + 1), '')), {_WORD_HEAD}), 1)),
                          n -> concat('~', t, ' ', left(coalesce(get(__w, i + 1), ''), n)))))))))""")
    sides = parcels.withColumn("__addr", F.upper("site_address")).withColumn("__w", F.split("__addr", " "))
    return sides.withColumn("block", F.explode(blocks)).drop("__w")


def validate_against_register(df: DataFrame) -> DataFrame:
    """Overlay the facts of ``reg``: fill what is missing, replace what differs materially, flag conflicts."""
    reg = {f: F.col(f"reg.{f}") for f in _FACTS}
    hit = reg["sqft"].isNotNull() | reg["year_built"].isNotNull()
    r_sqft, r_year = F.nullif(reg["sqft"], F.lit(0)), F.nullif(reg["year_built"], F.lit(0))
    sqft, year = F.col("sqft"), F.col("year_built")
    sqft_off = F.coalesce(F.abs(sqft - r_sqft) / r_sqft > fv.SQFT_CONFLICT_RATIO, F.lit(False))
    year_off = F.coalesce(F.abs(year - r_year) > fv.YEAR_CONFLICT_YEARS, F.lit(False))
    return df.withColumns({
        "county_hit": F.coalesce(hit, F.lit(False)),
        "county_folio": F.when(hit, reg["folio"]), "county_sqft": F.when(hit, reg["sqft"]),
        "county_year_built": F.when(hit, reg["year_built"]), "county_source": F.when(hit, reg["source"]),
        "sqft_conflict": sqft_off, "year_conflict": year_off, "county_conflict": sqft_off | year_off,
        "sqft_filled": sqft.isNull() & r_sqft.isNotNull(), "year_filled": year.isNull() & r_year.isNotNull(),
        "sqft": F.when(sqft.isNull() | sqft_off, F.coalesce(r_sqft, sqft)).otherwise(sqft),
        "year_built": F.when(year.isNull() | year_off, F.coalesce(r_year, year)).otherwise(year),
        "beds": F.coalesce("beds", F.when(hit, reg["beds"])), "baths": F.coalesce("baths", F.when(hit, reg["baths"])),
    })


def verify_units(df: DataFrame, register: DataFrame, parcels: DataFrame | None = None) -> DataFrame:
    """Register lookup, and for units it has no street for the parcel layer, then the overlay."""
    df = df.withColumn("street_key", F.when(ad.is_usable(F.col("address_parts")), ad.street_line(F.col("address_parts"))))
    matched = match_register(df, with_street_key(register))
    if parcels is not None:
        # asked once per street and unit, however often a unit was sighted; the keys exist only where the first lookup found nothing
        lost = F.when(F.col("reg").isNull() & F.col("street_key").isNotNull(), F.concat_ws("\0", "street_key", F.coalesce("unit", F.lit("\0"))))
        matched = matched.withColumn("__lost", lost)
        # both are read several times, and the plan would hold all that is behind them each time
        rest = written(matched.where("__lost is not null").select("__lost", "street_key", "unit").distinct(), "lost-streets")
        second = match_register(rest, written(street_candidates(rest, parcels), "parcel-candidates")).select(
            F.col("__lost").alias("__ask"), F.col("reg").alias("__reg2"), F.col("reg_match").alias("__match2"))
        matched = matched.withColumn("__lost", _spread_nulls(F.col("__lost"), "dedupe_key")).join(
            second, F.col("__lost") == F.col("__ask"), "left").withColumns({
                "reg": F.coalesce("reg", "__reg2"), "reg_match": F.coalesce("reg_match", "__match2"),
            }).drop("__reg2", "__match2", "__lost", "__ask")
    return validate_against_register(matched).drop("reg")


def price_against_models(df: DataFrame, valuations: DataFrame, criteria: EnrichmentCriteria | None = None) -> DataFrame:
    """Rent and value estimates by address, the first provider that has one, then ratio, verdict and yield.

    ``valuations`` holds provider, address_key, rent, rent_low, rent_high, value; the key is the one-line address for
    the first provider and line|zip for the second. Of repeated answers the first by ``val_seq`` counts where there is
    that column, else the lowest.
    """
    c = criteria or EnrichmentCriteria()
    seq = [F.col("val_seq")] if "val_seq" in valuations.columns else []
    keys = {"rentcast": ad.valuation_line, "housecanary": ad.valuation_zip_line}
    rents, values = [], []
    for provider in c.rent_providers:
        one = valuations.where(F.col("provider") == provider).groupBy("address_key").agg(
            F.min(F.when(F.col("rent") > 0, F.struct(
                *seq, "rent", "rent_low", "rent_high", F.lit(provider).alias("by")))).alias(f"__rent_{provider}"),
            F.min(F.when(F.col("value") > 0, F.struct(*seq, "value", F.lit(provider).alias("by")))).alias(f"__value_{provider}"))
        asked = _spread_nulls(keys[provider](F.col("address_parts")), *df.columns[:3])
        df = df.withColumn("address_key", asked).join(one.where("address_key is not null"), "address_key", "left")
        rents.append(F.col(f"__rent_{provider}"))
        values.append(F.col(f"__value_{provider}"))
    df = df.withColumns({"__rent": F.coalesce(*rents), "__value": F.coalesce(*values)})
    price = F.nullif(F.col("price"), F.lit(0))
    ratio = price / F.col("__rent.rent")
    return df.withColumns({
        "rent_estimate": F.col("__rent.rent"), "rent_estimate_low": F.col("__rent.rent_low"),
        "rent_estimate_high": F.col("__rent.rent_high"), "rent_estimate_source": F.col("__rent.by"),
        "value_estimate": F.col("__value.value"), "value_estimate_source": F.col("__value.by"),
        "price_to_estimate_ratio": tx.half_up(ratio, 3),
        "price_verdict": F.when(ratio >= c.overpriced_ratio, "above market")
        .when(ratio <= c.underpriced_ratio, "below market").when(ratio.isNotNull(), "at market"),
        "gross_yield_pct": tx.half_up(price * 12 / F.col("__value.value") * 100, 2),
    }).drop("address_key", "__rent", "__value", *[f"__{k}_{p}" for p in c.rent_providers for k in ("rent", "value")])


ENRICHMENT_FIELDS = (
    "rent_estimate", "rent_estimate_low", "rent_estimate_high", "rent_estimate_source", "value_estimate",
    "value_estimate_source", "price_to_estimate_ratio", "gross_yield_pct", "price_verdict", "county_sqft",
    "county_year_built", "county_folio", "county_source", "county_conflict",
)


def enrich(df: DataFrame, register: DataFrame | None, valuations: DataFrame | None, parcels: DataFrame | None = None,
           criteria: EnrichmentCriteria | None = None) -> DataFrame:
    """Register first, as it can change the size a price is judged by; then the models. With ``only_matched`` the
    rows that failed skip the lookups and come back unchanged."""
    c = criteria or EnrichmentCriteria()
    # rows that are not asked for have no address to look up; they pass through the same joins and find nothing
    asked = F.col("passed") if c.only_matched else F.lit(True)
    done = df.withColumns({"__parts": F.col("address_parts"), "address_parts": F.when(asked, F.col("address_parts"))})
    if register is not None and c.register:
        done = verify_units(done, register, parcels)
    if valuations is not None:
        done = price_against_models(done.drop("price_to_estimate_ratio"), valuations, c)
    return done.withColumns({"address_parts": F.col("__parts"), "enrichment_attempted": F.when(asked, True)}).drop("__parts")


def valuation_type() -> Column:
    """The models' own word for a property type."""
    return F.try_element_at(tx.lookup_table(fv.VALUATION_TYPES), F.lower(F.btrim(F.col("property_type"))))


def valuation_requests(df: DataFrame) -> DataFrame:
    """What the models are asked: one row per address line, with the type in their own words and the size.

    Of units with one line the earliest by ``ingest_seq`` that states a fact gives it; units without a usable address are
    not asked for. A type the models do not know is left out of the request.
    """
    line = ad.valuation_line(F.col("address_parts"))
    asked = df.select("ingest_seq", line.alias("address_key"), ad.valuation_zip_line(F.col("address_parts")).alias("zip_key"),
                      valuation_type().alias("property_type"), "beds", "baths", "sqft").where("address_key is not null")
    facts = ("zip_key", "property_type", "beds", "baths", "sqft")
    return asked.groupBy("address_key").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ingest_seq"))).alias(c) for c in facts])


def enrichment_counters(df: DataFrame) -> DataFrame:
    """One row of counts over an enriched table."""
    flags = {"attempted": "enrichment_attempted", "county_hits": "county_hit", "sqft_conflicts": "sqft_conflict",
             "year_conflicts": "year_conflict", "sqft_filled": "sqft_filled", "year_filled": "year_filled"}
    counts = [F.count_if(F.col(c)).alias(n) for n, c in flags.items() if c in df.columns]
    if "rent_estimate" in df.columns:
        counts.append(F.count("rent_estimate").alias("rent_estimates"))
    return df.agg(*counts)
