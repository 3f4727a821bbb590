"""Postal addresses: from one line of text to canonical parts and identity keys, as Columns.

The steps narrow a street line from both ends, so each step is a column of its own; the temporary columns carry
the prefix ``__a_`` and are dropped at the end. Nothing here shuffles.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitlens import fixed_values as fv
from unitlens.functions.text import bind, blank_to_null, clean_text, lookup_table, settle, strip_chars, title_case

PARTS_TYPE = (
    "struct<number:string,directional:string,street:string,suffix:string,post_directional:string,"
    "unit:string,city:string,state:string,zip5:string>"
)


def _text(c: Column) -> Column:
    return F.coalesce(clean_text(c), F.lit(""))


def normalize_city(c: Column) -> Column:
    aliases = lookup_table(fv.CITY_ALIASES)
    text = strip_chars(_text(c), " ,.")
    return bind(text, lambda t: F.coalesce(F.try_element_at(aliases, F.lower(t)), title_case(t)))


def normalize_state(c: Column) -> Column:
    aliases = lookup_table(fv.STATE_ALIASES)
    text = strip_chars(_text(c), " ,.")
    return bind(text, lambda t: F.coalesce(F.try_element_at(aliases, F.lower(t)), F.substring(F.upper(t), 1, 2)))


def normalize_zip(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d{5})", 1)


def normalize_unit(c: Column) -> Column:
    noise = rf"^\s*(?:{'|'.join(fv.UNIT_NOISE_MARKERS)})\b\.?[\s#-]*"
    kept = F.regexp_replace(F.regexp_replace(F.lower(_text(c)), noise, ""), r"[^a-z0-9]+", "")
    return F.regexp_replace(kept, rf"^(?:{'|'.join(fv.UNIT_EMPTY_WORDS)})$", "")


def _peel(segment: Column) -> Column:
    """A trailing ZIP and state taken off a segment: struct(body, state, zip)."""

    def parts(text: Column, rest: Column) -> Column:
        only_state = F.lower(rest).isin(*fv.STATE_ALIASES)
        body = strip_chars(F.regexp_replace(rest, fv.TRAILING_STATE_PATTERN, ""), " ,")
        return F.struct(
            F.when(only_state, F.lit("")).otherwise(body).alias("body"),
            F.when(only_state, rest).otherwise(F.regexp_extract(rest, fv.TRAILING_STATE_PATTERN, 1)).alias("state"),
            F.regexp_extract(text, fv.TRAILING_ZIP_PATTERN, 1).alias("zip"),
        )

    return bind(strip_chars(segment, " ,"), lambda text: bind(
        strip_chars(F.regexp_replace(text, fv.TRAILING_ZIP_PATTERN, ""), " ,"), lambda rest: parts(text, rest)))


def _or_else(given: Column, parsed: Column) -> Column:
    return bind(given, lambda g: F.when(g != "", g).otherwise(F.coalesce(parsed, F.lit(""))))


_HASH_UNIT = rf"#\s*{fv.UNIT_VALUE_PATTERN}\s*$"
_MARKED_UNIT = rf"(?i)\b({'|'.join(fv.UNIT_MARKERS)})\b[\s.#-]*{fv.UNIT_VALUE_PATTERN}\s*$"
_CITY_TAIL = (
    r"(?i)(?<![\p{L}\p{N}])("
    + "|".join(re.escape(a).replace(r"\ ", " ") for a in sorted(fv.CITY_ALIASES, key=len, reverse=True))
    + r")$"
)


def parse_lines(df: DataFrame, address: str = "address", out: str = "address_line") -> DataFrame:
    """Add ``out``, what the address line says on its own. It depends on nothing but ``address``."""
    a = {n: F.col(f"__a_{n}") for n in (
        "segs", "locs", "line", "tail", "hash", "mark", "words", "bare", "street", "t0", "t1", "t2", "t3", "t4",
        "number", "dir", "post", "suffix", "unit",
    )}
    no_comma = F.size(a["segs"]) == 1

    staged = df.withColumn(
        "__a_segs",
        F.filter(F.transform(F.split(_text(F.col(address)), ","), lambda s: F.btrim(s)), lambda s: s != ""),
    ).withColumns({
        # what stands after the first comma, and for a line without one, what stands at its end
        "__a_locs": F.when(F.size(a["segs"]) > 1, F.transform(F.slice(a["segs"], F.lit(2), F.size(a["segs"])), _peel)),
        "__a_tail": F.when(no_comma, _peel(F.get(a["segs"], 0))),
    }).withColumn(
        "__a_line",
        F.when(no_comma, F.when(
            a["tail"]["body"].rlike(_CITY_TAIL),
            strip_chars(F.regexp_replace(a["tail"]["body"], _CITY_TAIL, ""), " ,-"),
        ).otherwise(a["tail"]["body"])).otherwise(F.coalesce(F.get(a["segs"], 0), F.lit(""))),
    ).withColumns({
        "__a_hash": F.regexp_extract(a["line"], _HASH_UNIT, 1),
        "__a_mark": F.regexp_extract(a["line"], _MARKED_UNIT, 2),
        "__a_words": F.filter(F.split(a["line"], r"\s+"), lambda t: t != ""),
    })

    n = F.size(a["words"])
    before_last = F.lower(strip_chars(F.get(a["words"], n - 2), ",."))
    last = strip_chars(F.get(a["words"], n - 1), ",")
    anchored = before_last.isin(*fv.STREET_SUFFIXES, *fv.DIRECTIONALS)
    label = F.lower(F.regexp_extract(a["line"], _MARKED_UNIT, 1))
    marked = F.when(label.isin(*fv.UNIT_LABEL_MARKERS), F.concat(label, a["mark"])).otherwise(a["mark"])
    staged = staged.withColumn(
        "__a_bare", F.when((n >= 3) & anchored & last.rlike(fv.BARE_UNIT_PATTERN), last)
    ).withColumns({
        "__a_unit": F.when(a["hash"] != "", a["hash"]).when(a["mark"] != "", marked).otherwise(
            F.coalesce(a["bare"], F.lit(""))),
        "__a_street": F.when(a["hash"] != "", strip_chars(F.regexp_replace(a["line"], _HASH_UNIT, ""), " ,-"))
        .when(a["mark"] != "", strip_chars(F.regexp_replace(a["line"], _MARKED_UNIT, ""), " ,-"))
        .when(a["bare"].isNotNull(), strip_chars(F.array_join(F.slice(a["words"], F.lit(1), n - 1), " "), " ,-"))
        .otherwise(F.btrim(a["line"])),
    })

    ordinals, dirs, suffixes = (lookup_table(t) for t in (fv.ORDINAL_WORDS, fv.DIRECTIONALS, fv.STREET_SUFFIXES))

    def word(t: Column) -> Column:
        bare = strip_chars(t, ".,")
        return F.coalesce(F.try_element_at(ordinals, bare), bare)

    def drop_first(t: Column, taken: Column) -> Column:
        return F.when(taken != "", F.slice(t, F.lit(2), F.size(t))).otherwise(t)

    def drop_last(t: Column, taken: Column) -> Column:
        return F.when(taken != "", F.slice(t, F.lit(1), F.size(t) - 1)).otherwise(t)

    def end_word(t: Column, table: Column, position) -> Column:
        return F.when(F.size(t) > 1, F.coalesce(F.try_element_at(table, F.get(t, position)), F.lit(""))).otherwise("")

    first = F.coalesce(F.get(a["t0"], 0), F.lit(""))
    staged = (
        staged.withColumn("__a_t0", F.filter(
            F.transform(F.split(F.lower(a["street"]), r"\s+"), word), lambda t: t != ""))
        .withColumn("__a_number", F.when(first.rlike(fv.HOUSE_NUMBER_PATTERN), first).otherwise(""))
        .withColumn("__a_t1", drop_first(a["t0"], a["number"]))
        .withColumn("__a_dir", end_word(a["t1"], dirs, 0))
        .withColumn("__a_t2", drop_first(a["t1"], a["dir"]))
        .withColumn("__a_post", end_word(a["t2"], dirs, F.size(a["t2"]) - 1))
        .withColumn("__a_t3", drop_last(a["t2"], a["post"]))
        .withColumn("__a_suffix", end_word(a["t3"], suffixes, F.size(a["t3"]) - 1))
        .withColumn("__a_t4", drop_last(a["t3"], a["suffix"]))
    )

    locs = a["locs"]

    def found_in_locs(name: str) -> Column:
        return F.get(F.filter(F.transform(locs, lambda x: x[name]), lambda v: v != ""), 0)

    tail_city = F.regexp_extract(a["tail"]["body"], _CITY_TAIL, 1)
    said = F.struct(
        a["number"].alias("number"), a["dir"].alias("directional"),
        F.array_join(a["t4"], " ").alias("street"), a["suffix"].alias("suffix"), a["post"].alias("post_directional"),
        a["unit"].alias("unit"), F.coalesce(F.get(locs, 0)["body"], tail_city).alias("city"),
        F.coalesce(found_in_locs("state"), a["tail"]["state"]).alias("state"),
        F.coalesce(found_in_locs("zip"), a["tail"]["zip"]).alias("zip5"),
    )
    return settle(staged.withColumn(out, said).drop(*[f"__a_{n}" for n in a]), out)


def standardize_addresses(
    df: DataFrame, address: str = "address", city: str = "city", state: str = "state",
    zip_code: str = "zip_code", unit: str = "unit", out: str = "address_parts", line: str | None = None,
) -> DataFrame:
    """Add ``out``, the canonical parts of an address. Separate fields win over what the line says.

    ``line`` names a column with what ``parse_lines`` made of ``address``, so that it is not parsed again; it stays. There a
    NULL is a missing address.
    """
    staged = df if line else parse_lines(df, address, "__a_said")
    said = F.col(line or "__a_said")
    a = {n: F.col(f"__a_{n}") for n in ("unit", "city", "state", "zip")}
    staged = staged.withColumns({
        "__a_unit": _or_else(normalize_unit(F.col(unit)), normalize_unit(said["unit"])),
        "__a_city": normalize_city(_or_else(_text(F.col(city)), said["city"])),
        "__a_state": normalize_state(_or_else(_text(F.col(state)), said["state"])),
        "__a_zip": _or_else(normalize_zip(F.col(zip_code)), said["zip5"]),
    })
    street = [F.coalesce(said[n], F.lit("")).alias(n) for n in ("number", "directional", "street", "suffix", "post_directional")]
    parts = F.struct(*street, a["unit"].alias("unit"), a["city"].alias("city"), a["state"].alias("state"), a["zip"].alias("zip5"))
    return settle(staged.withColumn(out, parts).drop("__a_said", *[f"__a_{n}" for n in a]), out)


def is_usable(parts: Column) -> Column:
    return (parts["number"] != "") & (parts["street"] != "")


def street_line(parts: Column) -> Column:
    names = ("number", "directional", "street", "suffix", "post_directional")
    return F.concat_ws(" ", *[blank_to_null(parts[n]) for n in names])


def display_address(parts: Column) -> Column:
    line = title_case(street_line(parts))
    line = F.when(parts["unit"] != "", F.concat(line, F.lit(" #"), F.upper(parts["unit"]))).otherwise(line)
    region = F.btrim(F.concat_ws(" ", parts["state"], parts["zip5"]))
    return F.concat_ws(", ", line, blank_to_null(parts["city"]), blank_to_null(region))


def _hash(*parts: Column) -> Column:
    """128 bits over the parts; blanks keep their place."""
    return F.md5(F.concat_ws("|", *[F.lower(F.btrim(F.coalesce(p, F.lit("")))) for p in parts]))


def building_hash(parts: Column) -> Column:
    place = F.coalesce(blank_to_null(parts["zip5"]), parts["city"])
    names = ("number", "directional", "street", "suffix", "post_directional")
    return F.when(is_usable(parts), _hash(*[parts[n] for n in names], place))


def unit_hash(parts: Column) -> Column:
    return F.when(is_usable(parts), _hash(building_hash(parts), parts["unit"]))


def geo_hash(latitude: Column, longitude: Column, unit: Column) -> Column:
    """Four decimals, about 11 m: separates towers and forgives noise."""
    both = latitude.isNotNull() & longitude.isNotNull()
    return F.when(both, _hash(
        F.format_string("%.4f", latitude), F.format_string("%.4f", longitude), normalize_unit(unit)))


def valuation_line(parts: Column) -> Column:
    """One-line address a rent model is asked with; NULL if the address is not usable."""
    line = title_case(street_line(parts))
    line = F.when(parts["unit"] != "", F.concat(line, F.lit(" #"), F.upper(parts["unit"]))).otherwise(line)
    names = ("city", "state", "zip5")
    return F.when(is_usable(parts), F.concat_ws(", ", line, *[blank_to_null(parts[n]) for n in names]))


def valuation_zip_line(parts: Column) -> Column:
    """The same for a model that takes the ZIP apart and insists on it."""
    line = title_case(street_line(parts))
    line = F.when(parts["unit"] != "", F.concat(line, F.lit(" Unit "), F.upper(parts["unit"]))).otherwise(line)
    return F.when(is_usable(parts) & (parts["zip5"] != ""), F.concat_ws("|", line, parts["zip5"]))
