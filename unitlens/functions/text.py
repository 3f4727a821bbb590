"""Text expressions: cleaning, match form, phrase patterns and numbers out of free text.

Everything here is a Column built from JVM functions, except ``fold_unicode``: NFKD has no builtin, so it is an
Arrow UDF that is handed only the values which are not plain ASCII.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitlens import fixed_values as fv

_NON_ASCII = r"[^\x00-\x7F]"
_SPACES = r"[\s\x1c-\x1f]+"
#: White space outside ASCII, which Java's ``\\s`` does not match; read as plain spaces everywhere.
WIDE_SPACES = "".join(chr(c) for c in range(0x80, 0x3001) if chr(c).isspace())


def sql_text(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup_table(table: dict) -> Column:
    """A literal map column, parsed in one go."""
    return F.expr("map(" + ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in table.items()) + ")")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def bind(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def apart(c: Column) -> Column:
    """``c`` by way of a higher-order function, for one cheap column of a wide projection. Such a projection stays out of
    whole-stage code and is compiled in many short methods; as one long method, of more than 8,000 bytes, the JVM would
    interpret it for every row."""
    return bind(c, lambda x: x)


def settle(df: DataFrame, *names: str) -> DataFrame:
    """Pass the named columns through a one-row generator.

    Filters and join keys above are not pushed below it, so a condition on a derived column reads the column
    and does not derive it again at the scan. Conditions on the other columns still go down to the source.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names))))


def once_per_value(df: DataFrame, keys: tuple[str, ...], derive) -> DataFrame:
    """``df`` with the columns that ``derive`` adds to its columns ``keys``, worked out once for each different value of them.

    For what costs far more than a row's way through a join and repeats, as the texts of a unit do in all its sightings. Equal
    values combine on the map side, nulls are values, the join is many-to-one. ``df`` is read twice.
    """
    values = derive(df.select(*keys).distinct())
    held = values.withColumnsRenamed({k: f"__value_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__value_{k}")) for k in keys])
    rows = df.drop(*[c for c in values.columns if c not in keys])
    return rows.join(held, on, "left").drop(*[f"__value_{k}" for k in keys])


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def _nfkd_udf():
    @F.pandas_udf("string")
    def nfkd(values: pd.Series) -> pd.Series:
        return values.map(lambda s: unicodedata.normalize("NFKD", s), na_action="ignore")

    return nfkd


def fold_unicode(df: DataFrame, *columns: str) -> DataFrame:
    """NFKD of the named string columns. Values in ASCII never leave the JVM."""
    nfkd = _nfkd_udf()
    return df.withColumns(
        {c: F.coalesce(nfkd(F.when(F.col(c).rlike(_NON_ASCII), F.col(c))), F.col(c)) for c in columns}
    )


def plain_spaces(c: Column) -> Column:
    return F.translate(c, WIDE_SPACES, " " * len(WIDE_SPACES))


def clean_text(c: Column) -> Column:
    """Dashes, quotes and spaces unified, tags dropped, whitespace collapsed. NULL stays NULL."""
    unified = F.translate(c, "–—’" + WIDE_SPACES, "--'" + " " * len(WIDE_SPACES))
    untagged = F.regexp_replace(unified, r"<[^>]+>", " ")
    return F.btrim(F.regexp_replace(untagged, _SPACES, " "))


def match_form(c: Column) -> Column:
    """Lower case, letters, digits and a few signs only; the text all phrase searches run on."""
    kept = F.regexp_replace(F.lower(clean_text(c)), r"[^a-z0-9\-/+.,$ ]", " ")
    return F.btrim(F.regexp_replace(kept, r" +", " "))


def match_form_literal(text: str) -> str:
    """The match form of a keyword, worked out once on the driver."""
    folded = unicodedata.normalize("NFKD", text).lower()
    return " ".join(re.sub(r"[^a-z0-9\-/+.,$ ]", " ", folded).split())


def _phrase_body(phrase: str) -> str:
    parts = [p for p in re.split(r"[\s\-_/]+", match_form_literal(phrase)) if p]
    return r"[\s\-_]*".join(re.sub(r"([.+$^*?()\[\]{}|\\])", r"\\\1", p) for p in parts)


def phrase_pattern(*phrases: str) -> str:
    """Java regex for any of the phrases as whole tokens, whatever separates their words."""
    bodies = [b for b in dict.fromkeys(_phrase_body(p) for p in phrases) if b]
    return rf"(?<![a-z0-9])(?:{'|'.join(bodies)})(?![a-z0-9])" if bodies else r"(?!x)x"


def longest_word(phrase: str) -> str:
    """The longest literal part of a phrase's pattern: a text without it cannot match."""
    return max(re.split(r"[\s\-_/]+", match_form_literal(phrase)), key=len, default="")


def has_phrase(blob: Column, phrase: str) -> Column:
    """Whether a text in match form holds the phrase as whole tokens. A plain substring test spares most texts the pattern."""
    return F.contains(blob, F.lit(longest_word(phrase))) & blob.rlike(phrase_pattern(phrase))


def title_case(c: Column) -> Column:
    """Every run of letters starts with a capital, also after a digit, hyphen or apostrophe."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def truncate(c: Column, limit: int = 280) -> Column:
    text = clean_text(c)
    cut = F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def _number(c: Column, pattern: str) -> Column:
    """The first number the pattern finds; NULL if it finds none."""
    return F.regexp_replace(F.regexp_extract(c, pattern, 1), ",", "").try_cast("double")


def price_from_number(n: Column) -> Column:
    return bind(n, lambda x: F.when(x > 0, F.bround(x).try_cast("int")))


def price_from_text(c: Column) -> Column:
    return price_from_number(_number(clean_text(c), fv.PRICE_PATTERN))


def beds_from_number(n: Column) -> Column:
    return bind(n, lambda x: F.when(x >= 0, x))


def beds_from_text(c: Column) -> Column:
    words = F.expr("map(" + ", ".join(f"'{k}', {v}D" for k, v in fv.WORD_NUMBERS.items() if v <= 6) + ")")
    return bind(F.lower(clean_text(c)), lambda t: F.when(F.contains(t, F.lit("studio")), F.lit(0.0)).otherwise(
        F.coalesce(_number(t, fv.NUMBER_PATTERN), F.try_element_at(words, F.regexp_extract(t, fv.BED_WORD_PATTERN, 1)))))


def baths_from_text(c: Column) -> Column:
    def total(t: Column) -> Column:
        full = F.coalesce(_number(t, fv.NUMBER_PATTERN), F.lit(0.0))
        half = F.coalesce(_number(t, fv.HALF_BATH_PATTERN), F.lit(0.0))
        return full + half * 0.5

    return bind(bind(F.lower(clean_text(c)), total), lambda x: F.when(x != 0, x))


def sqft_from_number(n: Column) -> Column:
    return bind(n, lambda x: F.when(x.between(*fv.SQFT_RANGE), F.bround(x).try_cast("int")))


def sqft_from_text(c: Column) -> Column:
    text = F.regexp_replace(F.lower(clean_text(c)), ",", "")
    return sqft_from_number(_number(text, fv.NUMBER_PATTERN))


def year_from_text(c: Column) -> Column:
    year = F.regexp_extract(c, fv.YEAR_PATTERN, 1).try_cast("int")
    return bind(year, lambda y: F.when(y.between(*fv.YEAR_RANGE), y))


def stat_from_text(c: Column, pattern: str) -> Column:
    return _number(plain_spaces(c), pattern)


def plain_number(c: Column) -> Column:
    """A number as a person reads it: no decimals when whole, '?' when unknown."""
    whole = c == F.floor(c)
    return F.coalesce(F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string")), F.lit("?"))


def dollars(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 0))


def half_up(c: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def any_contains(c: Column, needles) -> Column:
    """Plain substring test against any of the needles."""
    tests = [F.contains(c, F.lit(match_form_literal(n))) for n in needles]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def first_contained(c: Column, needles) -> Column:
    """The first needle, in list order, that is a substring; NULL if none is."""
    cases = [F.when(F.contains(c, F.lit(match_form_literal(n))), F.lit(n)) for n in needles]
    return F.coalesce(*cases) if cases else F.lit(None).cast("string")


def standardize_specs(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Turn raw spec texts into numbers: ``columns`` maps price/beds/baths/sqft/year_built to raw column names."""
    parsers = {
        "price": price_from_text, "beds": beds_from_text, "baths": baths_from_text,
        "sqft": sqft_from_text, "year_built": year_from_text,
    }
    return df.withColumns({name: parsers[name](F.col(raw)) for name, raw in columns.items()})
