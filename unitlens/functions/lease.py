"""Lease windows out of prose, as a struct column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitlens import fixed_values as fv
from unitlens.functions.text import apart, bind, clean_text, match_form, settle

_DIGITS = r"(\d{1,2})"
_LAST_DIGITS = r"(\d{1,2})\s*(?:\+)?\s*(?:mo|mos|month|months)$"

LEASE_TYPE = "struct<min_months:int,max_months:int,raw:string,evidence:array<string>>"


def _digits_for(word: str):
    """One word's step. A plain substring test spares a text the pattern, which looks at every position of it."""
    body, part = word.replace(" ", r"\s+"), max(word.split(), key=len)
    found = rf"(?<![a-z0-9]){body}(?![a-z0-9])"
    return lambda t: F.when(F.contains(t, F.lit(part)), F.regexp_replace(t, found, str(fv.WORD_NUMBERS[word]))).otherwise(t)


def digits_for_words(c: Column) -> Column:
    """Numbers written as words become digits; texts without any are passed through."""
    for w in sorted(fv.WORD_NUMBERS, key=len, reverse=True):
        c = bind(c, _digits_for(w))
    return c


#: Wider than every pattern below: a digit, then a unit word with nothing but spaces and signs between.
_GATE = r"\d[^a-z0-9]*(?:mo|mos|month|months|yr|yrs|year|years)\b"
_PATTERNS = (
    [("range", p) for p in fv.LEASE_RANGE_PATTERNS] + [("min", p) for p in fv.LEASE_MIN_PATTERNS]
    + [("max", p) for p in fv.LEASE_MAX_PATTERNS] + [("years", p) for p in fv.LEASE_YEAR_PATTERNS]
    + [("exact", p) for p in fv.LEASE_EXACT_PATTERNS]
)


def _window(label: str) -> Column:
    """The first pattern of a group whose first match holds an allowed value."""
    cases = []
    for i, (name, _) in enumerate(_PATTERNS):
        if name != label:
            continue
        low, high, hit = F.col(f"__low{i}"), F.col(f"__high{i}"), F.col(f"__hit{i}")
        if label == "years":
            ok, low, high = low.between(1, fv.LEASE_MAX_YEARS), low * 12, low * 12
        elif label == "range":
            ok = (low > 0) & (low <= high) & (high <= fv.LEASE_MAX_MONTHS)
        else:
            ok, high = low.between(1, fv.LEASE_MAX_MONTHS), low
        cases.append(F.when(ok, F.struct(
            low.alias("lo"), high.alias("hi"), F.concat(F.lit(f"{label}:"), F.btrim(hit)).alias("ev"))))
    return F.coalesce(*cases)


def _phrase(blob: Column) -> Column:
    cases = [F.when(F.contains(blob, F.lit(p)), F.lit(p)) for p in fv.ANNUAL_PHRASES]
    return F.coalesce(*cases)


def extract_lease_terms(df: DataFrame, *columns: str, out: str = "lease_term") -> DataFrame:
    """Add ``out``: the lease window stated anywhere in the named text columns, read as one text.

    Every pattern but the phrases needs a number before a month or year word, so one search for that spares most
    texts the others. A pattern runs once over the text; its numbers are read off the few words it matched.
    """
    texts = [F.when(F.col(c) != "", clean_text(F.col(c))) for c in columns]
    blob, gate = F.col("__lease_blob"), F.col("__lease_gate")
    staged = df.withColumn("__lease_blob", match_form(F.concat_ws(" . ", *texts))).withColumn(
        "__lease_blob", digits_for_words(blob)
    ).withColumn("__lease_gate", blob.rlike(_GATE))
    staged = staged.withColumns({
        f"__hit{i}": F.when(gate if i else apart(gate), F.regexp_extract(blob, p, 0)) for i, (_, p) in enumerate(_PATTERNS)
    })
    numbers = {}
    for i, (label, _) in enumerate(_PATTERNS):
        hit = F.col(f"__hit{i}")
        numbers[f"__low{i}"] = F.when(hit != "" if i else apart(hit != ""), F.regexp_extract(hit, _DIGITS, 1).try_cast("int"))
        if label == "range":
            numbers[f"__high{i}"] = F.when(hit != "", F.regexp_extract(hit, _LAST_DIGITS, 1).try_cast("int"))
    staged = staged.withColumns(numbers)
    staged = staged.withColumns({f"__lease_{g}": _window(g) for g in ("range", "min", "max", "years", "exact")})
    rng, low, high = (F.col(f"__lease_{g}") for g in ("range", "min", "max"))
    unsaid = rng.isNull() & low.isNull() & high.isNull()
    number = F.coalesce("__lease_years", "__lease_exact")
    staged = staged.withColumn("__lease_phrase", F.when(unsaid & number.isNull(), _phrase(blob)))
    said = F.col("__lease_phrase")
    phrase = F.when(said.isNotNull(), F.struct(
        F.lit(12).alias("lo"), F.lit(12).alias("hi"), F.concat(F.lit("phrase:"), said).alias("ev")))
    staged = staged.withColumn("__lease_other", F.when(unsaid, F.coalesce(number, phrase)))
    other = F.col("__lease_other")
    bounded = F.when(rng.isNull(), low["ev"]), F.when(rng.isNull(), high["ev"])
    term = F.struct(
        F.when(rng.isNotNull(), rng["lo"]).otherwise(F.coalesce(low["lo"], other["lo"])).alias("min_months"),
        F.when(rng.isNotNull(), rng["hi"]).otherwise(F.coalesce(high["hi"], other["hi"])).alias("max_months"),
        blob.alias("raw"),
        F.array_compact(F.array(rng["ev"], *bounded, other["ev"])).alias("evidence"),
    )
    made = [c for c in staged.columns if c.startswith(("__lease_", "__hit", "__low", "__high"))]
    return settle(staged.withColumn(out, term).drop(*made), out)


def lease_known(term: Column) -> Column:
    return term["min_months"].isNotNull() | term["max_months"].isNotNull()


def describe_lease(term: Column) -> Column:
    low, high = term["min_months"], term["max_months"]
    return (
        F.when(low == high, F.format_string("%d months", low))
        .when(low.isNotNull() & high.isNotNull(), F.format_string("%d-%d months", low, high))
        .when(low.isNotNull(), F.format_string("%d+ months", low))
        .when(high.isNotNull(), F.format_string("up to %d months", high))
        .otherwise("unspecified")
    )
