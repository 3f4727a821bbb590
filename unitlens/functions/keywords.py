"""Phrase and keyword search over a text column, with and without regard to negation."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitlens import fixed_values as fv
from unitlens.functions.text import has_phrase, longest_word, match_form, phrase_pattern, settle, sql_text

SCAN_TYPE = "struct<hits:array<string>,negated:array<string>>"

_HIT, _NEGATED = 1, 2
_BEFORE = rf"(?:^| )[.,]*(?:{'|'.join(fv.NEGATORS_BEFORE)})[.,]*(?= |$)"
_AFTER = phrase_pattern(*fv.NEGATORS_AFTER)


def _occurrence_state(blob: str, pattern: str) -> Column:
    """_HIT if some occurrence stands without a negation next to it, _NEGATED if all have one.

    Zipping the pieces between occurrences with the occurrences gives each one's place in the text in one fold;
    the words around it are then cut out by counting spaces, as the match form has single ones only.
    """
    p, n = sql_text(pattern), fv.NEGATION_WINDOW
    start = "acc.pos + length(e.`0`)"
    end = f"{start} + length(e.`1`)"
    before = f"substring_index(rtrim(left({blob}, {start})), ' ', -{n})"
    after = f"substring_index(trim(LEADING ' .,-:;' FROM substring({blob}, {end} + 1)), ' ', {n})"
    negated = f"({before} rlike {sql_text(_BEFORE)} or {after} rlike {sql_text(_AFTER)})"
    return F.expr(f"""
        if(aggregate(
            arrays_zip(split({blob}, {p}, -1), regexp_extract_all({blob}, {p}, 0)),
            named_struct('pos', 0, 'negated', true),
            (acc, e) -> if(e.`1` is null, acc, named_struct('pos', {end}, 'negated', acc.negated and {negated}))
        ).negated, {_NEGATED}, {_HIT})""")


def scan_keywords(df: DataFrame, text: str, keywords, out: str = "keyword_scan", normalized: bool = False) -> DataFrame:
    """Add ``out``: keywords found in column ``text`` as genuine hits and as negated mentions.

    Spellings with one pattern are searched once. Plain substring tests sort out the texts that hold none, so most
    rows take no pattern at all.
    """
    patterns: dict[str, list[int]] = {}
    for i, keyword in enumerate(keywords):
        patterns.setdefault(phrase_pattern(keyword), []).append(i)
    blob = F.col("__scan_blob")
    none = F.lit(0)
    found = {p: has_phrase(blob, keywords[members[0]]) for p, members in patterns.items()}
    per_pattern = [F.when(found[p], _occurrence_state("__scan_blob", p)).otherwise(none) for p in patterns]
    any_word = reduce(or_, [F.contains(blob, F.lit(w)) for w in dict.fromkeys(longest_word(k) for k in keywords)], F.lit(False))
    slot = {i: n for n, members in enumerate(patterns.values()) for i in members}
    staged = df.withColumn("__scan_blob", F.col(text) if normalized else match_form(F.col(text)))
    staged = staged.withColumn(
        "__scan_states", F.when(any_word, F.array(*per_pattern))
    )
    states = F.col("__scan_states")

    def named(state: int) -> Column:
        cases = [F.when(states[slot[i]] == state, F.lit(k)) for i, k in enumerate(keywords)]
        empty = F.array().cast("array<string>")
        return F.when(states.isNotNull(), F.array_compact(F.array(*cases))).otherwise(empty)

    scan = F.struct(named(_HIT).alias("hits"), named(_NEGATED).alias("negated"))
    return settle(staged.withColumn(out, scan).drop("__scan_blob", "__scan_states"), out)


def _present(blob: Column, phrases) -> Column:
    return F.array_compact(F.array(*[F.when(has_phrase(blob, p), F.lit(p)) for p in phrases]))


def find_phrases(blob: Column, phrases) -> Column:
    """The phrases present in a text in match form, in list order."""
    return F.when(blob.rlike(phrase_pattern(*phrases)), _present(blob, phrases))


def category_map(blob: Column, categories: dict) -> Column:
    """category -> phrases found, for a text in match form; categories without a find are left out."""
    entries = [F.struct(F.lit(name).alias("k"), _present(blob, phrases).alias("v")) for name, phrases in categories.items()]
    if not entries:
        return F.create_map().cast("map<string,array<string>>")
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["v"]) > 0))


def tag_categories(df: DataFrame, text: str, categories: dict, out: str = "amenity_matches") -> DataFrame:
    staged = df.withColumn("__tag_blob", match_form(F.col(text)))
    return staged.withColumn(out, category_map(F.col("__tag_blob"), categories)).drop("__tag_blob")
