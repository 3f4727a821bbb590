"""Sources by name: a scan, the field map that reads its records, and the ranges its scan can be asked by.

A source that is registered takes part in ``read_sources`` like the built-in ones. A range is put on the source's own
columns, below its mapping, so it reaches the files' scan; what a source cannot be asked by is reported, not guessed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitlens.schema import conform
from unitlens.sources import landed, mapping

OUTCOME_SCHEMA = "source string, file string, kind string, message string"


@dataclass(frozen=True)
class Source:
    """``scan`` gives rows from a path. With a ``field_map`` the column ``item`` (VARIANT) of ``record`` rows is mapped, else the
    rows are sightings already. ``record`` turns scanned rows into those the mapping reads, after the range. ``ranges``:
    canonical field to the scan's column it can be asked by."""

    name: str
    scan: Callable[[SparkSession, str], DataFrame]
    field_map: dict | None = None
    record: Callable[[DataFrame], DataFrame] | None = None
    ranges: dict[str, str] = field(default_factory=dict)
    casts: dict | None = None
    site: str | None = None
    need_both_coordinates: bool = False


_SOURCES: dict[str, Source] = {}


def register_source(source: Source, replace: bool = False) -> Source:
    if source.name in _SOURCES and not replace:
        raise ValueError(f"a source named {source.name!r} is registered already")
    _SOURCES[source.name] = source
    return source


def registered() -> tuple[str, ...]:
    return tuple(_SOURCES)


def range_predicate(columns: dict[str, str], ranges: dict[str, tuple]) -> tuple[Column | None, list[str]]:
    """The ranges (low, high; None is open) as one condition on a source's columns, and the fields it has no column for."""
    tests = []
    for name, (low, high) in ranges.items():
        if name in columns:
            c = F.col(columns[name])
            tests += [c >= low] if low is not None else []
            tests += [c <= high] if high is not None else []
    return reduce(lambda a, b: a & b, tests) if tests else None, [n for n in ranges if n not in columns]


def read_source(spark: SparkSession, name: str, path: str, ranges: dict[str, tuple] | None = None) -> tuple[DataFrame, DataFrame]:
    """(sightings, outcomes) of one registered source.

    A range that matches nothing is dropped and the source read whole, as a provider's filters may be off; the outcomes
    (source, file, kind, message) say so, and name the fields that could not be asked by range.
    """
    if name not in _SOURCES:
        raise ValueError(f"no source {name!r} is registered; there are {sorted(_SOURCES)}")
    source = _SOURCES[name]
    rows, notes = source.scan(spark, path), []
    predicate, left = range_predicate(source.ranges, ranges or {})
    if predicate is not None:
        rows, note = landed.ranged_or_all(rows, predicate)
        notes += [note] if note else []
    notes += [f"cannot be asked by range: {', '.join(left)}"] if left else []
    rows = source.record(rows) if source.record else rows
    if source.field_map is not None:
        rows = mapping.map_payloads(rows, source.field_map, name, site=source.site, casts=source.casts,
                                    need_both_coordinates=source.need_both_coordinates)
    outcomes = spark.createDataFrame([(name, None, "note", n) for n in notes], OUTCOME_SCHEMA)
    return conform(rows.withColumn("source", F.lit(name))), outcomes


def read_sources(spark: SparkSession, paths: dict[str, str], ranges: dict[str, tuple] | None = None) -> tuple[DataFrame, DataFrame]:
    """(sightings, outcomes) of several registered sources, in the order of ``paths``."""
    if not paths:
        raise ValueError("no source to read")
    parts = [read_source(spark, name, path, ranges) for name, path in paths.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r for r, _ in parts])
    return rows, reduce(DataFrame.unionByName, [o for _, o in parts])
