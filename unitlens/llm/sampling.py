"""Bounded, repeatable samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(key: str) -> Column:
    """A number in [0, 1) that depends on the key alone and is spread evenly."""
    return F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string")), 11) / F.lit(float(1 << 53))


def per_label(rows: DataFrame, label: str, key: str, most: int, labels: int) -> tuple[dict, DataFrame]:
    """(rows by label, about ``most`` rows of each label): the ``labels`` most frequent labels, ties by value.

    A row is in the sample if its key's number is below ``most`` over its label's rows, so nothing is sorted and a
    label with up to ``most`` rows is there whole.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(labels).collect()}
    if not counts:
        return counts, rows.where("false")
    chance = F.create_map(*[F.lit(x) for value, n in counts.items() for x in (value, min(1.0, most / n))])
    return counts, rows.where(share(key) < F.coalesce(F.try_element_at(chance, F.col(label)), F.lit(0.0)))
