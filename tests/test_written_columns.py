"""What a query writes to read it twice holds no column that it does not read."""

import pytest

from unitlens.plans import checks


@pytest.mark.parametrize("query", ["first_wins_merge", "contributing_sightings", "register_validate", "enrichment_counters"])
def test_keys_that_no_one_reads_are_not_written(spark, sf_dir, monkeypatch, query):
    seen = []
    monkeypatch.setattr(checks, "written", lambda df, name: seen.append(df.columns) or df.limit(0))
    checks.QUERIES[query](spark, sf_dir)
    assert len(seen) == 1 and not {"unit_hash", "building_hash", "geo_hash", "dedupe_key", "source_key"} & set(seen[0])
