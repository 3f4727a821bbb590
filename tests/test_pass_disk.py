"""What a pass leaves on the disk."""

from datetime import datetime, timedelta
from pathlib import Path

import pyarrow.parquet as pq
from test_store import SCHEMA, START, sightings

from unitlens.operators.sinks import Store
from unitlens.plans.run_pass import PassSettings, run_pass, stored_units
from unitlens.streaming import passes

KEPT = {"alert_events", "alerts", "commits", "price_history", "runs", "sightings", "units"}


def test_a_pass_leaves_only_the_tables_that_are_read_later(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    for batch in (0, 1):
        at = START + timedelta(days=batch)
        run_pass(spark, store, sightings(spark, range(400, 420 + batch), at, price=7000 - 100 * batch), at, batch, PassSettings(prefilter=False))
    left = {p.parent.relative_to(tmp_path / "s").parts[0] for p in Path(tmp_path / "s").rglob("*.parquet")}
    assert left == KEPT
    assert stored_units(store).count() == 21 and store.log("price_history").count() == 41
    for table in ("units", "sightings", "alert_events"):
        files = [pq.ParquetFile(p).metadata for p in Path(tmp_path / "s" / table).rglob("*.parquet")]
        codecs = {f.row_group(0).column(0).compression for f in files if f.num_row_groups}
        assert codecs == {"ZSTD"}, table


def test_a_pass_that_is_given_up_leaves_no_working_tables(spark, tmp_path):
    def check(store, batch_id):
        raise ValueError("never")

    sightings(spark, [500], datetime(2024, 3, 5)).write.parquet(str(tmp_path / "landing"))
    stream = passes.read_sightings(spark, str(tmp_path / "landing"), SCHEMA)
    passes.watch(stream, str(tmp_path / "s"), str(tmp_path / "cp"), PassSettings(prefilter=False), attempts=1, before_commit=check).awaitTermination()
    left = {p.parent.relative_to(tmp_path / "s").parts[0] for p in Path(tmp_path / "s").rglob("*.parquet")}
    assert {"failed_rows", "failures"} <= left <= (KEPT - {"commits"}) | {"failed_rows", "failures"}
