"""Streams over a table of several files that are not in time order."""

import os
import time

import pytest

import __spark_entry__ as ent
from tests.conftest import SF001
from tickframe.streaming import jobs


def _shuffled(spark, folder, cuts=4, *, by=("ts",)):
    """events.parquet under ``folder`` in ``cuts`` files, the newest ticks in the oldest file."""
    events = spark.read.parquet(f"{SF001}/events.parquet").toPandas().sort_values(list(by), ascending=False)
    schema = spark.read.parquet(f"{SF001}/events.parquet").schema
    (folder / "events.parquet").mkdir()
    n = -(-len(events) // cuts)
    now = time.time()
    for k in range(cuts):
        out = f"{folder}/part{k}"
        spark.createDataFrame(events[k * n:(k + 1) * n], schema).coalesce(1).write.parquet(out)
        file = next(f for f in os.listdir(out) if f.endswith(".parquet"))
        target = folder / "events.parquet" / f"a b,{k}.parquet"
        os.link(f"{out}/{file}", target)
        os.utime(target, (now - 100 + k, now - 100 + k))
    return str(folder)


def _same(got, want):
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=2e-4)


@pytest.mark.parametrize("by", [("ts",), ("event_id",)], ids=["newest first", "overlapping"])
@pytest.mark.parametrize("name", ["stream_bars", "stream_sliding_mean", "stream_snapshot"])
def test_files_out_of_time_order(spark, tmp_path, monkeypatch, name, by):
    """One file per trigger, files newest first or each over all times."""
    folder = _shuffled(spark, tmp_path, by=by)
    monkeypatch.setitem(jobs.replay.__kwdefaults__, "files", 1)
    got, want = (sorted(map(tuple, ent.queries()[name](spark, d).collect())) for d in (folder, SF001))
    _same(got, want)


def test_one_file_per_trigger_oldest_first(spark, tmp_path):
    folder = _shuffled(spark, tmp_path)
    got = jobs.replay_ticks(spark, folder, jobs.stream_bars, "ordered", files=1)
    spans = {r.epoch: (r[1], r[2]) for r in got.groupBy("epoch").agg({"ts": "min"}).join(
        got.groupBy("epoch").agg({"ts": "max"}), "epoch").collect()}
    order = sorted(spans)
    assert len(order) >= 4
    assert all(spans[a][0] <= spans[b][0] for a, b in zip(order, order[1:]))


def test_overlap(spark):
    spans = spark.createDataFrame([("a", 0.0, 10.0), ("b", 4.0, 6.0), ("c", 5.5, 20.0), ("d", 30.0, 40.0)], "file string, first double, last double")
    assert jobs.overlap(spans).first().seconds == 6
    assert jobs.overlap(spans.filter("file IN ('a', 'd')")).first().seconds == 0
    assert not jobs.overlap(spans.limit(0)).first().seconds


def test_snapshot_goes_on_from_its_checkpoint(spark, tmp_path):
    """The oldest and the newest file, then a new query on the same checkpoint when the others have come."""
    folder = _shuffled(spark, tmp_path)
    table = f"{folder}/events.parquet"
    later = sorted(f for f in os.listdir(table) if f.endswith(".parquet"))[1:3]
    for f in later:
        os.rename(f"{table}/{f}", f"{tmp_path}/{f}")
    options = {"files": 1, "out": f"{tmp_path}/out"}
    before = jobs.latest(jobs.replay_ticks(spark, folder, jobs.stream_snapshot, "snapshot", **options), "symbol").collect()
    for f in later:
        os.rename(f"{tmp_path}/{f}", f"{table}/{f}")
    versions = jobs.replay_ticks(spark, folder, jobs.stream_snapshot, "snapshot", **options)
    want = jobs.replay_ticks(spark, SF001, jobs.stream_snapshot, "snapshot")
    got, want = (sorted(map(tuple, jobs.latest(v, "symbol").collect())) for v in (versions, want))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    _same([r[2:] for r in got], [r[2:] for r in want])
    assert sorted(r.symbol for r in before) == [r[0] for r in got]
    assert versions.select("epoch").distinct().count() == 4  # no file was read twice


def test_snapshot_of_odd_ticks(spark, tmp_path):
    """Nulls in every column, one tick, equal ticks, an empty table."""
    rows = [(1, None, "a", 5.0), (2, "2024-01-01 00:00:01", "a", None), (3, "2024-01-01 00:00:02", "a", 8.0),
            (4, "2024-01-01 00:00:01", None, 2.0), (4, "2024-01-01 00:00:01", None, 2.0), (5, "2024-01-01 00:00:01", "b", 0.0)]
    df = spark.createDataFrame(rows, "event_id long, at string, event_type string, value double").selectExpr(
        "event_id", "CAST(at AS TIMESTAMP) AS ts", "event_type", "value")
    df.write.parquet(f"{tmp_path}/odd/events.parquet")
    got = jobs.latest(jobs.replay_ticks(spark, f"{tmp_path}/odd", jobs.stream_snapshot, "odd"), "symbol")
    assert {r.symbol: (r.price, r.previous_price, r.change_percent) for r in got.collect()} == {
        "a": (8.0, None, None), None: (2.0, 2.0, 0.0), "b": (0.0, None, None)}
    df.limit(0).write.parquet(f"{tmp_path}/none/events.parquet")
    assert jobs.replay_ticks(spark, f"{tmp_path}/none", jobs.stream_bars, "none").count() == 0
