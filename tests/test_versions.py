"""Tables as logs of deltas."""

import pytest
from pyspark.sql import functions as F

from forumlake.sources import sinks, versions


def rows(spark, *x, schema="k int, v string, at int"):
    return spark.createDataFrame(list(x), schema)


def told(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_latest_past_and_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "BUCKET_ROWS", 4)
    path, state, after = str(tmp_path / "t"), {}, {}
    sinks.create(path, rows(spark))
    sinks.create(path, rows(spark))
    assert told(sinks.read(spark, path)) == []
    for turn in range(2, 16):
        batch = [(k, f"{turn}", (turn * 7 + k) % 11) for k in range(turn % 5, 20 + turn * 3, 1 + turn % 4)]
        sinks.upsert(rows(spark, *batch, *batch[:2]), path, ["k"], "at")
        for k, v, at in batch:
            if k not in state or at >= state[k][2]:
                state[k] = (k, v, at)
        after[versions.read(spark, path)["version"]] = sorted(state.values())
        assert told(sinks.read(spark, path)) == sorted(state.values())
    content = versions.read(spark, path)
    assert len(content["deltas"]) <= sinks.DELTAS and content["buckets"] > 8
    for version in (2, 5, 9):
        known = {v: s for v, s in after.items() if v <= version}
        if version in after:
            assert told(sinks.read(spark, path, version)) == known[version]


def test_a_write_adds_its_rows_only(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert(spark.range(5000).selectExpr("id AS k", "'a' AS v", "1 AS at"), path, ["k"], "at")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "rows").rglob("*.parquet")}
    sinks.upsert(rows(spark, (7, "new", 2), schema="k long, v string, at int"), path, ["k"], "at")
    now = {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "rows").rglob("*.parquet")}
    assert before.items() <= now.items() and versions.read(spark, path)["deltas"][-1]["n"] == 1
    assert sinks.read(spark, path).filter("k = 7").first().v == "new" and sinks.read(spark, path).count() == 5000
    assert sinks.read(spark, path, version=1).filter("v = 'new'").count() == 0


def test_a_failed_write_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert(rows(spark, (1, "a", 1)), path, ["k"], "at")
    broken = rows(spark, (1, "b", 2)).withColumn("v", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        sinks.upsert(broken, path, ["k"], "at")
    assert told(sinks.read(spark, path)) == [(1, "a", 1)]
    sinks.upsert(rows(spark, (1, "c", 2)), path, ["k"], "at")
    assert told(sinks.read(spark, path)) == [(1, "c", 2)]


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sinks.upsert(rows(spark, (1, "a", 1)), path, ["k"], "at")
    original = sinks._write

    def slow(*args, **options):
        monkeypatch.setattr(sinks, "_write", original)
        sinks.upsert(rows(spark, (2, "other", 1)), path, ["k"], "at")
        return original(*args, **options)

    monkeypatch.setattr(sinks, "_write", slow)
    with pytest.raises(versions.Conflict):
        sinks.upsert(rows(spark, (1, "late", 2)), path, ["k"], "at")
    assert {r.k for r in sinks.read(spark, path).collect()} == {1, 2}


def test_new_columns_and_null_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert(rows(spark, (1, "a", 1), (None, "n", 1)), path, ["k"], "at")
    sinks.upsert(rows(spark, (1, 2, 0.5), (None, 3, 0.1), schema="k int, at int, w double"), path, ["k"], "at")
    assert {(r.k, r.v, r.at, r.w) for r in sinks.read(spark, path).collect()} == {(1, None, 2, 0.5), (None, None, 3, 0.1)}


def test_append_new(spark, tmp_path):
    path = str(tmp_path / "t")
    for turn in range(12):
        found = sinks.append_new(rows(spark, *[(k, f"{turn}", turn) for k in range(turn * 2, turn * 2 + 6)]), path, ["k"])
        assert {r.k for r in found.collect()} == set(range(turn * 2 + 4 if turn else 0, turn * 2 + 6))
    assert sinks.append_new(rows(spark, (3, "x", 9)), path, ["k"]).count() == 0
    assert told(sinks.read(spark, path).select("k")) == [(k,) for k in range(28)]
    assert len(versions.read(spark, path)["deltas"]) <= sinks.DELTAS
