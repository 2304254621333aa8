"""Readers, sinks, and streams against their batch twins."""

import pytest
from pyspark.sql import functions as F

from unifold.operators import series
from unifold.sources import readers, sinks
from unifold.streaming import windows


def test_event_files(spark, tmp_path):
    for run, rows in ((2, "5\t1\tB\tx\n"), (10, "0\t1\tn/a\ty\n1\tbad\tA\tz\n")):
        (tmp_path / f"sub-01_run-{run}_events.tsv").write_text("onset\tduration\ttrial_type\textra\n" + rows)
    paths = [str(p) for p in tmp_path.iterdir()]
    got = {(r.run, r.onset, r.duration, r.trial_type, r.extra) for r in readers.read_events(spark, paths).collect()}
    assert got == {(0, 5.0, 1.0, "B", "x"), (1, 1.0, None, "A", "z")}


def test_onsets_and_matrix(spark, tmp_path):
    (tmp_path / "a.1D").write_text("9 38 79:4\n*\n15.5\n")
    assert sorted(tuple(r) for r in readers.read_onsets(spark, str(tmp_path / "a.1D")).collect()) == [(0, 9.0), (0, 38.0), (0, 79.0), (2, 15.5)]
    (tmp_path / "m.1D").write_text("# head\n1 2\n\n3 4\n")
    assert [(r.row, r["values"]) for r in readers.read_matrix(spark, str(tmp_path / "m.1D")).orderBy("row").collect()] == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]


def test_selectors():
    assert readers.selected("[0,3]", 5) == [0, 3]
    assert readers.selected("0..8(3)", 9) == [0, 3, 6]
    assert readers.selected("{2..$}", 5) == [2, 3, 4]
    assert readers.repeated("2@0,1") == [0.0, 0.0, 1.0]
    with pytest.raises(ValueError):
        readers.selected("7", 5)


def test_long_stats(spark, tmp_path):
    sinks.write_stats(spark.createDataFrame([(1, 0.5, 2.0)], "v int, beta double, t double"), ["v"], ["beta", "t"], str(tmp_path / "out"))
    assert {(r.v, r.stat, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "beta", 0.5), (1, "t", 2.0)}


def stream(spark, sf):
    import os
    import shutil
    import tempfile

    folder = tempfile.mkdtemp()
    shutil.copy(os.path.join(sf, "events.parquet"), folder)
    batch = spark.read.parquet(folder)
    return batch.withColumn("ts", F.col("ts").cast("timestamp")), spark.readStream.schema(batch.schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def run(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_windows_match_batch(spark, sf):
    batch, live = stream(spark, sf)
    want = {(r.start, r.event_type, r.n, round(r.mean, 9)) for r in windows.windowed_stats(batch, "ts", ["event_type"], "value", "1 day").collect()}
    got = {(r.start, r.event_type, r.n, round(r.mean, 9)) for r in run(windows.windowed_stats(live, "ts", ["event_type"], "value", "1 day", late="60 days"), "win", "update").collect()}
    assert got == want


def test_visits_match_batch(spark, sf):
    batch, live = stream(spark, sf)
    v = series.visits(batch, ["user_id"], ["ts", "event_id"], "event_type").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("visits"), F.sum("frames").alias("frames"))
    got = run(windows.visit_counts(live, "user_id", "ts", "event_id", "event_type"), "vis", "update")
    assert {tuple(r) for r in got.select("user_id", "event_type", "visits", "frames").collect()} == {tuple(r) for r in v.collect()}
