"""Streams over folders of part files, and the clock of a replayed batch."""

from __future__ import annotations

from datetime import datetime, timedelta

from postlens.streaming import ingest


def test_a_stream_reads_a_table_of_several_files_and_one_of_one_file(spark, tmp_path):
    folder = str(tmp_path / "events.parquet")
    spark.range(300).repartition(3).write.parquet(folder)
    single = next((tmp_path / "events.parquet").glob("part-*.parquet"))
    for k, (table, n) in enumerate([(folder, 300), (str(single), 100)]):
        out = str(tmp_path / f"out{k}")
        stream = ingest.file_stream(spark, table, spark.range(1).schema, files_per_batch=1)
        ingest.append_to(stream, out, str(tmp_path / f"state{k}")).awaitTermination()
        assert spark.read.parquet(out).count() == n


def test_a_batch_keeps_the_time_of_its_first_attempt(spark, tmp_path):
    log = str(tmp_path / "clock")
    first = ingest.batch_clock(spark, log, 0)
    assert abs(first - datetime.now()) < timedelta(days=2)
    assert ingest.batch_clock(spark, log, 0) == first and ingest.batch_clock(spark, log, 1) >= first


def test_alerts_of_a_repeated_run_are_logged_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from postlens.operators import views

    rows = spark.createDataFrame([("a", "A", True), ("b", "B", False)], "id string, priority_tier string, strong_alert boolean")
    path = str(tmp_path / "alerts")
    for run_id in ("r1", "r2", "r1"):
        views.log_alerts(views.alerts(rows, run_id, "email", F.current_timestamp()), path)
    assert spark.read.parquet(path).count() == 4


def test_daily_counts_touch_their_own_days(spark, tmp_path):
    """Files that bring rows of older and newer days, one a batch; replaying counts changes nothing."""
    from pyspark.sql import functions as F

    zone, out = str(tmp_path / "events"), str(tmp_path / "days")
    parts = [[("2026-01-01", "a"), ("2026-01-01", "b"), ("2026-01-02", "a")], [("2026-01-02", "a"), ("2026-01-03", None)], [("2026-01-02", "b"), ("2026-01-03", None)]]
    for part in parts:
        rows = spark.createDataFrame([(f"{d} 10:00:00", s) for d, s in part], "ts string, source string").withColumn("ts", F.to_timestamp("ts"))
        rows.coalesce(1).write.mode("append").parquet(zone)
    events = spark.read.parquet(zone)
    stream = ingest.file_stream(spark, zone, events.schema, files_per_batch=1)
    ingest.keep_days(ingest.daily_counts(stream, "ts", "source", late_days=30), out, str(tmp_path / "state")).awaitTermination()

    def kept():
        return sorted(((r.day, r.source, r.n) for r in spark.read.schema("source string, n long, day string").parquet(out).collect()), key=str)

    want = sorted(((r.day, r.source, r.n) for r in ingest.daily_counts(events, "ts", "source").collect()), key=str)
    assert kept() == want and len(want) == 5
    first = sorted(p.name for p in (tmp_path / "days" / "day=2026-01-01").iterdir())
    ingest.merge_days(spark.createDataFrame([("2026-01-03", None, 2)], "day string, source string, n long"), out)
    assert kept() == want and sorted(p.name for p in (tmp_path / "days" / "day=2026-01-01").iterdir()) == first


def test_a_file_of_one_row_group_is_worked_on_by_all_cores(spark, tmp_path, monkeypatch):
    from datetime import date

    seen = []
    monkeypatch.setattr(ingest, "run_batch", lambda raw, *args, **more: seen.append((raw.rdd.getNumPartitions(), raw.count())))
    zone, state = str(tmp_path / "zone"), str(tmp_path / "state")
    for k in range(2):
        spark.range(k * 500, k * 500 + 500).coalesce(1).write.mode("append").parquet(zone)
        landed = ingest.file_stream(spark, zone, spark.range(1).schema, files_per_batch=1_000_000)
        ingest.run_stream(landed, lambda b: b, None, None, None, date(2026, 6, 21), "table", "index", state).awaitTermination()
    assert seen == [(spark.sparkContext.defaultParallelism, 500)] * 2
