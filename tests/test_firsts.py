"""Keep-first by event time: any order and split into batches, late rows listed, against brute force."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest

from postlens.streaming import firsts, ingest

ZERO = datetime(2026, 1, 1)
SCHEMA = "k string, n long, at timestamp"


def run(spark, tmp_path, name, batches, gap, late):
    zone, out, state = (str(tmp_path / f"{name}-{part}") for part in ("zone", "out", "state"))
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(zone)
    stream = ingest.file_stream(spark, zone, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    firsts.start(firsts.keep_earliest(stream, ["k"], "at", gap, late), out, state).awaitTermination()
    told = spark.read.schema(f"{SCHEMA}, kind string").parquet(out).collect()
    return sorted(((r.kind, r.k, r.n, r["at"]) for r in told), key=str)


def expected(batches, gap, late):
    gap, late = timedelta(days=gap), timedelta(days=late)
    mark, on_time, out = None, {}, []
    for rows in batches:
        for k, n, at in rows:
            if at is None:
                out.append(("undated", k, n, at))
            elif mark is not None and _ms(at) <= _ms(mark):
                out.append(("late", k, n, at))
            else:
                on_time.setdefault(k, []).append((at, n))
        times = [at for _, _, at in rows if at is not None]
        mark = max([t for t in [mark, *(at - late for at in times)] if t is not None], default=None)
    for k, rows in on_time.items():
        before = None
        for at, n in sorted(rows):
            if (before is None or at - before > gap) and mark is not None and _ms(at) <= _ms(mark):
                out.append(("first", k, n, at))
            before = at
    return sorted(out, key=str)


def _ms(at):
    return (at.replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(milliseconds=1)


@pytest.mark.parametrize("seed", [1, 2])
def test_firsts_and_late_rows_equal_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    batches, n = [], 100
    for b in range(5):
        rows = []
        for _ in range(60):
            day = b * 4 + rng.choice([0, 1, 2, 3, -3, -8]) + rng.choice([0, 0.5, 0.123456789])
            n += 1
            at = ZERO + timedelta(days=day, microseconds=rng.randrange(3))
            rows.append((rng.choice(["a", "b", "c", "d", None]), n, None if rng.random() < 0.03 else at))
        batches.append(rows)
    got, want = run(spark, tmp_path, "x", batches, 2, 5), expected(batches, 2, 5)
    assert got == want and {kind for kind, *_ in want} == {"first", "late", "undated"}


def test_an_earlier_row_of_a_later_batch_is_first(spark, tmp_path):
    day = lambda d: ZERO + timedelta(days=d)
    rows = [("a", 1, day(3)), ("a", 2, day(1)), ("a", 3, day(12)), ("b", 4, day(30))]
    want = [("first", "a", 2, day(1)), ("first", "a", 3, day(12))]
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert run(spark, tmp_path, "split", [rows[:1], rows[1:]], 5, 7) == want
    assert run(spark, tmp_path, "whole", [rows], 5, 7) == want
    assert run(spark, tmp_path, "empty", [[]], 5, 7) == []
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider


def test_chains_do_not_depend_on_the_order_of_rows():
    rng = random.Random(3)
    rows = [(rng.randrange(60), str(i)) for i in range(25)]
    results = set()
    for _ in range(30):
        rng.shuffle(rows)
        chains = []
        for t, row in rows:
            chains = firsts.add_time(chains, t, row, 2)
        results.add(tuple(chains))
    assert len(results) == 1


def test_rows_before_1970_are_not_late_when_nothing_came_before(spark, tmp_path):
    day = lambda d: datetime(1969, 1, 1) + timedelta(days=d)
    rows = [("a", 1, day(3)), ("a", 2, day(1)), ("a", 3, day(9)), (None, 4, day(2)), (None, 5, day(40))]
    want = [("first", "a", 2, day(1)), ("first", "a", 3, day(9)), ("first", None, 4, day(2))]
    assert run(spark, tmp_path, "old", [rows[:2], rows[2:]], 5, 7) == sorted(want, key=str)


def test_a_repeated_batch_changes_nothing_and_no_key_goes_to_python(spark, tmp_path):
    """Batches of one hot key and many others, each taken twice."""
    rng = random.Random(5)
    day = lambda d: ZERO + timedelta(days=d)
    batches = []
    for b in range(3):
        rows = [("hot", b * 1000 + i, day(b * 4 + rng.random() * 6)) for i in range(800)]
        batches.append(rows + [(f"k{i}", b * 1000 + 800 + i, day(b * 4 + rng.random() * 6 - 3)) for i in range(200)])
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    told = firsts.keep_earliest(spark.createDataFrame([], SCHEMA), ["k"], "at", 1, 2)
    for b, rows in enumerate(batches):
        for _ in range(2):
            firsts.take(told, spark.createDataFrame(rows, SCHEMA), b, out, state)
    got = [(r.kind, r.k, r.n, r["at"]) for r in spark.read.schema(f"{SCHEMA}, kind string").parquet(out).collect()]
    assert sorted(got, key=str) == expected(batches, 1, 2)
    fresh = firsts._fresh(told, spark.createDataFrame(batches[0], SCHEMA), None)
    assert fresh.where("key LIKE '%hot%'").count() <= 7  # a row per day, not per row
    assert "Python" not in firsts._joined(fresh, told.gap)._jdf.queryExecution().toString()
