"""Resolution and the whole run batch by batch against one run over everything."""

from __future__ import annotations

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from postlens.operators import enrich, incremental, resolve, store
from postlens.operators.normalize import normalize
from postlens.plans.pipeline import land, run, run_batch
from postlens.schema import PAYLOAD, POSTING, RAW_POSTING

TODAY = date(2026, 6, 21)


def postings(n, seed):
    random.seed(seed)
    rows = []
    for seq in range(n):
        title = random.choice(["Quality Manager", "Senior Quality Manager", "QA Lead (Casual)", "Site Quality Lead"])
        company = random.choice(["Bega Group", "bega group", "Coles", "Coles Pty Ltd", "Kerry"])
        place = random.choice(["Sydney NSW", "Sydney", "Melbourne VIC", "", None, "Perth WA"])
        when = random.choice(["2026-06-01", "2026-06-15", "2026-04-01", "2026-05-03", None])
        job = random.choice([None, "", f"J{seq % 9}", f"K{seq}"])
        text = random.choice(["Lead the site quality team. HACCP, GMP.", "Food safety audits.", None])
        rows.append((seq, random.choice(["seek", "official_ats", "jora"]), title, company, f"https://h/{seq % 40}", job, place, text, when, None, None, None))
    return rows


def batches_of(rows, cuts):
    return [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]


def test_batches_resolve_as_one(spark, tmp_path):
    rows = postings(160, 3)
    path = str(tmp_path / "index")
    known = {}
    for k, part in enumerate([*batches_of(rows, [70]), rows[70:]]):  # the second batch is replayed
        batch = store.with_id(normalize(spark.createDataFrame(part, RAW_POSTING), TODAY))
        links = incremental.resolve_batch(path, batch, min(k, 1), 2, buckets=4)
        known |= {r.id: r.canonical for r in links.collect()}
    whole = store.with_id(resolve.deduplicate(normalize(spark.createDataFrame(rows, RAW_POSTING), TODAY))).collect()
    by_seq = {r.seq: r.id for r in whole}
    want = {}
    for r in sorted(whole, key=lambda r: r.seq):
        want[r.id] = by_seq[r.canonical]
    assert known == want and len(set(want.values())) < len(want)


def test_a_batch_reads_its_own_units_only(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = postings(80, 5)
    incremental.resolve_batch(path, store.with_id(normalize(spark.createDataFrame(rows, RAW_POSTING), TODAY)), 0, buckets=4)
    other = [(500, "seek", "Warehouse Picker", "Kerry", "https://h/p", "P", "Sydney", None, None, None, None, None)]
    links = incremental.resolve_batch(path, store.with_id(normalize(spark.createDataFrame(other, RAW_POSTING), TODAY)), 1, buckets=4)
    assert links.count() == 1


def stored(spark, path):
    columns = [F.col(c) for c in ("id", "status", "duplicate_of", "title", "priority_tier", "final_score")]
    return sorted((tuple(r) for r in store.read_table(spark, path, POSTING).select(*columns).collect()), key=str)


def test_a_run_in_batches_leaves_the_table_of_one_run(spark, tmp_path):
    # One row per stored id, so that the values stored do not depend on which row came last.
    rows = [r[:5] + (f"N{r[0]}",) + r[6:] for r in postings(90, 8)]
    dims = enrich.companies(spark), enrich.ratings(spark)
    paths = str(tmp_path / "table"), str(tmp_path / "index")
    for k, part in enumerate([rows[:50], rows[50:], rows[50:]]):  # the second batch is replayed
        raw = spark.createDataFrame(part, RAW_POSTING)
        done = run_batch(raw, min(k, 1), *dims, None, TODAY, F.lit(datetime(2026, 6, 21 + min(k, 1))), *paths)
    assert done.digest.count() == 0  # its rows are stored already
    whole = run(spark.createDataFrame(rows, RAW_POSTING), *dims, None, TODAY, F.lit(datetime(2026, 6, 21)), str(tmp_path / "plain"))
    plain = sorted((tuple(r) for r in whole.table.select("id", "status", "duplicate_of", "title", "priority_tier", "final_score").collect()), key=str)
    assert stored(spark, paths[0]) == plain and {r[1] for r in plain} >= {"new", "duplicate"}


def test_a_person_s_status_outlives_a_better_copy(spark, tmp_path):
    def pair(seq, title):
        first = (seq, "jora", title, "Bega", f"https://j/{seq}", "A", "Sydney", None, "2026-06-01", None, None, None)
        better = (seq + 1, "official_ats", title, "Bega Ltd", f"https://o/{seq}", "B", "Sydney", "Lead quality.", "2026-06-03", None, None, None)
        return first, better

    pairs = [pair(1, "Quality Manager"), pair(3, "Quality Lead")]
    dims = enrich.companies(spark), enrich.ratings(spark)
    paths = str(tmp_path / "table"), str(tmp_path / "index")
    run_batch(spark.createDataFrame([p[0] for p in pairs], RAW_POSTING), 0, *dims, None, TODAY, F.lit(datetime(2026, 6, 21)), *paths)
    first = store.read_table(spark, paths[0], POSTING).where("seq = 1").first()
    change = spark.createDataFrame([(first.id, first.month, "applied", None)], "id string, month string, _status string, _duplicate_of string")
    store.set_status(spark, paths[0], POSTING, change)
    run_batch(spark.createDataFrame([p[1] for p in pairs], RAW_POSTING), 1, *dims, None, TODAY, F.lit(datetime(2026, 6, 22)), *paths)
    table = {r.seq: r for r in store.read_table(spark, paths[0], POSTING).collect()}
    assert (table[1].status, table[1].duplicate_of, table[1].final_score) == ("applied", None, first.final_score)
    assert (table[3].status, table[3].duplicate_of, table[3].final_score) == ("duplicate", table[4].id, None)
    assert table[2].status == table[4].status == "new"


def test_a_run_from_landed_bodies(spark, tmp_path):
    job = '{"jobPostings": [{"title": "Site Quality Manager", "externalPath": "/job/%s", "locationsText": "Sydney NSW", "postedOn": "2026-06-18", "bulletFields": ["R%s"]}]}'
    bodies = [("official_ats", "bega", job % (1, 1)), ("official_ats", "bega", job % (2, 2)), ("official_ats", "bega", job % (1, 1)), ("official_ats", "bega", "{broken")]
    rows = [(s, c, "Bega Group", "https://h", "S", 1, b) for s, c, b in bodies]
    raw, states = land(spark.createDataFrame(rows, PAYLOAD), enrich.companies(spark))
    assert raw.count() == 3 and sorted(r.state for r in states.collect()) == ["error", "rows", "rows", "rows"]
    done = run(raw, enrich.companies(spark), enrich.ratings(spark), None, TODAY, F.lit(datetime(2026, 6, 21)), str(tmp_path / "t"))
    assert done.postings.count() == 3 and done.stats.first().asDict() == {"canonical": 1, "duplicates": 2, "persisted": 3}
    table = {r.source_job_id: r for r in done.table.collect()}
    # The body landed twice is one stored posting, and no row is its own duplicate.
    assert len(table) == 2 and sorted(r.status for r in table.values()) == ["duplicate", "new"]
    assert table["R1"].extra == {"external_path": "/job/1"}


def test_alerts_of_a_batch_that_failed_are_logged_when_it_is_repeated(spark, tmp_path, monkeypatch):
    text = "Lead the site quality team. HACCP, GMP, audit readiness, site leadership."
    rows = [(1, "official_ats", "Site Quality Manager", "Bega Group", "https://e/1", "JR-1", "Western Sydney NSW", text, "2026-06-18", "$140,000 - $160,000", "bega", None)]
    raw, dims = spark.createDataFrame(rows, RAW_POSTING), (enrich.companies(spark), enrich.ratings(spark))
    paths, log = (str(tmp_path / "table"), str(tmp_path / "index")), str(tmp_path / "alerts")
    similar = lambda df: df.withColumn("similarity", F.lit(0.7))
    take = lambda: run_batch(raw, 0, *dims, similar, TODAY, F.lit(datetime(2026, 6, 21)), *paths, alerts_path=log)
    merge = store.merge_table
    for fails_after in (False, True):  # before anything is stored, and with all of it stored

        def broken(*args, fails_after=fails_after):
            if fails_after:
                merge(*args)
            raise RuntimeError("lost")

        monkeypatch.setattr(store, "merge_table", broken)
        with pytest.raises(RuntimeError):
            take()
        monkeypatch.undo()
        if fails_after:
            assert take().digest.count() == 0
        assert [r.run_id for r in spark.read.parquet(log).collect()] == ["batch-0"]
