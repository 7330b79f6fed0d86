"""Upsert, newness, re-gating, repair, and the whole run over a stored table."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from postlens.operators import enrich, store
from postlens.plans.pipeline import run
from postlens.schema import POSTING, RAW_POSTING, conform

TODAY = date(2026, 6, 21)


def posting(seq, title, location="Sydney NSW", status="new", **more):
    row = {
        "seq": seq, "source": "official_ats", "company_name": "Bega Group", "title": title, "normalized_title": title.lower(),
        "location": location, "posted_date": date(2026, 6, 1), "apply_url": f"https://x/{title}", "description_hash": "h", "status": status,
    }
    return row | more


def table(spark, rows):
    names = sorted({k for r in rows for k in r})
    types = {f.name: f.dataType.simpleString() for f in POSTING.fields}
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} {types[n]}" for n in names))
    return conform(store.with_id(conform(df, POSTING)), POSTING)


def at(day):
    return F.lit(datetime(2026, 6, day))


def test_upsert_is_idempotent_and_keeps_human_status(spark):
    empty = spark.createDataFrame([], POSTING)
    first = store.upsert(empty, table(spark, [posting(1, "QM"), posting(2, "QA", status="applied")]), at(1))
    batch = table(spark, [posting(3, "QM", final_score=61.0), posting(4, "QA"), posting(5, "New"), posting(6, "New", final_score=7.0)])
    once = store.upsert(first, batch, at(2))
    twice = store.upsert(once, batch, at(2))
    rows = {r.title: r for r in once.collect()}
    assert len(rows) == 3 and rows["QM"].final_score == 61.0 and rows["New"].final_score == 7.0
    assert rows["QA"].status == "applied" and rows["QM"].first_seen == datetime(2026, 6, 1) and rows["QM"].last_seen == datetime(2026, 6, 2)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    legacy = store.upsert(first, batch, at(2), legacy_status_overwrite=True)
    assert {r.title: r.status for r in legacy.collect()}["QA"] == "new"
    assert [r.title for r in store.new_postings(batch, first).orderBy("seq").collect()] == ["New", "New"]


def test_merge_table_rewrites_only_touched_months(spark, tmp_path):
    path = str(tmp_path / "table")
    store.merge_table(path, table(spark, [posting(1, "QM"), posting(2, "QA", posted_date=date(2026, 5, 1))]), POSTING, at(1))
    untouched = sorted(p.name for p in (tmp_path / "table" / "month=2026-05").iterdir())
    merged = store.merge_table(path, table(spark, [posting(3, "QM", final_score=9.0), posting(4, "None", posted_date=None)]), POSTING, at(2))
    assert sorted((r.title, r.final_score) for r in merged.collect()) == [("None", None), ("QA", None), ("QM", 9.0)]
    assert sorted(p.name for p in (tmp_path / "table" / "month=2026-05").iterdir()) == untouched


def test_merge_and_maintenance_rewrite_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "table")
    files = lambda: {p.parent.relative_to(path): p.name for p in (tmp_path / "table").rglob("part-*.parquet")}
    undated = [posting(i, f"QA Lead {i}", posted_date=None) for i in range(60)]
    store.merge_table(path, table(spark, [*undated, posting(99, "Quality Manager", "Franklin, WI")]), POSTING, at(1))
    first = files()
    assert len(first) == len({(r.month, r.bucket) for r in store.read_table(spark, path, POSTING).collect()}) > 10
    merged = store.merge_table(path, table(spark, [posting(200, "QA Lead 7", posted_date=None, final_score=9.0)]), POSTING, at(2))
    second = files()
    moved = merged.where("final_score = 9").first()
    found = store.find(merged, [moved.id, "unknown"])
    assert [r.seq for r in found.collect()] == [200] and store.find(merged, []).count() == 0
    scan = next(line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line)
    assert "bucket#" in scan.split("PartitionFilters")[1].split("]")[0]
    assert merged.count() == 61 and moved.seq == 200
    assert {str(p) for p in first if first[p] != second[p]} == {f"month=none/bucket={moved.bucket}"}
    assert store.maintain(spark, path, POSTING) == {"regated": 1, "relinked": 0, "promoted": 0}
    gated = store.read_table(spark, path, POSTING).where("status = 'irrelevant'").first()
    assert {str(p) for p in files() if files()[p] != second[p]} == {f"month=2026-06/bucket={gated.bucket}"}


def test_maintain_table(spark, tmp_path):
    path = str(tmp_path / "table")
    store.merge_table(path, table(spark, [
        posting(1, "Quality Manager", "Franklin, WI"), posting(2, "QA Manager", posted_date=date(2026, 5, 1)),
        posting(3, "QA Lead", "Sydney", "duplicate"), posting(4, "QA Lead", "Perth", "duplicate", source="jora"),
    ]), POSTING, at(1))
    kept = sorted(p.name for p in (tmp_path / "table" / "month=2026-05").iterdir())
    assert store.maintain_table(spark, path, POSTING).count() == 4
    once = {r.seq: (r.status, r.duplicate_of) for r in store.maintain_table(spark, path, POSTING).collect()}
    ids = {r.seq: r.id for r in store.read_table(spark, path, POSTING).collect()}
    assert once == {1: ("irrelevant", None), 2: ("new", None), 3: ("new", None), 4: ("duplicate", ids[3])}
    assert sorted(p.name for p in (tmp_path / "table" / "month=2026-05").iterdir()) == kept
    assert {r.seq: (r.status, r.duplicate_of) for r in store.maintain_table(spark, path, POSTING).collect()} == once
    assert sorted(p.name for p in (tmp_path / "table").glob("month=*")) == ["month=2026-05", "month=2026-06"]


def test_regate(spark):
    stored = table(spark, [
        posting(1, "Quality Manager"), posting(2, "Quality Manager", "Franklin, WI"), posting(3, "Production Operator", "Melbourne VIC"),
        posting(4, "Production Operator", status="applied"),
    ])
    once = store.regate(stored)
    assert [r.status for r in once.orderBy("seq").collect()] == ["new", "irrelevant", "irrelevant", "applied"]
    assert sorted(map(str, store.regate(once).collect())) == sorted(map(str, once.collect()))


def test_repair_orphans(spark):
    stored = table(spark, [
        posting(1, "A", "Sydney", "duplicate", source="jora"), posting(2, "A", "Sydney CBD", "duplicate", source="seek"),
        posting(3, "B", "Sydney", "duplicate"), posting(4, "B", "Perth", "new", final_score=5.0), posting(5, "B", "Eden", "expired", final_score=9.0),
        posting(6, "B", "Bega", "irrelevant", final_score=99.0),
    ])
    for hot_rows in (None, 1):
        fixed = {r.seq: r for r in store.repair_orphans(stored, hot_rows).collect()}
        ids = {s: r.id for s, r in fixed.items()}
        assert fixed[2].status == "new" and fixed[2].duplicate_of is None
        assert fixed[1].status == "duplicate" and fixed[1].duplicate_of == ids[2]
        assert fixed[3].duplicate_of == ids[5] and len(fixed) == 6


def test_whole_run_and_second_run_is_not_new(spark, tmp_path):
    text = "Lead the site quality team. HACCP, GMP, audit readiness, site leadership."
    rows = [
        (1, "official_ats", "Site Quality Manager", "Bega Group", "https://e/1", "JR-1", "Western Sydney NSW", text, "2026-06-18", "$140,000 - $160,000", "bega", None),
        (2, "seek", "Site Quality Manager", "Bega Group", "https://s/2", "12345", "Western Sydney NSW", text, "2026-06-18", "$140k - $160k", None, None),
        (3, "seek", "Software QA Engineer", "Tech Co", "https://s/3", "99999", "Sydney NSW", "Automated test analyst for our SaaS platform. Selenium, CI/CD.", "2026-06-20", None, None, None),
        (4, "seek", "", "Nobody", "https://s/4", "4", None, None, None, None, None, None),
    ]
    raw = spark.createDataFrame(rows, RAW_POSTING)
    sims = spark.createDataFrame([(1, 0.7), (3, 0.7)], "seq long, similarity double")
    dims = enrich.companies(spark), enrich.ratings(spark)
    path = str(tmp_path / "store")
    logs = {"run_id": "r1", "alerts_path": str(tmp_path / "alerts"), "report_path": str(tmp_path / "report")}
    first = run(raw, *dims, sims, TODAY, at(21), path, **logs)
    assert [r.job_id for r in spark.read.parquet(logs["alerts_path"]).collect()] == [r.id for r in first.digest.collect()]
    report = spark.read.parquet(logs["report_path"])
    assert [(r.section, r.seq) for r in report.select("section", "seq").collect()] == [(1, 1)]
    assert first.stats.first().asDict() == {"canonical": 2, "duplicates": 1, "persisted": 3}
    status = {r.seq: r.status for r in first.postings.collect()}
    assert status == {1: "new", 2: "duplicate", 3: "irrelevant"}
    by_seq = {r.seq: r for r in first.table.collect()}
    assert by_seq[2].duplicate_of == by_seq[1].id and by_seq[2].final_score is None
    assert [r.seq for r in first.digest.collect()] == [1]
    second = run(raw, *dims, sims, TODAY, at(22), path)
    assert second.digest.count() == 0 and second.top.count() == 1 and second.table.count() == 3


def test_plans_broadcast_pack_tables(spark):
    raw = spark.createDataFrame([], RAW_POSTING)
    plan = enrich.enrich_companies(raw, enrich.companies(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_whole_rows_are_written_once_for_every_change(spark, tmp_path, monkeypatch):
    """No copy of the texts is set aside by a first merge or by maintenance, and a later merge sets aside its batch alone."""
    aside, real = [], store.cut
    monkeypatch.setattr(store, "cut", lambda df, name: ("description" in df.columns and aside.append(name)) or real(df, name))
    path = str(tmp_path / "table")
    rows = [posting(i, f"QA Lead {i}", description="text") for i in range(40)] + [posting(99, "Quality Manager", "Franklin, WI")]
    store.merge_table(path, table(spark, rows), POSTING, at(1))
    assert store.maintain(spark, path, POSTING) == {"regated": 1, "relinked": 0, "promoted": 0}
    assert aside == []
    merged = store.merge_table(path, table(spark, [posting(200, "QA Lead 7", final_score=9.0)]), POSTING, at(2))
    assert aside == ["merge-batch"]
    got = {r.title: r for r in merged.collect()}
    assert len(got) == 41 and got["QA Lead 7"].seq == 200 and got["QA Lead 8"].description == "text"
    assert got["Quality Manager"].status == "irrelevant" and got["QA Lead 7"].first_seen == datetime(2026, 6, 1)
