"""Expected labels and scores of the default rule pack."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from postlens.operators import classify, score, views
from postlens.packs import food_au as pack


def labels(spark, inputs, expr):
    df = spark.createDataFrame(list(enumerate(inputs)), "i int, v string")
    return [r.x for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def check(spark, expr, table):
    assert labels(spark, list(table), expr) == list(table.values())


def test_seniority(spark):
    check(spark, classify.seniority("v"), {
        "National Quality Manager": "national_group_head", "Group Head of Quality": "national_group_head",
        "Site Quality Manager": "site_quality_manager", "Senior Quality Manager": "senior_quality_manager",
        "Senior Food Quality Specialist": "senior_quality_manager", "Food Safety Quality Manager": "food_safety_quality_manager",
        "Vendor Assurance Manager": "supplier_quality_manager", "Regulatory Affairs Manager": "regulatory_affairs_manager_food",
        "Site Technical Quality Manager": "site_technical_manager", "QA Manager": "qa_manager",
        "Quality Lead": "senior_specialist_quality_lead", "Quality Coordinator": "qa_officer_coordinator", "Warehouse Picker": "other",
    })
    check(spark, classify.seniority("v", False), {"Senior Food Quality Specialist": "senior_specialist_quality_lead"})


def test_relevance(spark):
    check(spark, classify.is_relevant("v"), {
        "Quality Control Manager": True, "QA Officer": True, "Technical Manager": True, "Production Operator": False,
        "Safety Coordinator - Work Health and Safety": False, "Quality Control Technician": False,
    })


def test_places(spark):
    check(spark, classify.location_class("v"), {
        "Western Sydney NSW": "sydney_greater", "Macquarie Park": "sydney_greater", "Some Suburb NSW": "sydney_greater",
        "Newcastle": "nsw_regional", "Orange NSW Regional": "nsw_regional", "Melbourne VIC": "melbourne_brisbane",
        "Moorabbin, Australia": "melbourne_brisbane", "Australia": "other_au", "London UK": "overseas", "Chicago, IL": "overseas",
        "Hung Yen, Vietnam": "overseas", "": "other_au", None: "other_au", "Sweden": "nsw_regional",
    })
    check(spark, classify.is_home_country("v", word_boundary=True), {"Sweden": False, "Eden": True})
    check(spark, classify.mentions_other_state("v"), {"Coordinator - Moorabbin, VIC": True, "Site QM - Parramatta NSW": False, None: False})
    df = spark.createDataFrame(
        [("Sydney NSW", "QM"), ("Melbourne VIC", "QM"), (None, "QM"), ("Moorabbin, Australia", "QM"), ("Australia", "QM - Moorabbin, VIC"),
         ("Remote", "QM"), ("Kewdale, Australia", "QM"), ("Nowhere, Australia", "QM")], "location string, title string")
    got = [r[0] for r in df.select(classify.region("location", "title")).collect()]
    assert got == ["nsw", "other", "ambiguous", "other", "other", "nsw", "other", "other"]


def test_signals(spark):
    cases = {
        "Software QA Engineer with Selenium and CI/CD": "ex_software_qa", "Civil construction project": "ex_construction",
        "NDIS support coordinator": "ex_ndis", "Aged care and clinical role": "ex_health_aged_edu", "Call centre agent": "ex_call_centre",
        "Laboratory technician": "ex_lab_tech", "Junior graduate": "ex_junior", "forklift driver": "ex_operator", "Chef and barista": "ex_food_service_role",
        "across 8 plants": "multi_site_national", "direct reports": "manages_quality_team", "laboratory management": "laboratory",
        "Site leadership": "site_leadership", "vendor approval": "supplier_vendor_assurance", "co-packers": "co_packer",
        "customer audit": "customer_retailer_audit", "fssc 22000": "food_safety_cert", "labelling": "regulatory_compliance",
        "non-conformance": "capa_nc_traceability", "technical leadership": "alert_quality_systems_ownership",
    }
    df = spark.createDataFrame(list(cases.items()), "v string, want string").withColumn("t", F.lower("v"))
    for row in df.select("want", classify.signals("t").alias("s")).collect():
        assert row.want in row.s
    plain = spark.createDataFrame([("señor nción ncé",)], "t string")
    assert plain.select(classify.signals("t")).first()[0] == []


def test_industry_and_company(spark):
    rows = [
        ("software", "x", "Co", False, "out_of_domain", "unclear"), ("food manufacturing", "site quality", "Co", False, "food_manufacturing_fmcg", "large_food_group"),
        ("dairy", "milk", "Co", False, "food_subsector", "unclear"), ("retail group", "food safety", "Co", False, "retailer_supplier_quality", "large_retail_food"),
        ("foodservice", "central kitchen", "Co", False, "foodservice", "unclear"), ("pharma", "medical device", "Co", False, "pharma_meddevice", "unclear"),
        ("", "", "Coca-Cola Europacific Partners", False, "unclear", "large_food_group"), ("", "", "Hays Recruitment", False, "unclear", "recruiter_anonymous_food"),
        ("unknown", "", "Co", True, "unclear", "recruiter_anonymous_food"), ("food", "", "Co", False, "food_manufacturing_fmcg", "mid_food_manufacturer"),
    ]
    df = spark.createDataFrame(rows, "s string, t string, n string, r boolean, i string, c string")
    got = df.select("i", "c", classify.industry("s", "t").alias("gi"), classify.company_class("s", "t", "r", "n").alias("gc")).collect()
    for r in got:
        assert (r.gi, r.gc) == (r.i, r.c)


def test_salary_points_and_bands(spark):
    table = {170000: 15.0, 160000: 12.0, 130000: 10.0, 110000: 5.0, 105000: 0.0, 100000: 0.0, 99999: -10.0}
    df = spark.createDataFrame([(k,) for k in table], "v long")
    assert [r[0] for r in df.select(score.salary_points("cast(null as long)", "v", "true")).collect()] == list(table.values())
    tiers = {90.0: "A+", 80.0: "A+", 79.9: "A", 65.0: "A", 64.9: "B", 50.0: "B", 49.9: "C", 38.0: "C", 37.9: "D", 0.0: "D", None: None}
    df = spark.createDataFrame([(k,) for k in tiers], "v double")
    assert [r[0] for r in df.select(score.priority_tier("v")).collect()] == list(tiers.values())


def golden(spark):
    rows = [
        (1, "Site Quality Manager", "Lead the site quality team. HACCP, GMP, audit readiness, QA team, site leadership.", "Western Sydney NSW",
         140000, 160000, "AUD", "food manufacturing", True, 0.68),
        (2, "Senior Food Quality Specialist", "Responsible for supplier quality, food safety, and risk management across our retail group.", "Sydney",
         None, None, None, "retail group", False, 0.68),
        (3, "QA Officer", "Entry-level QA officer, food factory.", "Sydney", 75000, 85000, "AUD", "food", False, 0.4),
        (4, "Software QA Engineer", "Automated test analyst for our SaaS platform. Selenium, CI/CD.", "Sydney NSW", None, None, None, "software", False, 0.5),
        (5, "Warehouse Picker", "x", "Sydney", None, None, None, "", False, 0.5),
    ]
    df = spark.createDataFrame(
        rows, "seq long, title string, description string, location string, salary_min long, salary_max long, salary_currency string, "
        "sector string, is_tier1 boolean, similarity double")
    df = df.withColumns({"company_name": F.lit("Example Co"), "is_recruiter": F.lit(False), "status": F.lit("new"), "posted_date": F.lit(date(2026, 6, 19)),
                         "stars": F.when(F.col("seq") == 1, 5).otherwise(3), "source": F.lit("seek"), "apply_url": F.col("title")})
    return score.score(score.gate(df), date(2026, 6, 21))


def test_golden_scores(spark):
    got = {r.seq: r for r in golden(spark).collect()}
    assert [(got[i].final_score, got[i].priority_tier) for i in (1, 2, 3)] == [(89.8, "A+"), (78.2, "A"), (34.3, "D")]
    assert got[1].industry_score == 80 and got[2].industry_score == 62 and got[1].location_score == 95.0
    assert got[1].strong_alert and "Tier-1 target company" in got[1].match_reasons
    assert got[4].status == "irrelevant" and got[4].hard_excluded and not got[3].hard_excluded
    assert got[5].status == "irrelevant" and got[5].final_score is None and got[5].industry_score is None


def test_boost_and_views(spark):
    boosted = score.boost(golden(spark))
    got = {r.seq: r.final_score for r in boosted.collect()}
    assert got[1] == 94.8 and got[2] == 78.2
    top = [r.seq for r in views.top_jobs(boosted, limit=2).collect()]
    assert top == [1, 2]
    counts = [(r.tier, r.n) for r in views.tier_counts(boosted).collect()]
    assert counts[0] == ("A+", 1) and counts[-1] == ("Unscored", 1)


def test_sections_overlap_and_dedupe(spark):
    rows = [
        (1, "official_ats", "u1", "Melbourne VIC", 90.0), (2, "seek", "u1", "Melbourne VIC", 80.0), (3, "seek", "u3", None, None),
        (4, "official_ats", "u4", "Sydney", 70.0), (5, "jora", "u5", "Sydney", 60.0),
    ]
    df = spark.createDataFrame(rows, "seq long, source string, apply_url string, location string, final_score double").withColumn("title", F.lit("QM"))
    placed = sorted((r.section, r.seq) for r in views.report_sections(df).collect())
    assert placed == [(1, 1), (1, 4), (2, 3), (2, 5), (3, 1)]
    top = sorted((r.section, r.rank, r.seq) for r in views.top_n_per_section(views.report_sections(df), 1).collect())
    assert top == [(1, 1, 1), (2, 1, 5), (3, 1, 1)]
    assert pack.EMAIL_TOP_N == 10
