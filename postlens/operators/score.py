"""Component scores, final score, tiers, alerts and tips."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions import rules
from postlens.operators import classify
from postlens.packs import food_au as pack


def _words(items) -> str:
    return ", ".join(f"'{i}'" for i in items)


def _text(value: str) -> str:
    return rules.text_literal(value)


def semantic_score(similarity: str) -> Column:
    return F.expr(rules.clamp_sql(f"{similarity} / {pack.SEMANTIC_CEILING}D", 0, 1) + " * 100")


def seniority_score(category: str) -> Column:
    return F.expr(rules.clamp_sql(f"{rules.points_sql(category, pack.SENIORITY_POINTS)} * 100 / 30", 0, 100))


def industry_score(industry_key: str, fired: str) -> Column:
    """Industry points plus the points of the fired responsibilities, the overlap counted once."""
    earned = rules.points_sql("signal", pack.RESPONSIBILITY_POINTS)
    total = f"aggregate({fired}, {rules.points_sql(industry_key, pack.INDUSTRY_POINTS)}, (acc, signal) -> acc + {earned})"
    first, counted_once = pack.AUDIT_OVERLAP
    overlap = (
        f"CASE WHEN array_contains({fired}, '{first}') AND array_contains({fired}, '{counted_once}') "
        f"THEN {float(pack.RESPONSIBILITY_POINTS[counted_once])}D ELSE 0D END"
    )
    return F.expr(rules.clamp_sql(f"{total} - {overlap}", 0, 100))


def company_score(company_key: str, is_tier1: str) -> Column:
    anchor = float(pack.COMPANY_POINTS[pack.COMPANY_ANCHOR] or 15)
    earned = rules.points_sql(company_key, pack.COMPANY_POINTS)
    lifted = rules.let_sql(earned, "p", f"CASE WHEN {is_tier1} AND p < {anchor}D THEN {anchor}D ELSE p END")
    return F.expr(rules.clamp_sql(f"{lifted} / {anchor}D * 100", 0, 100))


def salary_points(lo: str, hi: str, disclosed: str) -> Column:
    """Points of the upper bound (the lower one if there is none); 0 when undisclosed."""
    gap_from, gap_to = pack.SALARY_NEUTRAL_GAP
    amount = f"coalesce({hi}, {lo})"
    banded = rules.band_sql(amount, [(b, float(p)) for b, p in pack.SALARY_BANDS], "0D")
    return F.expr(
        f"CASE WHEN NOT ({disclosed}) OR {amount} IS NULL THEN 0D "
        f"WHEN {amount} >= {gap_from} AND {amount} < {gap_to} THEN 0D ELSE {banded} END"
    )


def location_salary_score(location_key: str, salary_pts: str) -> Column:
    raw = f"{rules.points_sql(location_key, pack.LOCATION_POINTS)} + {salary_pts}"
    return F.expr(rules.clamp_sql(f"({raw} + 30) / 60 * 100", 0, 100))


def final_score(semantic: str, seniority: str, industry: str, company: str, place: str) -> Column:
    w = pack.WEIGHTS
    parts = [
        (w["semantic"], semantic), (w["seniority"], seniority), (w["industry"], industry), (w["company"], company),
        (w["location_salary"], place),
    ]
    return F.expr("round(" + " + ".join(f"{weight}D * {score}" for weight, score in parts) + ", 1)")


def priority_tier(score: str) -> Column:
    banded = f"CASE WHEN s IS NOT NULL THEN {rules.band_sql('s', pack.TIER_BANDS, repr('D'))} END"
    return F.expr(rules.let_sql(score, "s", banded))


def tier_rank(tier: str) -> Column:
    return F.expr(f"CASE {tier} " + " ".join(f"WHEN '{t}' THEN {r}" for t, r in pack.TIER_RANK.items()) + " ELSE 4 END")


def match_reasons(category: str, is_tier1: str, location_key: str, salary_pts: str, fired: str, age_days: str) -> Column:
    """Texts of the alert conditions that hold, in fixed order."""

    def has(*names: str) -> str:
        return f"arrays_overlap({fired}, array({_words(names)}))"

    text = {k: _text(v) for k, v in pack.REASONS.items()}
    cases = [
        (f"{category} IN ({_words(pack.ALERT_SENIORITY)})", f"concat({text['seniority']}, replace({category}, '_', ' '))"),
        (is_tier1, text["tier1"]),
        (f"{location_key} IN ({_words(pack.HOME_REGION)})", text["region"]),
        (f"{salary_pts} >= 10", text["salary"]),
        (has("multi_site_national"), text["multi_site"]),
        (has("supplier_vendor_assurance", "co_packer"), text["supplier"]),
        (has("site_leadership", "alert_quality_systems_ownership"), text["leadership"]),
        (has("food_safety_cert"), text["food_safety"]),
        (f"{age_days} < 7", text["fresh"]),
    ]
    return F.expr("array_compact(array(" + ", ".join(f"CASE WHEN {t} THEN {r} END" for t, r in cases) + "))")


def resume_tips(fired: str, category: str) -> Column:
    cases = []
    for names, categories, tip in pack.TIPS:
        test = f"arrays_overlap({fired}, array({_words(names)}))"
        if categories:
            test += f" OR {category} IN ({_words(categories)})"
        cases.append(f"CASE WHEN {test} THEN {_text(tip)} END")
    held = f"array_compact(array({', '.join(cases)}))"
    shown = f"CASE WHEN size(h) = 0 THEN array({_text(pack.DEFAULT_TIP)}) ELSE slice(h, 1, {pack.MAX_TIPS}) END"
    return F.expr(rules.let_sql(held, "h", shown))


def gate(df: DataFrame) -> DataFrame:
    """Mark rows as scorable; overseas or irrelevant ones become 'irrelevant' but stay."""
    marked = df.withColumns(
        {"location_key": classify.location_class("location"), "_relevant": classify.is_relevant("title")}
    ).withColumn("scorable", F.expr("location_key <> 'overseas' AND _relevant"))
    return marked.withColumn("status", F.expr("CASE WHEN scorable THEN status ELSE 'irrelevant' END")).drop("_relevant")


def score(df: DataFrame, today: date) -> DataFrame:
    """Score gated rows in one narrow pass; rows that are not scorable keep NULL scores.

    Needs title, description, location, company_name, sector, is_tier1, is_recruiter,
    similarity, the salary columns, posted_date and the columns of :func:`gate`. Each level
    is its own projection, so the text is lowered once and the signals are computed once.
    """

    def scored(expr: Column) -> Column:
        return F.when(F.col("scorable"), expr)

    components = ["semantic_score", "seniority_score", "industry_score", "company_score", "location_score"]
    levels = [
        {"text_lc": scored(classify.posting_text("title", "description"))},
        {
            "category": scored(classify.seniority("title")),
            "signals": scored(classify.signals("text_lc")),
            "industry_key": scored(classify.industry("sector", "text_lc")),
            "company_key": scored(classify.company_class("sector", "text_lc", "is_recruiter", "company_name")),
            "salary_pts": scored(salary_points("salary_min", "salary_max", "salary_currency IS NOT NULL")),
            "age_days": F.date_diff(F.lit(today), F.col("posted_date")),
        },
        {
            "semantic_score": scored(semantic_score("similarity")),
            "seniority_score": seniority_score("category"),
            "industry_score": industry_score("industry_key", "signals"),
            "company_score": company_score("company_key", "is_tier1"),
            "location_score": scored(location_salary_score("location_key", "salary_pts")),
            "hard_excluded": F.coalesce(classify.is_hard_excluded("industry_key", "signals"), F.lit(False)),
            "match_reasons": scored(
                match_reasons("category", "is_tier1", "location_key", "salary_pts", "signals", "age_days")
            ),
            "resume_tips": scored(resume_tips("signals", "category")),
        },
        {
            "final_score": final_score(*components),
            "strong_alert": F.expr("coalesce(size(match_reasons) > 0, false)"),
            "status": F.expr("CASE WHEN hard_excluded THEN 'irrelevant' ELSE status END"),
        },
        {"priority_tier": priority_tier("final_score")},
    ]
    for level in levels:
        df = df.withColumns(level)
    return df.drop("text_lc", "salary_pts")


def boost(df: DataFrame) -> DataFrame:
    """Shift the score by the company's star rating and band it again."""
    delta = f"(stars - {pack.DEFAULT_STARS}) * {pack.STAR_BOOST}D"
    shifted = f"CASE WHEN stars = {pack.DEFAULT_STARS} THEN final_score ELSE {rules.clamp_sql(f'final_score + {delta}', 0, 100)} END"
    return df.withColumn("final_score", F.expr(shifted)).withColumn("priority_tier", priority_tier("final_score"))
