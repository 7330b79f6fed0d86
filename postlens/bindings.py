"""The driver's tables seen as postings: inputs of the registered queries.

The texts below use only syntax Spark SQL and DuckDB share, so the query and its check
start from the very same rows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from postlens.session import spread

TODAY = date(2026, 9, 1)

_BASE = "CAST(floor(doc_id / 3) AS BIGINT)"


def _case(selector: str, values: list[str | None]) -> str:
    arms = " ".join(
        f"WHEN {i} THEN {'NULL' if v is None else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39)}"
        for i, v in enumerate(values)
    )
    return f"CASE CAST({selector} AS INT) {arms} END"


_TITLES = [
    "National Quality Manager", "Site Quality Manager (12-Month Fixed Term)", "Senior Food Quality Specialist",
    "Senior Quality Manager", "Food Safety & Quality Manager", "Vendor Assurance Manager",
    "Regulatory Affairs Manager", "Site Technical Manager [Remote]", "QA Manager - Moorabbin, VIC",
    "Quality Systems Lead", "QA Officer (Casual) (Night Shift)", "Quality Control Technician",
    "Software QA Engineer", "Warehouse Picker",
]
_COMPANIES = [
    "Bega Group", "PepsiCo", "Woolworths", "Hays Recruitment", "Harbour Foods", "Cloud Kitchens & Co", "Coles",
    "Kerry", "Northern Labs", "The Arnott's Group",
]
_COMPANY_IDS = [
    "bega", "pepsico_au", "woolworths", None, None, "seek_qa_food_mfg", "coles", "kerry_au", "dnata_catering",
    "arnotts",
]
_LOCATIONS = [
    "Western Sydney NSW", "Chatswood, Australia", "Melbourne VIC", "Newcastle NSW", "Australia", "Remote",
    "London UK", "Kewdale, Australia", "",
]
_SALARIES = [
    "$140,000 - $160,000 + super", "$170k - $190k", "120000-140000 p.a.", "$55/hr", "Competitive", None, "$95.5k",
    "$104,000 per year",
]
_PHRASES = [
    "Lead the site quality team. HACCP, GMP, audit readiness, site leadership.",
    "Multi-site national quality across 8 plants; supplier quality and vendor approval.",
    "Automated test analyst for our SaaS platform. Selenium, CI/CD.",
    "Civil construction commissioning on an infrastructure project.",
    "Dairy and beverage factory; CAPA, non-conformance, traceability, risk assessment.",
    "Manage co-packers and contract manufacturers; regulatory compliance and labelling.",
    "Entry-level graduate role in a food factory laboratory, micro testing.",
    "Retail private label, customer audit and retailer audit, root cause.",
    "Central kitchen and meal kit; chef and kitchen hand supervision.",
    "Medical device and pharmaceutical quality, TGA, clinical documents.",
    "Quality systems ownership, technical leadership, direct reports.",
    "General duties at the depot.",
]
_SOURCES = ["official_ats", "linkedin", "seek", "indeed", "jora"]

# base groups three documents; v numbers them. A sixth of the groups holds exact copies
# (v = 0 and 1), half of those under one natural key.
_COPIES = "(base % 6 = 0 AND v <= 1)"
_SAME_KEY = "(base % 12 = 0 AND v <= 1)"

POSTINGS_RAW_SQL = f"""
SELECT
  doc_id AS seq,
  {_case("doc_id % 5", _SOURCES)} AS source,
  {_case("base % 14", _TITLES)} || CASE WHEN v = 2 AND base % 5 = 0 THEN ' - Permanent' ELSE '' END AS title,
  {_case("base % 10", _COMPANIES)}
    || CASE WHEN CAST(floor(base / 350) AS BIGINT) % 50 = 0 THEN ''
            ELSE ' ' || CAST(CAST(floor(base / 350) AS BIGINT) % 50 AS VARCHAR(10)) END
    || CASE WHEN v = 0 OR {_COPIES} THEN '' WHEN v = 1 THEN ' Australia' ELSE ' Pty Ltd' END AS company_name,
  'https://ex.com/job/' || CAST(doc_id AS VARCHAR(20)) AS apply_url,
  CASE WHEN {_SAME_KEY} THEN 'B' || CAST(base AS VARCHAR(20))
       WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN ''
       ELSE 'J' || CAST(doc_id AS VARCHAR(20)) END AS source_job_id,
  CASE WHEN v = 2 AND base % 4 = 0 THEN NULL ELSE {_case("base % 9", _LOCATIONS)} END AS location,
  CASE WHEN {_COPIES} THEN {_case("base % 12", _PHRASES)}
       ELSE {_case("base % 12", _PHRASES)} || ' ' || text END AS description,
  CASE CAST(CASE WHEN {_SAME_KEY} THEN base % 7 ELSE doc_id % 7 END AS INT)
       WHEN 0 THEN CAST(CAST('2026-06-01' AS DATE) + CAST(base % 97 AS INT) AS VARCHAR(10))
       WHEN 1 THEN '3 days ago' WHEN 2 THEN 'Posted 30+ Days Ago' WHEN 3 THEN 'today'
       WHEN 4 THEN '18 Jun 2026' WHEN 5 THEN NULL ELSE 'soon' END AS posted_date_raw,
  {_case("doc_id % 8", _SALARIES)} AS salary_raw,
  {_case("base % 10", _COMPANY_IDS)} AS company_id
FROM (SELECT doc_id, text, {_BASE} AS base, doc_id % 3 AS v FROM documents) d
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_of(documents: DataFrame) -> DataFrame:
    """Documents seen as raw postings."""
    sql = POSTINGS_RAW_SQL.replace("FROM documents)", "FROM {documents})")
    return documents.sparkSession.sql(sql, documents=documents)


def postings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_of(spread(table(spark, sf_dir, "documents")))
