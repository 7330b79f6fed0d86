"""Human-readable columns of the report and digest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens.functions.rules import any_match
from postlens.packs import food_au as pack


def is_recruiter(company_name: Column) -> Column:
    name = F.lower(F.coalesce(company_name, F.lit("")))
    return any_match(name, pack.RECRUITER_NAMES)


def star_bar(company_name: Column, stars: Column) -> Column:
    """``★★★★☆ (4/5)``, or '' for recruiters."""
    bar = F.concat(
        F.repeat(F.lit("★"), stars.cast("int")),
        F.repeat(F.lit("☆"), (F.lit(5) - stars).cast("int")),
        F.format_string(" (%d/5)", stars),
    )
    return F.when(is_recruiter(company_name), F.lit("")).otherwise(bar)


def recruiter_mark(company_name: Column) -> Column:
    return F.when(is_recruiter(company_name), F.lit(pack.RECRUITER_LABEL)).otherwise(F.lit(""))


def format_salary(lo: Column, hi: Column, currency: Column, period: Column, raw: Column) -> Column:
    prefix = F.when(F.coalesce(currency, F.lit("")) != "", F.concat(currency, F.lit(" "))).otherwise(F.lit(""))
    suffix = F.when(F.coalesce(period, F.lit("")) != "", F.concat(F.lit(" / "), period)).otherwise(F.lit(""))

    def money(amount: Column) -> Column:
        return F.concat(prefix, F.format_number(amount, 0))

    figures = (
        F.when(lo != hi, F.concat(money(lo), F.lit(" - "), money(hi)))
        .when(lo.isNotNull(), money(lo))
        .when(hi.isNotNull(), money(hi))
    )
    stated = F.trim(F.coalesce(raw, F.lit("")))
    return F.coalesce(
        F.concat(figures, suffix), F.when(stated != "", stated), F.lit(pack.UNDISCLOSED_LABEL)
    )


def digest_lines(p: dict[str, Column]) -> Column:
    """The text block of one posting in the plain digest."""
    dash = F.lit("—")
    head = F.concat_ws(
        " — ",
        p["title"],
        p["company_name"],
        F.when(F.coalesce(p["location"], F.lit("")) != "", p["location"]).otherwise(dash),
        F.concat(
            F.coalesce(F.format_string("%.1f", p["final_score"]), dash),
            F.lit("/"),
            F.coalesce(p["priority_tier"], dash),
        ),
    )
    mark = recruiter_mark(p["company_name"])
    bar = star_bar(p["company_name"], p["stars"])
    return F.concat_ws(
        "\n",
        head,
        F.when(mark != "", F.concat(F.lit("  "), mark)),
        F.when(bar != "", F.concat(F.lit("  评分 / Rating: "), bar)),
        F.concat(F.lit("  薪资 / Salary: "), p["salary_text"]),
        F.concat(F.lit("  申请链接 / Apply: "), p["apply_url"]),
    )
