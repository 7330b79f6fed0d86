"""Salary strings to structured figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens.functions.rules import any_match
from postlens.functions.text import let, squash
from postlens.packs import food_au as pack

# Rough working time per year, used only when a caller asks for annual figures.
_PERIODS_PER_YEAR = {"hour": 1976, "day": 260, "year": 1}


def pay_period(text: Column) -> Column:
    lowered = F.lower(text)
    return (
        F.when(any_match(lowered, pack.PERIOD_HOUR), F.lit("hour"))
        .when(any_match(lowered, pack.PERIOD_DAY), F.lit("day"))
        .otherwise(F.lit("year"))
    )


def parse_salary(raw: Column, annualize: bool = False) -> Column:
    """Struct ``(min, max, currency, period, disclosed)``; all NULL and false when undisclosed.

    The first two money-like figures give the range. Figures are kept as stated unless
    ``annualize`` scales hourly and daily ones to a year.
    """
    figure = F.lit(pack.SALARY_FIGURE)

    def amount(f: Column) -> Column:
        number = F.regexp_replace(f["number"], ",", "").try_cast("double")
        scaled = number * F.when(f["kilo"] != "", F.lit(1000.0)).otherwise(F.lit(1.0))
        return F.struct(F.bround(scaled, 0).try_cast("bigint").alias("value"), (f["kilo"] != "").alias("kilo"))

    def read(text: Column) -> Column:
        found = F.arrays_zip(
            F.regexp_extract_all(text, figure, F.lit(1)).alias("number"),
            F.regexp_extract_all(text, figure, F.lit(2)).alias("kilo"),
        )
        hidden = (text == "") | any_match(F.lower(text), pack.UNDISCLOSED_SALARY)
        return F.struct(
            F.when(~hidden, F.transform(found, amount)).alias("amounts"),
            text.contains("$").alias("dollar"),
            pay_period(text).alias("period"),
        )

    def choose(s: Column) -> Column:
        money = F.filter(s["amounts"], lambda a: a["kilo"] | s["dollar"] | (a["value"] >= 1000))
        kept = let(money, lambda m: F.when(F.size(m) > 0, m).otherwise(s["amounts"]))
        factor = F.lit(1)
        if annualize:
            for name, count in _PERIODS_PER_YEAR.items():
                factor = F.when(s["period"] == name, F.lit(count)).otherwise(factor)
        bounds = let(F.slice(kept, 1, 2), lambda k: F.struct(F.array_min(F.transform(k, lambda a: a["value"])).alias("lo"), F.array_max(F.transform(k, lambda a: a["value"])).alias("hi")))
        return let(bounds, lambda b: result(b, s, factor))

    def result(b: Column, s: Column, factor: Column) -> Column:
        usable = b["lo"].isNotNull()
        return F.struct(
            (b["lo"] * factor).alias("min"),
            (b["hi"] * factor).alias("max"),
            F.when(usable, F.lit(pack.CURRENCY)).alias("currency"),
            F.when(usable, s["period"]).alias("period"),
            usable.alias("disclosed"),
        )

    return let(let(squash(F.coalesce(raw, F.lit(""))), read), choose)
