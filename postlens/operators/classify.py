"""Classification: seniority, signals, industry, company size, place, relevance.

Arguments are SQL expressions, usually column names. Each classifier names its subject once
(``let_sql``): the subject is computed once per row, and the rules are evaluated next to it
instead of being generated into one Java method, which the full tables would push over the
size the JVM accepts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens.functions import rules
from postlens.packs import food_au as pack


def _lower(text: str) -> str:
    return f"lower(coalesce({text}, ''))"


def posting_text(title: str, description: str) -> Column:
    """Lowercased title and description, the subject of every text rule."""
    return F.expr(f"lower(concat(coalesce({title}, ''), '\\n', coalesce({description}, '')))")


# -- titles ---------------------------------------------------------------
def _seniority(title: str, promote_senior_specialist: bool = True) -> str:
    lowered = _lower(title)
    tokens = f"concat(' ', trim(regexp_replace({lowered}, '[^a-z0-9]+', ' ')), ' ')"
    cases = rules.token_rules_sql(
        "s.tokens", "s.text", pack.SENIORITY_RULES, "other", promote_senior_specialist=promote_senior_specialist
    )
    return rules.let_sql(f"named_struct('tokens', {tokens}, 'text', {lowered})", "s", cases)


def seniority(title: str, promote_senior_specialist: bool = True) -> Column:
    return F.expr(_seniority(title, promote_senior_specialist))


def is_relevant(title: str) -> Column:
    """Relevance is decided on the title alone."""
    named = f"s.category <> 'other' OR {rules.any_match_sql('s.text', pack.QUALITY_TITLE)}"
    excluded = rules.any_match_sql("s.text", pack.TITLE_EXCLUDE)
    subject = f"named_struct('category', {_seniority(title)}, 'text', {_lower(title)})"
    return F.expr(rules.let_sql(subject, "s", f"NOT {excluded} AND ({named})"))


# -- text -----------------------------------------------------------------
def signals(text: str) -> Column:
    """Names of all fired signals, in table order (``text`` is already lowercase)."""
    return F.expr(rules.let_sql(text, "t", rules.multi_label_sql("t", pack.SIGNALS)))


def _test(subject: str):
    return lambda patterns: rules.any_match_sql(subject, patterns)


def _sector_or_text(patterns) -> str:
    """A rule about "text" covers the sector too; no pattern can span the two."""
    return f"({rules.any_match_sql('s.sector', patterns)} OR {rules.any_match_long_sql('s.text', patterns)})"


def industry(sector: str, text: str) -> Column:
    subjects = {"sector": _test("s.sector"), "text": _sector_or_text}
    subject = f"named_struct('sector', {_lower(sector)}, 'text', {text})"
    return F.expr(rules.let_sql(subject, "s", rules.pattern_rules_sql(subjects, pack.INDUSTRY_RULES, "unclear")))


def company_class(sector: str, text: str, is_recruiter: str, company_name: str) -> Column:
    subjects = {
        "name": _test("s.name"), "sector": _test("s.sector"), "text": _sector_or_text, "flag": lambda _: "s.flag",
    }
    subject = (
        f"named_struct('sector', {_lower(sector)}, 'text', {text}, 'flag', {is_recruiter}, "
        f"'name', {_lower(company_name)})"
    )
    return F.expr(rules.let_sql(subject, "s", rules.pattern_rules_sql(subjects, pack.COMPANY_RULES, "unclear")))


def is_hard_excluded(industry_key: str, fired: str) -> Column:
    return F.expr(f"{industry_key} = 'out_of_domain' AND exists({fired}, s -> startswith(s, 'ex_'))")


# -- places ---------------------------------------------------------------
def _home_country(loc: str, word_boundary: bool = False) -> str:
    cities = pack.SYDNEY_SUBURBS + pack.NSW_REGIONAL + pack.OTHER_STATE_CITIES
    city = (
        rules.any_match_sql(loc, [rf"\b{c}\b" for c in cities])
        if word_boundary
        else rules.contains_any_sql(loc, cities)
    )
    marked = rules.any_match_sql(loc, pack.HOME_COUNTRY + pack.STATE_CODES)
    named = rules.contains_any_sql(loc, pack.REMOTE_MARKERS + pack.STATE_NAMES)
    return f"(trim({loc}) = '' OR {marked} OR {named} OR {city})"


def is_home_country(location: str, word_boundary: bool = False) -> Column:
    """Any sign of the home country, or no place at all.

    City names match as substrings; ``word_boundary`` asks for whole words instead.
    """
    return F.expr(rules.let_sql(_lower(location), "loc", _home_country("loc", word_boundary)))


def _home_state(text: str) -> str:
    return rules.any_match_sql(text, pack.HOME_STATE)


def _other_state(text: str) -> str:
    return rules.any_match_sql(text, pack.OTHER_STATE_CITIES + pack.OTHER_STATE_MARKS)


def _location_class(location: str) -> str:
    cases = [
        ("other_au", "trim(loc) = ''"),
        ("overseas", f"NOT {_home_country('loc')}"),
        ("melbourne_brisbane", f"{_other_state('loc')} AND NOT {_home_state('loc')}"),
        ("sydney_greater", rules.contains_any_sql("loc", pack.SYDNEY_SUBURBS)),
        ("nsw_regional", rules.contains_any_sql("loc", pack.NSW_REGIONAL)),
        ("sydney_greater", _home_state("loc")),
        ("melbourne_brisbane", _other_state("loc")),
    ]
    return rules.let_sql(_lower(location), "loc", rules.first_label_sql(cases, "other_au"))


def location_class(location: str) -> Column:
    return F.expr(_location_class(location))


def mentions_other_state(text: str) -> Column:
    return F.expr(rules.let_sql(_lower(text), "t", f"{_other_state('t')} AND NOT {_home_state('t')}"))


def _names_a_place(loc: str) -> str:
    """Is anything left of the location once country, remote and filler words are gone?"""
    filler = r"(?U)\b(?:" + "|".join(pack.NON_LOCALITY) + r")\b"
    return f"regexp_replace({loc}, {rules.text_literal(filler)}, ' ') RLIKE '[a-z0-9]'"


def region(location: str, title: str) -> Column:
    """``nsw`` (keep), ``other`` (drop) or ``ambiguous`` (keep) for the home-region view."""
    home = ", ".join(f"'{c}'" for c in pack.HOME_REGION)
    home_places = rules.contains_any_sql("s.both", pack.SYDNEY_SUBURBS + pack.NSW_REGIONAL)
    elsewhere = f"({_other_state('s.title')} AND NOT {_home_state('s.title')})"
    cases = [
        ("nsw", f"s.bucket IN ({home})"),
        ("nsw", f"{_home_state('s.both')} OR {home_places}"),
        ("other", f"s.bucket IN ('melbourne_brisbane', 'overseas') OR {elsewhere}"),
        ("nsw", rules.contains_any_sql("s.loc", pack.REMOTE_MARKERS)),
        ("other", _names_a_place("s.loc")),
    ]
    subject = (
        f"named_struct('loc', {_lower(location)}, 'title', {_lower(title)}, 'bucket', {_location_class(location)}, "
        f"'both', concat({_lower(location)}, ' ', {_lower(title)}))"
    )
    return F.expr(rules.let_sql(subject, "s", rules.first_label_sql(cases, "ambiguous")))


def location_bucket(location: str) -> Column:
    home = ", ".join(f"'{c}'" for c in pack.HOME_REGION)
    remote = rules.contains_any_sql(_lower(location), pack.BUCKET_REMOTE_MARKERS)
    return F.expr(
        rules.first_label_sql([("nsw_remote", f"{remote} OR {_location_class(location)} IN ({home})")], "other_au")
    )


def source_rank(source: Column) -> Column:
    """Preference rank of a source, unknown ones last."""
    order = F.array(*[F.lit(s) for s in pack.SOURCE_PREFERENCE])
    position = F.array_position(order, source)
    return F.when(position > 0, position - 1).otherwise(F.lit(len(pack.SOURCE_PREFERENCE))).cast("int")
