"""DuckDB SQL that computes what each registered query must return.

The texts come from the same rule tables but follow their own path: RE2 patterns instead of
prefiltered Java ones, all-pairs joins and recursive closure instead of sparse links, window
functions instead of keyed aggregations.
"""

from __future__ import annotations

from postlens.bindings import POSTINGS_RAW_SQL, TODAY
from postlens.packs import food_au as pack

WS = r"[\t-\r\x1C-\x20\x85\p{Z}]"
NOT_WORD = r"[^\p{L}\p{N}_\s]"
TODAY_SQL = f"DATE '{TODAY.isoformat()}'"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


def squash(e: str) -> str:
    return f"trim(regexp_replace({e}, {q(WS + '+')}, ' ', 'g'))"


def re2(pattern: str) -> str:
    """Unicode word boundaries for RE2, whose own are ASCII: spell out the neighbour."""
    edge = r"[^\p{L}\p{N}_]"
    if pattern.startswith(r"\b/"):
        pattern = r"[\p{L}\p{N}_]" + pattern[2:]
    if pattern.startswith(r"\b"):
        pattern = f"(?:^|{edge})" + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + f"(?:$|{edge})"
    return pattern.replace(r"\w", r"[\p{L}\p{N}_]")


def any_re(e: str, patterns) -> str:
    def test(pattern: str) -> str:
        return f"regexp_matches({e}, {q(re2(pattern))})"

    return "(" + " OR ".join(test(p) for p in patterns) + ")"


def any_sub(e: str, items) -> str:
    return "(" + " OR ".join(f"contains({e}, {q(i)})" for i in items) + ")"


def normalize_title(e: str) -> str:
    text = f"replace(lower({e}), '&', ' and ')"
    trailing = r"(?:[\(\[\{][^\)\]\}]*[\)\]\}]" + WS + r"*)+$"
    text = f"regexp_replace(regexp_replace({text}, {q(WS + '+$')}, ''), {q(trailing)}, '')"
    return squash(f"regexp_replace({text}, {q(NOT_WORD)}, ' ', 'g')")


def company_key(e: str) -> str:
    text = squash(f"regexp_replace(replace(lower({e}), '&', ' and '), {q(NOT_WORD)}, '', 'g')")
    kept = f"list_filter(string_split({text}, ' '), lambda t: t <> '' AND t NOT IN {words(pack.COMPANY_STOP_TOKENS)})"
    return f"coalesce(array_to_string({kept}, ' '), '')"


def title_core(e: str) -> str:
    test = f"t <> '' AND t NOT IN {words(pack.TITLE_NOISE_TOKENS)} AND NOT regexp_full_match(t, '[0-9]+')"
    return f"coalesce(array_to_string(list_filter(string_split({e}, ' '), lambda t: {test}), ' '), '')"


def city(e: str) -> str:
    return squash(f"lower(split_part(coalesce({e}, ''), ',', 1))")


def posted_date(e: str) -> str:
    t = f"lower(trim(coalesce({e}, '')))"
    n = f"CAST(regexp_extract({t}, '([0-9]+)', 1) AS INT)"
    return (
        f"CASE WHEN {t} = '' THEN NULL WHEN contains({t}, 'today') THEN {TODAY_SQL} "
        f"WHEN regexp_matches({t}, '[0-9]+ *\\+? *day') AND (contains({t}, 'ago') OR contains({t}, 'posted')) "
        f"THEN {TODAY_SQL} - {n} "
        f"ELSE CAST(try_strptime({t}, ['%Y-%m-%d', '%d %b %Y', '%d/%m/%Y']) AS DATE) END"
    )


# -- salary: each figure as a struct, then the first two money-like ones -----
_AMOUNTS = (
    "list_transform(range(1, len(nums) + 1), lambda i: {{'k': coalesce(kilos[i], '') <> '', "
    "'v': CAST(round_even(CAST(replace(nums[i], ',', '') AS DOUBLE) * CASE WHEN coalesce(kilos[i], '') <> '' THEN 1000 ELSE 1 END, 0) AS BIGINT)}})"
).replace("{{", "{").replace("}}", "}")


def salary_cte(source: str, column: str = "salary_raw") -> str:
    figure = q(pack.SALARY_FIGURE)
    return f"""
sal0 AS (SELECT *, {squash(f"coalesce({column}, '')")} AS st FROM {source}),
sal1 AS (SELECT *, regexp_extract_all(st, {figure}, 1) AS nums, regexp_extract_all(st, {figure}, 2) AS kilos FROM sal0),
sal2 AS (SELECT *, {_AMOUNTS} AS amounts FROM sal1),
sal3 AS (SELECT *, list_filter(amounts, lambda a: a.k OR contains(st, '$') OR a.v >= 1000) AS money,
  st <> '' AND NOT {any_re("lower(st)", pack.UNDISCLOSED_SALARY)} AND len(amounts) > 0 AS disclosed FROM sal2),
sal4 AS (SELECT *, CASE WHEN len(money) > 0 THEN money ELSE amounts END AS kept FROM sal3),
salary AS (SELECT * EXCLUDE (st, nums, kilos, amounts, money, kept),
  CASE WHEN disclosed THEN least(kept[1].v, coalesce(kept[2].v, kept[1].v)) END AS salary_min,
  CASE WHEN disclosed THEN greatest(kept[1].v, coalesce(kept[2].v, kept[1].v)) END AS salary_max,
  CASE WHEN disclosed THEN 'AUD' END AS salary_currency,
  CASE WHEN disclosed THEN CASE WHEN {any_re("lower(st)", pack.PERIOD_HOUR)} THEN 'hour'
    WHEN {any_re("lower(st)", pack.PERIOD_DAY)} THEN 'day' ELSE 'year' END END AS salary_period FROM sal4)"""


RAW = f"raw AS ({POSTINGS_RAW_SQL})"

NORM = f"""{RAW},
norm0 AS (SELECT seq, source, source_job_id, company_id, trim(company_name) AS company_name, trim(title) AS title,
  {normalize_title("title")} AS normalized_title, location, {posted_date("posted_date_raw")} AS posted_date,
  apply_url, {squash("description")} AS description, salary_raw, 'new' AS status FROM raw),
{salary_cte("norm0")},
norm AS MATERIALIZED (SELECT *, sha256(lower(description)) AS description_hash FROM salary)"""


def with_(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {select}"


# -- classification ----------------------------------------------------------
def _clause(c) -> str:
    has = lambda w: f"contains(tok, ' {w} ')"
    tests = [has(w) for w in c.get("all", [])]
    tests += ["(" + " OR ".join(has(w) for w in ws) + ")" for ws in c.get("any", [])]
    tests += [f"NOT {has(w)}" for w in c.get("none", [])]
    if "phrase" in c:
        tests.append(f"contains(title_lc, {q(c['phrase'])})")
    return "(" + " AND ".join(tests) + ")"


SENIORITY = (
    "CASE "
    + " ".join(f"WHEN {' OR '.join(_clause(c) for c in cs)} THEN '{label}'" for label, cs in pack.SENIORITY_RULES)
    + " ELSE 'other' END"
)
RELEVANT = (
    f"(NOT {any_re('title_lc', pack.TITLE_EXCLUDE)} AND (category <> 'other' OR {any_re('title_lc', pack.QUALITY_TITLE)}))"
)


def _rules(rules, default: str) -> str:
    def test(subject, patterns):
        if subject == "flag":
            return "is_recruiter"
        return any_re({"name": "lower(company_name)", "sector": "lower(sector)", "text": "blob"}[subject], patterns)

    return "CASE " + " ".join(f"WHEN {test(s, p)} THEN '{label}'" for label, s, p in rules) + f" ELSE '{default}' END"


INDUSTRY = _rules(pack.INDUSTRY_RULES, "unclear")
COMPANY_CLASS = _rules(pack.COMPANY_RULES, "unclear")

_LOC = "lower(coalesce(location, ''))"
_BLANK = "trim(coalesce(location, '')) = ''"
_CITIES = pack.SYDNEY_SUBURBS + pack.NSW_REGIONAL + pack.OTHER_STATE_CITIES


def home_state(e: str) -> str:
    return any_re(e, pack.HOME_STATE)


def other_state(e: str) -> str:
    return "(" + any_sub(e, pack.OTHER_STATE_CITIES) + " OR " + any_re(e, pack.OTHER_STATE_MARKS) + ")"


HOME_COUNTRY = (
    f"({_BLANK} OR {any_re(_LOC, pack.HOME_COUNTRY + pack.STATE_CODES)} "
    f"OR {any_sub(_LOC, pack.REMOTE_MARKERS + pack.STATE_NAMES + _CITIES)})"
)
LOCATION_CLASS = (
    f"CASE WHEN {_BLANK} THEN 'other_au' WHEN NOT {HOME_COUNTRY} THEN 'overseas' "
    f"WHEN {other_state(_LOC)} AND NOT {home_state(_LOC)} THEN 'melbourne_brisbane' "
    f"WHEN {any_sub(_LOC, pack.SYDNEY_SUBURBS)} THEN 'sydney_greater' "
    f"WHEN {any_sub(_LOC, pack.NSW_REGIONAL)} THEN 'nsw_regional' WHEN {home_state(_LOC)} THEN 'sydney_greater' "
    f"WHEN {other_state(_LOC)} THEN 'melbourne_brisbane' ELSE 'other_au' END"
)
_BOTH = f"({_LOC} || ' ' || lower(title))"
_FILLER = r"\b(?:" + "|".join(pack.NON_LOCALITY) + r")\b"
REGION = (
    f"CASE WHEN location_key IN ('sydney_greater', 'nsw_regional') THEN 'nsw' "
    f"WHEN {home_state(_BOTH)} OR {any_sub(_BOTH, pack.SYDNEY_SUBURBS + pack.NSW_REGIONAL)} THEN 'nsw' "
    f"WHEN location_key IN ('melbourne_brisbane', 'overseas') "
    f"OR ({other_state('lower(title)')} AND NOT {home_state('lower(title)')}) THEN 'other' "
    f"WHEN {any_sub(_LOC, pack.REMOTE_MARKERS)} THEN 'nsw' "
    f"WHEN regexp_matches(regexp_replace({_LOC}, {q(_FILLER)}, ' ', 'g'), '[a-z0-9]') THEN 'other' "
    f"ELSE 'ambiguous' END"
)
BUCKET = (
    f"CASE WHEN {any_sub(_LOC, pack.BUCKET_REMOTE_MARKERS)} OR location_key IN ('sydney_greater', 'nsw_regional') "
    f"THEN 'nsw_remote' ELSE 'other_au' END"
)


def points(e: str, table) -> str:
    return f"CASE {e} " + " ".join(f"WHEN {q(k)} THEN {float(v)!r}::DOUBLE" for k, v in table.items()) + " ELSE 0::DOUBLE END"


def bands(e: str, table, default: str) -> str:
    show = lambda v: q(v) if isinstance(v, str) else f"{float(v)!r}::DOUBLE"
    return "CASE " + " ".join(f"WHEN {e} >= {b} THEN {show(v)}" for b, v in table) + f" ELSE {default} END"


def clamp(e: str, lo: int, hi: int) -> str:
    return f"greatest({lo}::DOUBLE, least({hi}::DOUBLE, {e}))"


SALARY_POINTS = (
    "CASE WHEN NOT disclosed OR coalesce(salary_max, salary_min) IS NULL THEN 0::DOUBLE "
    f"WHEN coalesce(salary_max, salary_min) >= {pack.SALARY_NEUTRAL_GAP[0]} "
    f"AND coalesce(salary_max, salary_min) < {pack.SALARY_NEUTRAL_GAP[1]} THEN 0::DOUBLE "
    f"ELSE {bands('coalesce(salary_max, salary_min)', pack.SALARY_BANDS, '0::DOUBLE')} END"
)

COMPANIES = (
    "companies(company_id, name, sector, priority_tier, adapter, active) AS (VALUES "
    + ", ".join(
        f"({q(a)}, {q(b)}, {q(c)}, {q(d)}, {q(e)}, {str(f).upper()})" for a, b, c, d, e, f in pack.COMPANIES
    )
    + ")"
)
RATED = (
    "rated0(pos, name, stars) AS (VALUES "
    + ", ".join(f"({i}, {q(n)}, {s})" for i, (n, s) in enumerate(pack.RATINGS.items()))
    + f"), rated AS (SELECT company_key, arg_max(stars, pos) AS stars FROM (SELECT {company_key('name')} AS company_key, "
    "stars, pos FROM rated0) GROUP BY company_key)"
)
SIMS = """sims AS (SELECT vec_id, greatest(-1, least(1, list_cosine_similarity(embedding::DOUBLE[], p.e::DOUBLE[]))) AS similarity
  FROM embeddings, (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) p),
nvec AS (SELECT max(vec_id) + 1 AS n FROM embeddings)"""

ENRICHED = f"""{NORM}, {COMPANIES}, {RATED}, {SIMS},
enr AS MATERIALIZED (SELECT n.*, coalesce(c.sector, '') AS sector, coalesce(upper(c.priority_tier) = 'P1', false) AS is_tier1,
  CASE WHEN c.company_id IS NOT NULL THEN lower(c.sector) = 'aggregator'
       ELSE contains(lower(n.company_name), 'recruit') OR contains(lower(n.company_name), 'agency') END AS is_recruiter,
  coalesce(r.stars, {pack.DEFAULT_STARS}) AS stars, s.similarity,
  ' ' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || ' ' AS tok, lower(title) AS title_lc,
  lower(title || chr(10) || description) AS text_lc,
  lower(coalesce(c.sector, '') || chr(10) || title || chr(10) || description) AS blob
  FROM norm n LEFT JOIN companies c USING (company_id)
  LEFT JOIN rated r ON r.company_key = {company_key("n.company_name")}
  LEFT JOIN sims s ON s.vec_id = n.seq % (SELECT n FROM nvec)),
gated AS MATERIALIZED (SELECT *, {SENIORITY} AS category, {LOCATION_CLASS} AS location_key FROM enr),
cls AS MATERIALIZED (SELECT *, location_key <> 'overseas' AND {RELEVANT} AS scorable, {INDUSTRY} AS industry_key,
  {COMPANY_CLASS} AS company_key, {REGION} AS region,
  list_filter([{", ".join(f"CASE WHEN {any_re('text_lc', ps)} THEN '{k}' END" for k, ps in pack.SIGNALS.items())}],
    lambda s: s IS NOT NULL) AS signals FROM gated)"""


def has(*names: str) -> str:
    return "(" + " OR ".join(f"list_contains(signals, '{n}')" for n in names) + ")"


INDUSTRY_SCORE = clamp(
    points("industry_key", pack.INDUSTRY_POINTS)
    + "".join(f" + CASE WHEN {has(k)} THEN {v} ELSE 0 END" for k, v in pack.RESPONSIBILITY_POINTS.items())
    + f" - CASE WHEN {has(pack.AUDIT_OVERLAP[0])} AND {has(pack.AUDIT_OVERLAP[1])} THEN "
    f"{pack.RESPONSIBILITY_POINTS[pack.AUDIT_OVERLAP[1]]} ELSE 0 END",
    0,
    100,
)
COMPANY_SCORE = clamp(
    f"(CASE WHEN is_tier1 THEN greatest({points('company_key', pack.COMPANY_POINTS)}, 15::DOUBLE) "
    f"ELSE {points('company_key', pack.COMPANY_POINTS)} END) / 15 * 100",
    0,
    100,
)
_R = pack.REASONS
REASONS = (
    "list_filter(["
    f"CASE WHEN category IN {words(pack.ALERT_SENIORITY)} THEN {q(_R['seniority'])} || replace(category, '_', ' ') END, "
    f"CASE WHEN is_tier1 THEN {q(_R['tier1'])} END, "
    f"CASE WHEN location_key IN {words(pack.HOME_REGION)} THEN {q(_R['region'])} END, "
    f"CASE WHEN salary_pts >= 10 THEN {q(_R['salary'])} END, "
    f"CASE WHEN {has('multi_site_national')} THEN {q(_R['multi_site'])} END, "
    f"CASE WHEN {has('supplier_vendor_assurance', 'co_packer')} THEN {q(_R['supplier'])} END, "
    f"CASE WHEN {has('site_leadership', 'alert_quality_systems_ownership')} THEN {q(_R['leadership'])} END, "
    f"CASE WHEN {has('food_safety_cert')} THEN {q(_R['food_safety'])} END, "
    f"CASE WHEN {TODAY_SQL} - posted_date < 7 THEN {q(_R['fresh'])} END], lambda r: r IS NOT NULL)"
)


def _tip(names, categories, tip) -> str:
    test = has(*names) + (f" OR category IN {words(categories)}" if categories else "")
    return f"CASE WHEN {test} THEN {q(tip)} END"


TIPS = f"list_filter([{', '.join(_tip(*t) for t in pack.TIPS)}], lambda t: t IS NOT NULL)"
_W = pack.WEIGHTS
SCORED = f"""{ENRICHED},
sc0 AS MATERIALIZED (SELECT *, {SALARY_POINTS} AS salary_pts FROM cls),
sc1 AS MATERIALIZED (SELECT *, {clamp("similarity / 0.8::DOUBLE", 0, 1)} * 100 AS semantic_score,
  {clamp(points("category", pack.SENIORITY_POINTS) + " * 100 / 30", 0, 100)} AS seniority_score,
  {INDUSTRY_SCORE} AS industry_score, {COMPANY_SCORE} AS company_score,
  {clamp("(" + points("location_key", pack.LOCATION_POINTS) + " + salary_pts + 30) / 60 * 100", 0, 100)} AS location_score,
  {REASONS} AS match_reasons, {TIPS} AS tips0,
  industry_key = 'out_of_domain' AND len(list_filter(signals, lambda s: starts_with(s, 'ex_'))) > 0 AS excl FROM sc0),
sc2 AS MATERIALIZED (SELECT *, round({_W["semantic"]}::DOUBLE * semantic_score + {_W["seniority"]}::DOUBLE * seniority_score
  + {_W["industry"]}::DOUBLE * industry_score + {_W["company"]}::DOUBLE * company_score
  + {_W["location_salary"]}::DOUBLE * location_score, 1) AS base_score FROM sc1),
sc3 AS (SELECT *, CASE WHEN stars <> {pack.DEFAULT_STARS}
  THEN {clamp(f"base_score + (stars - {pack.DEFAULT_STARS}) * {pack.STAR_BOOST}::DOUBLE", 0, 100)} ELSE base_score END AS boosted FROM sc2),
scored AS (SELECT * EXCLUDE (status, category, signals, industry_key, company_key, match_reasons, semantic_score, seniority_score,
    industry_score, company_score, location_score),
  CASE WHEN NOT scorable OR excl THEN 'irrelevant' ELSE status END AS status,
  CASE WHEN scorable THEN category END AS category, CASE WHEN scorable THEN signals END AS signals,
  CASE WHEN scorable THEN industry_key END AS industry_key, CASE WHEN scorable THEN company_key END AS company_key,
  CASE WHEN scorable THEN semantic_score END AS semantic_score, CASE WHEN scorable THEN seniority_score END AS seniority_score,
  CASE WHEN scorable THEN industry_score END AS industry_score, CASE WHEN scorable THEN company_score END AS company_score,
  CASE WHEN scorable THEN location_score END AS location_score, scorable AND excl AS hard_excluded,
  CASE WHEN scorable THEN match_reasons END AS match_reasons, scorable AND len(match_reasons) > 0 AS strong_alert,
  CASE WHEN scorable THEN CASE WHEN len(tips0) = 0 THEN [{q(pack.DEFAULT_TIP)}] ELSE list_slice(tips0, 1, {pack.MAX_TIPS}) END END AS resume_tips,
  CASE WHEN scorable THEN boosted END AS final_score,
  CASE WHEN scorable THEN {bands("boosted", pack.TIER_BANDS, "'D'")} END AS priority_tier FROM sc3)"""

_RANK = "CASE source " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(pack.SOURCE_PREFERENCE)) + " ELSE 5 END"
_TIER_RANK = "CASE priority_tier " + " ".join(f"WHEN '{t}' THEN {i}" for t, i in pack.TIER_RANK.items()) + " ELSE 4 END"

# -- resolution: the definition itself, pair by pair ---------------------------
ER = f"""{NORM},
k AS (SELECT *, lower(trim(company_name)) AS co, coalesce(location, '') AS lo, coalesce(CAST(posted_date AS VARCHAR), '') AS da,
  CASE WHEN coalesce(source_job_id, '') <> '' THEN source_job_id ELSE apply_url END AS ident,
  {company_key("company_name")} AS ck, {title_core("normalized_title")} AS tc, {city("location")} AS cy FROM norm),
p1 AS MATERIALIZED (SELECT *, min(seq) OVER (PARTITION BY normalized_title, co, lo, da, ident) AS rep1 FROM k),
c2 AS (SELECT seq, min(seq) OVER (PARTITION BY description_hash, normalized_title, co) AS rep2 FROM p1 WHERE seq = rep1),
p2 AS MATERIALIZED (SELECT p1.*, c2.rep2 FROM p1 JOIN c2 ON p1.rep1 = c2.seq),
reps AS MATERIALIZED (SELECT seq, ck, tc, cy, posted_date FROM p2 WHERE seq = rep2 AND ck <> '' AND tc <> ''),
pairs AS MATERIALIZED (SELECT a.seq AS a, b.seq AS b FROM reps a JOIN reps b ON a.ck = b.ck AND a.tc = b.tc AND a.seq <> b.seq
  WHERE (a.cy = '' OR b.cy = '' OR len(list_intersect(string_split(a.cy, ' '), string_split(b.cy, ' '))) > 0)
  AND (a.posted_date IS NULL OR b.posted_date IS NULL OR abs(a.posted_date - b.posted_date) <= 21)),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
root AS (SELECT a AS seq, least(a, min(b)) AS cluster FROM reach GROUP BY a),
members AS MATERIALIZED (SELECT p2.*, coalesce(root.cluster, p2.rep2) AS cluster FROM p2 LEFT JOIN root ON p2.rep2 = root.seq),
best AS (SELECT *, first_value(seq) OVER (PARTITION BY cluster ORDER BY {_RANK}, length(coalesce(description, '')) DESC,
  coalesce(apply_url, ''), seq) AS canonical FROM members)"""


# -- one SQL text per query ------------------------------------------------------
def S(select: str) -> str:
    return with_(SCORED, select)


def E(select: str) -> str:
    return with_(ER, select, recursive=True)


def arr(e: str) -> str:
    return f"coalesce(array_to_string({e}, '|'), '')"


_ID = (
    "sha256(normalized_title || chr(31) || company_name || chr(31) || coalesce(location, '') || chr(31) || "
    "coalesce(CAST(posted_date AS VARCHAR), '') || chr(31) || coalesce(source_job_id, apply_url))"
)
_DIGEST = f"scored WHERE status <> 'irrelevant' AND priority_tier IS NOT NULL AND {_TIER_RANK} <= 3 AND region <> 'other'"
_STORE = f"""{NORM},
ids AS MATERIALIZED (SELECT *, {_ID} AS id FROM norm),
v0 AS (SELECT id, arg_max(seq, seq) AS seq, arg_min(source_job_id, seq) AS source_job_id, arg_max(salary_raw, seq) AS salary_raw,
  arg_max(title, seq) AS title, arg_max(location, seq) AS location,
  arg_max(CASE WHEN seq % 20 = 1 THEN 'applied' WHEN seq % 20 = 2 THEN 'expired' ELSE status END, seq) AS status
  FROM ids WHERE seq % 4 <> 3 GROUP BY id),
v0n AS (SELECT v0.* EXCLUDE (salary_raw, source_job_id), d.salary_raw, f.source_job_id FROM v0 JOIN ids d ON d.seq = v0.seq
  JOIN (SELECT id, source_job_id FROM (SELECT id, source_job_id, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM ids WHERE seq % 4 <> 3) WHERE rn = 1) f ON f.id = v0.id),
b1 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn, first_value(source_job_id) OVER (PARTITION BY id ORDER BY seq) AS fsj
  FROM ids WHERE seq % 4 <> 0),
batch AS (SELECT id, seq, fsj AS source_job_id, status, 'v1 ' || coalesce(salary_raw, '-') AS salary_raw FROM b1 WHERE rn = 1)"""
_SECTIONS = f"""{SCORED},
placed AS (SELECT *, 1 AS section FROM scored WHERE source = 'official_ats'
  UNION ALL SELECT *, 2 FROM scored WHERE source <> 'official_ats' AND region <> 'other'
  UNION ALL SELECT *, 3 FROM scored WHERE region = 'other'),
sections AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section, CASE WHEN section = 3 THEN apply_url ELSE CAST(seq AS VARCHAR) END
  ORDER BY final_score DESC NULLS LAST, seq) AS u FROM placed) WHERE u = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY final_score DESC NULLS LAST, seq) AS rank FROM sections)"""
_HEADING = f"CASE section WHEN 1 THEN {q(pack.SECTIONS[0])} WHEN 2 THEN {q(pack.SECTIONS[1])} ELSE {q(pack.SECTIONS[2])} END"


def _money(e: str) -> str:
    return f"coalesce(salary_currency || ' ', '') || format('{{:,}}', {e})"


_SALARY_TEXT = (
    f"CASE WHEN salary_min IS NULL THEN CASE WHEN trim(coalesce(salary_raw, '')) <> '' THEN trim(salary_raw) ELSE {q(pack.UNDISCLOSED_LABEL)} END "
    f"WHEN salary_min = salary_max THEN {_money('salary_min')} || ' / ' || salary_period "
    f"ELSE {_money('salary_min')} || ' - ' || {_money('salary_max')} || ' / ' || salary_period END"
)
_RECRUITER = any_re("lower(company_name)", pack.RECRUITER_NAMES)
_BAR = (
    f"CASE WHEN {_RECRUITER} THEN '' ELSE repeat('★', CAST(stars AS INT)) || repeat('☆', CAST(5 - stars AS INT)) "
    "|| ' (' || CAST(stars AS VARCHAR) || '/5)' END"
)
_MARK = f"CASE WHEN {_RECRUITER} THEN {q(pack.RECRUITER_LABEL)} ELSE '' END"
_LINES = (
    "title || ' — ' || company_name || ' — ' || CASE WHEN coalesce(location, '') = '' THEN '—' ELSE location END || ' — ' "
    "|| coalesce(format('{:.1f}', final_score), '—') || '/' || coalesce(priority_tier, '—') "
    f"|| CASE WHEN {_RECRUITER} THEN chr(10) || '  ' || {_MARK} ELSE chr(10) || '  评分 / Rating: ' || {_BAR} END "
    f"|| chr(10) || '  薪资 / Salary: ' || ({_SALARY_TEXT}) || chr(10) || '  申请链接 / Apply: ' || apply_url"
)
_STATUS_OF_EVENT = (
    "CASE WHEN event_type IN ('view', 'click') THEN 'ok' WHEN event_type = 'purchase' THEN 'blocked' "
    "WHEN event_type = 'error' THEN 'error' ELSE 'empty' END"
)
_STATS = f"""{RAW}, {COMPANIES},
bad AS (SELECT user_id % 20 AS n, min(CASE WHEN value > 250 THEN 'blocked' ELSE 'error' END) AS status
  FROM events WHERE event_type = 'error' AND value > 200 GROUP BY 1),
counts AS (SELECT company_id, count(*) AS fetched FROM raw GROUP BY 1),
stats AS (SELECT c.company_id, c.name, c.priority_tier, coalesce(b.status, CASE WHEN coalesce(k.fetched, 0) > 0 THEN 'ok' ELSE 'empty' END) AS status,
  CAST(coalesce(k.fetched, 0) AS BIGINT) AS fetched
  FROM companies c LEFT JOIN counts k USING (company_id) LEFT JOIN bad b ON b.n = length(c.company_id) WHERE c.active)"""
_INVISIBLE = r"(?is)<head\b.*?</head\s*>|<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!doctype[^>]*>|</?[a-z][^>]*>"


def _decoded(e: str) -> str:
    for entity, char in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        e = f"replace({e}, {q(entity)}, {q(char)})"
    return e


_BODY_HASH = f"sha256(lower({squash('description')}))"
_OK = "seq % 17 <> 0"
_FIRST_WORD = "split_part(location, ' ', 1)"
_HREFS = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a\s*>"
_LINKS = f"""links AS (SELECT page_id, url, unnest(regexp_extract_all(b, {q(_HREFS)}, 1)) AS href,
    unnest(regexp_extract_all(b, {q(_HREFS)}, 2)) AS inner_html, unnest(range(len(regexp_extract_all(b, {q(_HREFS)}, 1)))) AS pos
  FROM (SELECT page_id, url, regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g') AS b FROM pages)),
named AS (SELECT page_id, pos, href, {squash(_decoded("regexp_replace(inner_html, '<[^>]*>', ' ', 'g')"))} AS title,
  regexp_extract(url, '^(https?://[^/?#]*)', 1) || href AS apply_url FROM links)"""
_SITE = "https://{}.example.com"
_HIDDEN = "CASE WHEN seq % 9 = 0 THEN '' ELSE company_name END"

# What the landed bodies hold, feed by feed, and the bodies that go wrong.
_PLACE = "CASE WHEN location <> '' THEN location END"
_API_URL = "CASE WHEN seq % 6 = 0 THEN apply_url ELSE 'https://ph.example.com/job/slug-' || CAST(seq AS VARCHAR) END"
_API_PLACE = (
    f"CASE WHEN seq % 2 = 0 AND coalesce(location, '') <> '' THEN location ELSE CASE WHEN coalesce({_FIRST_WORD}, '') <> '' THEN {_FIRST_WORD} || ', ' ELSE '' END "
    "|| CASE WHEN seq % 3 = 0 THEN 'NSW, ' ELSE '' END || 'Australia' END"
)
_WIDGET_PLACE = (
    "CASE WHEN seq % 2 = 0 AND coalesce(location, '') <> '' THEN location ELSE 'Sydney, ' || "
    "CASE seq % 3 WHEN 0 THEN 'Australia' WHEN 1 THEN 'AU' ELSE 'Vietnam' END END"
)
_SMART_PLACE = f"CASE WHEN coalesce({_FIRST_WORD}, '') <> '' THEN {_FIRST_WORD} || ', ' ELSE '' END || CASE WHEN seq % 2 = 0 THEN 'NSW, ' ELSE '' END || 'au'"
_WD_URL = "'https://wd.example.com/en-US/Careers/job/' || CAST(seq AS VARCHAR)"
_LINKED = _LINKS.replace("FROM pages)", "FROM (SELECT page_id, url, replace(html, 'href=\"/', 'href=\"/job/') AS html FROM pages) h)")
_LANDED = f"""{RAW}, p AS (SELECT *, CAST(floor(seq / 20) AS BIGINT) AS page_no, seq % 20 AS pos FROM raw), {_LINKED},
found AS (SELECT page_id, pos, title, apply_url FROM (SELECT *, row_number() OVER (PARTITION BY page_id, apply_url ORDER BY pos) AS rn FROM named
  WHERE regexp_matches(lower(href), '/job/|jobdetail|/jobs/') AND NOT regexp_matches(lower(href), '^(#|javascript:|mailto:)') AND length(title) >= 3) WHERE rn = 1),
landed AS (
  SELECT 'list' AS kind, page_no, pos, title, {_WD_URL} AS url, location FROM p WHERE {_OK}
  UNION ALL SELECT 'list', page_no, pos, title, {_WD_URL}, location FROM p WHERE {_OK} AND page_no % 3 = 0
  UNION ALL SELECT 'board_jobs', page_no, pos, title, apply_url, {_PLACE} FROM p WHERE {_OK} OR pos = 0
  UNION ALL SELECT 'board_jobs', page_no, pos, title, replace(apply_url, '/job/', '/term/'), {_PLACE} FROM p WHERE ({_OK} OR pos = 0) AND page_no % 2 = 0
  UNION ALL SELECT 'postings_array', page_no, pos, title, apply_url, {_PLACE} FROM p WHERE {_OK}
  UNION ALL SELECT 'api_jobs', page_no, pos, title, {_API_URL}, {_API_PLACE} FROM p
  UNION ALL SELECT 'widgets', page_no, pos, title, CASE WHEN seq % 2 = 0 THEN apply_url ELSE apply_url || '/view' END, {_WIDGET_PLACE} FROM p WHERE {_OK}
  UNION ALL SELECT 'content', page_no, pos, title, 'https://sr.example.com/board/S' || CAST(seq AS VARCHAR), {_SMART_PLACE} FROM p WHERE {_OK}
  UNION ALL SELECT 'rss', page_no, pos, title || ' - Sydney', apply_url, CASE WHEN seq % 2 = 0 AND coalesce(location, '') <> '' THEN location ELSE 'Sydney' END FROM p WHERE page_no % 10 <> 9
  UNION ALL SELECT 'embedded_json', page_no, pos, title, 'https://seek.example.com/job/' || CAST(seq AS VARCHAR), {_PLACE} FROM p WHERE {_OK}
  UNION ALL SELECT 'cards', page_no, pos, title, 'https://seek.example.com/job/' || CAST(seq AS VARCHAR), {_PLACE} FROM p
  UNION ALL SELECT 'html', page_id, pos, title, apply_url, CASE WHEN contains(title, ' - ') AND length(trim(list_extract(string_split(title, ' - '), -1))) BETWEEN 1 AND 40
    THEN trim(list_extract(string_split(title, ' - '), -1)) END FROM found
), pn AS (SELECT DISTINCT page_no FROM p),
errors AS (
  SELECT 'rss' AS kind, page_no, 'no_rows' AS reason FROM pn WHERE page_no % 10 = 9
  UNION ALL SELECT 'postings_array', page_no, 'malformed' FROM pn WHERE page_no % 4 = 0 UNION ALL SELECT 'list', page_no, 'no_rows' FROM pn WHERE page_no % 5 = 0
  UNION ALL SELECT 'empty', page_no, 'empty' FROM pn WHERE page_no % 7 = 0 UNION ALL SELECT 'unknown_json', page_no, 'unknown_shape' FROM pn WHERE page_no % 8 = 0
  UNION ALL SELECT 'html', page_id, 'no_rows' FROM pages WHERE page_id NOT IN (SELECT page_id FROM found)
)"""

SQL = {
    "normalize_title": with_(RAW, f"SELECT seq, {normalize_title('title')} AS normalized_title FROM raw"),
    "description_hash": f"SELECT doc_id, sha256({squash('lower(text)')}) AS description_hash FROM documents",
    "normalize_company": with_(RAW, f"SELECT seq, {company_key('company_name')} AS company_key FROM raw"),
    "title_core": with_(RAW, f"SELECT seq, {title_core(normalize_title('title'))} AS title_core FROM raw"),
    "city_key": with_(RAW, f"SELECT seq, {city('location')} AS city FROM raw"),
    "token_set": "SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))), ' '), '') AS tokens FROM documents",
    "clean_text": f"SELECT page_id, {squash(_decoded(f'regexp_replace(html, {q(_INVISIBLE)}, {q(chr(32))}, {q(chr(103))})'))} AS text FROM pages",
    "parse_salary": with_(f"{RAW}, {salary_cte('raw')}", "SELECT seq, salary_min, salary_max, salary_currency, salary_period, disclosed FROM salary"),
    "parse_posted_date": with_(RAW, f"SELECT seq, CAST({posted_date('posted_date_raw')} AS VARCHAR) AS posted_date FROM raw"),
    "format_salary": with_(NORM, f"SELECT seq, {_SALARY_TEXT} AS salary_text FROM norm"),
    "star_bar": with_(
        f"{RAW}, {RATED}, s AS (SELECT raw.*, coalesce(r.stars, 3) AS stars FROM raw LEFT JOIN rated r ON r.company_key = {company_key('raw.company_name')})",
        f"SELECT seq, {_BAR} AS bar, {_MARK} AS mark FROM s",
    ),
    "normalize_postings": with_(
        NORM,
        "SELECT seq, source, source_job_id, company_id, company_name, title, normalized_title, location, CAST(posted_date AS VARCHAR) AS posted_date, "
        "apply_url, description_hash, salary_min, salary_max, salary_currency, salary_period, salary_raw, status FROM norm",
    ),
    "relevance_gate": S(f"SELECT seq, title FROM cls WHERE {RELEVANT}").replace(SCORED, ENRICHED),
    "precision_gate": with_(ENRICHED, "SELECT seq, location_key, CASE WHEN scorable THEN 'new' ELSE 'irrelevant' END AS status FROM cls"),
    "hard_exclude": with_(
        ENRICHED,
        "SELECT seq, industry_key = 'out_of_domain' AND len(list_filter(signals, lambda s: starts_with(s, 'ex_'))) > 0 AS excluded FROM cls",
    ),
    "region_filter": with_(ENRICHED, "SELECT seq, location, region FROM cls WHERE region <> 'other'"),
    "recruiter_flag": with_(RAW, f"SELECT seq, {_RECRUITER} AS is_recruiter FROM raw"),
    "classify_first_match": with_(
        ENRICHED,
        f"SELECT seq, category, {SENIORITY.replace(_clause(pack.SENIORITY_RULES[2][1][0]), 'false')} AS category_plain FROM cls",
    ),
    "detect_signals": with_(ENRICHED, f"SELECT seq, {arr('signals')} AS signals FROM cls"),
    "classify_industry": with_(ENRICHED, "SELECT seq, industry_key FROM cls"),
    "classify_company": with_(ENRICHED, "SELECT seq, company_key FROM cls"),
    "is_home_country": with_(RAW, f"SELECT seq, {HOME_COUNTRY} AS home FROM raw"),
    "classify_location": with_(RAW, f"SELECT seq, {LOCATION_CLASS} AS location_key FROM raw"),
    "location_bucket": with_(
        f"{RAW}, l AS (SELECT *, {LOCATION_CLASS} AS location_key FROM raw)", f"SELECT seq, {BUCKET} AS bucket FROM l"
    ),
    "cosine_to_profile": with_(SIMS, "SELECT vec_id, round(similarity, 6) AS similarity FROM sims"),
    "text_vectors": "SELECT doc_id, 128 AS dim, 1.0::DOUBLE AS unit FROM documents",
    "score_industry": with_(ENRICHED, f"SELECT seq, {INDUSTRY_SCORE} AS industry_score FROM cls"),
    "score_company": with_(ENRICHED, f"SELECT seq, round({COMPANY_SCORE}, 6) AS company_score FROM cls"),
    "salary_bands": "SELECT o_orderkey, "
    + SALARY_POINTS.replace("coalesce(salary_max, salary_min)", "o_totalprice").replace("NOT disclosed OR ", "")
    + " AS points FROM orders",
    "final_score": S(
        "SELECT seq, round(semantic_score, 6) AS semantic_score, round(seniority_score, 6) AS seniority_score, round(industry_score, 6) AS industry_score, "
        "round(company_score, 6) AS company_score, round(location_score, 6) AS location_score, round(final_score, 6) AS final_score FROM scored WHERE scorable"
    ),
    "priority_tier": S("SELECT seq, priority_tier, status FROM scored"),
    "rating_boost": S("SELECT seq, CAST(stars AS BIGINT) AS stars, round(final_score, 6) AS final_score, priority_tier FROM scored"),
    "strong_alert": S(f"SELECT seq, strong_alert, {arr('match_reasons')} AS match_reasons FROM scored WHERE scorable"),
    "tips": S(f"SELECT seq, {arr('resume_tips')} AS resume_tips FROM scored WHERE scorable"),
    "score_postings": S(
        "SELECT seq, status, category, array_to_string(signals, '|') AS signals, industry_key, company_key, location_key, hard_excluded, strong_alert, "
        "priority_tier, round(similarity, 6) AS similarity, round(final_score, 6) AS final_score FROM scored"
    ),
    "company_enrich": with_(ENRICHED, "SELECT seq, company_id, sector, is_tier1, is_recruiter FROM enr"),
    "new_postings": with_(_STORE, "SELECT seq, id FROM ids WHERE seq % 4 <> 0 AND id NOT IN (SELECT id FROM v0n)"),
    "upsert_merge": with_(
        _STORE,
        "SELECT coalesce(o.id, n.id) AS id, coalesce(n.seq, o.seq) AS seq, CASE WHEN o.id IS NOT NULL THEN o.source_job_id ELSE n.source_job_id END AS source_job_id, "
        "CASE WHEN o.status IN ('reviewed', 'apply', 'applied', 'rejected') THEN o.status ELSE coalesce(n.status, o.status) END AS status, "
        "CASE WHEN n.id IS NOT NULL THEN n.salary_raw ELSE o.salary_raw END AS salary_raw, "
        "CASE WHEN o.id IS NOT NULL THEN '2026-08-01' ELSE '2026-09-01' END AS first_seen, CASE WHEN n.id IS NOT NULL THEN '2026-09-01' ELSE '2026-08-01' END AS last_seen "
        "FROM v0n o FULL OUTER JOIN batch n ON o.id = n.id",
    ),
    "store_run": with_(
        _STORE
        + """, last AS (SELECT id, title, location FROM b1 WHERE rn = 1), merged AS (SELECT coalesce(o.id, n.id) AS id, coalesce(n.seq, o.seq) AS seq,
  CASE WHEN o.id IS NOT NULL THEN o.source_job_id ELSE n.source_job_id END AS source_job_id,
  CASE WHEN o.status IN ('reviewed', 'apply', 'applied', 'rejected') THEN o.status ELSE coalesce(n.status, o.status) END AS status,
  CASE WHEN n.id IS NOT NULL THEN n.salary_raw ELSE o.salary_raw END AS salary_raw,
  CASE WHEN n.id IS NOT NULL THEN l.title ELSE o.title END AS title, CASE WHEN n.id IS NOT NULL THEN l.location ELSE o.location END AS location,
  CASE WHEN o.id IS NOT NULL THEN '2026-08-01' ELSE '2026-09-01' END AS first_seen, CASE WHEN n.id IS NOT NULL THEN '2026-09-01' ELSE '2026-08-01' END AS last_seen
  FROM v0n o FULL OUTER JOIN batch n ON o.id = n.id LEFT JOIN last l ON l.id = n.id), """
        f"t AS (SELECT *, ' ' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || ' ' AS tok, lower(title) AS title_lc FROM merged), "
        f"u AS (SELECT *, {SENIORITY} AS category, {LOCATION_CLASS} AS location_key FROM t)",
        f"SELECT id, seq, source_job_id, CASE WHEN status = 'new' AND (location_key = 'overseas' OR NOT {RELEVANT}) THEN 'irrelevant' ELSE status END AS status, "
        "salary_raw, first_seen, last_seen FROM u",
    ),
    "point_lookup": with_(
        _STORE,
        "SELECT id, seq, source_job_id, status, salary_raw FROM v0n WHERE id = (SELECT min(id) FROM v0n) OR id = (SELECT max(id) FROM v0n)",
    ),
    "regate": with_(
        _STORE
        + f", t AS (SELECT *, ' ' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || ' ' AS tok, lower(title) AS title_lc FROM v0n), "
        f"u AS (SELECT *, {SENIORITY} AS category, {LOCATION_CLASS} AS location_key FROM t)",
        f"SELECT id, CASE WHEN status = 'new' AND (location_key = 'overseas' OR NOT {RELEVANT}) THEN 'irrelevant' ELSE status END AS status FROM u",
    ),
    "repair_orphans": with_(
        f"""{NORM}, t AS (SELECT seq, source, normalized_title, company_name, 'p' || CAST(seq AS VARCHAR) AS id,
  CASE WHEN seq % 3 = 0 THEN 'duplicate' WHEN seq % 7 = 1 THEN 'irrelevant' WHEN seq % 5 = 2 THEN 'duplicate' ELSE 'new' END AS status,
  CASE WHEN seq % 9 = 0 THEN 'kept' END AS duplicate_of, CASE WHEN seq % 4 <> 0 THEN CAST((seq * 37) % 100 AS DOUBLE) END AS final_score FROM norm),
o AS (SELECT *, status = 'duplicate' AND duplicate_of IS NULL AS orphan FROM t),
s AS (SELECT DISTINCT ON (normalized_title, company_name) normalized_title, company_name, id FROM o WHERE status NOT IN ('duplicate', 'irrelevant')
  ORDER BY normalized_title, company_name, final_score DESC NULLS LAST, seq),
b AS (SELECT DISTINCT ON (normalized_title, company_name) normalized_title, company_name, id FROM o WHERE orphan
  ORDER BY normalized_title, company_name, {_RANK}, seq),
j AS (SELECT o.*, s.id AS survivor, b.id AS best FROM o LEFT JOIN s USING (normalized_title, company_name) LEFT JOIN b USING (normalized_title, company_name))""",
        "SELECT id, CASE WHEN orphan AND survivor IS NULL AND id = best THEN 'new' ELSE status END AS status, "
        "CASE WHEN orphan AND NOT (survivor IS NULL AND id = best) THEN coalesce(survivor, best) ELSE duplicate_of END AS duplicate_of FROM j",
    ),
    "maintenance_counts": with_(
        f"""{NORM}, g AS (SELECT *, 'p' || CAST(seq AS VARCHAR) AS id, ' ' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || ' ' AS tok, lower(title) AS title_lc FROM norm),
u AS (SELECT *, {SENIORITY} AS category, {LOCATION_CLASS} AS location_key FROM g),
w AS (SELECT seq, source, normalized_title, company_name, id, location_key = 'overseas' OR NOT {RELEVANT} AS fails,
  CASE WHEN seq % 3 = 0 THEN 'duplicate' WHEN seq % 7 = 1 THEN 'irrelevant' WHEN seq % 5 = 2 THEN 'duplicate' ELSE 'new' END AS was,
  CASE WHEN seq % 9 = 0 THEN 'kept' END AS duplicate_of, CASE WHEN seq % 4 <> 0 THEN CAST((seq * 37) % 100 AS DOUBLE) END AS final_score FROM u),
t AS (SELECT *, CASE WHEN was = 'new' AND fails THEN 'irrelevant' ELSE was END AS status FROM w),
o AS (SELECT *, status = 'duplicate' AND duplicate_of IS NULL AS orphan FROM t),
s AS (SELECT DISTINCT normalized_title, company_name FROM o WHERE status NOT IN ('duplicate', 'irrelevant')),
b AS (SELECT DISTINCT ON (normalized_title, company_name) normalized_title, company_name, id AS best FROM o WHERE orphan ORDER BY normalized_title, company_name, {_RANK}, seq),
j AS (SELECT o.*, s.company_name IS NULL AND o.id = b.best AS promoted FROM o LEFT JOIN b ON o.normalized_title = b.normalized_title AND o.company_name = b.company_name
  LEFT JOIN s ON o.normalized_title = s.normalized_title AND o.company_name = s.company_name)""",
        "SELECT count(*) FILTER (was <> status) AS regated, count(*) FILTER (orphan AND NOT promoted) AS relinked, count(*) FILTER (orphan AND promoted) AS promoted, count(*) FILTER (orphan AND promoted AND fails) AS again FROM j",
    ),
    "encode_new": with_(
        f"""{NORM}, ids AS MATERIALIZED (SELECT *, {_ID} AS id FROM norm), nv AS (SELECT max(vec_id) + 1 AS n FROM embeddings),
known AS (SELECT DISTINCT ON (normalized_title, company_name, description_hash) normalized_title, company_name, description_hash, embedding
  FROM ids i JOIN embeddings e ON e.vec_id = i.seq % (SELECT n FROM nv) WHERE i.seq % 4 <> 3
  ORDER BY normalized_title, company_name, description_hash, i.id, i.seq),
counted AS (SELECT seq, embedding, [len(normalized_title), len(normalized_title) - len(replace(normalized_title, 'a', '')), len(normalized_title) - len(replace(normalized_title, 'e', '')),
  len(normalized_title) - len(replace(normalized_title, ' ', ''))] AS c FROM ids LEFT JOIN known USING (normalized_title, company_name, description_hash) WHERE seq % 2 = 1),
v AS (SELECT seq, embedding IS NOT NULL AS reused, CASE WHEN embedding IS NOT NULL THEN CAST(embedding AS DOUBLE[]) ELSE list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) END AS v FROM counted)""",
        "SELECT seq, reused, round(v[1], 5) AS v0, round(v[2], 5) AS v1, round(v[3], 5) AS v2, round(v[4], 5) AS v3 FROM v",
    ),
    "feed_files": with_(
        RAW,
        "SELECT apply_url, title || ' - Sydney' AS title, CASE WHEN seq % 2 = 0 AND coalesce(location, '') <> '' THEN location ELSE 'Sydney' END AS location, CAST(NULL AS VARCHAR) AS reason "
        "FROM raw WHERE CAST(floor(seq / 20) AS BIGINT) % 10 <> 9 "
        "UNION ALL SELECT NULL, NULL, NULL, 'malformed' FROM (SELECT DISTINCT CAST(floor(seq / 20) AS BIGINT) AS page_no FROM raw) WHERE page_no % 10 = 9",
    ),
    "embedding_reuse": with_(
        f"""{NORM}, ids AS MATERIALIZED (SELECT *, {_ID} AS id FROM norm), nv AS (SELECT max(vec_id) + 1 AS n FROM embeddings),
known AS (SELECT DISTINCT ON (normalized_title, company_name, description_hash) normalized_title, company_name, description_hash, embedding[1] AS first
  FROM ids i JOIN embeddings e ON e.vec_id = i.seq % (SELECT n FROM nv) WHERE i.seq % 4 <> 3
  ORDER BY normalized_title, company_name, description_hash, i.id, i.seq)""",
        "SELECT seq, first IS NOT NULL AS reused, round(CAST(first AS DOUBLE), 6) AS first FROM ids LEFT JOIN known USING (normalized_title, company_name, description_hash) WHERE seq % 2 = 1",
    ),
    "er_pass1": E("SELECT rep1 AS rep, count(*) AS rows FROM p1 GROUP BY 1"),
    "er_pass2": E("SELECT rep2 AS rep, count(DISTINCT rep1) AS groups FROM p2 GROUP BY 1"),
    "er_edges": E("SELECT DISTINCT a AS seq FROM pairs"),
    "er_components": E("SELECT seq, cluster FROM members"),
    "pick_best": E("SELECT DISTINCT cluster, canonical FROM best"),
    "deduplicate": E("SELECT seq, cluster, canonical, CASE WHEN seq = canonical THEN 'new' ELSE 'duplicate' END AS status FROM best"),
    "duplicate_links": E("SELECT seq, canonical AS duplicate_of FROM best WHERE seq <> canonical"),
    "dedup_stats": E("SELECT count(*) FILTER (seq = canonical) AS canonical, count(*) FILTER (seq <> canonical) AS duplicates, count(*) AS persisted FROM best"),
    "content_dedup": f"SELECT sha256({squash('lower(text)')}) AS description_hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1",
    "digest_select": S(f"SELECT seq, priority_tier, round(final_score, 6) AS final_score FROM {_DIGEST}"),
    "digest_new_only": with_(
        SCORED + ", v0i AS (SELECT " + _ID + " AS id FROM norm WHERE seq % 4 <> 3)",
        f"SELECT seq, priority_tier FROM (SELECT * FROM {_DIGEST}) WHERE {_ID} NOT IN (SELECT id FROM v0i)",
    ),
    "digest_summary": S(
        f"SELECT count(*) AS roles, count(*) FILTER (strong_alert OR coalesce(priority_tier, '') = 'A+') AS high_priority FROM {_DIGEST}"
    ),
    "top_jobs": S(
        "SELECT seq, round(final_score, 6) AS final_score FROM scored WHERE final_score >= 40 AND status NOT IN ('duplicate', 'irrelevant', 'expired') "
        "ORDER BY final_score DESC, seq LIMIT 50"
    ),
    "seen_since": "SELECT event_id, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'",
    "report_sections": with_(
        _SECTIONS, f"SELECT CAST(section AS BIGINT) AS section, {_HEADING} AS heading, seq, round(final_score, 6) AS final_score FROM sections"
    ),
    "section_counts": with_(_SECTIONS, "SELECT CAST(section AS BIGINT) AS section, count(*) AS n FROM sections GROUP BY 1"),
    "email_top_n": with_(
        _SECTIONS, "SELECT CAST(section AS BIGINT) AS section, rank, seq, round(final_score, 6) AS final_score FROM ranked WHERE rank <= 10"
    ),
    "digest_lines": with_(_SECTIONS, f"SELECT CAST(section AS BIGINT) AS section, rank, {_LINES} AS lines FROM ranked WHERE rank <= 10"),
    "tier_counts": S(
        f"SELECT coalesce(priority_tier, 'Unscored') AS tier, count(*) AS n, CAST(CASE WHEN priority_tier IS NULL THEN 5 ELSE {_TIER_RANK} END AS BIGINT) AS position "
        "FROM scored GROUP BY 1, 3"
    ),
    "alerts_log": S(
        f"SELECT {_ID} AS job_id, 'run-1' AS run_id, 'email' AS channel, priority_tier, strong_alert, '2026-09-01' AS sent_at FROM {_DIGEST}"
    ),
    "source_stats": with_(_STATS, "SELECT company_id, status, fetched FROM stats"),
    "source_health": with_(
        _STATS,
        "SELECT company_id, name, status, status = 'ok' AS ok, fetched AS job_count, status <> 'ok' AND priority_tier = 'P1' AS failing FROM stats",
    ),
    "health_gate": with_(
        _STATS,
        "SELECT count(*) FILTER (status <> 'ok' AND priority_tier = 'P1') AS failing, count(*) FILTER (status <> 'ok' AND priority_tier = 'P1') = 0 AS passes FROM stats",
    ),
    "run_stats": (
        f"SELECT strftime(ts, '%Y-%m-%d') AS run_id, count(*) AS sources, CAST(sum(floor(value)) AS BIGINT) AS raw_fetched, count(*) FILTER ({_STATUS_OF_EVENT} = 'ok') AS ok, "
        f"count(*) FILTER ({_STATUS_OF_EVENT} = 'blocked') AS blocked, count(*) FILTER ({_STATUS_OF_EVENT} = 'error') AS errors FROM events GROUP BY 1"
    ),
    "fresh_payloads": (
        "SELECT user_id, event_id, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) "
        "WHERE rn = 1 AND ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 12 HOUR"
    ),
    "company_sync": with_(
        """sup AS (SELECT s.*, n.n_name FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey),
o AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS company_id, lower(s_name) AS name FROM sup WHERE s_suppkey % 2 = 0),
c AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS company_id, s_name AS name, n_name AS sector, CASE WHEN s_acctbal > 5000 THEN 'P1' ELSE 'P2' END AS priority_tier,
  s_acctbal > 0 AS active FROM sup WHERE s_suppkey % 3 <> 0)""",
        "SELECT coalesce(c.company_id, o.company_id) AS company_id, coalesce(c.name, o.name) AS name, coalesce(c.sector, '') AS sector, coalesce(c.priority_tier, 'P3') AS priority_tier, "
        "coalesce(c.active, true) AS active, CASE WHEN o.company_id IS NULL THEN '2026-09-01' ELSE '2026-01-01' END AS created_at, "
        "CASE WHEN c.company_id IS NULL THEN '2026-01-01' ELSE '2026-09-01' END AS updated_at FROM o FULL OUTER JOIN c ON o.company_id = c.company_id",
    ),
    "ingest_json_list": with_(
        RAW,
        f"SELECT 'list' AS feed, title, 'Bega Group' AS company_name, 'https://wd.example.com/en-US/Careers/job/' || CAST(seq AS VARCHAR) AS apply_url, "
        f"CASE WHEN seq % 5 <> 0 THEN 'R' || CAST(seq AS VARCHAR) ELSE '/job/' || CAST(seq AS VARCHAR) END AS source_job_id, location, posted_date_raw, CAST(NULL AS VARCHAR) AS body_hash "
        f"FROM raw WHERE {_OK} UNION ALL SELECT 'board_jobs', title, 'Bega Group', apply_url, CAST(seq AS VARCHAR), CASE WHEN location <> '' THEN location END, posted_date_raw, {_BODY_HASH} FROM raw WHERE {_OK} OR seq % 20 = 0",
    ),
    "ingest_json_nested": with_(
        RAW,
        f"SELECT 'api_jobs' AS feed, title, 'Bega Group' AS company_name, CASE WHEN seq % 6 = 0 THEN apply_url ELSE 'https://ph.example.com/job/slug-' || CAST(seq AS VARCHAR) END AS apply_url, "
        f"CASE WHEN seq % 4 <> 0 THEN 'Q' ELSE 'slug-' END || CAST(seq AS VARCHAR) AS source_job_id, "
        f"CASE WHEN seq % 2 = 0 AND coalesce(location, '') <> '' THEN location ELSE CASE WHEN coalesce({_FIRST_WORD}, '') <> '' THEN {_FIRST_WORD} || ', ' ELSE '' END || CASE WHEN seq % 3 = 0 THEN 'NSW, ' ELSE '' END || 'Australia' END AS location, "
        f"posted_date_raw, CAST(NULL AS VARCHAR) AS body_hash FROM raw "
        f"UNION ALL SELECT * FROM (SELECT 'widgets', title, 'Bega Group', CASE WHEN {_OK} THEN CASE WHEN seq % 2 = 0 THEN apply_url ELSE apply_url || '/view' END END AS u, "
        f"CASE WHEN seq % 4 <> 0 THEN 'W' ELSE 'N' END || CAST(seq AS VARCHAR), "
        f"CASE WHEN seq % 2 = 0 AND coalesce(location, '') <> '' THEN location ELSE 'Sydney, ' || CASE seq % 3 WHEN 0 THEN 'Australia' WHEN 1 THEN 'AU' ELSE 'Vietnam' END END AS loc, "
        f"posted_date_raw, sha256({squash('lower(title || chr(32) || chr(114) || chr(111) || chr(108) || chr(101))')}) FROM raw) "
        f"WHERE u IS NOT NULL AND (contains(lower(loc), 'australia') OR CAST(regexp_extract(u, 'job/([0-9]+)', 1) AS BIGINT) % 3 <> 2) "
        f"UNION ALL SELECT 'content', title, CASE WHEN seq % 3 = 0 THEN company_name ELSE 'Bega Group' END, 'https://sr.example.com/board/S' || CAST(seq AS VARCHAR), 'S' || CAST(seq AS VARCHAR), "
        f"CASE WHEN coalesce({_FIRST_WORD}, '') <> '' THEN {_FIRST_WORD} || ', ' ELSE '' END || CASE WHEN seq % 2 = 0 THEN 'NSW, ' ELSE '' END || 'au', posted_date_raw, NULL FROM raw WHERE {_OK}",
    ),
    "ingest_epoch_millis": with_(
        RAW,
        f"SELECT 'postings_array' AS feed, title, 'Bega Group' AS company_name, apply_url, 'L' || CAST(seq AS VARCHAR) AS source_job_id, CASE WHEN location <> '' THEN location END AS location, "
        f"strftime(make_timestamp((1750118400000 + seq * 7200000) * 1000), '%Y-%m-%d') AS posted_date_raw, {_BODY_HASH} AS body_hash FROM raw WHERE {_OK}",
    ),
    "ingest_xml_items": with_(
        RAW,
        f"SELECT 'rss' AS feed, title || ' - Sydney' AS title, 'Bega Group' AS company_name, apply_url, 'G' || CAST(seq AS VARCHAR) AS source_job_id, "
        f"CASE WHEN seq % 2 = 0 AND coalesce(location, '') <> '' THEN location ELSE 'Sydney' END AS location, 'Thu, 18 Jun 2026 00:00:00 GMT' AS posted_date_raw, "
        f"sha256({squash('lower(title)')}) AS body_hash FROM raw WHERE CAST(floor(seq / 20) AS BIGINT) % 10 <> 9",
    ),
    "ingest_detail_join": with_(
        RAW,
        f"SELECT 'https://wd.example.com/en-US/Careers/job/' || CAST(seq AS VARCHAR) AS apply_url, title, CASE WHEN seq % 3 <> 0 THEN {_BODY_HASH} END AS body_hash FROM raw WHERE {_OK}",
    ),
    "payload_router": with_(
        f"{RAW}, p AS (SELECT count(DISTINCT CAST(floor(seq / 20) AS BIGINT)) AS n FROM raw)",
        "SELECT k AS kind, n FROM p, (SELECT unnest(['list', 'board_jobs', 'postings_array', 'api_jobs', 'widgets', 'content', 'rss', 'embedded_json']) AS k) "
        "UNION ALL SELECT 'html', n + (SELECT count(*) FROM pages) FROM p",
    ),
    "ingest_all": with_(
        _LANDED,
        "SELECT CASE kind WHEN 'html' THEN 'site' WHEN 'cards' THEN 'seek' WHEN 'embedded_json' THEN 'seek' ELSE 'official_ats' END AS source, "
        "CASE WHEN kind <> 'html' THEN 'bega' END AS company_id, page_no, CAST(pos AS BIGINT) AS pos, title, url AS apply_url, location, 1 AS rows_of_seq FROM landed",
    ),
    "ingest_errors": with_(
        _LANDED,
        "SELECT CASE kind WHEN 'html' THEN 'site' ELSE 'official_ats' END AS source, CASE WHEN kind <> 'html' THEN 'bega' END AS company_id, page_no, kind, reason FROM errors",
    ),
    "body_states": with_(
        f"{_LANDED}, bodies AS (SELECT k AS kind, 1 AS every FROM (SELECT unnest(['list', 'board_jobs', 'postings_array', 'api_jobs', 'widgets', 'content', 'rss', 'embedded_json', 'html']) AS k) "
        "UNION ALL SELECT * FROM (VALUES ('list', 3), ('board_jobs', 2), ('postings_array', 4), ('list', 5), ('list', 6), ('empty', 7), ('unknown_json', 8)) t(k, n)), "
        "counted AS (SELECT kind, count(*) AS n FROM bodies, pn WHERE page_no % every = 0 GROUP BY kind), "
        "every AS (SELECT kind, n + CASE WHEN kind = 'html' THEN (SELECT count(*) FROM pages) ELSE 0 END AS n FROM counted), "
        "bad AS (SELECT kind, 'error' AS state, count(*) AS n FROM errors GROUP BY kind UNION ALL SELECT 'list', 'empty_list', count(*) FROM pn WHERE page_no % 6 = 0)",
        "SELECT kind, state, n FROM bad UNION ALL SELECT * FROM (SELECT e.kind, 'rows' AS state, CAST(e.n - coalesce((SELECT sum(n) FROM bad WHERE bad.kind = e.kind), 0) AS BIGINT) AS n FROM every e) WHERE n > 0",
    ),
    "loose_fields": with_(
        RAW,
        f"SELECT {_WD_URL} AS apply_url, '/job/' || CAST(seq AS VARCHAR) AS external_path, NULL AS slug, NULL AS job_id, NULL AS ref FROM raw WHERE {_OK} "
        f"UNION ALL SELECT {_API_URL}, NULL, 'slug-' || CAST(seq AS VARCHAR), NULL, NULL FROM raw "
        f"UNION ALL SELECT CASE WHEN seq % 2 = 0 THEN apply_url ELSE apply_url || '/view' END, NULL, NULL, CASE WHEN seq % 4 <> 0 THEN 'W' || CAST(seq AS VARCHAR) END, NULL FROM raw WHERE {_OK} "
        f"UNION ALL SELECT 'https://sr.example.com/board/S' || CAST(seq AS VARCHAR), NULL, NULL, NULL, 'r' FROM raw WHERE {_OK}",
    ),
    "source_union": with_(
        f"{RAW}, {COMPANIES}",
        "SELECT seq, source, title, company_id, CASE WHEN source = 'official_ats' THEN location END AS location, CASE WHEN source <> 'official_ats' THEN salary_raw END AS salary_raw "
        "FROM raw WHERE company_id IS NULL OR company_id IN (SELECT company_id FROM companies WHERE active)",
    ),
    "page_dedup": with_(RAW, "SELECT source, title, company_name, min(seq) AS seq, CAST(floor(min(seq) / 20) AS BIGINT) AS page_no FROM raw GROUP BY 1, 2, 3"),
    "title_tail_location": with_(
        RAW,
        "SELECT seq, CASE WHEN contains(title, ' - ') AND length(trim(list_extract(string_split(title, ' - '), -1))) BETWEEN 1 AND 40 "
        "THEN trim(list_extract(string_split(title, ' - '), -1)) ELSE '' END AS place FROM raw",
    ),
    "html_links": with_(
        _LINKS,
        "SELECT page_id, pos, title, apply_url FROM (SELECT *, row_number() OVER (PARTITION BY page_id, apply_url ORDER BY pos) AS rn FROM named "
        "WHERE href <> '' AND length(title) >= 3 AND NOT starts_with(href, '#')) WHERE rn = 1",
    ),
    "html_extract_pages": with_(_LINKS, "SELECT page_id, pos, title, href AS link FROM named WHERE title <> '' AND href <> ''"),
    "html_extract": with_(
        RAW,
        f"SELECT 'seek' AS source, title, {_HIDDEN} AS company_name, '{_SITE.format('seek')}/job/' || CAST(seq AS VARCHAR) AS apply_url, CAST(seq AS VARCHAR) AS source_job_id, "
        f"CASE WHEN location <> '' THEN location END AS location, title AS description, posted_date_raw, salary_raw FROM raw "
        f"UNION ALL SELECT 'jora', title, CASE WHEN seq % 9 = 0 THEN 'Private Advertiser' ELSE company_name END, '{_SITE.format('jora')}/job/Role-' || md5(CAST(seq AS VARCHAR)), md5(CAST(seq AS VARCHAR)), "
        f"CASE WHEN location <> '' THEN location END, title, posted_date_raw, NULL FROM raw "
        f"UNION ALL SELECT 'linkedin', title, CASE WHEN seq % 9 = 0 THEN 'Private Advertiser' ELSE company_name END, 'https://au.example.com/jobs/view/role-' || CAST(seq AS VARCHAR), CAST(seq AS VARCHAR), "
        f"CASE WHEN location <> '' THEN location END, NULL, '2026-06-18', NULL FROM raw",
    ),
    "html_embedded_json": with_(
        f"{RAW}, paged AS (SELECT *, CAST(floor(seq / 20) AS BIGINT) AS page_no FROM raw)",
        f"SELECT 'seek' AS source, title, CASE WHEN seq % 3 <> 0 THEN company_name WHEN seq % 9 = 0 THEN '' ELSE company_name END AS company_name, "
        f"'{_SITE.format('seek')}/job/' || CAST(seq AS VARCHAR) AS apply_url, CAST(seq AS VARCHAR) AS source_job_id, CASE WHEN location <> '' THEN location END AS location, "
        f"'}} \" {{ ' || title AS description, posted_date_raw, salary_raw FROM paged WHERE {_OK}".replace("\" {{ '", "\"{ '").replace("'}} \"", "'} \"").replace("'} \" { '", "'} \"{ '"),
    ),
    "url_job_id": (
        "SELECT page_id, CASE WHEN regexp_matches(url, '[?#]') THEN NULL ELSE CAST(page_id AS VARCHAR) END AS plain, CAST(page_id AS VARCHAR) AS seek, md5(CAST(page_id AS VARCHAR)) AS jora, "
        "CASE WHEN page_id % 2 = 0 THEN '9' ELSE '' END || CAST(page_id AS VARCHAR) AS linkedin FROM pages"
    ),
    "url_canonical": (
        "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS canonical, 'https://b.example' || regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*', '') AS resolved, "
        "CASE WHEN contains(url, '?page=2&ref=x') THEN replace(url, '?page=2&ref=x', '?ref=x&page=3') WHEN contains(url, '?') THEN url || '&page=3' "
        "WHEN contains(url, '#') THEN replace(url, '#', '?page=3#') ELSE url || '?page=3' END AS paged FROM pages"
    ),
    "stream_source_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS source, count(*) AS n FROM events GROUP BY 1, 2",
    "source_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS source, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_first": with_(
        "e AS MATERIALIZED (SELECT user_id, event_type, ts, epoch_us(ts) AS t, (day(ts) - 1) // 10 + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS wave FROM events), "
        "marks AS (SELECT w.wave, max(e.t) // 1000 - 3 * 86400000 AS mark FROM (SELECT unnest(range(6)) AS wave) w LEFT JOIN e ON e.wave < w.wave GROUP BY w.wave), "
        "seen AS MATERIALIZED (SELECT e.*, coalesce(e.t // 1000 <= m.mark, false) AS late FROM e JOIN marks m ON m.wave = e.wave), "
        "gaps AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t) AS gap FROM seen WHERE NOT late)",
        "SELECT user_id, event_type, ts, 'late' AS kind FROM seen WHERE late UNION ALL "
        "SELECT user_id, event_type, ts, 'first' AS kind FROM gaps WHERE (gap IS NULL OR gap > 86400000000) AND t // 1000 <= (SELECT mark FROM marks WHERE wave = 5)",
    ),
    "stream_ingest": with_(
        f"{NORM}, ids AS MATERIALIZED (SELECT *, {_ID} AS id FROM norm)",
        "SELECT id, max(seq) AS seq, arg_max(title, seq) AS title, 'new' AS status, true AS seen_now FROM ids GROUP BY id",
    ),
    "stream_run": with_(
        f"{SCORED}, {ER.replace(NORM + ',', '', 1)}, ids AS MATERIALIZED (SELECT seq, {_ID} AS id FROM norm), "
        "rows AS MATERIALIZED (SELECT i.seq, i.id, b.canonical FROM ids i JOIN best b ON b.seq = i.seq), "
        "linked AS (SELECT a.id, arg_max(c.id, a.seq) AS canonical, arg_max(c.seq, a.seq) AS best FROM rows a JOIN rows c ON c.seq = a.canonical GROUP BY a.id)",
        "SELECT l.id, CASE WHEN l.id = l.canonical THEN s.status ELSE 'duplicate' END AS status, CASE WHEN l.id <> l.canonical THEN l.canonical END AS duplicate_of, "
        "CASE WHEN l.id = l.canonical THEN s.priority_tier END AS priority_tier, CASE WHEN l.id = l.canonical THEN round(s.final_score, 6) END AS final_score "
        "FROM linked l JOIN scored s ON s.seq = l.best",
        recursive=True,
    ),
    "pipeline_run": with_(
        f"{SCORED}, {ER.replace(NORM + ',', '', 1)}",
        "SELECT s.seq, s.status, s.priority_tier, round(s.final_score, 6) AS final_score FROM scored s JOIN best b ON b.seq = s.seq WHERE b.seq = b.canonical",
        recursive=True,
    ),
    "seniority_top": with_(
        ENRICHED,
        f"SELECT seq, title, round({clamp(points('category', pack.SENIORITY_POINTS) + ' * 100 / 30', 0, 100)}, 6) AS seniority_score FROM cls WHERE seq IN "
        "(SELECT min(seq) FROM norm GROUP BY normalized_title, lower(trim(company_name)), coalesce(location, ''), coalesce(CAST(posted_date AS VARCHAR), ''), "
        "CASE WHEN coalesce(source_job_id, '') <> '' THEN source_job_id ELSE apply_url END) ORDER BY seniority_score DESC, seq LIMIT 20",
    ),
}
