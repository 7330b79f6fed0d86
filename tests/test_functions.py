"""Expected values of the scalar functions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from postlens.functions import dates, display, rules, salary, text, urls, vectors

TODAY = date(2026, 6, 21)


def values(spark, inputs, expr):
    df = spark.createDataFrame(list(enumerate(inputs)), "i int, v string")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def check(spark, expr, table):
    assert values(spark, list(table), expr) == list(table.values())


def test_normalize_title(spark):
    check(spark, text.normalize_title, {
        "Health & Safety Lead": "health and safety lead",
        "Quality Manager, Senior": "quality manager senior",
        "QA/QC Lead": "qa qc lead",
        "Quality Manager (12 month contract) (m/f/d)": "quality manager",
        "  Quality    Manager  [Remote] ": "quality manager",
        "Manager (APAC) Quality": "manager apac quality",
        "Qualité Manager": "qualité manager",
        "": "",
    })


def test_company_title_city(spark):
    check(spark, text.normalize_company, {
        "PepsiCo Australia": "pepsico", "The Arnott's Group": "arnotts", "Ltd Pty The": "", "A & B Pty Ltd": "a and b",
    })
    check(spark, text.title_core, {
        "quality manager full time permanent": "quality manager", "night shift warehouse operator 2": "warehouse operator",
    })
    check(spark, text.city_key, {"Chatswood, Australia": "chatswood", "Sydney NSW": "sydney nsw", None: ""})


def test_hash_ignores_case_and_space(spark):
    a, b, c, none, empty = values(
        spark, ["Lead the team.", " lead \n the  TEAM. ", "other", None, ""], text.description_hash
    )
    assert a == b != c and none == empty and len(a) == 64


def test_clean_text(spark):
    check(spark, text.clean_text, {
        "<p>Lead   the <b>site</b> team.</p>\n<p>HACCP &amp; GMP</p>": "Lead the site team. HACCP & GMP",
        "Food &amp; Beverage": "Food & Beverage",
        None: "",
        "a&nbsp;b &#8364; &#x1F600; &amp;lt; &bogus; x&y": "a b € 😀 &lt; &bogus; x&y",
        "<head><title>t</title></head><body>x<!-- a > b -->y<script>var t='</p>';</script> 1 < 2</body>": "x y 1 < 2",
    })


def test_salary(spark):
    cases = {
        "$140,000 - $160,000 + super": (140000, 160000, "AUD", "year", True),
        "$140k - $160k": (140000, 160000, "AUD", "year", True),
        "120000-140000 p.a.": (120000, 140000, "AUD", "year", True),
        "$55/hr": (55, 55, "AUD", "hour", True),
        "$700/day": (700, 700, "AUD", "day", True),
        "130000": (130000, 130000, "AUD", "year", True),
        "$95.5k": (95500, 95500, "AUD", "year", True),
        "12 months, 160000 then 140000": (140000, 160000, "AUD", "year", True),
        "Competitive": (None, None, None, None, False),
        "": (None, None, None, None, False),
        None: (None, None, None, None, False),
    }
    got = values(spark, list(cases), salary.parse_salary)
    assert [tuple(r) for r in got] == list(cases.values())
    yearly = values(spark, ["$50/hr"], lambda c: salary.parse_salary(c, annualize=True))[0]
    assert yearly.min == 98800


def test_posted_date(spark):
    cases = {
        "2026-06-18": date(2026, 6, 18), "2026-06-05": date(2026, 6, 5), "18 Jun 2026": date(2026, 6, 18),
        "18/06/2026": date(2026, 6, 18), "3 days ago": date(2026, 6, 18), "Posted 2 days ago": date(2026, 6, 19),
        "30+ days ago": date(2026, 5, 22), "today": TODAY, "yesterday": date(2026, 6, 20), "1 week ago": date(2026, 6, 14),
        "5 hours ago": TODAY, "2 months ago": date(2026, 4, 22), "Thu, 18 Jun 2026 00:00:00 GMT": date(2026, 6, 18),
        "2026-06-18T10:00:00+10:00": date(2026, 6, 18), "Jun 2026": None, "31/02/2026": None, "": None,
        "garbage that is not a date": None, None: None,
    }
    assert values(spark, list(cases), lambda c: dates.parse_posted_date(c, TODAY)) == list(cases.values())
    assert values(spark, ["2026-06-05", "2026-06-18"], lambda c: dates.parse_posted_date(c, TODAY, True)) == [
        date(2026, 5, 6), date(2026, 6, 18),
    ]


def test_title_tail_and_urls(spark):
    check(spark, text.title_tail_location, {"Role - Sydney": "Sydney", "Role": "", "A - " + "x" * 41: ""})
    check(spark, lambda c: urls.canonical(c, F.lit("https://h/")), {
        "/job/1?x=2#y": "https://h/job/1", "job/1": "https://h/job/1", "https://o/p?q": "https://o/p", "": "",
    })
    check(spark, lambda c: urls.set_query_param(c, "page", F.lit(3)), {
        "https://h/a?page=1&b=2#t": "https://h/a?b=2&page=3#t", "https://h/a": "https://h/a?page=3",
    })
    check(spark, lambda c: urls.job_id(c, "linkedin"), {"https://h/jobs/view/a-b-123?x": "123", "https://h/": None})
    check(spark, lambda c: urls.join(F.lit("https://h/a/b?x=1"), c), {
        "/z": "https://h/z", "z": "https://h/a/z", "//o/z": "https://o/z", "?y=2": "https://h/a/b?y=2", "http://o/": "http://o/",
    })


def test_display(spark):
    bar = values(spark, ["Bega Group", "Hays Recruitment"], lambda c: display.star_bar(c, F.lit(4)))
    assert bar == ["★★★★☆ (4/5)", ""]
    row = spark.sql("select 140000L lo, 160000L hi, 'AUD' cur, 'year' per, cast(null as string) raw")
    cols = [F.col(c) for c in ("lo", "hi", "cur", "per", "raw")]
    assert row.select(display.format_salary(*cols)).first()[0] == "AUD 140,000 - AUD 160,000 / year"


def test_cosine(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [-3.0, 0.0]), (4, [0.0, 0.0]), (5, None)]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    want = {1: 1.0, 2: 0.0, 3: -1.0, 4: 0.0, 5: None}
    assert {r.id: r.similarity for r in vectors.with_cosine(df, "v", [2.0, 0.0]).collect()} == want
    profile = F.array(F.lit(2.0), F.lit(0.0))
    assert {r.id: r.s for r in df.select("id", vectors.cosine(F.col("v"), profile).alias("s")).collect()} == want


def test_required_literal_is_necessary():
    import re

    from postlens.packs import food_au as pack

    for patterns in [*pack.SIGNALS.values(), pack.OUT_OF_DOMAIN, pack.TIER1_FOOD_GROUP, pack.RECRUITER_NAMES]:
        for part in [a for p in patterns for a in rules.split_alternatives(p)]:
            assert re.compile(part)
            literal = rules.required_literal(part)
            assert literal == "" or literal in part
    assert rules.required_literal(r"fssc\s?22000") == "22000"
    assert rules.required_literal(r"manage[s]? (?:a|the)? ?(?:quality|qa) team") == "manage"
    assert rules.required_literal(r"\baudits?\b") == "audit"


def test_required_literal_is_in_every_match(spark):
    cases = [
        (r"\d{4}", "", "grade 1999"), (r"\p{L}+", "", "abc"), ("ab{0,2}c", "a", "ac"), (r"\x41bc", "", "Abc"), ("[(|]ab|c", "", "c"),
        (r"a\.b", "a.b", "a.b"), ("(?i)abc", "", "ABC"), ("colou?r", "colo", "color"), ("[^]]x", "x", "ax"), ("[a[b]c]d", "d", "bd"),
        (r"\Qa|b\E", "", "a|b"), ("x(?:y|z)end", "end", "xyend"), (r"\bqa\b lead", " lead", "qa lead"), ("a*b+c", "c", "bc"),
    ]
    for pattern, literal, sample in cases:
        assert rules.required_literal(pattern) == literal, pattern
        df = spark.createDataFrame([(sample,)], "t string")
        assert df.where(rules.matches_sql("t", pattern)).count() == 1, pattern
    assert rules.split_alternatives("[(|]ab|c") == ["[(|]ab", "c"] and rules.split_alternatives("(a|b)|c") == ["(a|b)", "c"]


def test_vectors_of_another_length_have_no_cosine(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, [0.0, 2.0])], "id long, v array<double>")
    got = {r.id: r.s for r in vectors.with_cosine(df, "v", [1.0, 0.0], "s").collect()}
    assert got == {1: 1.0, 2: None, 3: None, 4: None, 5: 0.0}
    built_in = df.select("id", vectors.cosine(F.col("v"), F.array(F.lit(1.0), F.lit(0.0))).alias("s"))
    assert {r.id: r.s for r in built_in.collect()} == got


def test_texts_without_entities_are_not_taken_apart(spark):
    check(spark, text.clean_text, {"a <b>b</b>  c": "a b c", "x &amp;lt; &nope; &": "x &lt; &nope; &", "<i>&eacute;</i>&#65;": "é A"})
    plan = spark.range(1).select(text.clean_text(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert ", &) THEN" in plan
