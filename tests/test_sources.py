"""Feed parsers on malformed and partial bodies, and the selector helper."""

from __future__ import annotations

from datetime import date

import pandas as pd
from pyspark.sql import functions as F

from postlens.operators import resolve
from postlens.operators.normalize import normalize
from postlens.schema import PAYLOAD, RAW_POSTING, conform
from postlens.sources import html, html_tree, json_feeds, landing, xml_feeds


def landed(spark, *bodies):
    rows = [("official_ats", "bega", "Bega Group", "https://h", "Site", i, b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, PAYLOAD)


def test_malformed_bodies_give_no_rows(spark):
    bad = landed(spark, "{broken", "", "[]", '{"jobs": 3}', "null")
    for parser in (json_feeds.workday, json_feeds.phenom_jobs, json_feeds.phenom_widgets, json_feeds.smartrecruiters, json_feeds.greenhouse, json_feeds.lever):
        assert parser(bad).count() == 0
    assert xml_feeds.rss(landed(spark, "<rss><channel><item>", "no xml")).count() == 0


def test_every_body_gives_rows_or_an_error(spark):
    seek = '<article data-automation="normalJob"><a data-automation="jobTitle" href="/job/7?x=1">Quality Lead</a></article>'
    state = '<script>window.SEEK_REDUX_DATA = {"results": {"jobs": [{"id": "9", "title": "QA"}]}};</script>'
    rss = "<!-- " + "long comment " * 100 + "--><rss><channel><item><title>QM - Perth</title><link>https://r/1</link></item></channel></rss>"
    bodies = [
        ("a", '{"jobPostings": [{"title": "QM", "externalPath": "/job/1"}]}'), ("a", "[broken"), ("a", "<rss><channel><item>"),
        ("a", '<html><a href="/job/3">Quality Manager</a></html>'), ("seek", f"<html>{seek}</html>"), ("seek", state), ("a", ""),
        ("a", '{"x": 1}'), (None, rss), ("a", "<html>nothing</html>"), ("a", '{"jobPostings": []}'), ("jora", "<div>" * 5000),
    ]
    rows = [(s, "bega", "Bega", "https://h", "Site", i, b) for i, (s, b) in enumerate(bodies)]
    df = spark.createDataFrame(rows, PAYLOAD)
    parsed = landing.parse_all(df).collect()
    assert sorted((r.page_no, r.title, r.apply_url) for r in parsed) == [
        (0, "QM", "https://h/en-US/Site/job/1"), (3, "Quality Manager", "https://h/job/3"), (4, "Quality Lead", "https://h/job/7"),
        (5, "QA", "https://h/job/9"), (8, "QM - Perth", "https://r/1"),
    ]
    assert len({r.seq for r in parsed}) == 5
    again = {(r.page_no, r.seq) for r in landing.parse_all(df.repartition(3)).collect()}
    assert again == {(r.page_no, r.seq) for r in parsed}
    errors = {r.page_no: r.reason for r in landing.ingest_errors(df).collect()}
    assert errors == {1: "malformed", 2: "no_rows", 6: "empty", 7: "unknown_shape", 9: "no_rows", 11: "no_rows"}


def test_rows_without_a_company_pass(spark):
    rows = spark.createDataFrame([(1, "on"), (2, "off"), (3, None), (4, "unknown")], "seq long, company_id string")
    companies = spark.createDataFrame([("on", True), ("off", False)], "company_id string, active boolean")
    assert sorted(r.seq for r in landing.active_only(rows, companies).collect()) == [1, 3]


def test_details_stay_with_their_company(spark):
    rows = spark.createDataFrame([("s", "a", "/1", None), ("s", "b", "/1", None), (None, "a", "/2", None)], "source string, company_id string, path string, description string")
    body = lambda t: '{"jobPostingInfo": {"jobDescription": "%s"}}' % t
    details = spark.createDataFrame(
        [("s", "a", "/1", "2026-01-01", body("old")), ("s", "a", "/1", "2026-01-02", body("new")), (None, "a", "/2", "2026-01-01", body("c"))],
        "source string, company_id string, detail_key string, landed_at string, payload string",
    ).withColumn("landed_at", F.to_timestamp("landed_at"))
    got = json_feeds.with_details(rows, F.col("path"), json_feeds.workday_detail(details)).collect()
    assert {(r.company_id, r.path): r.description for r in got} == {("a", "/1"): "new", ("b", "/1"): None, ("a", "/2"): "c"}
    smart = spark.createDataFrame(
        [("s", "a", "/1", '{"jobAd": {"sections": {"jobDescription": {"text": "<p>A</p>"}, "qualifications": {"text": "B"}}}}')],
        "source string, company_id string, detail_key string, payload string",
    )
    got = json_feeds.with_details(rows, F.col("path"), json_feeds.smartrecruiters_detail(smart)).collect()
    assert {r.company_id: r.description for r in got if r.path == "/1"} == {"a": "A B", "b": None}


def test_anchor_attributes_and_dot_segments(spark):
    page = (
        """<a title="a>b" href="/job/1?a=1&amp;b=2">Quality One</a><a class=x href=/job/2>Quality Two</a>"""
        """<A HREF='../job/3'>Quality Three</A><a data-href="/job/9" href="./job/4/../5#x">Quality Five</a>"""
    )
    df = spark.createDataFrame([(1, "https://h/a/b/list", page)], "id long, url string, html string")
    got = [r.apply_url for r in html.anchor_postings(df, "html", "url").orderBy("pos").collect()]
    assert got == ["https://h/job/1?a=1&b=2", "https://h/job/2", "https://h/a/job/3", "https://h/a/b/job/5#x"]


def test_deep_pages_do_not_fail():
    tree = html_tree.parse("<div>" * 5000 + "<p class=x>deep")
    assert [n.text() for n in html_tree.select(tree, ".x")] == ["deep"] and tree.text() == "deep"


def test_list_feed(spark):
    body = '{"jobPostings": [{"title": "QM", "externalPath": "/job/1", "bulletFields": ["R1"]}, {"title": "x"}, {"externalPath": "/job/2"}]}'
    rows = json_feeds.workday(landed(spark, body)).orderBy("pos").collect()
    assert [(r.apply_url, r.source_job_id, r.title) for r in rows] == [
        ("https://h/en-US/Site/job/1", "R1", "QM"), ("https://h/en-US/Site/job/2", "/job/2", ""),
    ]


def test_epoch_and_escaped_content(spark):
    lever = '[{"id": "a", "text": "QM", "hostedUrl": "https://l/a", "createdAt": 1750118400000}, {"id": "b"}]'
    assert [r.posted_date_raw for r in json_feeds.lever(landed(spark, lever)).collect()] == ["2025-06-17"]
    board = '{"jobs": [{"id": 7, "absolute_url": "https://g/7", "content": "&lt;p&gt;A &amp;amp; B&lt;/p&gt;"}]}'
    row = json_feeds.greenhouse(landed(spark, board)).first()
    assert (row.source_job_id, row.description) == ("7", "A & B")


def test_rss_location_prefix_and_title_tail(spark):
    body = (
        '<rss xmlns:g="http://base.google.com/ns/1.0"><channel><item><title>QM - Perth</title><link>https://r/1</link>'
        "<g:location>Sydney</g:location></item><item><title>QA - Perth</title><link>https://r/2</link></item></channel></rss>"
    )
    assert [r.location for r in xml_feeds.rss(landed(spark, body)).orderBy("pos").collect()] == ["Sydney", "Perth"]


def test_anchors(spark):
    page = '<a href="/job/1">Quality Manager</a><a href="/job/1">Again</a><a href="#/job/">x y z</a><a href="/about">About us</a><a href="/jobs/2">QA</a>'
    df = spark.createDataFrame([(1, "https://h/careers", page)], "id long, url string, html string")
    assert [(r.title, r.apply_url) for r in html.anchor_postings(df, "html", "url").collect()] == [("Quality Manager", "https://h/job/1")]


def test_selectors():
    tree = html_tree.parse('<ul><li class="a b" id=x><p>one<p>two<br></li><li data-k="v"><a href="/l"> go </a></ul>')
    assert [n.text() for n in html_tree.select(tree, "li p")] == ["one", "two"]
    assert len(html_tree.select(tree, "li.a.b#x")) == 1 and len(html_tree.select(tree, '[data-k="v"] a')) == 1
    assert html_tree.value_of(tree, "a@href") == "/l" and html_tree.value_of(tree, "a") == "go" and html_tree.value_of(tree, "li:hover") is None
    assert html_tree.balanced_object('x = {"a": "}\\"{", "b": {}} ;', 4) == '{"a": "}\\"{", "b": {}}'
    assert html_tree.balanced_object("x = [1]", 4) is None


def test_keep_first_is_by_order(spark):
    df = spark.createDataFrame([("s", "u", 2, 0), ("s", "u", 1, 5), ("s", "v", 3, 1)], "source string, u string, page_no long, pos long")
    got = landing.keep_first(df, ["source", "u"], ["page_no", "pos"])
    assert sorted(map(tuple, got.collect())) == [("s", "u", 1, 5), ("s", "v", 3, 1)]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_bodies_of_one_page_number_are_told_apart(spark):
    """Two search terms, a body landed twice, and a broken one beside them: nothing multiplies or vanishes."""
    one = '{"jobPostings": [{"title": "Quality Manager", "externalPath": "/job/1"}]}'
    two = '{"jobPostings": [{"title": "Site Quality Lead", "externalPath": "/job/2"}]}'
    rows = [("official_ats", "bega", "Bega", "https://h", "S", 1, b) for b in (one, two, one, "{broken")] + [("official_ats", None, None, None, None, None, one)]
    df = spark.createDataFrame(rows, PAYLOAD)
    parsed = landing.parse_all(df).collect()
    assert len(parsed) == 3 and len({r.seq for r in parsed}) == 3  # without a base there is no link
    again = landing.parse_all(df.repartition(3), hot_rows=1)
    assert {(r.apply_url, r.seq) for r in again.collect()} == {(r.apply_url, r.seq) for r in parsed}
    done = resolve.deduplicate(normalize(landing.parse_all(df), date(2026, 6, 21))).collect()
    assert sorted(r.status for r in done) == ["duplicate", "new", "new"]
    states = landing.states_of(landing.account(df)).collect()
    assert sorted((r.state, r.reason or "") for r in states) == [("error", "malformed"), ("error", "no_rows"), ("rows", ""), ("rows", ""), ("rows", "")]


def test_bodies_with_entries_but_no_posting_are_errors(spark):
    bodies = [
        '{"jobPostings": [{"title": "x"}]}', '{"content": [{"name": "x"}]}', '[{"text": "x"}]', '{"jobs": [{"title": "x"}]}', "[1, 2]", "[]",
        '{"refineSearch": {"data": {"jobs": []}}}', '{"content": 3}', '<?xml version="1.0"?><!DOCTYPE html><html><a href="/job/1">Quality Lead</a></html>',
        '<?xml version="1.0"?><rss><channel></channel></rss>',
    ]
    states = {r.page_no: (r.kind, r.state, r.reason, r.entries) for r in landing.states_of(landing.account(landed(spark, *bodies))).collect()}
    assert states == {
        0: ("list", "error", "no_rows", 1), 1: ("content", "error", "no_rows", 1), 2: ("postings_array", "error", "no_rows", 1),
        3: ("api_jobs", "error", "no_rows", 1), 4: ("postings_array", "error", states[4][2], states[4][3]), 5: ("postings_array", "empty_list", None, 0),
        6: ("widgets", "empty_list", None, 0), 7: ("content", "error", "no_rows", 0), 8: ("html", "rows", None, 1), 9: ("rss", "error", "no_rows", 0),
    }


def test_rows_that_share_a_number_do_not_multiply(spark):
    rows = [(7, "Quality Manager", f"https://h/{i}") for i in range(3)] + [(8, "Quality Lead", "https://h/9")]
    raw = spark.createDataFrame([(s, "seek", t, "Bega", u) for s, t, u in rows], "seq long, source string, title string, company_name string, apply_url string")
    raw = conform(raw, RAW_POSTING)
    done = resolve.deduplicate(normalize(raw, date(2026, 6, 21)), hot_rows=1).collect()
    assert sorted(r.apply_url for r in done) == sorted(u for _, _, u in rows) and len({r.seq for r in done}) == 4
    assert sorted(r.status for r in done) == ["duplicate", "duplicate", "new", "new"]


def test_landed_bodies_are_read_once(spark):
    """Shape, hash and copies are told from one reading, however many bodies repeat."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(payload):
        seen.add(1)
        return payload

    bodies = ['{"jobPostings":[]}', '{"jobPostings":[]}', "", '{"x":1}', '{"content":null,"jobs":[{"absolute_url":"u"}]}', "<html></html>"]
    payloads = landed(spark, *bodies).withColumn("payload", counted.asNondeterministic()("payload"))
    states = landing.states_of(landing.account(payloads))
    assert sorted(r.kind for r in states.select("kind").collect()) == ["board_jobs", "empty", "html", "list", "list", "unknown_json"]
    assert seen.value == len(bodies)


def test_shapes_told_without_parsing_are_those_parsing_tells(spark):
    """Names in other places, escaped or quoted otherwise, and keys without value do not mislead."""
    kinds = {
        '{"\\u006aobs":[1]}': "api_jobs", "{'jobPostings':[]}": "list", '{"refineSearch":null,"content":[]}': "content",
        '{"x":{"jobPostings":[]}}': "unknown_json", '{"x":"\\"content\\":1"}': "unknown_json", '{"jobs":[{"absolute_url":null}]}': "api_jobs",
        '{"jobPostings":[': "unknown_json",
    }
    df = spark.createDataFrame(list(enumerate(kinds)), "i int, payload string")
    told = df.select("i", json_feeds.payload_kind(F.col("payload")).alias("kind")).orderBy("i").collect()
    assert [r.kind for r in told] == list(kinds.values())


def test_cards_are_held_for_few_pages_at_a_time():
    """A batch of many pages comes out in frames of few, so memory does not grow with the batch."""
    page = '<article data-automation="normalJob"><a data-automation="jobTitle" href="/job/1">Lead</a></article>'
    batch = pd.DataFrame({"page_no": range(250), "payload": [page] * 250})
    frames = list(html.card_frames(batch, "payload", html.SEEK_CARDS, ["page_no"]))
    assert [len(f) for f in frames] == [100, 100, 50]
    assert sorted(n for f in frames for n in f["page_no"]) == list(range(250))
