"""HTML pages to raw postings: anchors, configured cards, embedded JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions import urls
from postlens.functions.text import blank_to_null, clean_text, decode_entities, title_tail_location
from postlens.packs import food_au as pack
from postlens.sources import html_tree
from postlens.sources.json_feeds import finished

# What marks a link as a posting, and the boards' card markup.
JOB_HREF_MARKERS = ["/job/", "jobdetail", "/jobs/"]
IGNORED_HREFS = ["#", "javascript:", "mailto:"]
MIN_TITLE_LEN = 3

CARD_FIELDS = ["title", "link", "company", "location", "salary", "date", "snippet", "urn"]
SEEK_CARDS = {
    "item": ['[data-automation="normalJob"]'],
    "title": ['[data-automation="jobTitle"]'],
    "link": ['[data-automation="jobTitle"]@href'],
    "company": ['[data-automation="jobCompany"]'],
    "location": ['[data-automation="jobLocation"]', '[data-automation="jobCardLocation"]'],
    "salary": ['[data-automation="jobSalary"]'],
    "date": ['[data-automation="jobListingDate"]'],
    "snippet": ['[data-automation="jobShortDescription"]'],
}
JORA_CARDS = {
    "item": ["div.job-card", "div.result"],
    "title": ["a.job-link"],
    "link": ["a.job-link@href"],
    "company": [".job-company", "span.company", ".company"],
    "location": [".job-location", ".location"],
    "salary": [".job-salary", ".salary"],
    "date": [".job-listed-date", ".date"],
    "snippet": [".job-abstract", ".summary"],
}
LINKEDIN_CARDS = {
    "item": ["div.base-card", "div.base-search-card"],
    "title": ["h3.base-search-card__title"],
    "link": ["a.base-card__full-link@href", "a.base-search-card--link@href"],
    "company": [
        "h4.base-search-card__subtitle a.hidden-nested-link", "h4.base-search-card__subtitle",
        "a.hidden-nested-link",
    ],
    "location": ["span.job-search-card__location", ".job-search-card__location"],
    "date": ["time@datetime", "time"],
    "urn": ["@data-entity-urn"],
}
BOARD_CARDS = {"seek": SEEK_CARDS, "jora": JORA_CARDS, "linkedin": LINKEDIN_CARDS}
REDUX_MARKER = r"window\.SEEK_REDUX_DATA\s*=\s*"


# The rest of a tag: quoted values may hold any sign.
_IN_TAG = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_ATTRIBUTE = r"""(?s)([^\s=>"'/]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _href(anchor: Column) -> Column:
    """The decoded value of the anchor's first href attribute, quoted or not; '' without one."""
    tag = F.regexp_extract(anchor, rf"(?is)^<a({_IN_TAG})>", 1)
    attributes = F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0))
    href = F.get(F.filter(attributes, lambda x: x.rlike(r"(?i)^href\s*=")), F.lit(0))
    value = F.regexp_replace(href, r"""(?is)^href\s*=\s*["']?|["']$""", "")
    return F.trim(decode_entities(F.coalesce(value, F.lit(""))))


def anchor_postings(pages: DataFrame, html: str, base: str, any_link: bool = False, outer: bool = False) -> DataFrame:
    """Posting links of a page, one row per (page, URL), first occurrence kept.

    ``any_link`` lifts the posting-path test for sites with their own link scheme. With
    ``outer`` a page's other links are one more row that is not ``usable``, as is a page
    without any.
    """
    # Tags other than anchors and raw-text blocks cannot contribute; one regex pass finds
    # every anchor, and the short matches are then taken apart.
    body = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    found_at = F.regexp_extract_all(body, F.lit(rf"(?is)<a(?=\s){_IN_TAG}>.*?</a\s*>"), F.lit(0))
    parts = F.transform(found_at, lambda a: F.struct(_href(a).alias("href"), F.regexp_extract(a, rf"(?is)^<a{_IN_TAG}>(.*)</a\s*>$", 1).alias("inner")))
    links = pages.select("*", F.posexplode_outer(parts).alias("pos", "a")).drop(html)
    href = F.lower("a.href")
    ignored = F.lit(False)
    for prefix in IGNORED_HREFS:
        ignored = ignored | href.startswith(prefix)
    marked = F.lit(any_link)
    for marker in JOB_HREF_MARKERS:
        marked = marked | href.contains(marker)
    linked = F.coalesce((href != "") & ~ignored & marked, F.lit(False))
    titled = (links if outer else links.where(linked)).withColumn("title", F.when(linked, clean_text(F.col("a.inner"))))
    good = F.coalesce(F.length("title") >= MIN_TITLE_LEN, F.lit(False))
    found = (titled if outer else titled.where(good)).withColumns(
        {"apply_url": F.when(good, urls.join(F.col(base), F.col("a.href"))), "usable": good}
    ).drop("a")
    # A page has a bounded number of links, and grouping by page and URL keeps groups tiny.
    keys = [c for c in found.columns if c not in ("pos", "title")]
    kept = found.groupBy(*keys).agg(F.min(F.struct("pos", "title")).alias("first"))
    rows = kept.select(*keys, "first.pos", "first.title").withColumn(
        "location", blank_to_null(title_tail_location(F.col("title")))
    )
    return rows if outer else rows.drop("usable")


# Pages whose cards are held at a time: what a task holds does not grow with its input.
PAGES_HELD = 100


def card_frames(
    batch: pd.DataFrame, html: str, config: dict[str, list[str]], keep: list[str], outer: bool = False
) -> Iterator[pd.DataFrame]:
    """The rows of :func:`cards` for a batch, a frame for every ``PAGES_HELD`` pages."""
    for first in range(0, len(batch), PAGES_HELD):
        part, out = batch.iloc[first : first + PAGES_HELD], []
        for page, *key in zip(part[html], *[part[c] for c in keep]):
            found = [(pos, row) for pos, row in enumerate(html_tree.extract(page or "", config)) if row.get("title") and row.get("link")]
            out += [[*key, pos, *[row.get(f) for f in CARD_FIELDS]] for pos, row in found or ([(None, {})] if outer else [])]
        yield pd.DataFrame(out, columns=[*keep, "pos", *CARD_FIELDS]).astype({"pos": "Int32"})


def cards(pages: DataFrame, html: str, config: dict[str, list[str]], keep: list[str], outer: bool = False) -> DataFrame:
    """One row per item with the configured fields; items without title or link are skipped.

    Pages are parsed in Arrow batches next to their partition; the config travels with the
    task. With ``outer`` a page without any such item is a row of its own, without ``pos``.
    """
    kept_schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kept_schema}, pos int, " + ", ".join(f"{f} string" for f in CARD_FIELDS)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from card_frames(batch, html, config, keep, outer)

    return pages.select(*keep, html).mapInPandas(parse, schema)


def advertiser(name: Column) -> Column:
    """Hidden advertisers read as no company at all."""
    company = clean_text(name)
    return F.when(F.lower(company).isin(pack.HIDDEN_ADVERTISERS), F.lit("")).otherwise(company)


def _site(base: str | Column) -> Column:
    return F.lit(base) if isinstance(base, str) else base


def board_postings(found: DataFrame, source: str, base: str | Column, outer: bool = False) -> DataFrame:
    """Card rows of a board to raw postings: canonical link, id from link, hidden names.

    With ``outer`` cards without a title or link stay, told by ``usable``.
    """
    link, site = F.col("link"), _site(base)
    job_id = urls.job_id(urls.canonical(link, site), source, F.col("urn"))
    url = urls.canonical(link, site)
    if source == "seek":
        url = F.when(job_id.isNotNull(), F.concat(site, F.lit("/job/"), job_id)).otherwise(url)
    rows = found.select(
        *[c for c in found.columns if c not in CARD_FIELDS],
        F.lit(source).alias("source"),
        clean_text(F.col("title")).alias("title"),
        (advertiser(F.col("company")) if source == "seek" else clean_text(F.col("company"))).alias("company_name"),
        url.alias("apply_url"),
        job_id.alias("source_job_id"),
        F.col("location"),
        blank_to_null(clean_text(F.col("snippet"))).alias("description"),
        F.col("date").alias("posted_date_raw"),
        F.col("salary").alias("salary_raw"),
    )
    return finished(rows, (F.col("title") != "") & (F.col("apply_url") != ""), outer)


@F.pandas_udf(T.StringType())
def _object_at(text: pd.Series, start: pd.Series) -> pd.Series:
    return pd.Series(
        [html_tree.balanced_object(t, s - 1) if t is not None and s > 0 else None for t, s in zip(text, start)]
    )


_RECORD = (
    "struct<id:string, title:string, companyName:string, advertiser:struct<description:string>, "
    "locations:array<struct<label:string>>, salaryLabel:string, listingDateDisplay:string, teaser:string>"
)


def embedded_json(pages: DataFrame, html: str, base: str | Column, outer: bool = False) -> DataFrame:
    """Postings of the state object a results page assigns to a script variable.

    With ``outer`` every page gives a row, and records that are no posting stay, told by ``usable``.
    """
    marker = F.regexp_extract(F.col(html), f"(?s){REDUX_MARKER}", 0)
    start = F.when(marker != "", F.position(marker, F.col(html)) + F.length(marker)).otherwise(F.lit(0))
    blob = pages.withColumn("_blob", _object_at(F.col(html), start)).drop(html)
    jobs = F.coalesce(
        F.get_json_object("_blob", "$.results.results.jobs"), F.get_json_object("_blob", "$.results.jobs")
    )
    records = F.when(F.substring(jobs, 1, 1) == "[", F.from_json(jobs, f"array<{_RECORD}>")).otherwise(
        F.map_values(F.from_json(jobs, f"map<string,{_RECORD}>"))
    )
    rows = blob.select(*[c for c in blob.columns if c != "_blob"], F.posexplode_outer(records).alias("pos", "r"))
    labels = F.filter(F.transform("r.locations", lambda p: clean_text(p["label"])), lambda t: t != "")
    text = {k: blank_to_null(clean_text(F.col(f"r.{k}"))) for k in ("salaryLabel", "listingDateDisplay", "teaser")}
    named = rows.select(
        *[c for c in rows.columns if c != "r"],
        F.lit("seek").alias("source"),
        clean_text(F.col("r.title")).alias("title"),
        advertiser(F.coalesce(blank_to_null(F.col("r.companyName")), F.col("r.advertiser.description"))).alias("company_name"),
        F.concat(_site(base), F.lit("/job/"), blank_to_null(F.col("r.id"))).alias("apply_url"),
        blank_to_null(F.col("r.id")).alias("source_job_id"),
        F.get(labels, F.lit(0)).alias("location"),
        text["teaser"].alias("description"),
        text["listingDateDisplay"].alias("posted_date_raw"),
        text["salaryLabel"].alias("salary_raw"),
    )
    return finished(named, (F.col("title") != "") & F.col("apply_url").isNotNull(), outer)
