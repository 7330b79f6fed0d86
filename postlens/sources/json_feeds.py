"""JSON feeds: landed response bodies to raw postings, one parser per shape.

Every parser maps ``PAYLOAD`` rows to raw-posting columns plus ``page_no`` and ``pos``.
Schemas are explicit; a malformed body parses to NULL and contributes no rows. With ``outer``
every body gives at least one row: entries that are no posting stay and are told by
``usable``, and a body without entries is one such row with its ``fault`` (NULL for a list
that is empty). Fields that only one feed has are in ``extra``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.dates import epoch_millis_date
from postlens.functions.text import blank_to_null, clean_text, decode_entities

_KEYS = ["source", "company_id", "company_name", "base_url", "site", "page_no"]
BODY = "body"  # number of the landed body, where the input has one


def _text(path: str) -> Column:
    return blank_to_null(F.trim(F.col(path)))


def _join(*paths: str) -> Column:
    return blank_to_null(F.concat_ws(", ", *[_text(p) for p in paths]))


def carried(payloads: DataFrame, *names: str) -> list[str]:
    """The named columns, and the body's number where there is one."""
    return [*names, *([BODY] if BODY in payloads.columns else [])]


def _records(payloads: DataFrame, schema: str, array: str | None = None) -> DataFrame:
    items = F.from_json("payload", schema)
    for part in (array or "").split("."):
        items = items[part] if part else items
    keys = carried(payloads, *_KEYS)
    # The fault is told before the entries are, or every entry would carry the whole body.
    listed = payloads.select(*keys, "payload", items.alias("items"))
    unread = F.when(F.try_parse_json("payload").isNull(), F.lit("malformed")).otherwise(F.lit("no_rows"))
    told = listed.select(*keys, F.when(F.col("items").isNull(), unread).alias("fault"), "items")
    return told.select(*keys, "fault", F.posexplode_outer("items").alias("pos", "r"))


def finished(rows: DataFrame, usable: Column, outer: bool) -> DataFrame:
    """All rows with ``usable`` and ``fault``, or the usable ones alone."""
    told = F.coalesce(usable, F.lit(False))
    return rows.withColumn("usable", told) if outer else rows.where(told).drop("fault")


def _extra(**fields: Column) -> Column:
    pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in fields]), F.array(*[v.cast("string") for v in fields.values()]))
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def _rows(records: DataFrame, outer: bool, asked: Column | None = None, **fields: Column) -> DataFrame:
    """Raw postings of the entries; ``asked`` further limits the usable ones."""
    columns = {
        "title": F.lit(""), "company_name": F.coalesce("company_name", F.lit("")), "apply_url": F.lit(None),
        "source_job_id": F.lit(None), "location": F.lit(None), "description": F.lit(None),
        "posted_date_raw": F.lit(None), "salary_raw": F.lit(None),
    } | fields
    extra = columns.pop("extra", F.lit(None).cast("map<string,string>"))
    named = records.select(
        *carried(records, "source", "company_id", "page_no", "pos", "fault"),
        *[c.cast("string").alias(n) for n, c in columns.items()], extra.alias("extra"),
        (F.lit(True) if asked is None else asked).alias("asked"),
    )
    return finished(named, (F.coalesce("apply_url", F.lit("")) != "") & F.col("asked"), outer).drop("asked")


# The feeds' response shapes.
WORKDAY_LIST = (
    "jobPostings array<struct<title:string, externalPath:string, locationsText:string, postedOn:string, "
    "bulletFields:array<string>>>"
)
PHENOM_JOBS = (
    "jobs array<struct<data:struct<slug:string, req_id:string, title:string, city:string, state:string, "
    "country:string, full_location:string, posted_date:string, apply_url:string>>>"
)
PHENOM_WIDGETS = (
    "refineSearch struct<data:struct<jobs:array<struct<title:string, cityState:string, city:string, state:string, "
    "country:string, cityStateCountry:string, jobId:string, jobSeqNo:string, applyUrl:string, jobUrl:string, "
    "reqId:string, descriptionTeaser:string, postedDate:string>>>>"
)
SMARTRECRUITERS_LIST = (
    "content array<struct<id:string, name:string, ref:string, releasedDate:string, "
    "location:struct<city:string, region:string, country:string>, company:struct<name:string>>>"
)
GREENHOUSE = (
    "jobs array<struct<id:string, title:string, absolute_url:string, location:struct<name:string>, "
    "updated_at:string, content:string>>"
)
LEVER = (
    "array<struct<id:string, text:string, hostedUrl:string, categories:struct<location:string>, "
    "createdAt:bigint, descriptionPlain:string>>"
)


def workday(payloads: DataFrame, outer: bool = False) -> DataFrame:
    path = blank_to_null(F.col("r.externalPath"))
    return _rows(
        _records(payloads, WORKDAY_LIST, "jobPostings"),
        outer,
        title=F.coalesce("r.title", F.lit("")),
        apply_url=F.concat(F.regexp_replace("base_url", "/+$", ""), F.lit("/en-US/"), F.col("site"), path),
        source_job_id=F.coalesce(F.get("r.bulletFields", F.lit(0)), path),
        location=F.col("r.locationsText"),
        posted_date_raw=F.col("r.postedOn"),
        extra=_extra(external_path=path),
    )


def phenom_jobs(payloads: DataFrame, outer: bool = False) -> DataFrame:
    slug = _text("r.data.slug")
    return _rows(
        _records(payloads, PHENOM_JOBS, "jobs"),
        outer,
        title=F.coalesce("r.data.title", F.lit("")),
        apply_url=F.coalesce(
            _text("r.data.apply_url"), F.concat(F.regexp_replace("base_url", "/+$", ""), F.lit("/job/"), slug)
        ),
        source_job_id=F.coalesce(_text("r.data.req_id"), slug),
        location=F.coalesce(_text("r.data.full_location"), _join("r.data.city", "r.data.state", "r.data.country")),
        posted_date_raw=_text("r.data.posted_date"),
        extra=_extra(slug=slug),
    )


def phenom_widgets(payloads: DataFrame, country_words: tuple[str, str] | None = None, outer: bool = False) -> DataFrame:
    """``country_words`` (name, code) keeps only rows placed in that country."""
    location = F.coalesce(_text("r.cityState"), _join("r.city", "r.state", "r.country"))
    asked = None
    if country_words:
        name, code = country_words

        def placed(value: Column) -> Column:
            lowered = F.lower(F.coalesce(value, F.lit("")))
            return lowered.contains(name) | (F.trim(lowered) == code)

        asked = placed(F.col("r.country")) | placed(F.col("r.cityStateCountry")) | placed(location)
    return _rows(
        _records(payloads, PHENOM_WIDGETS, "refineSearch.data.jobs"),
        outer,
        asked,
        title=F.coalesce("r.title", F.lit("")),
        apply_url=F.coalesce(_text("r.applyUrl"), _text("r.jobUrl"), _text("r.reqId")),
        source_job_id=F.coalesce(_text("r.jobId"), _text("r.jobSeqNo")),
        location=location,
        description=blank_to_null(clean_text(F.col("r.descriptionTeaser"))),
        posted_date_raw=_text("r.postedDate"),
        extra=_extra(job_id=_text("r.jobId")),
    )


def smartrecruiters(payloads: DataFrame, outer: bool = False) -> DataFrame:
    """The site column carries the board's slug."""
    job = blank_to_null(F.col("r.id"))
    return _rows(
        _records(payloads, SMARTRECRUITERS_LIST, "content"),
        outer,
        title=F.coalesce("r.name", F.lit("")),
        company_name=F.coalesce(blank_to_null(F.col("r.company.name")), "company_name", F.lit("")),
        apply_url=F.concat(F.regexp_replace("base_url", "/+$", ""), F.lit("/"), F.col("site"), F.lit("/"), job),
        source_job_id=job,
        location=_join("r.location.city", "r.location.region", "r.location.country"),
        posted_date_raw=F.col("r.releasedDate"),
        extra=_extra(ref=F.col("r.ref")),
    )


def greenhouse(payloads: DataFrame, outer: bool = False) -> DataFrame:
    """Descriptions arrive as escaped HTML, so they are decoded before cleaning."""
    return _rows(
        _records(payloads, GREENHOUSE, "jobs"),
        outer,
        title=F.coalesce("r.title", F.lit("")),
        apply_url=F.col("r.absolute_url"),
        source_job_id=F.col("r.id"),
        location=blank_to_null(F.col("r.location.name")),
        description=blank_to_null(clean_text(decode_entities(F.coalesce("r.content", F.lit(""))))),
        posted_date_raw=F.col("r.updated_at"),
    )


def lever(payloads: DataFrame, outer: bool = False) -> DataFrame:
    return _rows(
        _records(payloads, LEVER),
        outer,
        title=F.coalesce("r.text", F.lit("")),
        apply_url=F.col("r.hostedUrl"),
        source_job_id=F.col("r.id"),
        location=blank_to_null(F.col("r.categories.location")),
        description=blank_to_null(F.col("r.descriptionPlain")),
        posted_date_raw=epoch_millis_date(F.col("r.createdAt")),
    )


DETAIL_KEY = ["source", "company_id", "detail_key"]


def _details(details: DataFrame, description: Column) -> DataFrame:
    landed = F.col("landed_at") if "landed_at" in details.columns else F.lit(None).cast("timestamp")
    return details.select(*DETAIL_KEY, landed.alias("landed_at"), blank_to_null(clean_text(description)).alias("description"))


def workday_detail(details: DataFrame) -> DataFrame:
    """``(source, company_id, detail_key, landed_at, description)`` of landed detail bodies."""
    return _details(details, F.get_json_object("payload", "$.jobPostingInfo.jobDescription"))


def smartrecruiters_detail(details: DataFrame) -> DataFrame:
    parts = [
        blank_to_null(F.get_json_object("payload", f"$.jobAd.sections.{s}.text"))
        for s in ("jobDescription", "qualifications")
    ]
    return _details(details, F.concat_ws("\n", *parts))


def with_details(rows: DataFrame, key: Column, details: DataFrame) -> DataFrame:
    """Left join of list rows to the latest detail of their own company; without one the description is NULL."""
    latest = F.max(F.struct(F.coalesce("landed_at", F.lit(0).cast("timestamp")), "description"))
    one = details.where("description is not null").groupBy(*[F.col(k).alias(f"_d_{k}") for k in DETAIL_KEY]).agg(latest.alias("_d"))
    keyed = rows.withColumn("detail_key", key)
    same = F.lit(True)
    for k in DETAIL_KEY:
        same = same & keyed[k].eqNullSafe(one[f"_d_{k}"])
    joined = keyed.join(one, same, "left")
    return joined.withColumn("description", F.col("_d.description")).select(*rows.columns)


def payload_kind(payload: Column) -> Column:
    """Shape of a landed body, from the marks that tell the shapes apart."""
    text = F.trim(F.coalesce(payload, F.lit("")))
    page = text.rlike(r"(?is)^(<\?xml.*?\?>\s*)?(<!--.*?-->\s*)*<(!doctype\s+html|html)\b")
    rss = ~page & (text.startswith("<?xml") | text.rlike(r"(?i)<rss\b|<item\b"))

    def has(key: str, path: str | None = None) -> Column:
        """A body without the name, plain or escaped, has no such key and is not parsed for it."""
        named = text.contains(f'"{key}"') | text.contains("\\u") | text.contains(f"'{key}'")
        return named & F.get_json_object(text, path or f"$.{key}").isNotNull()

    return (
        F.when(text == "", F.lit("empty"))
        .when(F.substring(text, 1, 1) == "[", F.lit("postings_array"))
        .when(
            F.substring(text, 1, 1) == "{",
            F.when(has("refineSearch"), F.lit("widgets"))
            .when(has("jobPostings"), F.lit("list"))
            .when(has("content"), F.lit("content"))
            .when(has("absolute_url", "$.jobs[0].absolute_url"), F.lit("board_jobs"))
            .when(has("jobs"), F.lit("api_jobs"))
            .otherwise(F.lit("unknown_json")),
        )
        .when(rss, F.lit("rss"))
        .when(text.contains("window.SEEK_REDUX_DATA"), F.lit("embedded_json"))
        .otherwise(F.lit("html"))
    )
