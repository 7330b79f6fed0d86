"""Landed payloads: freshness, routing to parsers, first-seen rows, active sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from postlens.operators.skew import number_copies
from postlens.session import scratch_dir
from postlens.sources import html, json_feeds, xml_feeds

PARSERS = {
    "list": json_feeds.workday,
    "api_jobs": json_feeds.phenom_jobs,
    "widgets": json_feeds.phenom_widgets,
    "content": json_feeds.smartrecruiters,
    "board_jobs": json_feeds.greenhouse,
    "postings_array": json_feeds.lever,
    "rss": xml_feeds.rss,
}


def fresh(payloads: DataFrame, key: list[str], ts: str, now: Column, ttl_seconds: int) -> DataFrame:
    """The latest payload per key, if not older than the time to live (negative: never expires)."""
    latest = payloads.groupBy(*key).agg(
        F.max(F.struct(ts, *[c for c in payloads.columns if c not in (*key, ts)])).alias("p")
    ).select(*key, "p.*")
    if ttl_seconds < 0:
        return latest
    return latest.where(F.col(ts) >= now - F.make_interval(secs=F.lit(ttl_seconds)))


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row per key over pages and terms.

    ``row_number() = 1`` lets every map task drop all but its own first row of a key before
    the shuffle, so a hot key moves one row per task.
    """
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


LANDED_KEY = ["source", "company_id", "page_no"]
IDENTITY = ["source", "company_id", "company_name", "base_url", "site", "page_no", "payload"]
ROW = [
    "source", "company_id", "page_no", "pos", "title", "company_name", "apply_url", "source_job_id", "location",
    "description", "posted_date_raw", "salary_raw",
]
_POSITIVE = (1 << 63) - 1


def numbered_bodies(routed: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """``routed`` with ``body``: a number of their own for all landed bodies, also for equal ones.

    It is a hash of what landed, so a body has the same number in every run; of n equal bodies
    one has that number and the others hashes of it and 1 to n - 1. Only bodies that repeat
    are shuffled; which ones do is told from the stored hashes, without the bodies.
    """
    # Equal bodies have one route; as part of the key it lets a reader of one route leave the others out.
    told = number_copies(routed, ["route", "_hash"], "_copy", hot_rows)
    number = F.when(F.col("_copy") == 0, F.col("_hash")).otherwise(F.xxhash64("_hash", "_copy"))
    return told.withColumn("body", number).drop("_hash", "_copy")


def _anchors(pages: DataFrame) -> DataFrame:
    slim = pages.select("body", *LANDED_KEY, F.coalesce("company_name", F.lit("")).alias("company_name"), "base_url", "payload")
    return html.anchor_postings(slim, "payload", "base_url", outer=True)


def _board(pages: DataFrame, board: str) -> DataFrame:
    found = html.cards(pages, "payload", html.BOARD_CARDS[board], ["body", "company_id", "base_url", "page_no"], outer=True)
    return html.board_postings(found, board, F.regexp_replace("base_url", "/+$", ""), outer=True)


def _routed(payloads: DataFrame) -> DataFrame:
    """The bodies in a folder per ``route``: the shape, or the board whose cards the page should hold.

    A body is looked at once to tell its shape and its hash, and each parser then reads its own bodies only.
    """
    kind = json_feeds.payload_kind(F.col("payload"))
    path = scratch_dir(payloads.sparkSession, "routed")
    board = (F.col("kind") == "html") & F.coalesce(F.col("source").isin(*html.BOARD_CARDS), F.lit(False))
    told = payloads.withColumns({"kind": kind, "_hash": F.xxhash64(*IDENTITY)})
    told = told.withColumn("route", F.when(board, F.col("source")).otherwise(F.col("kind"))).drop("kind")
    told.write.partitionBy("route").parquet(path)
    return payloads.sparkSession.read.schema(told.schema).parquet(path)


def _state(pages: DataFrame) -> DataFrame:
    """The source is the landed one: pages of other boards may carry the same state object."""
    slim = pages.select("body", F.col("source").alias("landed"), "company_id", "base_url", "page_no", "payload")
    found = html.embedded_json(slim, "payload", F.regexp_replace("base_url", "/+$", ""), outer=True)
    return found.withColumn("source", F.coalesce("landed", "source"))


def _complete(rows: DataFrame, kind: str) -> DataFrame:
    """The columns of every parser's rows; markup that holds no posting has the fault ``no_rows``."""
    fault = F.col("fault") if "fault" in rows.columns else F.lit("no_rows")
    extra = F.col("extra") if "extra" in rows.columns else F.lit(None).cast("map<string,string>")
    return rows.select(
        "body", *[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ROW],
        extra.alias("extra"), F.lit(kind).alias("kind"), "usable", F.when(~F.col("usable"), fault).alias("fault"),
    )


def account(payloads: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Every landed body and what it holds: one row per entry, at least one per body.

    ``usable`` rows are raw postings. The others say why they are none: ``empty``,
    ``unknown_shape``, ``malformed`` (JSON that does not parse), ``no_rows`` (nothing that
    could be read as entries), or NULL for an entry that lacks what its feed requires and for
    a list without entries. A page of a board goes to the board's cards, any other page to its
    posting links.
    """
    routed = numbered_bodies(_routed(payloads), hot_rows)

    def of(route: str) -> DataFrame:
        return routed.where(F.col("route") == route)

    feeds = [_complete(parser(of(kind), outer=True), kind) for kind, parser in PARSERS.items()]
    feeds += [_complete(_board(of(board), board), "html") for board in html.BOARD_CARDS]
    feeds += [_complete(_anchors(of("html")), "html"), _complete(_state(of("embedded_json")), "embedded_json")]
    bad = F.when(F.col("route") == "empty", "empty").when(F.try_parse_json("payload").isNull(), "malformed").otherwise("unknown_shape")
    for kind in ("empty", "unknown_json"):
        nothing = of(kind).select("body", *LANDED_KEY, bad.alias("fault"), F.lit(False).alias("usable"))
        feeds.append(_complete(nothing, kind))
    union = feeds[0]
    for feed in feeds[1:]:
        union = union.unionByName(feed)
    return union


def rows_of(accounted: DataFrame) -> DataFrame:
    """Raw postings with a stable ``seq``, a hash of the body's number and the position in it."""
    seq = F.xxhash64("body", "pos").bitwiseAND(F.lit(_POSITIVE))
    return accounted.where("usable").select(*ROW, "extra", "body", seq.alias("seq"))


def states_of(accounted: DataFrame) -> DataFrame:
    """One row per body: ``state`` is ``rows``, ``empty_list`` or ``error``, the last with its reason.

    A body with entries of which none is usable is an error, ``no_rows``. The entries of a
    body are next to each other, so they are counted before anything is shuffled.
    """
    told = accounted.groupBy("body").agg(
        *[F.any_value(c).alias(c) for c in (*LANDED_KEY, "kind")], F.count("pos").alias("entries"),
        F.count_if("usable").alias("postings"), F.max("fault").alias("fault"),
    )
    reason = F.when(F.col("postings") == 0, F.coalesce("fault", F.when(F.col("entries") > 0, F.lit("no_rows"))))
    state = F.when(F.col("postings") > 0, "rows").when(reason.isNull(), "empty_list").otherwise("error")
    return told.select("body", *LANDED_KEY, "kind", "entries", "postings", state.alias("state"), reason.alias("reason"))


def parse_all(payloads: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Raw postings of all landed bodies, in one pass over them."""
    return rows_of(account(payloads, hot_rows))


def ingest_errors(payloads: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Bodies without a usable posting, with their kind and a reason, instead of failing the run.

    A well-formed list without entries is no error. To have the postings and the errors from
    one reading of the bodies, write :func:`account` out and take ``rows_of`` and ``states_of``.
    """
    return states_of(account(payloads, hot_rows)).where("state = 'error'")


def active_only(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """Rows of active companies; rows without a company, as boards give them, pass."""
    active = companies.where("active").select("company_id").distinct()
    named = rows.where("company_id is not null").join(active, "company_id", "left_semi").select(*rows.columns)
    return named.unionByName(rows.where("company_id is null"))


def source_union(active: DataFrame, *feeds: DataFrame) -> DataFrame:
    """All feeds by column name, restricted to active companies."""
    union = feeds[0]
    for feed in feeds[1:]:
        union = union.unionByName(feed, allowMissingColumns=True)
    return active_only(union, active)


def company_sync(stored: DataFrame, configured: DataFrame, now: Column) -> DataFrame:
    """Upsert the configured companies: new ones appear, known ones take the new values,
    ones no longer configured stay."""
    values = [c for c in configured.columns if c != "company_id"]
    s, c = stored.alias("s"), configured.withColumn("_in", F.lit(True)).alias("c")
    given = F.col("c._in").isNotNull()
    return s.join(c, "company_id", "full").select(
        "company_id",
        *[F.when(given, F.col(f"c.{v}")).otherwise(F.col(f"s.{v}")).alias(v) for v in values],
        F.coalesce("s.created_at", now).alias("created_at"),
        F.when(given, now).otherwise(F.col("s.updated_at")).alias("updated_at"),
    )
