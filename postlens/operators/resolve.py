"""Entity resolution of postings: natural key, content key, fuzzy closure, survivorship.

The fuzzy pass joins no pairs. Two representatives match when company key and title core
agree, their cities share a word (or one is unknown) and their dates lie within the window
(or one is unknown). Only the closure of that relation matters, and it has sparse
generators: representatives collapse to distinct (block, city, date) nodes by a partial
aggregation, and every node is linked to a few leaders (see :func:`match_links`). A block
holding a third of all rows is a handful of nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from postlens.functions.text import city_key, normalize_company, title_core
from postlens.operators.classify import source_rank
from postlens.operators.components import connected_components
from postlens.operators.materialize import cut
from postlens.operators.skew import key_hash, lookup, number_copies

WINDOW_DAYS = 21
_NO_DATE = -1_000_000  # day number standing for an unknown date, so that keys are never NULL

_K1, _K2, _BLOCK = ["k1a", "k1b"], ["k2a", "k2b"], ["ba", "bb"]
_NODE = [*_BLOCK, "city", "day"]


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def er_key() -> list[Column]:
    """Natural key of a posting; an empty source id counts as missing."""
    identity = F.when(_text("source_job_id") != "", F.col("source_job_id")).otherwise(F.col("apply_url"))
    return [
        F.col("normalized_title"),
        F.trim(F.lower("company_name")),
        _text("location"),
        F.coalesce(F.col("posted_date").cast("string"), F.lit("")),
        identity,
    ]


def content_key() -> list[Column]:
    return [F.col("description_hash"), F.col("normalized_title"), F.trim(F.lower("company_name"))]


def city_words(location: Column) -> Column:
    """Distinct words of the city, sorted and joined; '' when unknown."""
    words = F.array_sort(F.array_distinct(F.split(city_key(location), " ")))
    return F.array_join(words, " ")


def day_number(posted: Column) -> Column:
    return F.coalesce(F.unix_date(posted), F.lit(_NO_DATE))


def slim(postings: DataFrame, *more: Column | str) -> DataFrame:
    """The columns resolution needs: hashed keys instead of texts; and ``more``."""
    company, core = F.col("company_key"), F.col("title_core")
    keyed = postings.withColumn("company_key", normalize_company(F.col("company_name"))).withColumn(
        "title_core", title_core(F.col("normalized_title"))
    )
    usable = (company != "") & (core != "")
    hashes = dict(zip([*_K1, *_K2, *_BLOCK], [*key_hash(*er_key()), *key_hash(*content_key()), *key_hash(company, core)]))
    for name in _BLOCK:
        hashes[name] = F.when(usable, hashes[name])
    return keyed.select(
        "seq",
        *[expr.alias(name) for name, expr in hashes.items()],
        city_words(F.col("location")).alias("city"),
        day_number(F.col("posted_date")).alias("day"),
        *more,
    )


def pass1(rows: DataFrame) -> DataFrame:
    """One representative (smallest seq) per natural key, with the number of rows behind it."""
    rep = F.min(F.struct("seq", *_K2, *_NODE)).alias("rep")
    return rows.groupBy(*_K1).agg(rep, F.count("*").alias("n")).select(*_K1, "rep.*", "n")


def pass2(reps: DataFrame) -> DataFrame:
    """One representative per content key among the pass-1 representatives."""
    rep = F.min(F.struct("seq", *_NODE)).alias("rep")
    return reps.groupBy(*_K2).agg(rep, F.count("*").alias("n")).select(*_K2, "rep.*", "n")


def nodes(reps: DataFrame) -> DataFrame:
    """Distinct (block, city, day) among blocked representatives."""
    grouped = reps.where(F.col("ba").isNotNull()).groupBy(*_NODE)
    return grouped.agg(F.min("seq").alias("node"), F.count("*").alias("n"))


def _token_links(node: DataFrame) -> DataFrame:
    """Nodes sharing a city word: chains of dates with no gap over the window, one leader each.

    An unknown date fits every date, so a word with one is a single chain. The windows run
    over distinct dates per (block, word), which the calendar bounds.
    """
    words = node.where("city <> ''").select(*_BLOCK, "day", "node", F.explode(F.split("city", " ")).alias("word"))
    dated = words.groupBy(*_BLOCK, "word", "day").agg(F.min("node").alias("first"))
    group = W.partitionBy(*_BLOCK, "word")
    ordered = group.orderBy("day")
    starts = (F.col("day") - F.lag("day").over(ordered) > WINDOW_DAYS).cast("int")
    chained = dated.withColumn("open", F.min("day").over(group) == _NO_DATE).withColumn(
        "chain", F.sum(F.coalesce(starts, F.lit(0))).over(ordered)
    )
    chained = chained.withColumn("chain", F.when(F.col("open"), 0).otherwise(F.col("chain")))
    leader = F.min("first").over(W.partitionBy(*_BLOCK, "word", "chain")).alias("b")
    leaders = chained.select(*_BLOCK, "word", "day", leader)
    return words.join(leaders, [*_BLOCK, "word", "day"]).select(F.col("node").alias("a"), "b")


def _unknown_city_links(node: DataFrame) -> DataFrame:
    """Nodes without a city fit every city: link what lies within the window of one.

    Per (block, date) the nearest such node before and after is enough, because those within
    the window of each other are chained themselves.
    """
    known = F.col("city") != ""
    dates = (
        node.where(F.col("day") != _NO_DATE)
        .groupBy(*_BLOCK, "day")
        .agg(F.min(F.when(~known, F.struct("day", "node"))).alias("here"))
    )
    ordered = W.partitionBy(*_BLOCK).orderBy("day")
    before = F.last("here", ignorenulls=True)
    after = F.first("here", ignorenulls=True)
    near = dates.select(
        *_BLOCK,
        "day",
        F.array(
            F.col("here"),
            before.over(ordered.rowsBetween(W.unboundedPreceding, -1)),
            after.over(ordered.rowsBetween(1, W.unboundedFollowing)),
        ).alias("near"),
    )
    close = F.filter("near", lambda h: h.isNotNull() & (F.abs(h["day"] - F.col("day")) <= WINDOW_DAYS))
    near = near.select(*_BLOCK, "day", F.transform(close, lambda h: h["node"]).alias("leaders")).where(
        F.size("leaders") > 0
    )
    return node.join(near, [*_BLOCK, "day"]).select(F.col("node").alias("a"), F.explode("leaders").alias("b"))


def _unknown_date_links(node: DataFrame) -> DataFrame:
    """A node without city and date fits the whole block; one with a city but no date fits
    every node without a city."""
    no_city, no_date = F.col("city") == "", F.col("day") == _NO_DATE
    facts = node.groupBy(*_BLOCK).agg(
        F.min(F.when(no_city & no_date, F.col("node"))).alias("all"),
        F.min(F.when(no_city, F.col("node"))).alias("blank"),
        F.max(~no_city & no_date).alias("undated"),
        F.count("*").alias("n"),
    )
    facts = facts.where(F.col("all").isNotNull() | (F.col("blank").isNotNull() & F.col("undated")))
    joined = lookup(node.drop("n"), facts, _BLOCK, "n", "node")
    leader = F.coalesce(F.col("all"), F.when(no_city | no_date, F.col("blank")))
    return joined.select(F.col("node").alias("a"), leader.alias("b")).where("b is not null")


def match_links(node: DataFrame) -> DataFrame:
    """Sparse links whose closure equals the closure of the pairwise match relation."""
    links = _token_links(node).union(_unknown_city_links(node)).union(_unknown_date_links(node))
    return links.where("a <> b").distinct()


def key_clusters(reps1: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """``(*key, rep1, rep2, cluster, n)`` for the representatives of the natural keys."""
    reps2 = cut(pass2(reps1), "er-pass2")
    node = cut(nodes(reps2), "er-nodes")
    roots = connected_components(match_links(node), hot_rows).withColumnRenamed("v", "node")
    placed = cut(
        node.join(roots, "node", "left").select(*_NODE, F.coalesce("root", "node").alias("cluster"), "n"), "er-placed"
    )
    by_content = lookup(reps2.withColumnRenamed("n", "m"), placed, _NODE, "n", "seq", hot_rows).select(
        *_K2, F.col("seq").alias("rep2"), F.coalesce("cluster", "seq").alias("cluster"), F.col("m").alias("n")
    )
    by_content = cut(by_content, "er-content")
    by_key = lookup(
        reps1.select(*_K1, *_K2, F.col("seq").alias("rep1"), F.col("n").alias("m")), by_content, _K2, "n", "rep1", hot_rows
    ).select(*_K1, "rep1", "rep2", "cluster", F.col("m").alias("n"))
    return cut(by_key, "er-keys")


def _clustered(rows: DataFrame, hot_rows: int | None, *more: str) -> DataFrame:
    by_key = key_clusters(cut(pass1(rows), "er-pass1"), hot_rows)
    return lookup(rows.select("seq", *_K1, *more), by_key, _K1, "n", "seq", hot_rows).select("seq", "rep1", "rep2", "cluster", *more)


def clusters(postings: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """``(seq, rep1, rep2, cluster)`` for every posting; a cluster is named by its smallest seq."""
    return _clustered(cut(slim(postings), "er-rows"), hot_rows)


def preference() -> Column:
    """Sort key of survivorship: source rank, longest description, link, then input order."""
    return F.struct(
        source_rank(F.col("source")).alias("rank"),
        (-F.length(_text("description"))).alias("len"),
        _text("apply_url").alias("url"),
        F.col("seq").alias("seq"),
    )


def survivors(postings: DataFrame, membership: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """``(seq, cluster, canonical)``: the best member of each cluster by preference."""
    ranked = postings.select("seq", preference().alias("pref")).join(membership.select("seq", "cluster"), "seq")
    return best_of(cut(ranked, "er-ranked"), hot_rows)


def best_of(ranked: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """``(seq, cluster, canonical)`` of rows with their cluster and ``pref``."""
    best = cut(
        ranked.groupBy("cluster")
        .agg(F.min("pref").alias("pref"), F.count("*").alias("n"))
        .select("cluster", F.col("pref.seq").alias("canonical"), "n"),
        "er-best",
    )
    return lookup(ranked.select("seq", "cluster"), best, ["cluster"], "n", "seq", hot_rows)


def own_seq(postings: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """``postings`` with a ``seq`` for each row: of rows that share one, all but the first get another.

    Everything here is joined back by ``seq``, so rows that share one would multiply.
    """
    order = [F.col(c) for c in ("apply_url", "title", "source_job_id")]
    told = number_copies(postings, ["seq"], "_copy", hot_rows, order)
    other = F.xxhash64("seq", "_copy").bitwiseAND(F.lit((1 << 63) - 1))
    return told.withColumn("seq", F.when(F.col("_copy") == 0, F.col("seq")).otherwise(other)).drop("_copy")


def deduplicate(postings: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """All postings with cluster, canonical seq and status; losers become 'duplicate'.

    Rows that share a ``seq`` get numbers of their own. The postings are read twice: once for
    the hashed keys and the order of preference, once to be joined with the outcome.
    """
    postings = own_seq(postings, hot_rows)
    rows = cut(slim(postings, preference().alias("pref")), "er-rows")
    ranked = cut(_clustered(rows, hot_rows, "pref"), "er-ranked")
    links = cut(best_of(ranked, hot_rows), "er-links")
    return postings.join(links, "seq").withColumn(
        "status", F.when(F.col("seq") == F.col("canonical"), F.lit("new")).otherwise(F.lit("duplicate"))
    )


def duplicate_links(links: DataFrame) -> DataFrame:
    """Losers with the canonical posting they point to."""
    return links.where("seq <> canonical").select("seq", F.col("canonical").alias("duplicate_of"))


def dedup_stats(links: DataFrame) -> DataFrame:
    kept = F.col("seq") == F.col("canonical")
    return links.agg(
        F.count_if(kept).alias("canonical"), F.count_if(~kept).alias("duplicates"), F.count("*").alias("persisted")
    )
