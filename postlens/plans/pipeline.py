"""The whole run as one plan: raw postings to scored, deduplicated, stored rows and a digest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from postlens.operators import enrich, incremental, resolve, score, store, views
from postlens.operators.materialize import cut
from postlens.operators.normalize import normalize
from postlens.operators.skew import lookup
from postlens.schema import POSTING, conform
from postlens.sources import landing


@dataclass
class Run:
    postings: DataFrame  # every row of the run with scores, status and duplicate_of
    top: DataFrame  # report-worthy rows
    digest: DataFrame  # report-worthy rows not stored before
    table: DataFrame | None  # the stored table after the run
    stats: DataFrame


def score_all(postings: DataFrame, companies: DataFrame, ratings: DataFrame, today: date) -> DataFrame:
    """Gate, enrich, score and boost; needs a ``similarity`` column."""
    gated = score.gate(postings)
    enriched = enrich.with_stars(enrich.enrich_companies(gated, companies), ratings)
    return score.boost(score.score(enriched, today))


def run(
    raw: DataFrame,
    companies: DataFrame,
    ratings: DataFrame,
    similarity: DataFrame | None,
    today: date,
    now: Column,
    table_path: str | None = None,
    min_tier: str = "C",
    home_only: bool = True,
    hot_rows: int | None = None,
    run_id: str | None = None,
    alerts_path: str | None = None,
    report_path: str | None = None,
) -> Run:
    """``similarity(seq, similarity)`` gives the match to the profile, 0 where it has no row.

    With ``alerts_path`` the digest is logged there under ``run_id``, which a repeated run
    replaces; it is logged before the table is merged, so that a run taken up again after a failure
    still finds it new. With ``report_path`` the sections of the report-worthy rows are written there.

    Only canonical rows are scored, so losers carry NULL scores. Newness is taken from the
    table before it is merged.
    """
    resolved = cut(store.with_id(resolve.deduplicate(normalize(raw, today), hot_rows)), "run-resolved")
    kept = resolved.where("seq = canonical")
    if similarity is None:
        kept = kept.withColumn("similarity", F.lit(0.0))
    else:
        one = similarity.groupBy("seq").agg(F.max("similarity").alias("similarity"))
        kept = kept.join(one, "seq", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    scored = cut(score_all(kept, companies, ratings, today), "run-scored")
    losers = resolved.where("seq <> canonical")
    canonical_ids = resolved.where("seq = canonical").select("cluster", F.col("id").alias("duplicate_of"))
    sizes = resolved.groupBy("cluster").agg(F.count("*").alias("n"))
    facts = cut(canonical_ids.join(sizes, "cluster"), "run-canonicals")
    linked = lookup(losers, facts, ["cluster"], "n", "seq", hot_rows)
    postings = cut(
        conform(scored, POSTING).unionByName(conform(linked, POSTING)).drop("first_seen", "last_seen"), "run-postings"
    )
    canonical = postings.where("status <> 'duplicate'")
    top = views.select_for_digest(canonical, min_tier, home_only).orderBy(*views.by_score())
    digest, table = top, None
    if table_path:
        stored = store.read_table(raw.sparkSession, table_path, POSTING)
        digest = cut(store.new_postings(top, stored), "run-digest").orderBy(*views.by_score())
    if alerts_path:
        views.log_alerts(views.alerts(digest, run_id or today.isoformat(), "email", now), alerts_path)
    if table_path:
        # A copy under the canonical's own key is the same stored row: the canonical's values stay.
        own = (F.col("status") == "duplicate") & (F.col("duplicate_of") == F.col("id"))
        store.merge_table(table_path, postings.where(~F.coalesce(own, F.lit(False))), POSTING, now)
        table = store.maintain_table(raw.sparkSession, table_path, POSTING)
    if report_path:
        views.write_report(views.report_sections(cut(top, "run-top")), report_path)
    return Run(postings, top, digest, table, resolve.dedup_stats(resolved))


@dataclass
class Batch:
    links: DataFrame  # (id, month, canonical) of the postings the batch could change
    postings: DataFrame  # the batch's rows as stored, one per id
    digest: DataFrame  # report-worthy rows not stored before
    relinked: DataFrame  # stored rows that another posting replaced as canonical


SCORES = [
    "similarity", "semantic_score", "seniority_score", "industry_score", "company_score", "location_score", "final_score",
    "priority_tier", "strong_alert", "match_reasons", "resume_tips",
]


def run_batch(
    raw: DataFrame,
    batch_id: int,
    companies: DataFrame,
    ratings: DataFrame,
    with_similarity: Callable[[DataFrame], DataFrame] | None,
    today: date,
    now: Column,
    table_path: str,
    index_path: str,
    min_tier: str = "C",
    home_only: bool = True,
    hot_rows: int | None = None,
    alerts_path: str | None = None,
) -> Batch:
    """One batch of the run that goes on: the stored table is as if all batches had come at once.

    Postings are resolved against the index, so copies link across batches. An id that is
    canonical is scored from the batch's best row of it; another is a duplicate. A stored
    canonical that a better posting replaces becomes a duplicate without scores, and its
    duplicates point to the new one; statuses set by a person stay. Re-gating and orphan repair
    look at the whole table and are left to their own schedule. Repeating a batch changes nothing.
    The digest is logged to ``alerts_path`` before the table is touched: a batch that failed after it
    is new again when it is repeated, one that failed later is logged already.
    """
    spark = raw.sparkSession
    own = resolve.own_seq(raw, hot_rows)
    normal = cut(store.with_id(normalize(own, today)), "batch-normal")
    links = incremental.resolve_batch(index_path, normal, batch_id, hot_rows)
    pref = resolve.preference()
    rank = F.row_number().over(W.partitionBy("id").orderBy(*[pref[n] for n in ("rank", "len", "url", "seq")]))
    one = normal.withColumn("_rn", rank).where("_rn = 1").drop("_rn").join(links.select("id", "canonical"), "id")
    kept = one.where("id = canonical").drop("canonical")
    kept = kept.withColumn("similarity", F.lit(0.0)) if with_similarity is None else with_similarity(kept)
    scored = score_all(kept.withColumn("similarity", F.coalesce("similarity", F.lit(0.0))), companies, ratings, today)
    losers = one.where("id <> canonical").withColumn("status", F.lit("duplicate")).withColumn("duplicate_of", F.col("canonical"))
    postings = cut(
        conform(scored, POSTING).unionByName(conform(losers, POSTING)).drop("first_seen", "last_seen"), "batch-postings"
    )
    stored = store.read_table(spark, table_path, POSTING)
    top = views.select_for_digest(postings.where("status <> 'duplicate'"), min_tier, home_only)
    digest = cut(store.new_postings(top, stored), "batch-digest").orderBy(*views.by_score())
    if alerts_path:
        views.log_alerts(views.alerts(digest, f"batch-{batch_id}", "email", now), alerts_path)
    relinked = _relinked(links, postings, stored)
    store.set_status(spark, table_path, POSTING, relinked, clear=SCORES)
    store.merge_table(table_path, postings, POSTING, now)
    return Batch(links, postings, digest, relinked)


def _relinked(links: DataFrame, postings: DataFrame, stored: DataFrame) -> DataFrame:
    """``(id, month, _status, _duplicate_of)`` of stored rows outside the batch whose canonical is another by now."""
    moved = cut(links.where("id <> canonical").join(postings.select("id"), "id", "left_anti"), "batch-moved")
    here = stored.where(store.touched(moved)).select("id", "status", "duplicate_of")
    other = ~((F.col("status") == "duplicate") & F.col("duplicate_of").eqNullSafe(F.col("canonical")))
    changed = moved.join(here, "id").where(other & ~F.col("status").isin(store.HUMAN_STATUSES))
    return cut(changed.select("id", "month", F.lit("duplicate").alias("_status"), F.col("canonical").alias("_duplicate_of")), "batch-relinked")


def land(payloads: DataFrame, companies: DataFrame, hot_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Raw postings of active companies, and the state of every landed body, from one reading of the bodies."""
    accounted = cut(landing.account(payloads, hot_rows), "run-landed")
    return landing.active_only(landing.rows_of(accounted), companies), landing.states_of(accounted)
