"""The registered queries: every operator run over the driver's tables.

Outputs are flat: arrays joined to text, dates as ISO text, doubles rounded.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.bindings import TODAY, postings_raw, raw_of, table
from postlens.functions import dates, display, encode, rules, salary, text, urls, vectors
from postlens.operators import classify, enrich, health, normalize, resolve, score, store, views
from postlens.operators.materialize import cut
from postlens.plans.pipeline import run as run_plan
from postlens.plans.pipeline import score_all
from postlens.schema import POSTING, conform
from postlens.session import SETTINGS, scratch_dir, spread
from postlens.sources import html, json_feeds, landing, xml_feeds
from postlens.streaming import firsts, ingest

QUERIES = {}


def query(fn):
    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        for key, value in SETTINGS.items():
            spark.conf.set(key, value)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = prepared
    return fn


C = F.col


def day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def flat(column: str) -> Column:
    return F.array_join(column, "|").alias(column)


def rounded(*names: str, digits: int = 6) -> list[Column]:
    return [F.round(n, digits).alias(n) for n in names]


def big(expr: Column, name: str) -> Column:
    return expr.cast("bigint").alias(name)


# -- inputs -------------------------------------------------------------------
def norm(spark, sf_dir) -> DataFrame:
    return normalize.normalize(postings_raw(spark, sf_dir), TODAY)


def similarities(spark, sf_dir) -> DataFrame:
    """``(vec_id, similarity)`` to the profile, which is vector 0."""
    vecs = table(spark, sf_dir, "embeddings")
    profile = vecs.where("vec_id = 0").select("embedding").first()[0]
    return vectors.with_cosine(vecs.select("vec_id", "embedding"), "embedding", profile)


def with_similarity(df: DataFrame, spark, sf_dir) -> DataFrame:
    """Postings take the vectors in turn: vector number = seq modulo the number of vectors."""
    sims = similarities(spark, sf_dir)
    n = table(spark, sf_dir, "embeddings").agg((F.max("vec_id") + 1).alias("n")).scalar()
    return df.withColumn("vec_id", F.pmod(C("seq"), n)).join(sims, "vec_id", "left").drop("vec_id")


def enriched(spark, sf_dir) -> DataFrame:
    df = enrich.enrich_companies(norm(spark, sf_dir), enrich.companies(spark))
    return df.withColumn("text_lc", classify.posting_text("title", "description"))


def scored(spark, sf_dir) -> DataFrame:
    df = with_similarity(norm(spark, sf_dir), spark, sf_dir)
    return score_all(df, enrich.companies(spark), enrich.ratings(spark), TODAY)


def scored_table(spark, sf_dir) -> DataFrame:
    """Scored rows as stored, which is what the views read.

    A filter on a score would otherwise be pushed below the scoring and repeat it.
    """
    return cut(scored(spark, sf_dir).drop("description"), "scored")


# -- text, dates, salary ----------------------------------------------------------
@query
def normalize_title(spark, sf_dir):
    return postings_raw(spark, sf_dir).select("seq", text.normalize_title(C("title")).alias("normalized_title"))


@query
def description_hash(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", text.description_hash(C("text")).alias("description_hash"))


@query
def normalize_company(spark, sf_dir):
    return postings_raw(spark, sf_dir).select("seq", text.normalize_company(C("company_name")).alias("company_key"))


@query
def title_core(spark, sf_dir):
    core = text.title_core(text.normalize_title(C("title")))
    return postings_raw(spark, sf_dir).select("seq", core.alias("title_core"))


@query
def city_key(spark, sf_dir):
    return postings_raw(spark, sf_dir).select("seq", text.city_key(C("location")).alias("city"))


@query
def token_set(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.array_join(text.token_set(C("text")), " ").alias("tokens"))


@query
def clean_text(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages"))
    return pages.select("page_id", text.clean_text(C("html")).alias("text"))


@query
def parse_salary(spark, sf_dir):
    s = salary.parse_salary(C("salary_raw"))
    return postings_raw(spark, sf_dir).select("seq", s.alias("s")).select(
        "seq", C("s.min").alias("salary_min"), C("s.max").alias("salary_max"), C("s.currency").alias("salary_currency"),
        C("s.period").alias("salary_period"), C("s.disclosed").alias("disclosed"),
    )


@query
def parse_posted_date(spark, sf_dir):
    parsed = dates.parse_posted_date(C("posted_date_raw"), TODAY)
    return postings_raw(spark, sf_dir).select("seq", parsed.alias("posted_date")).select("seq", day("posted_date"))


@query
def format_salary(spark, sf_dir):
    shown = display.format_salary(
        C("salary_min"), C("salary_max"), C("salary_currency"), C("salary_period"), C("salary_raw")
    )
    return norm(spark, sf_dir).select("seq", shown.alias("salary_text"))


@query
def star_bar(spark, sf_dir):
    df = enrich.with_stars(postings_raw(spark, sf_dir), enrich.ratings(spark))
    return df.select(
        "seq",
        display.star_bar(C("company_name"), C("stars")).alias("bar"),
        display.recruiter_mark(C("company_name")).alias("mark"),
    )


@query
def normalize_postings(spark, sf_dir):
    df = norm(spark, sf_dir)
    # Long texts and the map of loose fields, which postings made from documents lack, are no flat columns.
    return df.select(*[day(c) if c == "posted_date" else c for c in df.columns if c not in ("description", "extra")])


# -- predicates and classes ----------------------------------------------------------
@query
def relevance_gate(spark, sf_dir):
    return postings_raw(spark, sf_dir).where(classify.is_relevant("title")).select("seq", "title")


@query
def precision_gate(spark, sf_dir):
    return score.gate(norm(spark, sf_dir)).select("seq", "location_key", "status")


@query
def hard_exclude(spark, sf_dir):
    df = enriched(spark, sf_dir)
    df = df.select(
        "seq", classify.industry("sector", "text_lc").alias("industry_key"),
        classify.signals("text_lc").alias("signals"),
    )
    return df.select("seq", classify.is_hard_excluded("industry_key", "signals").alias("excluded"))


@query
def region_filter(spark, sf_dir):
    region = classify.region("location", "title")
    df = postings_raw(spark, sf_dir).select("seq", "location", region.alias("region"))
    return df.where("region <> 'other'")


@query
def recruiter_flag(spark, sf_dir):
    return postings_raw(spark, sf_dir).select("seq", display.is_recruiter(C("company_name")).alias("is_recruiter"))


@query
def classify_first_match(spark, sf_dir):
    return postings_raw(spark, sf_dir).select(
        "seq", classify.seniority("title").alias("category"),
        classify.seniority("title", promote_senior_specialist=False).alias("category_plain"),
    )


@query
def detect_signals(spark, sf_dir):
    body = classify.posting_text("title", "description")
    df = postings_raw(spark, sf_dir).select("seq", body.alias("text_lc"))
    return df.select("seq", classify.signals("text_lc").alias("signals")).select("seq", flat("signals"))


@query
def classify_industry(spark, sf_dir):
    return enriched(spark, sf_dir).select("seq", classify.industry("sector", "text_lc").alias("industry_key"))


@query
def classify_company(spark, sf_dir):
    key = classify.company_class("sector", "text_lc", "is_recruiter", "company_name")
    return enriched(spark, sf_dir).select("seq", key.alias("company_key"))


@query
def is_home_country(spark, sf_dir):
    return postings_raw(spark, sf_dir).select("seq", classify.is_home_country("location").alias("home"))


@query
def classify_location(spark, sf_dir):
    return postings_raw(spark, sf_dir).select("seq", classify.location_class("location").alias("location_key"))


@query
def location_bucket(spark, sf_dir):
    return postings_raw(spark, sf_dir).select("seq", classify.location_bucket("location").alias("bucket"))


# -- vectors and scores -------------------------------------------------------------
@query
def cosine_to_profile(spark, sf_dir):
    return similarities(spark, sf_dir).select("vec_id", *rounded("similarity"))


@query
def text_vectors(spark, sf_dir):
    docs = encode.hashing_encoder(spread(table(spark, sf_dir, "documents")), C("text"), dim=128)
    return docs.select("doc_id", F.size("embedding").alias("dim"), F.round(vectors.cosine(C("embedding"), C("embedding")), 3).alias("unit"))


@query
def score_industry(spark, sf_dir):
    df = enriched(spark, sf_dir).select(
        "seq", classify.industry("sector", "text_lc").alias("industry_key"),
        classify.signals("text_lc").alias("signals"),
    )
    return df.select("seq", score.industry_score("industry_key", "signals").alias("industry_score"))


@query
def score_company(spark, sf_dir):
    key = classify.company_class("sector", "text_lc", "is_recruiter", "company_name")
    df = enriched(spark, sf_dir).select("seq", "is_tier1", key.alias("company_key"))
    return df.select("seq", score.company_score("company_key", "is_tier1").alias("company_score")).select(
        "seq", *rounded("company_score")
    )


@query
def salary_bands(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", score.salary_points("CAST(NULL AS DOUBLE)", "o_totalprice", "true").alias("points")
    )


@query
def final_score(spark, sf_dir):
    names = ["semantic_score", "seniority_score", "industry_score", "company_score", "location_score", "final_score"]
    return scored(spark, sf_dir).where("scorable").select("seq", *rounded(*names))


@query
def priority_tier(spark, sf_dir):
    return scored(spark, sf_dir).select("seq", "priority_tier", "status")


@query
def rating_boost(spark, sf_dir):
    return scored(spark, sf_dir).select("seq", big(C("stars"), "stars"), *rounded("final_score"), "priority_tier")


@query
def strong_alert(spark, sf_dir):
    return scored(spark, sf_dir).where("scorable").select("seq", "strong_alert", flat("match_reasons"))


@query
def tips(spark, sf_dir):
    return scored(spark, sf_dir).where("scorable").select("seq", flat("resume_tips"))


@query
def score_postings(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "seq", "status", "category", flat("signals"), "industry_key", "company_key", "location_key", "hard_excluded",
        "strong_alert", "priority_tier", *rounded("similarity", "final_score"),
    )


# -- joins -------------------------------------------------------------------------
@query
def company_enrich(spark, sf_dir):
    df = enrich.enrich_companies(postings_raw(spark, sf_dir), enrich.companies(spark))
    return df.select("seq", "company_id", "sector", "is_tier1", "is_recruiter")


def stored_v0(spark, sf_dir) -> DataFrame:
    """An earlier state of the table: three quarters of the postings, some handled by hand."""
    status = F.when(C("seq") % 20 == 1, F.lit("applied")).when(C("seq") % 20 == 2, F.lit("expired")).otherwise(C("status"))
    rows = store.with_id(norm(spark, sf_dir).where("seq % 4 <> 3").withColumn("status", status).drop("description"))
    return (
        store.last_per_key(rows)
        .withColumn("first_seen", F.lit(datetime(2026, 8, 1)))
        .withColumn("last_seen", F.lit(datetime(2026, 8, 1)))
    )


def batch_v1(spark, sf_dir) -> DataFrame:
    rows = norm(spark, sf_dir).where("seq % 4 <> 0").drop("description")
    return store.with_id(rows.withColumn("salary_raw", F.concat(F.lit("v1 "), F.coalesce("salary_raw", F.lit("-")))))


@query
def new_postings(spark, sf_dir):
    return store.new_postings(batch_v1(spark, sf_dir), stored_v0(spark, sf_dir)).select("seq", "id")


@query
def upsert_merge(spark, sf_dir):
    merged = store.upsert(stored_v0(spark, sf_dir), batch_v1(spark, sf_dir), F.lit(datetime(2026, 9, 1)))
    return merged.select("id", "seq", "source_job_id", "status", "salary_raw", day("first_seen"), day("last_seen"))


@query
def store_run(spark, sf_dir):
    """The stored table after an earlier batch, a later one and maintenance."""
    path = scratch_dir(spark, "store-run")
    for rows, when in ((stored_v0(spark, sf_dir), datetime(2026, 8, 1)), (batch_v1(spark, sf_dir), datetime(2026, 9, 1))):
        store.merge_table(path, conform(rows, POSTING).drop("first_seen", "last_seen"), POSTING, F.lit(when))
    merged = store.maintain_table(spark, path, POSTING)
    return merged.select("id", "seq", "source_job_id", "status", "salary_raw", day("first_seen"), day("last_seen"))


@query
def point_lookup(spark, sf_dir):
    """The stored postings of the smallest and the greatest id."""
    rows = conform(stored_v0(spark, sf_dir), POSTING).drop("first_seen", "last_seen")
    stored = store.merge_table(scratch_dir(spark, "lookup"), rows, POSTING, F.lit(datetime(2026, 8, 1)))
    ends = stored.agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
    return store.find(stored, [i for i in ends if i is not None]).select("id", "seq", "source_job_id", "status", "salary_raw")


@query
def regate(spark, sf_dir):
    return store.regate(stored_v0(spark, sf_dir)).select("id", "status")


@query
def repair_orphans(spark, sf_dir):
    status = (
        F.when(C("seq") % 3 == 0, F.lit("duplicate"))
        .when(C("seq") % 7 == 1, F.lit("irrelevant"))
        .when(C("seq") % 5 == 2, F.lit("duplicate"))
        .otherwise(F.lit("new"))
    )
    points = F.when(C("seq") % 4 != 0, ((C("seq") * 37) % 100).cast("double"))
    rows = norm(spark, sf_dir).select(
        "seq", "source", "normalized_title", "company_name", status.alias("status"),
        F.when(C("seq") % 9 == 0, F.lit("kept")).alias("duplicate_of"), points.alias("final_score"),
        F.concat(F.lit("p"), C("seq").cast("string")).alias("id"),
    )
    return store.repair_orphans(rows).select("id", "status", "duplicate_of")


def _orphaned(spark, sf_dir) -> DataFrame:
    """Postings with statuses that maintenance has to mend."""
    status = (
        F.when(C("seq") % 3 == 0, F.lit("duplicate")).when(C("seq") % 7 == 1, F.lit("irrelevant"))
        .when(C("seq") % 5 == 2, F.lit("duplicate")).otherwise(F.lit("new"))
    )
    points = F.when(C("seq") % 4 != 0, ((C("seq") * 37) % 100).cast("double"))
    return norm(spark, sf_dir).withColumns({
        "status": status, "duplicate_of": F.when(C("seq") % 9 == 0, F.lit("kept")), "final_score": points,
        "id": F.concat(F.lit("p"), C("seq").cast("string")),
    })


@query
def maintenance_counts(spark, sf_dir):
    """Rows re-gated, relinked and promoted in the stored table, and what a second call changes."""
    path = scratch_dir(spark, "maintained")
    rows = conform(_orphaned(spark, sf_dir), POSTING).drop("first_seen", "last_seen")
    store.merge_table(path, rows, POSTING, F.lit(datetime(2026, 9, 1)))
    first, second = (store.maintain(spark, path, POSTING) for _ in range(2))
    counts = [(first["regated"], first["relinked"], first["promoted"], sum(second.values()))]
    return spark.createDataFrame(counts, "regated long, relinked long, promoted long, again long")


def letters_model():
    """A small model: a text's length and how often it has some letters, as a unit vector."""
    import numpy as np

    def predict(texts):
        counts = np.array([[len(t), t.count("a"), t.count("e"), t.count(" ")] for t in texts], np.float32)
        return counts / np.maximum(np.sqrt((counts**2).sum(1, keepdims=True)), 1e-9)

    return predict


@query
def encode_new(spark, sf_dir):
    """Vectors of a batch: stored ones where the text is known, a model's for the rest."""
    base = store.with_id(norm(spark, sf_dir))
    vecs = table(spark, sf_dir, "embeddings")
    n = vecs.agg((F.max("vec_id") + 1).alias("n")).scalar()
    stored = base.where("seq % 4 <> 3").withColumn("vec_id", F.pmod(C("seq"), n)).join(vecs, "vec_id")
    encoder = encode.model_encoder(letters_model, C("normalized_title"), dim=4)
    whole, computed = store.encode_new(base.where("seq % 2 = 1").drop("description"), stored, encoder)
    ours = computed.select(*store.TEXT_KEY, F.lit(True).alias("computed"))
    told = whole.join(ours, store.TEXT_KEY, "left")
    values = [F.round(F.get("embedding", F.lit(i)).cast("double"), 5).alias(f"v{i}") for i in range(4)]
    return told.select("seq", C("computed").isNull().alias("reused"), *values)


@query
def embedding_reuse(spark, sf_dir):
    base = store.with_id(norm(spark, sf_dir))
    vecs = table(spark, sf_dir, "embeddings")
    n = vecs.agg((F.max("vec_id") + 1).alias("n")).scalar()
    stored = base.where("seq % 4 <> 3").withColumn("vec_id", F.pmod(C("seq"), n)).join(vecs, "vec_id")
    found = store.embedding_reuse(base.where("seq % 2 = 1").drop("description"), stored)
    return found.select("seq", C("embedding").isNotNull().alias("reused"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


# -- resolution --------------------------------------------------------------------
def members(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = norm(spark, sf_dir)
    return rows, resolve.clusters(rows)


@query
def er_pass1(spark, sf_dir):
    reps = resolve.pass1(resolve.slim(norm(spark, sf_dir)))
    return reps.select(C("seq").alias("rep"), C("n").alias("rows"))


@query
def er_pass2(spark, sf_dir):
    reps = resolve.pass2(resolve.pass1(resolve.slim(norm(spark, sf_dir))))
    return reps.select(C("seq").alias("rep"), C("n").alias("groups"))


@query
def er_edges(spark, sf_dir):
    """Every representative that matches another one (any pair makes it linked)."""
    reps = resolve.pass2(resolve.pass1(resolve.slim(norm(spark, sf_dir))))
    node = resolve.nodes(reps)
    links = resolve.match_links(node)
    touched = links.select(C("a").alias("node")).union(links.select(C("b").alias("node"))).distinct()
    crowded = node.where("n > 1").select("node")
    linked = touched.union(crowded).distinct().withColumn("linked", F.lit(True))
    facts = node.join(linked, "node", "left").select("ba", "bb", "city", "day", "linked", "n")
    placed = resolve.lookup(reps.drop("n"), facts, ["ba", "bb", "city", "day"], "n", "seq")
    return placed.where("linked").select("seq")


@query
def er_components(spark, sf_dir):
    return members(spark, sf_dir)[1].select("seq", "cluster")


@query
def pick_best(spark, sf_dir):
    rows, membership = members(spark, sf_dir)
    return resolve.survivors(rows, membership).where("seq = canonical").select("cluster", "canonical")


@query
def deduplicate(spark, sf_dir):
    return resolve.deduplicate(norm(spark, sf_dir)).select("seq", "cluster", "canonical", "status")


@query
def duplicate_links(spark, sf_dir):
    rows, membership = members(spark, sf_dir)
    return resolve.duplicate_links(resolve.survivors(rows, membership))


@query
def dedup_stats(spark, sf_dir):
    rows, membership = members(spark, sf_dir)
    return resolve.dedup_stats(resolve.survivors(rows, membership))


@query
def content_dedup(spark, sf_dir):
    """Exact copies of long texts: one row per distinct text with its first id and count."""
    docs = spread(table(spark, sf_dir, "documents"))
    hashed = docs.select("doc_id", text.description_hash(C("text")).alias("description_hash"))
    return hashed.groupBy("description_hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


# -- views -------------------------------------------------------------------------
@query
def digest_select(spark, sf_dir):
    return views.select_for_digest(scored_table(spark, sf_dir)).select("seq", "priority_tier", *rounded("final_score"))


@query
def digest_new_only(spark, sf_dir):
    top = store.with_id(views.select_for_digest(scored_table(spark, sf_dir)))
    return store.new_postings(top, stored_v0(spark, sf_dir)).select("seq", "priority_tier")


@query
def digest_summary(spark, sf_dir):
    return views.digest_summary(views.select_for_digest(scored_table(spark, sf_dir)))


@query
def top_jobs(spark, sf_dir):
    return views.top_jobs(scored_table(spark, sf_dir), limit=50, min_score=40.0).select("seq", *rounded("final_score"))


@query
def seen_since(spark, sf_dir):
    order = [C("value").desc_nulls_last(), C("event_id")]
    rows = views.seen_since(table(spark, sf_dir, "events"), "ts", datetime(2024, 1, 15), order)
    return rows.select("event_id", "user_id", "value")


@query
def report_sections(spark, sf_dir):
    rows = views.report_sections(scored_table(spark, sf_dir))
    return rows.select(
        big(C("section"), "section"), views.section_heading().alias("heading"), "seq", *rounded("final_score")
    ).orderBy("section", C("final_score").desc_nulls_last(), "seq")


@query
def section_counts(spark, sf_dir):
    counts = views.section_counts(views.report_sections(scored_table(spark, sf_dir)))
    return counts.select(big(C("section"), "section"), "n")


@query
def email_top_n(spark, sf_dir):
    rows = views.top_n_per_section(views.report_sections(scored_table(spark, sf_dir)))
    return rows.select(big(C("section"), "section"), big(C("rank"), "rank"), "seq", *rounded("final_score"))


@query
def digest_lines(spark, sf_dir):
    top = views.top_n_per_section(views.report_sections(scored_table(spark, sf_dir)))
    return views.digest_lines(top).select(big(C("section"), "section"), big(C("rank"), "rank"), "lines")


@query
def tier_counts(spark, sf_dir):
    return views.tier_counts(scored_table(spark, sf_dir)).select("tier", "n", big(C("position"), "position"))


@query
def alerts_log(spark, sf_dir):
    digest = store.with_id(views.select_for_digest(scored_table(spark, sf_dir)))
    path = scratch_dir(spark, "alerts")
    log = views.alerts(digest, "run-1", "email", F.lit(datetime(2026, 9, 1)))
    for _ in range(2):  # a repeated run must not double its rows
        views.log_alerts(log, path)
    return spark.read.parquet(path).select("job_id", "run_id", "channel", "priority_tier", "strong_alert", day("sent_at"))


# -- source health -------------------------------------------------------------------
def _failures(spark, sf_dir) -> DataFrame:
    """Failures as the event log reports them, mapped onto companies by user number."""
    ids = enrich.companies(spark).select("company_id").withColumn("n", F.length("company_id"))
    bad = table(spark, sf_dir, "events").where("event_type = 'error' AND value > 200")
    bad = bad.select((C("user_id") % 20).alias("n"), F.when(C("value") > 250, F.lit("blocked")).otherwise(F.lit("error")).alias("status"))
    return bad.groupBy("n").agg(F.min("status").alias("status")).join(ids, "n").select("company_id", "status")


def _stats(spark, sf_dir) -> DataFrame:
    return health.source_stats(enrich.companies(spark), postings_raw(spark, sf_dir), _failures(spark, sf_dir))


@query
def source_stats(spark, sf_dir):
    return _stats(spark, sf_dir).select("company_id", "status", "fetched")


@query
def source_health(spark, sf_dir):
    return health.source_health(_stats(spark, sf_dir))


@query
def health_gate(spark, sf_dir):
    """Whether the run passes: no unhealthy source of top priority."""
    return health.gate_passes(health.source_health(_stats(spark, sf_dir)))


@query
def run_stats(spark, sf_dir):
    status = (
        F.when(C("event_type").isin("view", "click"), F.lit("ok"))
        .when(C("event_type") == "purchase", F.lit("blocked"))
        .when(C("event_type") == "error", F.lit("error"))
        .otherwise(F.lit("empty"))
    )
    log = table(spark, sf_dir, "events").select("ts", status.alias("status"), F.floor("value").alias("fetched"))
    return health.run_stats(log, F.date_format("ts", "yyyy-MM-dd"))


@query
def fresh_payloads(spark, sf_dir):
    landed = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "props")
    fresh = landing.fresh(landed, ["user_id"], "ts", F.lit(datetime(2024, 1, 30, 12)), ttl_seconds=43200)
    return fresh.select("user_id", "event_id", "props")


@query
def company_sync(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(C("n_nationkey").alias("s_nationkey"), "n_name")
    sup = table(spark, sf_dir, "supplier").join(nation, "s_nationkey")
    key = F.concat(F.lit("S"), C("s_suppkey").cast("string")).alias("company_id")
    stored = sup.where("s_suppkey % 2 = 0").select(
        key, F.lower("s_name").alias("name"), F.lit("").alias("sector"), F.lit("P3").alias("priority_tier"),
        F.lit(True).alias("active"), F.lit(datetime(2026, 1, 1)).alias("created_at"), F.lit(datetime(2026, 1, 1)).alias("updated_at"),
    )
    configured = sup.where("s_suppkey % 3 <> 0").select(
        key, C("s_name").alias("name"), C("n_name").alias("sector"),
        F.when(C("s_acctbal") > 5000, F.lit("P1")).otherwise(F.lit("P2")).alias("priority_tier"),
        (C("s_acctbal") > 0).alias("active"),
    )
    merged = landing.company_sync(stored, configured, F.lit(datetime(2026, 9, 1)))
    return merged.select("company_id", "name", "sector", "priority_tier", "active", day("created_at"), day("updated_at"))


# -- landed payloads -----------------------------------------------------------------
class Feed(NamedTuple):
    """How a site shows its postings: an entry of each, and the body around the entries of a page."""

    source: str
    base: str
    site: str
    item: Column
    wrap: Callable[[Column], Column]


def paged(spark, sf_dir, *feeds: Feed) -> DataFrame:
    """Landed bodies of 20 postings each, built from the posting rows, with ``feed``, the place among ``feeds``.

    Rows are brought together once, before entries are made of them, so texts are read and moved once for all feeds.
    """
    docs = table(spark, sf_dir, "documents")
    tasks = max(2 * spark.sparkContext.defaultParallelism, 4 * docs.rdd.getNumPartitions())
    raw = raw_of(docs).withColumn("page_no", F.floor(C("seq") / 20)).repartition(tasks, "page_no")
    entries = F.struct("seq", *[f.item.alias(f"item{k}") for k, f in enumerate(feeds)])
    pages = raw.groupBy("page_no").agg(F.sort_array(F.collect_list(entries)).alias("items"))

    def body(k: int, feed: Feed) -> Column:
        items = F.transform("items", lambda x: x[f"item{k}"])
        return F.struct(
            F.lit(feed.source).alias("source"), F.lit("bega").alias("company_id"), F.lit("Bega Group").alias("company_name"),
            F.lit(feed.base).alias("base_url"), F.lit(feed.site).alias("site"), feed.wrap(items).alias("payload"),
        )

    told = pages.select("page_no", F.posexplode(F.array(*[body(k, f) for k, f in enumerate(feeds)])).alias("feed", "b"))
    return told.select("feed", *[C(f"b.{c}") for c in ("source", "company_id", "company_name", "base_url", "site")], "page_no", "b.payload")


def struct(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def seq_text() -> Column:
    return C("seq").cast("string")


def complete() -> Column:
    """The other rows lack what their parser requires."""
    return C("seq") % 17 != 0


def workday_feed() -> Feed:
    item = struct(
        title=C("title"), externalPath=F.when(complete(), F.concat(F.lit("/job/"), seq_text())), locationsText=C("location"),
        postedOn=C("posted_date_raw"), bulletFields=F.when(C("seq") % 5 != 0, F.array(F.concat(F.lit("R"), seq_text()))).otherwise(F.array().cast("array<string>")),
    )
    return Feed("official_ats", "https://wd.example.com/", "Careers", item, lambda i: F.to_json(struct(jobPostings=i)))


def escaped(column: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        column = F.replace(column, F.lit(raw), F.lit(entity))
    return column


def greenhouse_feed() -> Feed:
    body = F.concat(F.lit("<p>"), escaped(C("description")), F.lit("</p>"))
    item = struct(
        id=C("seq"), title=C("title"), absolute_url=F.when(complete() | (C("seq") % 20 == 0), C("apply_url")), location=struct(name=C("location")),
        updated_at=C("posted_date_raw"), content=escaped(body),
    )
    return Feed("official_ats", "", "", item, lambda i: F.to_json(struct(jobs=i)))


def lever_feed() -> Feed:
    item = struct(
        id=F.concat(F.lit("L"), seq_text()), text=C("title"), hostedUrl=F.when(complete(), C("apply_url")),
        categories=struct(location=C("location"), team=F.lit("QA")), createdAt=F.lit(1750118400000) + C("seq") * 7200000,
        descriptionPlain=C("description"),
    )
    return Feed("official_ats", "", "", item, F.to_json)


def phenom_feed() -> Feed:
    data = struct(
        slug=F.concat(F.lit("slug-"), seq_text()), req_id=F.when(C("seq") % 4 != 0, F.concat(F.lit("Q"), seq_text())), title=C("title"),
        city=F.substring_index("location", " ", 1), state=F.when(C("seq") % 3 == 0, F.lit("NSW")), country=F.lit("Australia"),
        full_location=F.when(C("seq") % 2 == 0, C("location")), posted_date=C("posted_date_raw"),
        apply_url=F.when(C("seq") % 6 == 0, C("apply_url")),
    )
    return Feed("official_ats", "https://ph.example.com/", "", struct(data=data), lambda i: F.to_json(struct(jobs=i)))


def widget_feed() -> Feed:
    item = struct(
        title=C("title"), cityState=F.when(C("seq") % 2 == 0, C("location")), city=F.lit("Sydney"),
        country=F.when(C("seq") % 3 == 0, F.lit("Australia")).when(C("seq") % 3 == 1, F.lit("AU")).otherwise(F.lit("Vietnam")),
        jobId=F.when(C("seq") % 4 != 0, F.concat(F.lit("W"), seq_text())), jobSeqNo=F.concat(F.lit("N"), seq_text()),
        applyUrl=F.when(complete() & (C("seq") % 2 == 0), C("apply_url")), jobUrl=F.when(complete(), F.concat(C("apply_url"), F.lit("/view"))),
        descriptionTeaser=F.concat(F.lit("<b>"), escaped(C("title")), F.lit("</b> role")), postedDate=C("posted_date_raw"),
    )
    wrap = lambda i: F.to_json(struct(refineSearch=struct(totalHits=F.size(i), data=struct(jobs=i))))
    return Feed("official_ats", "", "", item, wrap)


def smart_feed() -> Feed:
    item = struct(
        id=F.when(complete(), F.concat(F.lit("S"), seq_text())), name=C("title"), ref=F.lit("r"), releasedDate=C("posted_date_raw"),
        location=struct(city=F.substring_index("location", " ", 1), region=F.when(C("seq") % 2 == 0, F.lit("NSW")), country=F.lit("au")),
        company=F.when(C("seq") % 3 == 0, struct(name=C("company_name"))),
    )
    return Feed("official_ats", "https://sr.example.com", "board", item, lambda i: F.to_json(struct(content=i)))


def rss_feed() -> Feed:
    def tag(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"<{name}>"), escaped(value), F.lit(f"</{name}>"))

    item = F.concat_ws(
        "", F.lit("<item>"), tag("title", F.concat(C("title"), F.lit(" - Sydney"))), tag("link", C("apply_url")),
        tag("description", F.concat(F.lit("<p>"), escaped(C("title")), F.lit("</p>"))), tag("guid", F.concat(F.lit("G"), seq_text())),
        tag("pubDate", F.lit("Thu, 18 Jun 2026 00:00:00 GMT")),
        F.when(C("seq") % 2 == 0, tag("g:location", C("location"))), F.lit("</item>"),
    )
    wrap = lambda i: F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0" xmlns:g="http://base.google.com/ns/1.0"><channel>'),
        F.array_join(i, ""),
        F.when(C("page_no") % 10 == 9, F.lit("</broken>")).otherwise(F.lit("</channel></rss>")),
    )
    return Feed("official_ats", "", "", item, wrap)


def card_feed(kind: str) -> Feed:
    def el(tag: str, attrs: str, value: Column) -> Column:
        return F.concat(F.lit(f"<{tag} {attrs}>"), escaped(F.coalesce(value, F.lit(""))), F.lit(f"</{tag}>"))

    company = F.when(C("seq") % 9 == 0, F.lit("Private Advertiser")).otherwise(C("company_name"))
    if kind == "seek":
        link = F.concat(F.lit('<a data-automation="jobTitle" href="/job/'), seq_text(), F.lit('?type=standard#x">'), escaped(C("title")), F.lit("</a>"))
        card = F.concat(
            F.lit('<article data-automation="normalJob"><h3>'), link, F.lit("</h3>"),
            el("a", 'data-automation="jobCompany"', company), el("span", 'data-automation="jobLocation"', C("location")),
            el("span", 'data-automation="jobSalary"', C("salary_raw")), el("span", 'data-automation="jobListingDate"', C("posted_date_raw")),
            el("p", 'data-automation="jobShortDescription"', C("title")), F.lit("</article>"),
        )
    elif kind == "jora":
        slug = F.concat(F.lit("/job/Role-"), F.md5(seq_text()), F.lit("?fsv=true"))
        card = F.concat(
            F.lit('<div class="job-card result"><a class="job-link" href="'), slug, F.lit('">'), escaped(C("title")), F.lit("</a>"),
            F.lit('<div class="job-info">'), el("span", 'class="job-company"', company), el("a", 'class="job-location clickable"', C("location")),
            F.lit("</div>"), el("div", 'class="job-abstract"', C("title")), el("span", 'class="job-listed-date"', C("posted_date_raw")), F.lit("</div>"),
        )
    else:
        urn = F.when(C("seq") % 2 == 0, F.concat(F.lit(' data-entity-urn="urn:li:jobPosting:'), seq_text(), F.lit('"'))).otherwise(F.lit(""))
        card = F.concat(
            F.lit('<li><div class="base-card job-search-card"'), urn, F.lit('><a class="base-card__full-link" href="https://au.example.com/jobs/view/role-'),
            seq_text(), F.lit('?position=1">x</a>'), el("h3", 'class="base-search-card__title"', C("title")),
            F.lit('<h4 class="base-search-card__subtitle">'), el("a", 'class="hidden-nested-link"', company), F.lit("</h4>"),
            el("span", 'class="job-search-card__location"', C("location")),
            F.lit('<time datetime="2026-06-18">3 days ago</time></div></li>'),
        )
    wrap = lambda i: F.concat(F.lit("<html><body><ul>"), F.array_join(i, "\n"), F.lit("</ul></body></html>"))
    return Feed(kind, "", "", card, wrap)


def state_feed() -> Feed:
    item = struct(
        id=F.when(complete(), C("seq")), title=C("title"), companyName=F.when(C("seq") % 3 != 0, C("company_name")),
        advertiser=struct(description=F.when(C("seq") % 9 == 0, F.lit("Private Advertiser")).otherwise(C("company_name"))),
        locations=F.array(struct(label=C("location"))), salaryLabel=C("salary_raw"), listingDateDisplay=C("posted_date_raw"),
        teaser=F.concat(F.lit('} "{ '), C("title")),
    )
    as_list = lambda i: F.to_json(struct(results=struct(results=struct(jobs=i))))
    keyed = lambda i: F.to_json(struct(results=struct(results=struct(jobs=F.map_from_arrays(F.transform(i, lambda x, n: n.cast("string")), i)))))
    wrap = lambda i: F.concat(
        F.lit("<html><script>window.SEEK_REDUX_DATA = "), F.when(C("page_no") % 2 == 0, as_list(i)).otherwise(keyed(i)), F.lit(";\nfoo();</script></html>")
    )
    return Feed("seek", "", "", item, wrap)


def feed_rows(rows: DataFrame, label: str, with_description: bool = True) -> DataFrame:
    body = text.description_hash(C("description")) if with_description else F.lit(None).cast("string")
    return rows.select(
        F.lit(label).alias("feed"), "title", "company_name", "apply_url", "source_job_id", "location", "posted_date_raw",
        body.alias("body_hash"),
    )


@query
def ingest_json_list(spark, sf_dir):
    listed = feed_rows(json_feeds.workday(paged(spark, sf_dir, workday_feed())), "list", False)
    return listed.unionByName(feed_rows(json_feeds.greenhouse(paged(spark, sf_dir, greenhouse_feed())), "board_jobs"))


@query
def ingest_json_nested(spark, sf_dir):
    jobs = feed_rows(json_feeds.phenom_jobs(paged(spark, sf_dir, phenom_feed())), "api_jobs", False)
    widgets = json_feeds.phenom_widgets(paged(spark, sf_dir, widget_feed()), country_words=("australia", "au"))
    smart = json_feeds.smartrecruiters(paged(spark, sf_dir, smart_feed()))
    return jobs.unionByName(feed_rows(widgets, "widgets")).unionByName(feed_rows(smart, "content", False))


@query
def ingest_epoch_millis(spark, sf_dir):
    return feed_rows(json_feeds.lever(paged(spark, sf_dir, lever_feed())), "postings_array")


@query
def ingest_xml_items(spark, sf_dir):
    return feed_rows(xml_feeds.rss(paged(spark, sf_dir, rss_feed())), "rss")


@query
def feed_files(spark, sf_dir):
    """A folder of feed files: the rows of each, and the broken files by reason."""
    folder = scratch_dir(spark, "feeds")
    paged(spark, sf_dir, rss_feed()).select("payload").write.option("maxRecordsPerFile", 1).text(folder)
    rows, errors = xml_feeds.rss_files(spark, f"{folder}/*.txt", "official_ats", "bega", "Bega Group")
    found = rows.select("apply_url", "title", "location", F.lit(None).cast("string").alias("reason"))
    # A file's name is Spark's own, so broken files are counted.
    bad = errors.select(F.lit(None).cast("string").alias("apply_url"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("location"), "reason")
    return found.unionByName(bad)


@query
def ingest_detail_join(spark, sf_dir):
    body = F.to_json(struct(jobPostingInfo=struct(jobDescription=F.concat(F.lit("<div><p>"), escaped(C("description")), F.lit("</p></div>")))))
    details = postings_raw(spark, sf_dir).where("seq % 3 <> 0").select(
        F.lit("official_ats").alias("source"), F.lit("bega").alias("company_id"),
        F.concat(F.lit("/job/"), seq_text()).alias("detail_key"), body.alias("payload"), F.timestamp_seconds(F.lit(2)).alias("landed_at"),
    )
    rows = json_feeds.workday(paged(spark, sf_dir, workday_feed()))
    # Another company has details under the same paths, and older ones of this company exist.
    wrong = details.withColumn("payload", F.lit('{"jobPostingInfo":{"jobDescription":"wrong"}}'))
    other = wrong.withColumn("company_id", F.lit("another"))
    details = details.unionByName(other).unionByName(wrong.withColumn("landed_at", F.timestamp_seconds(F.lit(1))))
    path = F.regexp_extract("apply_url", "(/job/[0-9]+)$", 1)
    joined = json_feeds.with_details(rows, path, json_feeds.workday_detail(details))
    return joined.select("apply_url", "title", F.when(C("description").isNotNull(), text.description_hash(C("description"))).alias("body_hash"))


def all_feeds() -> list[Feed]:
    makers = [workday_feed, greenhouse_feed, lever_feed, phenom_feed, widget_feed, smart_feed, rss_feed, state_feed]
    return [card_feed("seek"), *[make() for make in makers]]


@query
def payload_router(spark, sf_dir):
    landed = paged(spark, sf_dir, *all_feeds()).select("page_no", "payload").unionByName(
        table(spark, sf_dir, "pages").select(C("page_id").alias("page_no"), C("html").alias("payload"))
    )
    return landed.groupBy(json_feeds.payload_kind(C("payload")).alias("kind")).agg(F.count("*").alias("n"))


def _landed(spark, sf_dir) -> DataFrame:
    """Bodies of every shape, pages of unknown sites, and what goes wrong: see :func:`_with_trouble`."""
    linked = F.replace("html", F.lit('href="/'), F.lit('href="/job/'))
    raw = table(spark, sf_dir, "pages").select(
        F.lit("site").alias("source"), F.lit(None).cast("string").alias("company_id"), F.lit(None).cast("string").alias("company_name"),
        C("url").alias("base_url"), F.lit("").alias("site"), C("page_id").alias("page_no"), linked.alias("payload"),
    )
    good = paged(spark, sf_dir, *all_feeds())
    board = F.when(C("source") == "seek", F.lit("https://seek.example.com/")).otherwise(C("base_url"))
    return _with_trouble(good.withColumn("base_url", board)).unionByName(raw)


def _with_trouble(good: DataFrame) -> DataFrame:
    """The bodies of :func:`all_feeds`, and more under page numbers that these have: landed twice, of another
    search term, cut off, without links, empty, and of no known shape."""
    listed, board, lever = (C("feed") == k for k in (1, 2, 3))

    def some(asked: Column, every: int, payload: Column) -> Column:
        asked = asked & (C("page_no") % every == 0)
        return F.struct(asked.alias("asked"), F.when(asked, payload).alias("payload"))

    bodies = F.array(
        F.struct(F.lit(True).alias("asked"), C("payload").alias("payload")),
        some(listed, 3, C("payload")), some(board, 2, F.replace("payload", F.lit("ex.com/job/"), F.lit("ex.com/term/"))),
        some(lever, 4, F.expr("substring(payload, 1, length(payload) div 2)")),
        some(listed, 5, F.replace("payload", F.lit("externalPath"), F.lit("path"))),
        some(listed, 6, F.lit('{"jobPostings":[]}')), some(listed, 7, F.lit("")), some(listed, 8, F.lit('{"x":1}')),
    )
    kept = [c for c in good.columns if c not in ("feed", "payload")]
    return good.select(*kept, F.explode(F.filter(bodies, lambda b: b["asked"])).alias("b")).select(*kept, "b.payload")


@query
def ingest_all(spark, sf_dir):
    """Raw postings of all landed bodies; a number belongs to one row."""
    rows = landing.parse_all(_landed(spark, sf_dir))
    same = F.count("*").over(Window.partitionBy("seq")).alias("rows_of_seq")
    return rows.select("source", "company_id", "page_no", big(C("pos"), "pos"), "title", "apply_url", "location", same)


@query
def ingest_errors(spark, sf_dir):
    """Landed bodies without a usable posting, by reason."""
    return landing.ingest_errors(_landed(spark, sf_dir)).select("source", "company_id", "page_no", "kind", "reason")


@query
def body_states(spark, sf_dir):
    """Every landed body is rows, an empty list or an error."""
    states = landing.states_of(landing.account(_landed(spark, sf_dir)))
    return states.groupBy("kind", "state").agg(F.count("*").alias("n"))


@query
def loose_fields(spark, sf_dir):
    """Fields that one feed has, from landed bodies through the run's steps to the stored table."""
    pages = paged(spark, sf_dir, workday_feed(), phenom_feed(), widget_feed(), smart_feed())
    rows = store.with_id(normalize.normalize(landing.parse_all(pages), TODAY))
    stored = store.merge_table(scratch_dir(spark, "loose"), rows, POSTING, F.lit(datetime(2026, 9, 1)))
    return stored.select("apply_url", *[C("extra")[k].alias(k) for k in ("external_path", "slug", "job_id", "ref")])


@query
def source_union(spark, sf_dir):
    """Feeds of different shape side by side; rows of inactive companies drop out."""
    raw = postings_raw(spark, sf_dir)
    dim = enrich.companies(spark)
    boards = raw.where("source <> 'official_ats'").select("seq", "source", "title", "company_id", "salary_raw")
    direct = raw.where("source = 'official_ats'").select("seq", "source", "title", "company_id", "location")
    return landing.source_union(dim, boards, direct).select("seq", "source", "title", "company_id", "location", "salary_raw")


@query
def page_dedup(spark, sf_dir):
    """Postings landed over overlapping pages: the first page that shows a title keeps it."""
    raw = postings_raw(spark, sf_dir).select("source", "title", "company_name", "seq", F.floor(C("seq") / 20).alias("page_no"))
    return landing.keep_first(raw, ["source", "title", "company_name"], ["page_no", "seq"])


@query
def title_tail_location(spark, sf_dir):
    return postings_raw(spark, sf_dir).select("seq", text.title_tail_location(C("title")).alias("place"))


@query
def html_links(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages")).select("page_id", "url", "html")
    found = html.anchor_postings(pages, "html", "url", any_link=True)
    return found.select("page_id", big(C("pos"), "pos"), "title", "apply_url")


@query
def html_extract(spark, sf_dir):
    boards = [("seek", html.SEEK_CARDS), ("jora", html.JORA_CARDS), ("linkedin", html.LINKEDIN_CARDS)]
    union = None
    for kind, config in boards:
        found = html.cards(paged(spark, sf_dir, card_feed(kind)), "payload", config, ["page_no"])
        rows = html.board_postings(found, kind, f"https://{kind}.example.com").drop("page_no", "pos")
        union = rows if union is None else union.unionByName(rows)
    return union


@query
def html_extract_pages(spark, sf_dir):
    """Configured extraction over the real pages: navigation items as cards."""
    pages = spread(table(spark, sf_dir, "pages"))
    config = {"item": ["nav li"], "title": ["a"], "link": ["a@href"]}
    found = html.cards(pages, "html", config, ["page_id"])
    return found.select("page_id", big(C("pos"), "pos"), "title", "link")


@query
def html_embedded_json(spark, sf_dir):
    rows = html.embedded_json(paged(spark, sf_dir, state_feed()).select("page_no", "payload"), "payload", "https://seek.example.com")
    return rows.drop("page_no", "pos")


@query
def url_job_id(spark, sf_dir):
    page = C("page_id").cast("string")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        urls.job_id(F.concat(C("url"), F.lit("/job/"), page), "seek").alias("plain"),
        urls.job_id(F.concat(F.lit("https://h/job/"), page, F.lit("?type=standard")), "seek").alias("seek"),
        urls.job_id(F.concat(F.lit("https://h/job/Role-"), F.md5(page), F.lit("?fsv=true")), "jora").alias("jora"),
        urls.job_id(
            F.concat(F.lit("https://h/jobs/view/a-role-"), page, F.lit("?p=1")), "linkedin",
            F.when(C("page_id") % 2 == 0, F.concat(F.lit("urn:li:jobPosting:9"), page)),
        ).alias("linkedin"),
    )


@query
def url_canonical(spark, sf_dir):
    url = C("url")
    path = F.regexp_replace(url, "^https?://[^/]*", "")
    return table(spark, sf_dir, "pages").select(
        "page_id", urls.canonical(url, F.lit("https://b.example")).alias("canonical"),
        urls.canonical(path, F.lit("https://b.example/")).alias("resolved"),
        urls.set_query_param(url, "page", F.lit(3)).alias("paged"),
    )


# -- streaming ----------------------------------------------------------------------
def _events_stream(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return ingest.file_stream(spark, f"{sf_dir}/events.parquet", schema)


@query
def stream_source_counts(spark, sf_dir):
    out, state = scratch_dir(spark, "counts"), scratch_dir(spark, "counts-state")
    counts = ingest.daily_counts(_events_stream(spark, sf_dir), "ts", "event_type", late_days=60)
    ingest.keep_days(counts, out, state).awaitTermination()
    return spark.read.schema("source string, n long, day string").parquet(out)


@query
def source_counts(spark, sf_dir):
    return ingest.daily_counts(table(spark, sf_dir, "events"), "ts", "event_type")


@query
def stream_dedup(spark, sf_dir):
    out, state = scratch_dir(spark, "firsts"), scratch_dir(spark, "firsts-state")
    events = _events_stream(spark, sf_dir).select("user_id", "event_type", C("ts").cast("timestamp").alias("ts"))
    ingest.append_to(ingest.keep_first(events, ["user_id", "event_type"], "ts"), out, state).awaitTermination()
    return spark.read.parquet(out).select("user_id", "event_type")


@query
def stream_first(spark, sf_dir):
    """Events land in waves, one in ten of them a wave late; the stream is started again after each."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", C("ts").cast("timestamp").alias("ts"))
    wave = F.floor((F.dayofmonth("ts") - 1) / 10) + (C("event_id") % 10 == 0).cast("int")
    zone, out, state = (scratch_dir(spark, n) for n in ("waves", "earliest", "earliest-state"))
    for k in range(5):
        events.where(wave == k).write.mode("append").parquet(zone)
        landed = ingest.file_stream(spark, zone, events.schema, files_per_batch=1_000_000)
        told = firsts.keep_earliest(landed, ["user_id", "event_type"], "ts", gap_days=1, late_days=3)
        firsts.start(told, out, state, spark.sparkContext.defaultParallelism).awaitTermination()
    told = spark.read.schema("user_id long, event_type string, ts timestamp, kind string").parquet(out)
    return told.select("user_id", "event_type", "ts", "kind")


def _stream_postings(docs: DataFrame) -> DataFrame:
    return store.with_id(normalize.normalize(raw_of(docs), TODAY).drop("description"))


@query
def stream_ingest(spark, sf_dir):
    schema = table(spark, sf_dir, "documents").schema
    landed = ingest.file_stream(spark, f"{sf_dir}/documents.parquet", schema)
    out, state = scratch_dir(spark, "table"), scratch_dir(spark, "table-state")
    ingest.ingest(landed, _stream_postings, out, POSTING, state).awaitTermination()
    stored = store.read_table(spark, out, POSTING)
    # Both times are the batch's own, so they agree and lie within this run.
    recent = (C("first_seen") == C("last_seen")) & (C("first_seen") > F.current_timestamp() - F.expr("INTERVAL 1 DAY"))
    return stored.select("id", "seq", "title", "status", recent.alias("seen_now"))


@query
def stream_run(spark, sf_dir):
    """The whole run over three lots of files, one after the other: the table as one run over all would leave it.

    A lot lands as many files as tasks read it; the stream is started again after each, so a lot is a batch.
    """
    docs = table(spark, sf_dir, "documents")
    third = -(-docs.count() // 9) * 3  # documents come in groups of three
    landing_zone, out, index, state = (scratch_dir(spark, n) for n in ("landing", "run-table", "run-index", "run-state"))
    for k in range(3):
        part = docs.where((C("doc_id") >= k * third) & ((C("doc_id") < (k + 1) * third) | F.lit(k == 2)))
        part.write.mode("append").parquet(landing_zone)
        landed = ingest.file_stream(spark, landing_zone, docs.schema, files_per_batch=1_000_000)
        ingest.run_stream(
            landed, raw_of, enrich.companies(spark), enrich.ratings(spark), lambda df: with_similarity(df, spark, sf_dir), TODAY, out, index, state
        ).awaitTermination()
    stored = store.read_table(spark, out, POSTING)
    return stored.select("id", "status", "duplicate_of", "priority_tier", *rounded("final_score"))


# -- whole run -------------------------------------------------------------------------
def full_run(spark, sf_dir, table_path=None):
    raw = postings_raw(spark, sf_dir)
    similarity = with_similarity(raw.select("seq"), spark, sf_dir)
    return run_plan(
        raw, enrich.companies(spark), enrich.ratings(spark), similarity, TODAY, F.lit(datetime(2026, 9, 1)), table_path
    )


@query
def pipeline_run(spark, sf_dir):
    """Distinct postings of the whole run with their scores."""
    rows = full_run(spark, sf_dir).postings.where("status <> 'duplicate'")
    return rows.select("seq", "status", "priority_tier", *rounded("final_score"))


@query
def seniority_top(spark, sf_dir):
    """The 20 best distinct postings by seniority score."""
    rows = norm(spark, sf_dir)
    first = resolve.pass1(resolve.slim(rows)).select("seq")
    ranked = rows.join(first, "seq", "left_semi").withColumn("category", classify.seniority("title")).select(
        "seq", "title", score.seniority_score("category").alias("seniority_score")
    )
    return ranked.orderBy(C("seniority_score").desc(), "seq").limit(20).select("seq", "title", *rounded("seniority_score"))
