"""A corpus pipeline of five stages over the documents table.

Every stage takes (spark, docs, sf_dir) and works on all the rows that the stage before kept;
all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import decontam, jaccard, langid, mixing, sharding
from postlens.llm.batches import small_batches
from postlens.operators.materialize import cut

MIN_LANGUAGE_SCORE = 0.5
SHARDS = 16
# Two stages train a model or follow links without end, which SQL can't express; tests compare
# the run with brute force.
ORACLE_SQL = None


_ASIDE = "_pipeline_aside"


def _aside(docs: DataFrame, *read: str) -> DataFrame:
    """The columns a stage reads, all others in one: operators replace columns named like their own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in read]
    return docs.select(*read, F.struct(*rest).alias(_ASIDE)) if rest else docs


def _restored(docs: DataFrame, *read: str) -> list[Column]:
    return [F.col(c) if c in read else F.col(_ASIDE).getField(c).alias(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: no letters or a score below one half, and they go.

    Null and empty texts have no letters and go; rows of any or no doc_id, and repeated rows,
    are judged by their text alone, so equal texts stay or go together. Where no row has a
    lang to learn from, no language can be told and all go; no rows give no rows.
    """
    small_batches(spark)
    read = ("doc_id", "text", "lang")
    labelled = langid.identify(_aside(docs, *read))
    sure = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return labelled.where(sure).select(*_restored(docs, *read))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, with the smallest doc_id.

    Rows of that doc_id that repeat within the group leave one; a group without any doc_id
    leaves one row too. Null texts and texts without words are in no group and all stay.
    """
    small_batches(spark)
    read = ("doc_id", "text")
    return jaccard.drop_near_duplicates(_aside(docs, *read)).select(*_restored(docs, *read))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark.

    Null and empty texts stay; rows of any or no doc_id are judged by their text. Items
    without an id or a word taint nothing, so an empty benchmark keeps all documents.
    """
    small_batches(spark)
    read = ("doc_id", "text")
    items, packed = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), _aside(docs, *read)
    return decontam.contamination(packed, items, keep=packed.columns).where(~F.col("contaminated")).select(*_restored(docs, *read))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, to meet the target weights of their sources.

    A null source is one of the sources, the last. Texts without words add nothing to a
    source; where a source has no other texts they stay once. Rows equal in doc_id, source
    and text draw alike.
    """
    read = ("doc_id", "text", "source")
    sizes, packed = mixing.sizes_of(docs), _aside(docs, *read)
    sized = packed.withColumns({"size": mixing.n_words(F.col("text")), mixing.MARK: mixing.mark()})
    return mixing.emit(mixing.with_copies(sized, sizes=sizes)).select(*_restored(docs, *read))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot, repeated rows each with its own; columns of those names are replaced."""
    return sharding.shard_rows(docs, [F.col("doc_id"), F.xxhash64("text")], SHARDS)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written as Parquet and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = cut(stage(spark, docs, sf_dir), f"corpus-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
