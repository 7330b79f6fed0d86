"""Every registered operator and the pipeline on odd tables: nulls in any column, empty and very
long texts, ties and repeated rows, empty tables, and extra columns whose names clash."""

import collections
import random

import pytest
from test_audits import expected as expected_fingerprints
from test_sets import expected_components, expected_hits
from test_sharding_mixing_lines import expected_mix

import corpus_pipeline
from postlens.llm import oracles, queries

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}
# Names that operators give columns of their own.
CLASHING = {
    "documents": [
        "size", "n", "n_words", "n_hit", "held_out", "score", "law", "shard", "slot", "row_no", "part", "rank", "component_id", "class", "token",
        "gram", "copies", "copy", "taken", "target", "source_size", "quality", "label", "words", "row_id", "held", "lang_pred", "hash", "key",
    ],
    "embeddings": ["n", "size", "score", "rank", "query_id", "component", "block", "cell"],
    "benchmark": ["n_words", "n_hit", "gram", "words", "size", "n", "place", "spot", "doc_id"],
    "labels": ["text", "label", "held_out", "score", "source"],
    "conversations": ["n", "size", "tokens", "start", "window", "doc_id"],
}


def long_text(seed, n=150_000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def odd_rows():
    passage = " ".join(f"the and of item{i}" for i in range(8))
    long = long_text(1)
    documents = [
        (1, long, "en", "hot", len(long)),
        (2, long + " end", "en", "hot", 1),
        (3, "the " + "x" * 300_000 + " and of with that", "en", "a", None),
        (4, "the and of with that only " + passage, "en", None, 3),
        (4, "the and of with that only " + passage, "en", None, 3),
        (5, "the and of", "en", "a", 0),
        (5, "the and with", "en", "a", 0),
        (6, "der und nicht ein haus zeit", "de", "b", 1),
        (7, "der und nicht ein haus jahr wenn auch", "de", "b", 1),
        (8, "", "en", "", 0),
        (9, None, None, None, None),
        (None, None, None, None, None),
        (None, "the and of with that only there", "en", "a", 2),
        (None, "the and of with that only there", "en", "a", 2),
        (-3, " \t\n ", "de", "a", 3),
        (12, "12 34 ...", None, "b", 9),
        (13, "The AND of with That only THERE", None, None, None),
    ]
    vectors = [(100, [1.0, 2.0]), (100, [1.0, 2.0]), (200, None), (300, []), (3, [float("nan"), 1.0]), (4, [1.0, None]), (None, [2.0, 1.0]),
               (5, [2.0, 1.0]), (6, [1.0, 2.0]), (7, [1.0]), (0, [-0.5, 3.0])]
    return {
        "documents": documents,
        "embeddings": [(i, v, None) for i, v in vectors],
        "benchmark": [(1, passage), (1, passage), (2, None), (3, ""), (None, passage), (4, "never seen here"), (5, long_text(7, 3000))],
        "labels": [(1, 1, 0), (1, 0, 0), (4, 1, None), (5, 0, 1), (6, None, None), (None, 1, 1), (7, 0, 0), (99, 1, 0)],
        "conversations": [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", "again"), (2, 0, "assistant", long_text(3, 60_000)),
                          (2, 1, None, "no role"), (3, None, "user", "no turn"), (None, 0, "user", "no conversation"), (4, 0, "system", "alone")],
    }


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """Odd rows, the same rows with clashing columns, and no rows."""
    out = {}
    for name in ("plain", "clashing", "empty"):
        out[name] = folder = str(tmp_path_factory.mktemp(name))
        for table, rows in odd_rows().items():
            df = spark.createDataFrame([] if name == "empty" else rows, SCHEMAS[table])
            if name == "clashing":
                df = df.selectExpr("*", *(f"'{c}' AS `{c}`" for c in CLASHING[table] if c not in df.columns))
            df.repartition(3).write.parquet(f"{folder}/{table}.parquet")
    return out


def told(rows):
    return collections.Counter(tuple(sorted((k, str(v)) for k, v in r.asDict().items())) for r in rows)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_extra_columns_change_nothing(spark, folders, name):
    plain = queries.QUERIES[name](spark, folders["plain"])
    clashing = queries.QUERIES[name](spark, folders["clashing"])
    rows = plain.collect()
    assert plain.columns == clashing.columns and told(rows) == told(clashing.collect())
    if "doc_id" in plain.columns:
        assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(d[0] for d in odd_rows()["documents"])


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables_give_no_rows(spark, folders, name):
    rows = queries.QUERIES[name](spark, folders["empty"]).collect()
    assert len(rows) == (1 if name == "op3_chat_windows" else 0)  # the conversation that the query plants


def without_ids(rows, marks):
    """Rows without doc_id stood for by numbers above all ids, and back."""
    return sorted((tuple(None if isinstance(x, int) and x >= marks else x for x in r) for r in rows), key=str)


def test_odd_rows_agree_with_brute_force(spark, folders):
    docs, items = [d[:2] for d in odd_rows()["documents"]], odd_rows()["benchmark"]

    def got(name, *columns):
        return sorted((tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, folders["plain"]).collect()), key=str)

    marked = [(10**9 + i if d is None else d, t) for i, (d, t) in enumerate(docs)]
    assert got("op4_ngram_jaccard", "doc_id", "n_shingles", "component_id") == without_ids(expected_components(marked), 10**9)
    hits = got("op8_benchmark_decontamination", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert hits == expected_hits(docs, items)
    assert got("op12_simhash_near_dedup", "doc_id", "fingerprint", "component_id") == sorted(expected_fingerprints(docs), key=str)


@pytest.mark.parametrize("kind", ["plain", "clashing"])
def test_pipeline_on_odd_rows(spark, folders, tmp_path, kind):
    folder = folders[kind]
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns, frames = now.columns, []
    extra = [c for c in columns if c in CLASHING["documents"]]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, folder).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        frames.append([r.asDict() for r in now.collect()])
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == columns and all(r[c] == c for r in frames[-1] for c in extra)
    named, kept, clean, mixed, sharded = frames

    def facts(rows):
        return sorted(((r["doc_id"], r["text"], r["source"]) for r in rows), key=str)

    lettered = [(d, t, s) for d, t, _, s, _ in odd_rows()["documents"] if any(c.isalpha() for c in t or "")]
    assert facts(named) == sorted(lettered, key=str)  # texts without a letter go, no others
    assert sorted(r["doc_id"] for r in kept) == [1, 3, 4, 5, 5, 6, 7, 13]
    assert sorted(r["doc_id"] for r in clean) == [1, 3, 5, 5, 6, 7, 13]
    rate = {m[0]: m[3] / m[2] for m in expected_mix(facts(clean))}
    copies = collections.Counter(facts(mixed))
    assert set(copies) <= set(facts(clean)) and all(copies[f] - int(rate[f[0]]) in (0, 1) for f in facts(clean))
    assert facts(sharded) == facts(mixed)
    sizes = collections.Counter(r["shard"] for r in sharded)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(16)) <= 1


def test_pipeline_on_no_rows(spark, folders):
    assert corpus_pipeline.run(spark, folders["empty"]).count() == 0


def test_sql_is_given_for_registered_queries_only():
    assert set(oracles.SQL) <= set(queries.QUERIES)
