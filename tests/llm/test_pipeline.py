"""The pipeline on a small fixture, stage by stage and as a whole, against brute force."""

import random

import pytest
from test_sets import expected_components, expected_hits
from test_sharding_mixing_lines import expected_mix

import corpus_pipeline

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = {
    "en": ["the", "and", "of", "with", "that", "shore", "bring", "when", "think", "house", "only", "there"],
    "de": ["der", "und", "nicht", "über", "schön", "ein", "haus", "straße", "wenn", "auch", "zeit", "jahr"],
}


def fixture(folder, spark):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice(VOCABULARY["en"]) for _ in range(20))) for i in range(4)]
    docs = []
    for i in range(150):
        lang = rng.choice(["en", "en", "de"])
        words = [rng.choice(VOCABULARY[lang]) + str(rng.randrange(30)) * (rng.random() < 0.2) for _ in range(rng.randint(8, 60))]
        text = " ".join(words)
        if docs and rng.random() < 0.3:
            text = rng.choice(docs)[1] + rng.choice(["", " more", " and more"])
        if rng.random() < 0.1:
            text += " " + rng.choice(items)[1]
        docs.append((i, text, lang, rng.choice(["hot", "hot", "a", "b", None]), len(text)))
    docs += [(200, "12 34", "en", "a", 5), (201, "", "de", "a", 0), (202, None, None, "b", None), (203, "...", None, None, 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(
        f"{folder}/documents.parquet"
    )
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs, items = fixture(folder, spark)
    frames, now = [], spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, folder).write.parquet(f"{folder}/stage{k}")
        now = spark.read.parquet(f"{folder}/stage{k}")
        frames.append(now)
    return folder, docs, items, frames


def rows(df):
    return [tuple(r[c] for c in NAMES) for r in df.collect()]


def test_stages_keep_the_columns_of_documents(ran):
    frames = ran[3]
    assert len(corpus_pipeline.STAGES) == 5 and all(f.columns == NAMES for f in frames[:-1])


def test_language_stage_rejects_only_texts_without_language(ran):
    _, docs, _, frames = ran
    assert sorted(rows(frames[0])) == sorted(d for d in docs if d[0] < 200)


def test_one_of_each_group_of_near_duplicates_stays(ran):
    frames = ran[3]
    before = rows(frames[0])
    want = {d for d, _, c in expected_components([r[:2] for r in before]) if d == c}
    assert sorted(rows(frames[1])) == sorted(r for r in before if r[0] in want) and len(want) < len(before)


def test_contaminated_documents_go(ran):
    _, _, items, frames = ran
    before = rows(frames[1])
    bad = {h[0] for h in expected_hits([r[:2] for r in before], items) if h[-1]}
    assert bad and sorted(rows(frames[2])) == sorted(r for r in before if r[0] not in bad)


def test_mixing_emits_copies(ran):
    frames = ran[3]
    before = {r[0]: r for r in rows(frames[2])}
    want = [before[d] for d, _, _, _, copies in expected_mix([(r[0], r[1], r[3]) for r in before.values()]) for _ in range(copies)]
    assert sorted(rows(frames[3]), key=str) == sorted(want, key=str)


def test_shards_hold_every_row(ran):
    frames = ran[3]
    assert sorted(rows(frames[4]), key=str) == sorted(rows(frames[3]), key=str)
    slots = {}
    for r in frames[4].collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(slots.get(s, [])) for s in range(corpus_pipeline.SHARDS)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_run_gives_the_rows_of_the_stages(spark, ran):
    folder, _, _, frames = ran
    out = corpus_pipeline.run(spark, folder)
    columns = ["doc_id", "shard", "slot"]
    assert sorted(map(tuple, out.select(columns).collect())) == sorted(map(tuple, frames[4].select(columns).collect()))
