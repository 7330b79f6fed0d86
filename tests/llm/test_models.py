import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postlens.llm import langid, lm, quality, sample
from postlens.llm import wordbytes as wb

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, score string, held_out string"


def held(doc_id, folds):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 2


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_of_held_out_documents(spark, documents):
    rows = langid.identify(documents.withColumn("extra", F.lit(1))).collect()
    assert len(rows) == documents.count() and "extra" in rows[0].asDict()
    out = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in rows if held(r["doc_id"], 4)}
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def plain_language(model, text):
    """The language of a text from the learned tables, word by word in plain Python."""
    low = (text or "").lower()
    found = re.findall(rb"[a-z\x80-\xff]+", low.encode())
    tables = [{int(k): row for k, row in zip(keys, scores, strict=True)} for keys, scores in model.tables]

    def hashes(word, k):
        words = wb.Words(pa.array([word.decode()]), langid.LETTERS, lower=False)
        return words.hashes() if k == 0 else langid._grams(words, np.array([0]), k)[0]

    total = np.array(model.prior, float)
    for word in found:
        for k in (0, *range(langid.LONGEST, 0, -1)):
            seen = [tables[k][int(h)] for h in hashes(word, k) if int(h) in tables[k]]
            if seen:
                total += sum(seen) / len(seen)
                break
    calm = np.exp((total - total.max()) / math.sqrt(max(1, len(found))))
    if not any(c.isalpha() for c in low):
        return "und", 0.0
    return model.langs[int(total.argmax())], float(calm.max() / calm.sum())


def test_language_agrees_with_plain_scoring_on_any_partitioning(spark, documents):
    some = documents.select("doc_id", "text", "lang").where("doc_id < 160")
    odd = spark.createDataFrame([(-1, "Ünseen wörds zzqx", None), (-2, None, "en"), (-3, "42", None)], "doc_id long, text string, lang string")
    docs = some.union(odd)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = langid.train(docs)
    runs = []
    for parts in (1, 16):
        rows = langid.identify(docs.repartition(parts)).collect()
        runs.append(sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in rows))
    assert runs[0] == runs[1]
    for doc_id, lang, score in runs[0]:
        want = plain_language(model, texts[doc_id])
        assert lang == want[0] and abs(score - want[1]) < 1e-9


def test_a_rare_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_DOCS", 40)
    rows = [(i, "the house and the garden of words", "en") for i in range(3000)]
    rows += [(5000 + i, f"talo ja puutarha sekä sanoja {i}", "fi") for i in range(12)] + [(9000, "talo ja sanoja", None), (9001, "the garden", None)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[9000] == "fi" and got[9001] == "en" and all(got[5000 + i] == "fi" for i in range(12))


def test_samples_are_bounded_whatever_repeats(spark):
    ids = [i for i in range(400) if not held(i, 4)]
    docs = spark.createDataFrame([(ids[0], f"text {i % 7}") for i in range(3000)] + [(i, "other") for i in ids[1:]], "doc_id long, text string")
    chosen = docs.select("doc_id").distinct().withColumn("label", F.lit(1))
    assert sample.bounded(docs, chosen, ["doc_id"]).count() == len(ids)
    keys = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b")).select("doc_id", "lang")
    drawn = sample.lowest(keys, 20, 7, "lang").collect()
    assert len(drawn) == len(set(drawn)) and max(collections.Counter(r["lang"] for r in drawn).values()) <= 20
    again = sample.lowest(keys.repartition(9), 20, 7, "lang").collect()
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, again))


def test_language_of_odd_texts(spark, documents):
    learned = documents.select("doc_id", "text", "lang").limit(200)
    odd = [(-1, None, None), (-2, "", "en"), (-3, "12 34 !!", "de"), (-4, "— ·", "fr"), (-5, "Ж", None), (None, "the and of", None), (-7, "x" * 300_000, None)]
    rows = langid.identify(learned.union(spark.createDataFrame(odd, "doc_id long, text string, lang string")).repartition(3)).collect()
    got = {r["doc_id"]: r for r in rows}
    assert all((got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0) for d in (-1, -2, -3, -4))
    assert got[-5]["lang_pred"] != "und" and got[None]["lang_pred"] == "en" and got[None]["held_out"] is False
    assert len(rows) == 207 and got[-7]["score"] <= 1


def test_language_without_training_or_documents(spark):
    df = spark.createDataFrame([(1, "the and", None, "s", "h")], DOCS)
    row = langid.identify(df).first()
    assert (row["lang_pred"], row["score"]) == ("und", 0.0)
    assert langid.identify(df.limit(0)).count() == 0


def test_unseen_words_back_off_to_shorter_grams():
    words = langid._words(pa.array(["abc abd"]))
    hashes = words.hashes()
    tables = [(np.zeros(0, np.uint64), np.zeros((0, 2)))] * (langid.LONGEST + 1)
    gram, _ = langid._grams(words, np.array([0, 1]), 2)
    keys = np.unique(gram)
    scores = np.zeros((len(keys), 2))
    scores[:, 1] = -1.0
    tables[2] = (keys, scores)
    model = langid.Model(["a", "b"], np.zeros(2), tables)
    got = model.word_scores(words, np.array([0, 1]), hashes)
    assert got.tolist() == [[0.0, -1.0], [0.0, -1.0]]


def test_quality_of_held_out_documents(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.classify(documents, labels).join(labels, "doc_id", "left").collect()
    assert len(rows) == documents.count()
    out = [r for r in rows if r["held_out"] and r["quality"] is not None]
    assert sum(r["predicted"] == r["quality"] for r in out) / len(out) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_quality_agrees_with_plain_scoring(spark, documents):
    docs = documents.select("doc_id", "text").where("doc_id < 120")
    vectors, weights = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    for r in quality.score(docs, vectors, weights, ["doc_id", "text"]).collect():
        found = [b for bucket, _ in quality.features(pa.array([r["text"]])) for b in bucket.tolist()]
        hidden = np.mean([vectors[b] for b in found], 0) if found else np.zeros(quality.DIM)
        logit = weights[:, :-1].astype(float) @ hidden + weights[:, -1]
        want = math.exp(logit[1] - logit.max()) / sum(math.exp(x - logit.max()) for x in logit)
        assert abs(r["score"] - want) < 1e-5


def test_quality_of_odd_texts_and_labels(spark, documents):
    odd = [(-1, None), (-2, ""), (-3, " \n"), (None, "a"), (-5, "y" * 200_000)]
    docs = documents.select("doc_id", "text").limit(150).union(spark.createDataFrame(odd, "doc_id long, text string"))
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    labels = labels.union(labels.limit(5)).union(spark.createDataFrame([(None, 1), (3, None), (4, 9)], "doc_id long, quality int"))
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 155 and all(0 <= r["score"] <= 1 for r in rows)
    none = quality.classify(docs.limit(3), labels.limit(0)).collect()
    assert [r["score"] for r in none] == [0.5] * 3
    assert quality.classify(docs.limit(0), labels).count() == 0


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


@pytest.mark.parametrize("run_bytes", [8 << 20, 2000])
def test_language_model_agrees_with_brute_force(spark, documents, monkeypatch, run_bytes):
    odd = [(None, "The the THE"), (-1, None), (-2, ""), (-2, ""), (-3, "new " * 700), (7, "the end")]
    docs = documents.select("doc_id", "text").where("doc_id < 120").union(spark.createDataFrame(odd, "doc_id long, text string")).repartition(3)
    all_docs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    one, two, ctx = collections.Counter(), collections.Counter(), collections.Counter()
    n_train = 0
    for d, text in all_docs:
        if not held(d, 7):
            t = tokens(text)
            one.update(t)
            two.update(zip(["<s>", *t], t, strict=False))
            n_train += 1
    total, types = sum(one.values()), len(one)
    ctx = {**one, "<s>": n_train}
    seen = {}
    monkeypatch.setattr(lm, "learn", lambda cells, n, t, f=lm.learn: seen.setdefault("w", f(cells, n, t)))
    rows = lm.score(docs, run_bytes).collect()
    weights = seen["w"]
    assert np.allclose(weights.sum(1), 1) and (weights > 0).all()
    want = []
    for d, text in all_docs:
        t = tokens(text)
        base = sum(math.log10((one[w] + 1) / (total + types + 1)) for w in t)
        model = 0.0
        for v, w in zip(["<s>", *t], t, strict=False):
            c = ctx.get(v, 0)
            a, b, u = weights[int(math.log2(c)) + 1 if c else 0]
            model += math.log10(a * two[v, w] / max(c, 1) + b * one[w] / total + u / (types + 1))
        want.append((str(d), held(d, 7), len(t), sum(one[w] > 0 for w in t), total, round(base, 6), round(model, 6)))
    got = [
        (str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6))
        for r in rows
    ]
    assert sorted(got) == sorted(want)


def test_interpolation_beats_the_base_on_held_out_text(spark, documents):
    rows = [r for r in lm.score(documents.select("doc_id", "text")).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_language_model_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(df).count() == 0
    held_id = next(i for i in range(99) if held(i, 7))
    row = lm.score(spark.createDataFrame([(held_id, "a b")], "doc_id long, text string")).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)


def test_expectation_maximisation_finds_the_better_part():
    cell = lambda two, one: ((3 * lm._CELLS) + two) * lm._CELLS + one
    strong, weak = int(lm._cell(np.array([0.5]))[0]), int(lm._cell(np.array([0.001]))[0])
    weights = lm.learn(np.array([cell(strong, weak)]), np.array([100]), 1000)
    assert weights[3][0] > 0.95
    weights = lm.learn(np.array([cell(lm._CELLS - 1, weak)]), np.array([100]), 10**9)
    assert weights[3][1] > 0.95
