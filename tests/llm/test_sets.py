import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postlens.llm import decontam, jaccard
from postlens.llm import wordbytes as wb

DOCS = "doc_id long, text string, key string, size string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é0-_.\n\t \x00", max_size=40)), max_size=6))
def test_words_agree_with_regex(texts):
    for kind, pattern in ((wb.NOT_SPACE, rb"[^\x20\x09-\x0D]+"), (wb.ALPHANUMERIC, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        words = wb.Words(pa.array(texts, pa.string()), kind)
        want = [re.findall(pattern, lower(t).encode()) for t in texts]
        got = [words.text_of(a, b).split(b" ") if b > a else [] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        assert got == want
        hashes = words.hashes().tolist()
        flat = [w for ws in want for w in ws]
        assert len({*zip(flat, hashes, strict=True)}) == len(set(flat)) == len(set(hashes))


def test_hashes_do_not_depend_on_the_run(monkeypatch):
    texts = pa.array(["one two three " * 50, "x" * 9000 + " y", "one"])
    whole = wb.Words(texts, wb.NOT_SPACE).hashes()
    monkeypatch.setattr(wb, "_HASH_BYTES", 16)
    assert (wb.Words(texts, wb.NOT_SPACE).hashes() == whole).all()
    assert (wb.Words(texts.slice(1, 1), wb.NOT_SPACE).hashes() == whole[150:152]).all()


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def expected_components(docs):
    sets = [shingle_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    smallest = {}
    for i, (d, _) in enumerate(docs):
        smallest[find(i)] = min(smallest.get(find(i), d), d)
    return sorted((d, len(sets[i]), smallest[find(i)]) for i, (d, _) in enumerate(docs))


def near_copies(seed, n, passage_words=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(passage_words)]
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.6:
            w = docs[rng.randrange(len(docs))][1].split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                if w:
                    at = rng.randrange(len(w))
                    w[at : at + rng.choice([0, 1])] = rng.choice([[], [rng.choice(vocabulary)]])
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 7, 12, 40, 90, 200]))]
            at = rng.randint(0, len(w))
            w[at:at] = passage
        docs.append((i, " ".join(w)))
    return docs


def run_components(spark, docs):
    df = spark.createDataFrame([(d, t, "k", "s") for d, t in docs], DOCS)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.components(df).collect())


@pytest.mark.parametrize("seed,passage", [(1, 0), (2, 30)])
def test_components_agree_with_all_pairs(spark, seed, passage):
    docs = near_copies(seed, 260, passage)
    docs += [(1000, ""), (1001, " \n"), (1002, docs[5][1].upper()), (1003, docs[5][1]), (1004, "One"), (1005, "one"), (1006, "two words")]
    assert run_components(spark, docs) == expected_components(docs)


def test_components_with_null_and_repeated_rows(spark):
    df = spark.createDataFrame(
        [(1, None), (2, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u v"), (3, "")], "doc_id long, text string"
    )
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.components(df).collect()), key=str)
    assert got == sorted([(1, 1), (2, 2), (2, 2), (None, 2), (None, None), (3, 3)], key=str)
    assert jaccard.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("worth", [1, 2])
@pytest.mark.parametrize("common", [0, 40])
def test_linked_sets_share_a_signature(worth, common):
    """The pigeonhole with either allocation, with and without common tokens, straight from the signatures."""
    rng = np.random.default_rng(7 * worth + common)
    shared = np.sort(rng.integers(1, 1 << 63, 400, dtype=np.uint64)) if common else np.zeros(0, np.uint64)
    for size in (4, 6, 9, 15, 33, 70, 150):
        base = np.unique(np.concatenate((rng.integers(1, 1 << 63, size, dtype=np.uint64), rng.choice(shared, size // 2) if common else shared[:0])))
        plan = [
            jaccard.Family(f.number, f.low, f.high, f.larger, -(-(f.segments * f.worth) // worth), worth,
                           -(-(f.segments * f.worth) // worth) * worth - jaccard.most_apart(f.low, f.high) - 1)
            for f in jaccard.families(400, {size: 10}, 0.1)
        ]
        for _ in range(40):
            keep = int(np.ceil(len(base) * 0.75))
            other = rng.choice(base, rng.integers(keep, len(base) + 1), replace=False)
            extra = rng.integers(1, 1 << 63, rng.integers(0, len(base) // 3 + 1), dtype=np.uint64)
            other = np.unique(np.concatenate((other, extra)))
            inter = len(np.intersect1d(base, other))
            if 100 * inter < 75 * (len(base) + len(other) - inter) or np.array_equal(base, other):
                continue
            found = []
            for tokens in (base, other):
                sets = object.__new__(jaccard.Sets)
                sets.token, sets.row = tokens, np.zeros(len(tokens), int)
                sets.size, sets.first = np.array([len(tokens)]), np.array([0, len(tokens)])
                found.append(set(np.concatenate([s for _, s, _ in jaccard._signatures(sets, plan, shared)]).tolist()))
            assert found[0] & found[1]


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (5, 40, 300, 5000):
        a = rng.integers(1, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate((a[n // 5 :], rng.integers(1, 1 << 63, n // 4, dtype=np.uint64)))
        sketches = []
        for tokens in (a, b):
            sets = object.__new__(jaccard.Sets)
            sets.token, sets.size, sets.first = np.sort(tokens), np.array([len(tokens)]), np.array([0, len(tokens)])
            sketches.append(jaccard._sketches(sets)[0])
        apart = len(np.setxor1d(a, b))
        assert jaccard.differ(*sketches) <= apart and jaccard.differ(sketches[0], sketches[0]) == 0


def test_one_document_of_each_group_stays(spark):
    docs = near_copies(5, 120)
    docs += [(0, docs[0][1]), (500, ""), (500, ""), (None, "quite other words that nobody else has here")]
    df = spark.createDataFrame([(d, t, "k", "s") for d, t in docs], DOCS)
    kept = jaccard.drop_near_duplicates(df)
    assert kept.columns == df.columns
    want = {(d, c) for d, n, c in expected_components(docs[:-1]) if d == c}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in got if x is not None and x != 500) == sorted({d for d, _ in want} - {500})
    assert got.count(500) == 2 and got.count(None) == 1


def test_unrelated_rows_with_null_or_repeated_ids_all_stay(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(12))
    alone = [(None, text("a")), (None, text("b")), (None, text("c")), (7, text("d")), (7, text("e")), (3, text("f"))]
    copies = [(None, text("a")), (7, text("d")), (7, text("f")), (None, text("f"))]
    df = spark.createDataFrame(alone + copies, "doc_id long, text string").repartition(3)
    kept = [(r["doc_id"], r["text"]) for r in jaccard.drop_near_duplicates(df).collect()]
    assert sorted(kept, key=str) == sorted(alone, key=str)


def expected_hits(docs, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {}
    for item, text in items:
        w = re.findall(pattern, lower(text))
        if item is None or not w:
            continue
        n = min(13, len(w))
        for i in range(len(w) - n + 1):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for d, text in docs:
        w = re.findall(pattern, lower(text))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= owners
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block,counted", [(250_000, 8_000_000), (9, 50)])
def test_contamination_agrees_with_brute_force(spark, monkeypatch, block, counted):
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", block)
    monkeypatch.setattr(decontam, "COUNTED", counted)
    rng = random.Random(11)
    word = lambda: rng.choice(["the", "of", "Éa", "x1", "and"]) if rng.random() < 0.5 else f"w{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 4, 5, 9, 13, 14, 30])))) for i in range(12)]
    items += [(3, items[3][1]), (50, items[4][1]), (60, None), (61, "..."), (None, "w1 w2 w3"), (70, "never ever seen words " * 6)]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randint(0, len(w))
            w[at:at] = (rng.choice(items)[1] or "").upper().split()
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    docs += [(100, None), (101, ""), (102, "?!"), (100, None), (None, items[5][1])]
    df = spark.createDataFrame([(d, t, "k", "s") for d, t in docs], DOCS).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.contamination(df, bench)
    assert rows.columns[:4] == df.columns
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows.collect()), key=str)
    assert got == expected_hits(docs, items)


def test_contamination_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c", 5)], "doc_id long, text string, n_hit int")
    row = decontam.contamination(docs, none).first()
    assert (row["n_words"], row["n_hit"], row["contaminated"]) == (3, 0, False)
    assert decontam.contamination(docs.limit(0), none).count() == 0
