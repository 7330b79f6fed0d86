"""Embedding whitening, SimHash near duplicates and the source divergence audit against brute force."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from postlens.llm import divergence, simhash, whitening

VECTORS = "vec_id long, embedding array<float>, n string"


def words_of(text, pattern):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(pattern, low.encode())


# -- whitening ---------------------------------------------------------------------
def usable(v):
    return v and all(c is not None and math.isfinite(c) for c in v)


def exact_x(v, scale=256):
    return tuple(math.floor(scale * float(np.float32(c))) for c in v)


def random_vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(dim, dim)) * np.linspace(1, 0.05, dim)
    return [[float(np.float32(c)) for c in rng.normal(size=dim) @ base / 8 + 0.3] for _ in range(n)]


@pytest.mark.parametrize("weigh", [False, True])
def test_whitening_agrees_with_numpy(spark, weigh):
    vectors = random_vectors(300, 12, 3)
    vectors += vectors[:40] * 3 + [vectors[0]] * 200 + [None, [], [1.0, None] + [0.0] * 10, [float("nan")] * 12, [float("inf")] * 12]
    rows = [(i if i % 50 else None, v, "clash") for i, v in enumerate(vectors)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(5), weigh_copies=weigh).collect()
    kept = [(i, exact_x(v)) for i, v, _ in rows if usable(v)]
    assert sorted(((r.vec_id is not None, r.vec_id) for r in got), key=str) == sorted(((i is not None, i) for i, _ in kept), key=str)

    counts = collections.Counter(x for _, x in kept)
    fit = sorted(counts)
    w = np.array([counts[x] if weigh else 1 for x in fit])
    n, total = int(w.sum()), [int(sum(int(a) * b for a, b in zip(w, column))) for column in zip(*fit)]
    x = np.array(fit, float)
    centred = x - np.array(total) / n
    values, axes = np.linalg.eigh((centred * w[:, None]).T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    for r in got:
        mine = exact_x(r.embedding)
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(mine, total))
        want = (np.array(mine) - np.array(total) / n) @ axes[:, :4] / np.sqrt(values[:4])
        assert np.allclose(np.abs(r.whitened), np.abs(want), atol=1e-9)
        assert np.allclose(r.explained, values[:4] / values.sum(), rtol=1e-9)
        assert r.identity_error < 1e-9
    by_vector = collections.defaultdict(set)
    for r in got:
        by_vector[exact_x(r.embedding)].add(tuple(r.whitened))
    assert all(len(s) == 1 for s in by_vector.values())
    z = np.array([next(iter(by_vector[v])) for v in fit])
    assert np.allclose((z * w[:, None]).T @ z / n, np.eye(4), atol=1e-9)


def test_whitening_does_not_depend_on_partitions(spark):
    vectors = [(i, v, "") for i, v in enumerate(random_vectors(200, 8, 5) * 2)]
    runs = []
    for parts in (1, 7):
        table = whitening.whiten(spark.createDataFrame(vectors, VECTORS).repartition(parts))
        runs.append(sorted((r.vec_id, r.deviation, tuple(r.whitened)) for r in table.collect()))
    assert runs[0] == runs[1]


def test_whitening_edge_cases(spark):
    empty = whitening.whiten(spark.createDataFrame([], VECTORS))
    assert empty.collect() == [] and whitening.by_component(empty).collect() == []
    # One distinct vector, a length of its own: nothing varies, so nothing can be whitened.
    rows = [(1, [0.5, 0.25], ""), (2, [0.5, 0.25], ""), (3, [0.1] * 3, ""), (4, [0.9, 0.1, 0.0], ""), (5, [1e30, -1e30, 0.0], "")]
    got = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got[1].n == 1 and got[1].deviation == 0 and got[1].whitened == [None, None] and got[1].explained == [0.0, 0.0]
    assert got[1].whitened == got[2].whitened and got[3].n == 3 and got[5].deviation is None
    lines = whitening.by_component(whitening.whiten(spark.createDataFrame(rows[:4], VECTORS))).collect()
    assert sorted((r.vec_id, r.component) for r in lines) == [(1, 1), (1, 2), (2, 1), (2, 2), *[(i, c) for i in (3, 4) for c in (1, 2, 3)]]
    # Two vectors lie on a line: one component has all the variance and whitens to +1 and -1.
    assert sorted(round(r.whitened, 9) for r in lines if r.vec_id > 2 and r.component == 1) == [-1.0, 1.0]


def test_whitening_is_exact_far_from_zero(spark):
    rng = np.random.default_rng(9)
    vectors = [(i, [4096.0 + float(v) / 256 for v in rng.integers(0, 3, 6)], "") for i in range(400)]
    got = whitening.whiten(spark.createDataFrame(vectors, VECTORS)).collect()
    fit = sorted({exact_x(v) for _, v, _ in vectors})
    total = [sum(c) for c in zip(*fit)]
    assert all(r.deviation == sum((len(fit) * a - s) ** 2 for a, s in zip(exact_x(r.embedding), total)) for r in got)
    assert got[0].identity_error < 1e-9


# -- SimHash -----------------------------------------------------------------------
def plain_fingerprint(text):
    w = words_of(text, rb"[^\x20\x09-\x0D]+")
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    ones = collections.Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g, 42) >> b & 1)
    return sum(1 << b for b, n in ones.items() if 2 * n > len(grams))


def expected(docs, apart=4):
    fps = [plain_fingerprint(t) for _, t in docs]
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, f in enumerate(distinct):
        for g in distinct[:i]:
            if (f ^ g).bit_count() <= apart:
                root[find(f)] = find(g)
    smallest = {}
    for (doc_id, _), f in zip(docs, fps, strict=True):
        if doc_id is not None:
            r = find(f)
            smallest[r] = min(smallest.get(r, doc_id), doc_id)
    return sorted(((d, f"{f:016x}", smallest.get(find(f))) for (d, _), f in zip(docs, fps, strict=True)), key=str)


def family_of_texts(seed, n):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "STRASSE", "x y"]
    docs = []
    for i in range(n):
        if i and random.random() < 0.6:
            words = re.split(r"(\s+)", random.choice(docs)[1] or "a b c d")
            words[random.randrange(len(words) // 2 + 1) * 2 % len(words)] = random.choice(vocabulary)
            text = "".join(words)
        else:
            text = random.choice([" ", "\n", "\t "]).join(random.choices(vocabulary, k=random.choice([3, 8, 40, 150, 400])))
        docs.append((i + 1, text))
    return docs


def test_fingerprints_of_any_text():
    texts = ["a b c d e f", None, "", " \n", "x", "A  b\tC d ", "é É é É é", "same " * 500, "a b c", "q" * 100_000 + " z " * 70_000]
    assert simhash.fingerprints(pa.array(texts)).tolist() == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("members", [simhash.ANCHOR_MEMBERS, 40])
def test_components_agree_with_all_pairs(spark, monkeypatch, members):
    monkeypatch.setattr(simhash, "ANCHOR_MEMBERS", members)
    docs = family_of_texts(4, 300) + [(900, None), (901, ""), (902, "  "), (None, "one two"), (None, "one two"), (7, "one two"), (5, "another text")]
    rows = [(d, t, "clash") for d, t in docs]
    random.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(6)
    got = sorted((tuple(r) for r in simhash.components(table).collect()), key=str)
    want = expected(docs)
    assert got == want
    assert len({c for _, _, c in want}) < len(want) - 40


def test_components_without_rows(spark):
    assert simhash.components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("n", [10, 10**8, 10**11])
def test_every_linked_pair_meets_at_an_anchor(n):
    """Pairs up to the threshold, also all within one window, are home and replica at some anchor."""
    rng = random.Random(n)
    windows = simhash.plan(n)
    for _ in range(400):
        a = rng.getrandbits(64)
        within = rng.choice([range(64), range(20, 30), range(50, 64)])
        b = a
        for bit in rng.sample(list(within), rng.randint(0, 4)):
            b ^= 1 << bit
        met = False
        for w in windows:
            x, y = (np.array([v & w.mask], np.uint64) for v in (a, b))
            home = x[0] ^ w.patterns[w.syndrome(x)[0]][0]
            assert (int(home) ^ int(x[0])).bit_count() <= 1
            met |= home in y[0] ^ w.patterns[w.syndrome(y)[0]]
        assert met


def test_dense_groups_give_few_edges():
    """All texts within four bits of one fingerprint: as many edges as join them, not all pairs."""
    fps = np.array([0] + [1 << i for i in range(20)] + [1 << i | 1 << j for i in range(20) for j in range(i)], np.uint64)
    a, b = np.repeat(fps, len(fps)), np.tile(fps, len(fps))
    left, right = simhash._joined(a, b)
    assert len(left) == len(fps) - 1 and set(left.tolist()) == {0}


# -- divergence ----------------------------------------------------------------------
def expected_divergences(rows, min_docs, top):
    groups, counts, docs = {}, collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.setdefault(lang, set()).add(source)
        terms = [w.decode() for w in words_of(text, rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")]
        counts[lang, source].update(terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for (x, t), n in docs.items() if x == lang and n >= min_docs]
        n = {s: sum(counts[lang, s][t] for t in kept) for s in sources}

        def share(count, total):
            return 1 + 10**9 * (count + 5) // (total + 5 * len(kept))

        p = {s: {t: share(counts[lang, s][t], n[s]) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s][t] for s in sources), sum(n.values())) for t in kept}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def audited(spark, rows, **limits):
    table = spark.createDataFrame([(*r, "clash") for r in rows], "text string, lang string, source string, n string")
    return sorted(tuple(r) for r in divergence.divergences(table.repartition(5), **limits).collect())


@pytest.mark.parametrize("held", [divergence.HELD_ENTRIES, 50])
def test_divergences_agree_with_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD_ENTRIES", held)
    monkeypatch.setattr(divergence, "BUCKET_ENTRIES", 60)
    monkeypatch.setattr(divergence, "TILE_SOURCES", 3)
    monkeypatch.setattr(divergence, "MERGE_ROWS", 70)
    random.seed(2)
    vocabulary = [f"Term{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(90)] + ["Été", "straße", "日本"]
    rows = []
    for i in range(400):
        lang = random.choice(["en", "en", "en", "de", None])
        source = random.choice(["a", "a", "a", "b", "ü", "Z", None, f"s{i % 4}"])
        words = random.choices(vocabulary, weights=[1 + (j * len(source or "")) % 7 for j in range(len(vocabulary))], k=random.choice([0, 1, 30]))
        rows.append((random.choice([" ", ", ", "1", "_"]).join(words), lang, source))
    rows += [(None, "fr", "only"), ("", "it", "x"), (None, "it", "y"), ("solo " * 9, "it", "z"), ("common " * 30_000, "en", "a")]
    assert audited(spark, rows, min_docs=8, top=7) == expected_divergences(rows, 8, 7)


def test_divergences_without_rows(spark):
    assert audited(spark, []) == []


def test_shares_are_exact_for_large_counts():
    count, total = np.array([10**14 + 7, 3, 10**12]), np.array(9 * 10**14 + 1)
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * c // int(total) for c in count.tolist()]
