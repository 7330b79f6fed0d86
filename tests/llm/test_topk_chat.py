import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postlens.llm import chat, topk

VECTORS = "vec_id long, embedding array<float>, label int, score string"


def expected_top(vectors, k=10):
    rows = []
    for i, v in vectors:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        rows.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    out = []
    for n, (q, mine) in enumerate(rows):
        if q % 100:
            continue
        scored = sorted(
            (-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(mine, v, strict=True)))), c)
            for m, (c, v) in enumerate(rows) if m != n and len(v) == len(mine)
        )
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def top(spark, vectors):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in vectors], VECTORS)
    return sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in topk.top_k(df).collect())


@pytest.mark.parametrize("block,pivots", [(512, 32), (40, 5)])
def test_top_k_agrees_with_brute_force(spark, monkeypatch, block, pivots):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "PIVOTS", pivots)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 8))
    vectors = [(i, (centers[i % 6] + 0.1 * rng.normal(size=8)).tolist()) for i in range(700)]
    vectors += [(700 + i, vectors[0][1]) for i in range(150)]  # many equal vectors, so ties
    vectors += [(-100, [0.0] * 8), (-200, [1.0, 2.0]), (-201, [2.0, 1.0]), (-300, []), (5, vectors[5][1]), (5, vectors[6][1])]
    vectors += [(200, vectors[200][1]), (200, [9.0] * 8), (300, vectors[7][1]), (1, vectors[0][1])]  # repeated ids
    vectors += [(1000, None), (1001, [float("nan")] * 8), (1002, [None] + [1.0] * 7), (1100, [float("inf")] * 8), (None, [1.0] * 8)]
    assert top(spark, vectors) == expected_top(vectors)


def test_rows_that_repeat_an_id_are_all_candidates(spark):
    assert top(spark, [(1, [5.0]), (1, [9.0]), (2, [3.0]), (100, [1.0])]) == [
        (100, 1, 1, 9 << 20), (100, 2, 1, 5 << 20), (100, 3, 2, 3 << 20),
    ]
    assert top(spark, [(100, [1.0]), (100, [2.0])]) == [(100, 1, 100, 2 << 20), (100, 1, 100, 2 << 20)]


def test_top_k_of_huge_components_and_of_nothing(spark):
    huge = [(0, [1e30, 1.0]), (1, [1e30, 1.0]), (2, [-1e30, 1.0]), (3, [0.5, 0.25])]
    assert top(spark, huge) == expected_top(huge)
    assert top(spark, []) == [] and top(spark, [(100, [1.0])]) == []


def test_trees_cover_their_points():
    rng = np.random.default_rng(5)
    points = np.floor(rng.normal(size=(900, 3)) * 1000)
    tree = topk.Tree(points)
    for begin, end, center, radius, children in tree.nodes:
        far = np.sqrt(((points[tree.order[begin:end]] - points[center]) ** 2).sum(1))
        assert far.max() <= radius + 1e-9
        if children:
            parts = sorted(tree.nodes[c][:2] for c in children)
            assert parts[0][0] == begin and parts[-1][1] == end
            assert all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    assert sorted(tree.order) == list(range(900)) and len(tree.nodes) > 10


def test_search_prunes_and_stays_exact(monkeypatch):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(20, 4)) * 5000
    points = np.floor(np.repeat(centers, 100, 0) + rng.normal(size=(2000, 4)))
    queries = points[:30]
    pairs = [0]
    monkeypatch.setattr(topk, "inner", lambda a, b, f=topk.inner: (pairs.__setitem__(0, pairs[0] + len(a) * len(b)), f(a, b))[1])
    best = topk.search(queries, np.arange(30), np.full(30, -np.inf), points, np.arange(2000), 5)
    scores = queries @ points.T
    for q in range(30):
        scores[q, q] = -np.inf
        want = sorted(zip(-scores[q], range(2000), strict=True))[:5]
        mine = best.top[0] == q
        assert [(s, i) for s, i in zip(-best.top[1][mine].astype(float), best.top[2][mine], strict=True)] == want
    assert pairs[0] < 0.6 * 30 * 2000


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='<|im_start>end\\\n a"é', max_size=30), st.text(alphabet="ab\\\n<|>", max_size=8))
def test_escapes_are_reversible(text, role):
    assert chat.unescape(chat.escape(text)) == text
    piece, begin, end = chat.turn_text(role, text)
    two = piece + chat.turn_text("x", "y")[0]
    turns = chat.read_turns(two)
    assert turns[0] == (role, begin, end) and chat.unescape(two[begin:end]) == text and turns[1][0] == "x" and len(turns) == 2


def expected_digests(rows):
    by_conv = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        by_conv.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return {
        c: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"), sha("".join(x for r, x in t if r == "assistant")))
        for c, t in by_conv.items()
    }


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(12), None]:
        first = ["system"] if rng.random() < 0.5 else []
        for turn, role in enumerate([*first, *(["user", "assistant"] * rng.randint(0, 8)), *rng.choice([[], ["system"], ["tool"]])]):
            text = rng.choice(["", "a", "word " * rng.randint(0, 60), "<|im_end|>\n<|im_start|>user", "\\<|x", "é\\"])
            rows.append((conv, turn, role, text))
    for turn in range(400):  # one long conversation
        rows.append((99, turn, "system" if turn == 0 else ["user", "assistant"][turn % 2], f"turn {turn} " * rng.randint(0, 9)))
    rows += [(200, 0, None, None), (200, 1, "assistant", None), (201, None, "user", "x"), (202, 0, "system", "alone")]
    return rows


@pytest.mark.parametrize("budget,history,stretch", [(2048, 512, 64 * 2048), (60, 25, 200), (10, 5, 40)])
def test_windows_hold_every_turn_once(spark, budget, history, stretch):
    rows = conversations(budget)
    df = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, tokens string").repartition(3)
    windows = chat.format_windows(df, budget, history, stretch)
    got = {
        r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(windows).collect()
    }
    assert got == expected_digests(rows)
    cost = lambda text: len(text.split()) + chat.MARK_TOKENS
    for w in windows.collect():
        turns = chat.read_turns(w["formatted"])
        texts = [(role, chat.unescape(w["formatted"][a:b])) for role, a, b in turns]
        new = len(turns) - w["repeated"]
        assert new >= 1
        total = sum(cost(t) for _, t in texts)
        opening = texts[0][0] == "system" and w["repeated"] == 0  # the system turn in its own place
        assert total <= budget or new - opening == 1  # a turn longer than the budget has a window of its own
        if w["conv_id"] == 99:
            assert texts[0] == ("system", expected_first(rows))
        spans = {(a, b) for role, a, b in turns[w["repeated"]:] if role == "assistant"}
        assert {tuple(x) for x in w["loss"]} <= spans and len(w["loss"]) == len(spans)


def expected_first(rows):
    return next(t for c, turn, _, t in rows if c == 99 and turn == 0)


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_windows(df)).count() == 0
