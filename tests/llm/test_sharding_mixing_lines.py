import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from postlens.llm import linededup, mixing, sharding

DOCS = "doc_id long, text string, source string, shard string, size string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 16, 17, 50, 101, 1000])
def test_every_row_has_one_place_and_shards_are_even(spark, n):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("shard"))
    rows = sharding.shard_rows(df, [F.col("doc_id")], 16).collect()
    assert len(rows) == n
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(slots.get(s, [])) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {r["law"] for r in rows} <= {"rows"}


def test_shuffle_does_not_depend_on_partitions_and_mixes(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"))
    one = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_rows(df.repartition(1), [F.col("doc_id")], 16).collect()}
    many = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_rows(df.repartition(7), [F.col("doc_id")], 16).collect()}
    assert one == many
    place = {d: s for d, s, _ in one}
    assert sum(place[d] == d % 16 for d in place) < 100
    other = {(r["doc_id"], r["shard"]) for r in sharding.shard_rows(df, [F.col("doc_id")], 16, seed=3).collect()}
    assert len(other & {(d, s) for d, s, _ in one}) < 100


def test_shards_take_null_and_equal_rows(spark):
    df = spark.createDataFrame([(None,)] * 40 + [(7,)] * 40, "doc_id long")
    rows = sharding.shard_rows(df, [F.col("doc_id")], 16).collect()
    assert len(rows) == 80 and len({(r["shard"], r["slot"]) for r in rows}) == 80


def expected_mix(docs):
    size = {}
    for _, text, source in docs:
        size[source] = size.get(source, 0) + len(words(text))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (i % 3) + 1 for i, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        open_ = [s for s in order if s not in capped]
        level = (total - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in open_) if open_ else 0.0
        new = {s for s in open_ if level * weight[s] > 3 * size[s]}
        if not new:
            break
        capped |= new
    target = {s: float(3 * size[s]) if s in capped else level * weight[s] for s in order}
    out = []
    for doc, text, source in docs:
        rate = target[source] / size[source] if size[source] else 1.0
        draw = int(hashlib.md5(f"20:{'null' if doc is None else doc}".encode()).hexdigest()[:13], 16) / 16**13
        out.append((doc, len(words(text)), size[source], round(target[source], 6), int(rate) + (draw < rate - int(rate))))
    return sorted(out, key=str)


def mix_rows(spark, docs):
    df = spark.createDataFrame([(*d, "s", "z") for d in docs], DOCS)
    return df, sorted(
        ((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["copies"]) for r in mixing.mix(df).collect()), key=str
    )


def test_mix_agrees_with_brute_force(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "b", "hot", "hot", "hot", None, "é", ""])) for i in range(300)]
    docs += [(None, "a b c", "a"), (5, None, "b"), (6, "", "only-empty"), (7, "x y z", "tiny"), (7, "x y z", "tiny")]
    _, got = mix_rows(spark, docs)
    assert got == expected_mix(docs)
    taken = sum(r[1] * r[4] for r in got)
    assert abs(taken - sum(r[1] for r in got)) < 0.15 * taken and all(r[4] <= 3 for r in got)


def test_mix_of_nothing_and_of_empty_texts(spark):
    df, got = mix_rows(spark, [])
    assert got == [] and mixing.emit(mixing.mix(df)).count() == 0
    _, got = mix_rows(spark, [(1, None, "a"), (2, "", None)])
    assert [(r[1], r[3]) for r in got] == [(0, 0.0), (0, 0.0)]


def test_rows_of_one_id_or_none_draw_apart_and_meet_the_target(spark):
    docs = [(None, f"w{i} " * 10, "a") for i in range(400)] + [(7, f"v{i} " * 10, "b") for i in range(200)]
    docs += [(None, f"w{i} " * 10, None) for i in range(400)] + [(None, "w0 " * 10, "a")] * 3
    df = spark.createDataFrame([(*d, "s", "z") for d in docs], DOCS)
    draws = lambda x: sorted(map(tuple, mixing.mix(x).select("doc_id", "text", "source", "copies").collect()), key=str)
    rows = mixing.mix(df).collect()
    assert draws(df) == draws(df.repartition(5))
    for source in ("a", "b", None):
        mine = [r for r in rows if r["source"] == source]
        taken = sum(r["size"] * r["copies"] for r in mine)
        assert mine and abs(taken - mine[0]["target"]) < 0.15 * mine[0]["target"]
    assert len({r["copies"] for r in rows if r["text"] == "w0 " * 10 and r["source"] == "a"}) == 1


def test_emit_repeats_rows(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 3)], "doc_id long, copies int")
    assert sorted(r["doc_id"] for r in mixing.emit(df).collect()) == [2, 3, 3, 3]


PIECE = re.compile(linededup.LINE)


def expected_lines(docs):
    """Line dedup by the definition, in plain Python."""
    lines = {d: PIECE.findall(t or "") for d, t in docs}
    seen, gone = {}, {d: set() for d, _ in docs}

    def rank(d, text):
        return (d,)

    for d, _ in sorted(docs, key=lambda x: x[0]):
        bare = [p.rstrip("\t\n\x0b\f\r ") for p in lines[d]]
        for i in range(len(bare) - 2):
            passage = tuple(bare[i : i + 3])
            if passage in seen:
                gone[d].update((i, i + 1, i + 2))
            seen.setdefault(passage, (d, i))
    return {d: "".join(p for i, p in enumerate(lines[d]) if i not in gone[d]) if gone[d] else t for d, t in docs}


def test_lines_join_to_the_text(spark):
    texts = ["", " ", "a", "One. Two!  three\n\nfour", "x" * 5000, "w " * 50, "\n\n a.b. c ", "é è. ñ o! ...", "tab\tend.\r\n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select("text", F.array_join(linededup.lines_of(F.col("text")), "").alias("again")).collect()
    assert all(r["text"] == r["again"] for r in rows)


def test_repeated_passages_go_and_first_occurrences_stay(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n)) + rng.choice([".\n", ". ", "! ", "\n"])
    passage = "".join(line(9) for _ in range(7))  # 63 words
    docs = []
    for i in range(60):
        text = "".join(line(rng.randint(1, 14)) for _ in range(rng.randint(0, 12)))
        if i % 4 == 0:
            text += passage + line(5)
        docs.append((i, text))
    docs += [(60, docs[3][1]), (61, None), (62, ""), (63, passage * 2), (64, "a. b. c. d. e. f. ")]
    df = spark.createDataFrame([(d, t, "s", "a", "b") for d, t in docs], DOCS)
    rows = {r["doc_id"]: r for r in linededup.dedup_lines(df).collect()}
    want = expected_lines(docs)
    assert {d: r["text"] for d, r in rows.items()} == want
    assert rows[0]["n_removed"] == 0 and rows[4]["n_removed"] >= 5 and rows[1]["text"] == docs[1][1]
    assert rows[61]["text"] is None and set(rows[0].asDict()) >= {"n_lines", "source", "shard"}


def test_three_short_lines_that_repeat_go(spark):
    """Lines of one, two and three words, and a passage of two-word lines in the middle of other text."""
    short = "Yes.\nNot now.\nTry it later.\n"
    pairs = "".join(f"a{i} b{i}.\n" for i in range(30))
    docs = [(1, short), (2, "x y z.\n" + short + "end"), (3, "Yes.\nNot now.\n"), (4, pairs), (5, "One more line.\n" + pairs + "tail")]
    rows = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows == {1: short, 2: "x y z.\nend", 3: "Yes.\nNot now.\n", 4: pairs, 5: "One more line.\ntail"} == expected_lines(docs)


def test_line_dedup_of_nothing_and_of_repeated_rows(spark):
    df = spark.createDataFrame([], DOCS)
    assert linededup.dedup_lines(df).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "short one.")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["n_removed"]) for r in linededup.dedup_lines(df).collect()))
    # null sorts first, so it keeps the passage; the two equal rows count as one occurrence.
    assert got == [(-1, 0), (1, 4), (1, 4), (2, 0)]


def test_texts_of_one_id_with_equal_32_bit_hashes_are_told_apart(spark):
    shared = " ".join(f"w{j}" for j in range(48))
    copy, clean = f"{shared} tail27638", " ".join(f"c10391x{j}" for j in range(48))
    df = spark.createDataFrame([(0, shared), (5, copy), (5, clean)], "doc_id long, text string")
    assert len({r["h"] for r in df.where("doc_id = 5").select(F.hash("text").alias("h")).collect()}) == 1
    assert sorted(r["text"] for r in linededup.dedup_lines(df).collect()) == [clean, "tail27638", shared]


def expected_passages(docs):
    """Passage dedup by the definition, in plain Python."""
    n, seen, out = linededup.PASSAGE_WORDS, set(), {}
    for d, text in sorted(docs):
        w, gone = words(text), set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in seen:
                gone.update(range(i, i + n))
            seen.add(tuple(w[i : i + n]))
        out[d] = (len(w), len(gone), [x for i, x in enumerate(w) if i not in gone])
    return out


def test_passages_of_51_words_go_wherever_they_are(spark):
    rng = random.Random(12)
    filler = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    plain = [f"p{rng.randrange(10**9)}" for _ in range(51)]
    lines = [f"q{rng.randrange(10**9)}" for _ in range(51)]  # of two words each
    two = "".join(x + (" " if i % 2 else ".\n") for i, x in enumerate(lines, 1))
    docs = [(0, " ".join(filler(20) + plain + filler(20))), (1, " ".join(filler(3)) + "\n" + two)]
    docs += [(2 + i, " ".join(filler(i) + plain + filler(30 - i))) for i in range(20)]
    docs += [(30 + i, " ".join(filler(i)) + " " + two + " ".join(filler(5))) for i in range(9)]
    docs += [(50, " ".join(filler(4) + plain[:50] + filler(4))), (51, "  " + " ".join(["w", "v"] * 70) + "\n"), (52, ""), (53, " \n"), (54, None)]
    docs += [(56, " ".join(filler(9) + (plain[:7][::-1] * 9)[:60] + filler(9)))]  # overlaps its own repeats
    docs += [(60, " ".join(filler(5) + docs[0][1].split()[7:80] * 2)), (61, docs[0][1])]
    rows = linededup.dedup_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    want = expected_passages([(d, t or "") for d, t in docs])
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], words(r["text"])) for r in rows} == want
    assert all(want[d][1] == 51 for d in range(2, 22)) and all(want[d][1] == 51 for d in range(30, 39)) and want[61][2] == []
    assert all(r["text"] == dict(docs)[r["doc_id"]] for r in rows if not r["n_removed"])


def test_op2_columns(spark):
    from postlens.llm.queries import op2_feistel_sharding

    rows = op2_feistel_sharding(spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), None)


def test_windows_carry_a_hash_of_the_text_only_where_a_doc_id_has_several(spark, monkeypatch):
    same = "One line here. Another line there. A third line too. "
    carried, real = {}, linededup.cut
    monkeypatch.setattr(linededup, "cut", lambda df, name: carried.update({name: {r[0] for r in df.select("_ld_hash").collect()}}) or real(df, name))

    def removed(docs):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        return sorted((r["doc_id"] or -1, r["text"], r["n_removed"]) for r in linededup.dedup_lines(df).collect())

    assert removed([(1, same + "End one."), (2, same + "End two."), (2, same + "End two."), (None, same + "End none.")]) == [
        (-1, same + "End none.", 0), (1, "End one.", 3), (2, "End two.", 3), (2, "End two.", 3)
    ]
    assert carried == {"line-windows": {0}, "line-repeats": {0}, "line-starts": {0}}
    got = removed([(1, same + "End one."), (2, "New start. " + same), (2, same + "End two.")])
    assert [(i, n) for i, _, n in got] == [(1, 0), (2, 3), (2, 3)] and len(carried["line-windows"]) == 3


def test_only_texts_that_may_have_repeats_are_shuffled(spark, monkeypatch):
    """A filter that lets nearly all pass, and one that is exact, give the same rows; texts outside it meet no exchange."""
    same = "One line here. Another line there. A third line too. "
    docs = [(i, f"Own start {i}. Own middle {i}. Own end {i}. " + (same if i % 5 == 0 else "")) for i in range(60)]
    df = spark.createDataFrame([*docs, (None, same), (None, same + "End.")], "doc_id long, text string").repartition(3)
    told = {}
    for words in (1, 1 << 18):
        monkeypatch.setattr(linededup, "FILTER_WORDS", words)
        told[words] = sorted(((r["doc_id"] if r["doc_id"] is not None else -9, r["text"], r["n_removed"]) for r in linededup.dedup_lines(df).collect()), key=str)
    assert told[1] == told[1 << 18] and len(told[1]) == 62
    assert sorted(i for i, _, n in told[1] if n == 3) == sorted([-9, *[i for i, _ in docs if i % 5 == 0]])
    starts = spark.createDataFrame([(7, 0, [0])], "_ld_id long, _ld_hash long, _ld_starts array<int>")
    plain = spark.createDataFrame([(i, "x") for i in range(100)], "doc_id long, text string")
    out = linededup._with_starts(plain, F.lit(0).cast("long"), starts)
    assert [r["doc_id"] for r in out.where("_ld_starts IS NOT NULL").collect()] == [7] and out.count() == 100
    assert "Union" in out._jdf.queryExecution().optimizedPlan().toString()
