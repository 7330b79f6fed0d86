"""SimHash near duplicates by anchor-point covering.

Fingerprints of 64 bits that differ in ``APART`` bits or fewer are linked. The bits are cut into
windows, such that any linked pair differs in at most t bits of one window. The words of a
covering code of the window (a perfect Hamming code on most of its bits, all words on the
rest) are its anchors: each fingerprint lies within the covering radius R of one, its home, and
is replicated to every anchor within R + t. So of any linked pair one side is at home where
the other is replicated, and only (home, replica) pairs of one anchor are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.llm import wordbytes as wb
from postlens.operators.components import connected_components
from postlens.operators.materialize import cut
from postlens.operators.skew import lookup

WORDS = 4
SEED = 42
APART = 4  # differing bits of linked fingerprints, at most
CUTS = ((3, 1), (5, 2), (2, 1))  # the 64 bits in so many parts, and so many parts in a window
REPLICA_COST = 200.0  # of a replica, in comparisons
ANCHOR_MEMBERS = 1 << 16  # replicas that meet at an anchor in one task
COMPARED = 1 << 21  # pairs compared at once
HELD_ROWS = 1 << 17  # replicas that a task compares at once
REPLICAS_A_TASK = 1 << 20
_UNPACKED = 1 << 15  # shingles whose bits are counted at once


def _single_spaced(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words of a run of texts, each with one space behind it; where they begin and end, and the first of each text."""
    words = wb.Words(texts, wb.NOT_SPACE)
    length = words.end - words.start
    begin = np.cumsum(length + 1) - (length + 1)
    out = np.full(int((length + 1).sum()), 0x20, np.uint8)
    within = np.ones(len(out), bool)
    within[begin + length] = False
    out[within] = words.data[wb.NOT_SPACE[words.data]]
    return out.tobytes(), begin, begin + length, words.first


def fingerprints(texts: pa.Array) -> np.ndarray:
    """A bit is set where it is in over half of the hashes of the text's shingles, repeats included."""
    data, begin, end, first = _single_spaced(texts)
    count = np.diff(first)
    out = np.zeros(len(count), np.uint64)
    n = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n - first[:-1], n)
    last = start + np.minimum(count[row], WORDS) - 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros((len(count), 64), np.int64)
    begins, ends = begin[start], end[last]
    for i in range(0, len(row), _UNPACKED):
        some = slice(i, i + _UNPACKED)
        hashes = np.fromiter(
            (digest(data[a:b], SEED) for a, b in zip(begins[some].tolist(), ends[some].tolist(), strict=True)), np.uint64, len(row[some])
        )
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        edge = np.flatnonzero(np.concatenate(([True], row[some][1:] != row[some][:-1])))
        ones[row[some][edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    full = np.flatnonzero(n)
    packed = np.packbits(2 * ones[full] > n[full, None], axis=1)
    out[full] = packed.view(">u8").astype(np.uint64).ravel()
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in wb.chunks(batches, "text"):
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints(part.column("text")).view(np.int64))], ["doc_id", "fp"])


@dataclass(frozen=True)
class Window:
    """Some of the 64 bits, with the anchors among the words of these bits.

    ``checks`` are the masks of the Hamming code's parities; the anchors within reach of a
    word are the word XOR each of the patterns of its syndrome, the first of which leads home.
    """

    mask: int
    checks: tuple[int, ...]
    patterns: tuple[np.ndarray, ...]

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for j, check in enumerate(self.checks):
            out |= (np.bitwise_count(words & np.uint64(check)) & 1).astype(np.int64) << j
        return out

    def replicas(self) -> float:
        """Anchors within reach of a word, on average."""
        return float(np.mean([len(p) for p in self.patterns]))

    def anchors(self) -> float:
        return 2.0 ** (self.mask.bit_count() - len(self.checks))


def window(bits: list[int], apart: int) -> Window:
    """The window of these bits for words ``apart`` bits from each other: R = 1, so anchors within 1 + ``apart``.

    Bits 1 to 2**r - 1 of the window carry a Hamming code, which is perfect: every word is at
    most one bit from exactly one code word. The other bits are free.
    """
    r = (len(bits) + 1).bit_length() - 1
    checks = tuple(sum(1 << b for place, b in enumerate(bits[: 2**r - 1], 1) if place >> j & 1) for j in range(r))
    empty = Window(sum(1 << b for b in bits), checks, ())
    found = [[] for _ in range(2**r)]
    for weight in range(apart + 2):
        masks = np.array([sum(1 << b for b in some) for some in combinations(bits, weight)], np.uint64)
        for s, mask in zip(empty.syndrome(masks).tolist(), masks.tolist(), strict=True):
            found[s].append(mask)  # by rising weight, so a syndrome's first pattern has one bit or none
    return Window(empty.mask, checks, tuple(np.array(x, np.uint64) for x in found))


def plan(n: int, apart: int = APART) -> list[Window]:
    """Windows for ``n`` fingerprints: few replicas while they are few, few comparisons when they are many.

    With the bits in m parts and c neighbouring parts in each of m windows, the windows together
    see a difference c times, so one of them sees at most apart * c / m.
    """
    best: tuple[float, list[Window]] | None = None
    for parts, joined in CUTS:
        cuts = [64 * i // parts for i in range(parts + 1)]
        blocks = [list(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
        windows = [window(sum((blocks[(i + k) % parts] for k in range(joined)), []), apart * joined // parts) for i in range(parts)]
        cost = sum(n * REPLICA_COST * w.replicas() + n * n * w.replicas() / w.anchors() for w in windows)
        if best is None or cost < best[0]:
            best = cost, windows
    return best[1]


def _replicate(windows: list[Window]):
    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(win, anchor, fp, home) of every anchor within reach."""
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                fp = batch.column("fp").slice(begin, 2000).to_numpy().view(np.uint64)
                wins, anchors, fps, homes = [], [], [], []
                for k, w in enumerate(windows):
                    words = fp & np.uint64(w.mask)
                    syndrome = w.syndrome(words)
                    for s, patterns in enumerate(w.patterns):
                        mine = np.flatnonzero(syndrome == s)
                        anchors.append((words[mine, None] ^ patterns[None, :]).ravel())
                        fps.append(np.repeat(fp[mine], len(patterns)))
                        homes.append(np.tile(np.arange(len(patterns)) == 0, len(mine)))
                        wins.append(np.full(len(mine) * len(patterns), k, np.int8))
                columns = [np.concatenate(x) for x in (wins, anchors, fps, homes)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0]), pa.array(columns[1].view(np.int64)), pa.array(columns[2].view(np.int64)), pa.array(columns[3])],
                    ["win", "anchor", "fp", "home"],
                )

    return replicate


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every vertex to the smallest one it is connected with: as many as connect the same vertices."""
    vertex, code = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    root = np.arange(len(vertex))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    other = np.flatnonzero(root != np.arange(len(vertex)))
    return vertex[root[other]], vertex[other]


def _compare(apart: int):
    def links(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges that connect the fingerprints linked within an anchor; rows are sorted by anchor."""
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.concatenate((edge, [len(key)])))
        homes = np.flatnonzero(home)
        group = np.searchsorted(edge, homes, "right") - 1
        begin, many = edge[group], size[group]
        done = np.concatenate(([0], np.cumsum(many)))
        lefts, rights, i = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], 0
        while i < len(homes):
            j = max(i + 1, int(np.searchsorted(done, done[i] + COMPARED, "right")) - 1)
            n = many[i:j]
            other = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - begin[i:j], n)
            a, b = np.repeat(fp[homes[i:j]], n), fp[other]
            good = (np.bitwise_count(a ^ b) <= apart) & (a != b)
            left, right = _joined(a[good], b[good])
            lefts.append(left)
            rights.append(right)
            i = j
        return _joined(np.concatenate(lefts), np.concatenate(rights))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b) edges; the rows of a spot come together and are bounded in number."""
        held: list[pa.RecordBatch] = []

        def whole_spots(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            spot = rows.column("spot").to_numpy()
            edges = np.flatnonzero(spot[1:] != spot[:-1])
            end = rows.num_rows if last else int(edges[-1]) + 1 if len(edges) else 0
            held = [rows.slice(end)] if end < rows.num_rows else []
            if end:
                fp, home = rows.column("fp").to_numpy().view(np.uint64), rows.column("home").to_numpy(zero_copy_only=False)
                a, b = links(spot[:end], fp[:end], home[:end])
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) > HELD_ROWS:
                yield from whole_spots(last=False)
        if held:
            yield from whole_spots(last=True)

    return compare


def _spots(replicas: DataFrame) -> DataFrame:
    """``(spot, fp, home)``: what meets at an anchor shares a spot.

    An anchor with more than ``ANCHOR_MEMBERS`` replicas is cut into blocks: those at home in
    block i meet the replicas of block j at spot (i, j). A spot is a hash; two anchors that
    share one only compare more than they must.
    """
    crowd = replicas.groupBy("win", "anchor").agg(F.ceil(F.count("*") / ANCHOR_MEMBERS).cast("int").alias("blocks")).where("blocks > 1")
    known = replicas.join(cut(crowd, "simhash-crowded"), ["win", "anchor"], "left")
    own = F.pmod(F.xxhash64(F.lit(3), "fp"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)

    def spot(i, j, home: bool):
        return F.struct(F.xxhash64("win", "anchor", i, j).alias("spot"), F.lit(home).alias("home"))

    asked = F.transform(every, lambda i: spot(i, F.col("own"), False))
    asking = F.when(F.col("home"), F.transform(every, lambda j: spot(F.col("own"), j, True))).otherwise(F.slice(asked, 1, 0))
    crowded = known.where("blocks IS NOT NULL").withColumn("own", own).select("fp", F.explode(F.concat(asked, asking)).alias("s"))
    alone = known.where("blocks IS NULL").select(F.xxhash64("win", "anchor").alias("spot"), "fp", "home")
    return alone.union(crowded.select("s.spot", "fp", "s.home"))


def linked(classes: DataFrame, apart: int = APART) -> DataFrame:
    """``(a, b)``: edges that connect the distinct fingerprints ``fp`` of ``classes`` that are linked, directly or by others."""
    n = classes.count()
    windows = plan(n, apart)
    tasks = max(1, -(-int(n * sum(w.replicas() for w in windows)) // REPLICAS_A_TASK))
    wide = classes.select("fp").repartition(tasks).mapInArrow(_replicate(windows), "win byte, anchor long, fp long, home boolean")
    spots = _spots(cut(wide, "simhash-replicas"))
    met = spots.repartition("spot").sortWithinPartitions("spot")
    return cut(met.mapInArrow(_compare(apart), "a long, b long"), "simhash-edges")


def components(docs: DataFrame, apart: int = APART) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row of ``docs``.

    Texts are lower-cased (A-Z) and cut at white space into shingles of ``WORDS`` words, the
    whole sequence where there are fewer. Null, empty and blank texts have the fingerprint
    zero, which is linked like any other. ``component_id`` is the smallest doc_id reachable
    by links, the own included. Rows of one text are one class before anything is compared;
    rows that repeat a doc_id are documents of their own, and a null doc_id counts only where
    a component has no other. Empty input gives an empty result; other columns are not read.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])
    described = cut(docs.select("doc_id", "text").mapInArrow(_describe, schema), "simhash-described")
    classes = cut(described.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-classes")
    roots = connected_components(linked(classes, apart))
    rooted = classes.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "n", "component_id")
    told = lookup(described, named, ["fp"], "n", "doc_id")
    return told.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
