"""Exact Jaccard join of shingle sets by universe partitioning.

Sets of one size band are cut into segments by a hash of the token. Two sets within the
threshold differ in at most H tokens, so among segments worth more than H together at least
one agrees: exactly where a segment is worth one, up to one token where it is worth two (its
one-deletion neighbourhood is indexed). Per band the cheaper allocation is chosen. Segments
that are empty or hold only common tokens agree by chance; each band has spare segments to
pay for leaving them out, and a set that would spend more than it has spared indexes all.

Signatures travel as one binary per run of documents and bucket, so a bucket is grouped with
a numpy sort. Groups give links to their smallest set first; groups that this does not
connect are then compared in full, as far as the triangle inequality leaves pairs open.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.llm import wordbytes as wb
from postlens.operators.components import connected_components
from postlens.operators.materialize import cut

WORDS = 5
NEED, OF = 3, 7  # |x n y| >= 3/7 (|x| + |y|) is a Jaccard similarity of 3/4
BAND = 4 / 3
SPARE = 0.4
VERIFY_COST = 40.0  # of a candidate pair, in signatures
COMMON_SHARE = 0.01  # of a run's sets, to report a token as common
COMMON_TOKENS = 50_000  # tokens told to every task; which ones are told never changes the result
BUCKET_SIGNATURES = 1_500_000
SMALL_GROUP = 3  # a signature shared by more sets is common
FAMILY_BITS = 7  # low bits of a signature that tell its family
LIST_ROWS = 1000
OPEN_PAIRS = 1 << 19  # pairs that a task holds to drop repeats
SKETCH_FROM, SKETCH_MOST = 64, 4096  # bits of a set's sketch
FILTER_WORDS = 1 << 20  # longs in the filter of wanted ids: 8 MB at most
_SALT = 0x51ED2701


@dataclass(frozen=True)
class Family:
    """Pairs whose smaller set has ``low`` to ``high`` tokens."""

    number: int
    low: int
    high: int
    larger: int  # the most tokens of the larger set
    segments: int
    worth: int  # of each segment: 1 exact, 2 with one-deletion neighbourhood
    spare: int  # worth above H + 1

    def signatures(self, size: float) -> float:
        return self.segments + (size if self.worth == 2 else 0)


def most_apart(low: int, high: int) -> int:
    """The largest symmetric difference of linked sets whose smaller has low to high tokens."""
    sums = np.arange(2 * low, high + 4 * high // 3 + 1, dtype=np.int64)
    return int(np.max(sums - 2 * -(-NEED * sums // OF)))


def families(largest: int, sets: dict[int, int], common: float) -> list[Family]:
    """Families for sets up to ``largest`` tokens.

    ``sets`` counts the sets by size and ``common`` is the share of common tokens. A segment
    of c tokens agrees by chance when all are common, with probability common ** c; the
    allocation with the smaller sum of signatures and expected candidates is taken.
    """
    out, low, number = [], 1, 0
    sizes = np.array(sorted(sets), np.int64)
    counts = np.array([sets[s] for s in sizes.tolist()], np.int64)
    while low <= largest:
        high = max(low, math.ceil(low * BAND) - 1)
        apart, larger = most_apart(low, high), 4 * high // 3
        if apart > 0:  # sets that may not differ at all are equal
            here = (sizes >= low) & (sizes <= larger)
            n, tokens = int(counts[here].sum()), int((counts * sizes)[here].sum())
            size = tokens / n if n else low

            def plan(worth: int) -> tuple[float, Family]:
                spare = math.ceil(SPARE * (apart + 1)) if apart > 3 else 0
                segments = -(-(apart + 1 + spare) // worth)
                family = Family(number, low, high, larger, segments, worth, segments * worth - apart - 1)
                chance = common ** max(1.0, size / segments - (worth - 1))
                return n * family.signatures(size) + VERIFY_COST * (n * chance) ** 2 * segments / 2, family

            out.append(min((plan(1), plan(2)), key=lambda p: p[0])[1])
        low, number = high + 1, number + 1
    return out


class Sets:
    """Distinct shingles of a run of texts, grouped by text and sorted within."""

    def __init__(self, texts: pa.Array):
        words = wb.Words(texts, wb.NOT_SPACE)
        token, row = wb.shingles(words.hashes(), words.first, WORDS)
        order = np.lexsort((token, row))
        token, row = token[order], row[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
        self.token, self.row = token[new], row[new]
        self.size = np.bincount(self.row, minlength=len(texts))
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        self.key = np.zeros(len(texts), np.uint64)
        np.add.at(self.key, self.row, wb.mix64(self.token ^ np.uint64(_SALT)))
        self.key = wb.mix64(self.key + self.size.astype(np.uint64))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, size, sketch) per text."""
    for part in wb.chunks(batches, "text"):
        sets = Sets(part.column("text"))
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"), pa.array(sets.key.view(np.int64)), pa.array(sets.size.astype(np.int64)),
                pa.array(_sketches(sets), pa.binary()),
            ],
            ["doc_id", "key", "size", "sketch"],
        )


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n) of tokens that are common among the sets of a run."""
    for part in wb.chunks(batches, "text"):
        sets = Sets(part.column("text"))
        _, once = np.unique(sets.key, return_index=True)
        keep = np.zeros(len(sets.key), bool)
        keep[once] = True
        token, n = np.unique(sets.token[keep[sets.row]], return_counts=True)
        many = n >= max(8, COMMON_SHARE * len(once))
        yield pa.RecordBatch.from_arrays(
            [pa.array(token[many].view(np.int64)), pa.array(n[many].astype(np.int64))], ["token", "n"]
        )


def _signatures(sets: Sets, plan: list[Family], common: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, signature, spare worth left or -1) of every set in every family that its size belongs to."""
    mixed = wb.mix64(sets.token)
    at = np.searchsorted(common, sets.token)
    at[at == len(common)] = 0
    is_common = common[at] == sets.token if len(common) else np.zeros(len(sets.token), bool)
    for family in plan:
        rows = np.flatnonzero((sets.size >= family.low) & (sets.size <= family.larger))
        if not len(rows):
            continue
        size = sets.size[rows]
        take = np.repeat(sets.first[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        m = np.uint64(family.segments)
        segment = ((mixed[take] >> np.uint64(32)) % m).astype(np.int64)
        cell = np.repeat(np.arange(len(rows)), size) * family.segments + segment
        cells = len(rows) * family.segments
        value = wb.mix64(mixed[take] + np.uint64(family.number))
        total = np.zeros(cells, np.uint64)
        np.add.at(total, cell, value)
        rare = np.bincount(cell[~is_common[take]], minlength=cells)
        salt = wb.mix64(np.arange(family.segments, dtype=np.uint64) + np.uint64((family.number + 1) << 32))
        salted = np.tile(salt, len(rows))
        poor = rare == 0
        spent = poor.reshape(len(rows), -1).sum(1) * family.worth
        if family.worth == 2:  # a deletion may leave a segment without a rare token
            spent += 2 * (rare == 1).reshape(len(rows), -1).sum(1)
        left = np.where(spent > family.spare, -1, family.spare - spent)
        everything = np.repeat(left < 0, family.segments)
        send = ~poor | everything
        at = np.flatnonzero(send) // family.segments
        yield rows[at], _tagged(total[send] + salted[send], family), left[at]
        if family.worth == 2:
            remain = rare[cell] - ~is_common[take]
            send = (remain > 0) | everything[cell]
            at = cell[send] // family.segments
            yield rows[at], _tagged(total[cell[send]] - value[send] + salted[cell[send]], family), left[at]


def _tagged(value: np.ndarray, family: Family) -> np.ndarray:
    low = np.uint64((1 << FAMILY_BITS) - 1)
    return (wb.mix64(value) & ~low) | (np.uint64(family.number) & low)


def _sketches(sets: Sets) -> list[bytes]:
    """Parities of a set's tokens by hash: two sets differ in at least as many tokens as their sketches in bits.

    A sketch has one or two bits for each token of the set, up to a limit; a longer
    sketch is folded to the length of a shorter one.
    """
    out = []
    value = wb.mix64(sets.token ^ np.uint64(_SALT << 1)) >> np.uint64(40)
    for i in range(len(sets.size)):
        mine = value[sets.first[i] : sets.first[i + 1]]
        bits = sketch_bits(len(mine))
        odd = np.bincount((mine & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8)).tobytes())
    return out


def sketch_bits(size: int) -> int:
    return min(SKETCH_MOST, max(SKETCH_FROM, 1 << int(size).bit_length()))


def differ(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer folded to the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), 0)
    return int(np.bitwise_count(x ^ y).sum())


def _pack(plan: list[Family], common: np.ndarray, buckets: int):
    """(bucket, blob): the signatures of a run of sets that fall into a bucket, by set."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in wb.chunks(batches, "text"):
            sets = Sets(part.column("text"))
            found = list(_signatures(sets, plan, common))
            if not found:
                continue
            row, signature, left = (np.concatenate(x) for x in zip(*found, strict=True))
            bucket = ((signature >> np.uint64(FAMILY_BITS)) % np.uint64(buckets)).astype(np.int64)
            tag = signature & np.uint64((1 << FAMILY_BITS) - 1)
            order = np.lexsort((tag, row, bucket))
            row, signature, left, tag, bucket = row[order], signature[order], left[order], tag[order], bucket[order]
            part_of = row.astype(np.uint64) << np.uint64(FAMILY_BITS) | tag
            edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            blobs = []
            for a, b in zip(edge, [*edge[1:], len(bucket)], strict=True):
                begin = np.flatnonzero(np.concatenate(([True], part_of[a + 1 : b] != part_of[a : b - 1])))
                count = np.diff([*begin, b - a]) << 32 | (left[a + begin] + 1)
                head = np.array([len(begin)], np.uint64)
                blobs.append(b"".join(x.astype(np.uint64).tobytes() for x in (head, sets.key[row[a + begin]], count, signature[a:b])))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edge].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return pack


def _groups_of(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Every signature that two or more sets share, equal groups once.

    Gives keys and spare worth of all members in a row, and where each group begins, its
    size, its family and how many signatures it stands for.
    """
    keys, lefts, signatures = [], [], []
    for blob in blobs:
        words = np.frombuffer(blob, np.uint64)
        n = int(words[0])
        count = (words[n + 1 : 2 * n + 1] >> np.uint64(32)).astype(np.int64)
        keys.append(np.repeat(words[1 : n + 1], count))
        lefts.append(np.repeat((words[n + 1 : 2 * n + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64) - 1, count))
        signatures.append(words[2 * n + 1 :])
    key, left, signature = np.concatenate(keys), np.concatenate(lefts), np.concatenate(signatures)
    order = np.argsort(signature, kind="stable")
    key, left, signature = key[order], left[order], signature[order]
    same = signature[1:] == signature[:-1]
    inside = np.zeros(len(key), bool)
    inside[1:] |= same
    inside[:-1] |= same
    key, left, signature = key[inside], left[inside], signature[inside]
    order = np.lexsort((key, signature))
    key, left, signature = key[order], left[order], signature[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (signature[1:] != signature[:-1])
    key, left, signature = key[new], left[new], signature[new]
    edge = np.flatnonzero(np.concatenate(([True], signature[1:] != signature[:-1]))) if len(key) else np.zeros(0, np.int64)
    size = np.diff([*edge, len(key)]).astype(np.int64)
    edge, size = edge[size > 1], size[size > 1]
    family = (signature[edge] & np.uint64((1 << FAMILY_BITS) - 1)).astype(np.int64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(wb.mix64(key))))
    name = wb.mix64(wb.mix64(total[edge + size] - total[edge] + size.astype(np.uint64)) + family.astype(np.uint64))
    _, once, times = np.unique(name, return_index=True, return_counts=True)
    return key, left, edge[once], size[once], family[once], times, name[once]


_GROUP = "name long, family int, times long, n long, member long, spare long"


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per member of every distinct group; buckets arrive one after another."""

    def rows(blobs: list[bytes]) -> pa.RecordBatch:
        key, left, edge, size, family, times, name = _groups_of(blobs)
        at = np.repeat(edge - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        columns = [
            np.repeat(name.view(np.int64), size), np.repeat(family.astype(np.int32), size), np.repeat(times, size),
            np.repeat(size, size), key[at].view(np.int64), left[at],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["name", "family", "times", "n", "member", "spare"])

    bucket, held = None, []
    for batch in batches:
        for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if b != bucket and held:
                yield rows(held)
                held = []
            bucket = b
            held.append(blob)
    if held:
        yield rows(held)


def wanted_filter(ids: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """Bits that tell which ids may be in a table: no id of the table is ever missed.

    The bits are combined by Spark; the driver sees at most ``FILTER_WORDS`` longs. With
    very many ids the filter lets more others pass, which costs time, never rows.
    """
    n = ids.count()
    words = min(FILTER_WORDS, max(1 << 10, 1 << (n // 4).bit_length()))
    value = F.coalesce(F.col(column), F.lit(-1))
    spot = F.pmod(value, F.lit(words * 64))
    bits = ids.groupBy(F.floor(spot / 64).cast("long").alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(spot, F.lit(64)).cast("int"))).alias("bits")
    )
    rows = bits.select("w", "bits").toPandas()
    out = np.zeros(words, np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint64), words


def may_want(bits: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Which of the ids the filter lets pass."""
    value = pc.fill_null(ids.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
    spot = np.mod(value, len(bits) * 64)
    return (bits[spot // 64] >> (spot % 64).astype(np.uint64) & np.uint64(1)).astype(bool)


def _wanted_sets(bits: np.ndarray):
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(may_want(bits, batch.column("doc_id"))))
            for part in wb.chunks(iter([some]), "text"):
                sets = Sets(part.column("text"))
                full = np.flatnonzero(sets.size)
                blobs = [sets.token[sets.first[i] : sets.first[i + 1]].tobytes() for i in full]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(full)), pa.array(sets.key[full].view(np.int64)), pa.array(blobs, pa.binary())],
                    ["doc_id", "key", "tokens"],
                )

    return fetch


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, common, all) sizes of intersection and union."""
    for batch in batches:
        shared, union = [], []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            u, v = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
            n = len(np.intersect1d(u, v, assume_unique=True))
            shared.append(n)
            union.append(len(u) + len(v) - n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array(union, pa.int64())],
            ["a", "b", "shared", "united"],
        )


def _may_link(size_a: int, size_b: int, sketch_a: bytes, sketch_b: bytes) -> bool:
    """Whether sizes and sketches leave room for a link."""
    total = size_a + size_b
    return differ(sketch_a, sketch_b) <= total - 2 * -(-NEED * total // OF) and 4 * min(size_a, size_b) >= 3 * max(size_a, size_b)


def _sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that may be linked."""
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("size_a", "size_b", "sketch_a", "sketch_b"))
        good = [_may_link(*r) for r in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("a").filter(pa.array(good, pa.bool_())), batch.column("b").filter(pa.array(good, pa.bool_()))], ["a", "b"]
        )


class _Side:
    """Members of a block as arrays; sketches by length, longer ones folded on demand."""

    def __init__(self, items: list[dict]):
        self.key = np.array([m["key"] for m in items], np.int64)
        self.root = np.array([m["root"] for m in items], np.int64)
        self.size = np.array([m["size"] for m in items], np.int64)
        self.sketch = [np.frombuffer(m["sketch"], np.uint8) for m in items]
        self.bytes = np.array([len(x) for x in self.sketch])

    def folded(self, which: np.ndarray, n: int) -> np.ndarray:
        """Sketches of ``n`` bytes."""
        return np.stack([np.bitwise_xor.reduce(self.sketch[i].reshape(-1, n), 0) for i in which])


def _between(x: _Side, y: _Side, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of pairs in different components whose sizes and sketches leave room for a link."""
    for n in np.unique(np.concatenate((x.bytes, y.bytes))).tolist():
        # Linked sets have sketches of the same length or of neighbouring ones.
        for few, many, flipped in ((x, y, False), (y, x, True)):
            mine = np.flatnonzero(few.bytes == n)
            longer = many.bytes == 2 * n
            other = np.flatnonzero(longer if flipped else longer | (many.bytes == n))
            if same and flipped or not len(mine) or not len(other):
                continue
            a, b = few.folded(mine, n), many.folded(other, n)
            for i, at in enumerate(mine.tolist()):
                total = few.size[at] + many.size[other]
                room = total - 2 * -(-NEED * total // OF)
                ok = (many.root[other] != few.root[at]) & (np.bitwise_count(b ^ a[i]).sum(1, dtype=np.int64) <= room)
                if same:
                    ok &= (many.bytes[other] > n) | (other > at)
                if ok.any():
                    yield np.full(int(ok.sum()), few.key[at]), many.key[other[ok]]


def _open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a group's members, from one block or two, in different components, that may be linked.

    Groups of the same sets arrive together, so most repeats of a pair end here.
    """
    found, held = np.zeros((0, 2), np.int64), 0
    new: list[np.ndarray] = []

    def merged() -> np.ndarray:
        return np.unique(np.concatenate((found, *new)), axis=0)

    for batch in batches:
        for left, right, same in zip(*(batch.column(c).to_pylist() for c in ("left", "right", "same")), strict=True):
            x = _Side(left)
            for one, two in _between(x, x if same else _Side(right), same):
                new.append(np.stack((np.minimum(one, two), np.maximum(one, two)), 1))
                held += len(one)
            if held > OPEN_PAIRS:
                found, new, held = merged(), [], 0
                if len(found) > OPEN_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])
                    found = found[:0]
    found = merged()
    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """``(a, b, shared, united)`` of pairs of keys, from the texts of one document of each class."""
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    chosen = cut(classes.join(keys, "key").select("key", "first"), f"{name}-chosen")
    bits, _ = wanted_filter(chosen, "first")
    sets = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_wanted_sets(bits), "doc_id long, key long, tokens binary")
    # Copies of a class carry the same set: only the chosen document's is shuffled.
    only = chosen.select("key", F.coalesce("first", F.lit(-1)).alias("_first"))
    sets = sets.withColumn("_first", F.coalesce("doc_id", F.lit(-1))).join(only, ["key", "_first"], "left_semi")
    sets = cut(sets.select("key", "tokens"), f"{name}-sets").dropDuplicates(["key"])
    x = sets.select(F.col("key").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("key").alias("b"), F.col("tokens").alias("y"))
    both = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return cut(both.mapInArrow(_compare, "a long, b long, shared long, united long"), f"{name}-compared")


def similar(compared: DataFrame) -> DataFrame:
    return compared.where(F.col("shared") * 100 >= F.col("united") * 75)


def groups(slim: DataFrame, classes: DataFrame) -> DataFrame:
    """``(name, member)``: groups of sets that share a signature, enough to hold every linked pair.

    A group of more than ``SMALL_GROUP`` sets keeps only those members for which such groups
    weigh more than the spare worth that they have left: any two linked sets whose shared
    signatures are all that common are both among them.
    """
    sizes = {r["size"]: r["n"] for r in classes.groupBy("size").agg(F.count("*").alias("n")).collect()}
    counted = slim.select("text").mapInArrow(_common, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "token").limit(COMMON_TOKENS).toPandas()
    common = np.sort(top["token"].to_numpy(np.int64).view(np.uint64))
    tokens = sum(s * n for s, n in sizes.items())
    share = min(0.5, float(top["n"].sum()) / tokens) if tokens else 0.0
    plan = families(max(sizes, default=0), sizes, share)
    total = sum(n * f.signatures(s) for s, n in sizes.items() for f in plan if f.low <= s <= f.larger)
    partitions = max(12, math.ceil(total / BUCKET_SIGNATURES))
    packed = slim.select("text").mapInArrow(_pack(plan, common, 2 * partitions), "bucket int, blob binary")
    found = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(_group, _GROUP)
    found = cut(found, "jaccard-groups")
    worth = F.element_at(F.array(F.lit(1), *[F.lit(w) for w in _worths(plan)]), F.col("family") + 2)
    large = found.where(F.col("n") > SMALL_GROUP)
    heavy = (
        large.groupBy("member", "family").agg(F.sum(F.col("times") * worth).alias("weight"), F.min("spare").alias("spare"))
        .where("weight > spare").select("member", "family")
    )
    kept = large.join(heavy, ["member", "family"], "left_semi").select("name", "member")
    return cut(found.where(F.col("n") <= SMALL_GROUP).select("name", "member").union(kept).distinct(), "jaccard-kept")


def _worths(plan: list[Family]) -> list[int]:
    by_tag = {f.number % (1 << FAMILY_BITS): f.worth for f in plan}
    return [by_tag.get(n, 1) for n in range(max(by_tag, default=0) + 1)]


def link(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of equal sets, links between classes that connect all linked ones, and documents.

    ``classes(key, size, first, n)``, ``links(a, b)``, ``members(doc_id, key, size)``.
    ``first`` is the smallest doc_id. A key is a 64-bit hash of the set.
    """
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    described = cut(slim.mapInArrow(_describe, "doc_id long, key long, size long, sketch binary"), "jaccard-members")
    members = described.select("doc_id", "key", "size")
    counted = members.where("size > 0").groupBy("key", "size").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    classes = cut(counted, "jaccard-classes")
    together = groups(slim, classes)

    facts = cut(_facts(together, classes, described), "jaccard-facts")
    # The set that is in most groups leads its groups: near copies then share few leaders.
    degree = together.groupBy("member").agg(F.count("*").alias("degree"))
    ranked = together.join(degree, "member")
    lead = cut(ranked.groupBy("name").agg(F.max_by("member", F.struct("degree", "member")).alias("lead")), "jaccard-leaders")
    led = together.join(lead, "name").where("lead <> member")
    stars = led.select(F.least("lead", "member").alias("a"), F.greatest("lead", "member").alias("b")).distinct()
    side_a = facts.select(F.col("key").alias("a"), F.col("size").alias("size_a"), F.col("sketch").alias("sketch_a"))
    side_b = facts.select(F.col("key").alias("b"), F.col("size").alias("size_b"), F.col("sketch").alias("sketch_b"))
    pairs = cut(stars.join(side_a, "a").join(side_b, "b").mapInArrow(_sieve, "a long, b long"), "jaccard-stars")
    compared = _verify(pairs, classes, docs, "jaccard-stars")
    links = similar(compared).select("a", "b")

    rest = _residual(together, lead, facts, compared, connected_components(links))
    if not rest.isEmpty():
        more = _verify(rest, classes, docs, "jaccard-rest")
        links = links.union(similar(more).select("a", "b"))
    return classes, links, members


def _facts(together: DataFrame, classes: DataFrame, described: DataFrame) -> DataFrame:
    """``(key, size, sketch)`` of the sets in any group, from one document each."""
    keys = together.select(F.col("member").alias("key")).distinct()
    chosen = classes.join(keys, "key").select("key", "size", F.coalesce("first", F.lit(-1)).alias("_first"))
    sketches = described.select("key", F.coalesce("doc_id", F.lit(-1)).alias("_first"), "sketch")
    return chosen.join(sketches, ["key", "_first"]).groupBy("key", "size").agg(F.first("sketch").alias("sketch"))


def _residual(together: DataFrame, lead: DataFrame, facts: DataFrame, compared: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs not compared yet that may be linked, from groups that are not one component by now."""
    rooted = together.join(roots.select(F.col("v").alias("member"), "root"), "member", "left").withColumn("root", F.coalesce("root", "member"))
    rooted = cut(rooted, "jaccard-rooted")
    names = rooted.groupBy("name").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x <> y")
    open_ = rooted.join(names.select("name", "n"), "name").join(facts.withColumnRenamed("key", "member"), "member")
    block = F.pmod(F.xxhash64("member"), F.ceil(F.col("n") / LIST_ROWS)).cast("int")
    item = F.struct(F.col("member").alias("key"), "root", "size", "sketch")
    parts = open_.withColumn("part", block).groupBy("name", "part").agg(F.collect_list(item).alias("items"))
    parts = cut(parts.join(lead, "name"), "jaccard-open")
    left = parts.select("name", "lead", F.col("part").alias("p"), F.col("items").alias("left"))
    right = parts.select(F.col("name").alias("other"), F.col("part").alias("q"), F.col("items").alias("right"))
    alone = parts.select("lead", "part", F.col("items").alias("left"), F.array().cast(parts.schema["items"].dataType).alias("right"), F.lit(True).alias("same"))
    several = left.join(right, (F.col("name") == F.col("other")) & (F.col("p") < F.col("q")))
    blocks = alone.union(several.select("lead", (F.col("p") * 1_000_003 + F.col("q")).alias("part"), "left", "right", F.lit(False).alias("same")))
    pairs = blocks.repartition("lead", "part").sortWithinPartitions("lead", "part").mapInArrow(_open_pairs, "a long, b long").distinct()
    return cut(pairs.join(compared.select("a", "b"), ["a", "b"], "left_anti"), "jaccard-open-pairs")


def decided(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, size, component_id, root)`` per row of ``docs``.

    ``root`` is a key that tells components apart also where ids are null or repeat; null for rows without shingles.
    """
    classes, links, members = link(docs)
    roots = connected_components(links)
    rooted = classes.join(roots.withColumnRenamed("v", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("key", "component_id", "root")
    # Many copies of one text share a key: Spark can split a large partition of this join.
    return members.join(named, "key", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def components(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row of ``docs``.

    Texts are lower-cased (A-Z) and cut at white space; a text of one to four words has one
    shingle of all its words; null, empty and blank texts have none and are linked with
    nothing. ``component_id`` is the smallest doc_id reachable by links; rows that repeat a
    doc_id are documents of their own that share it. A null doc_id counts only where a
    component has no other. Empty input gives an empty result.
    """
    return decided(docs).select("doc_id", F.col("size").alias("n_shingles"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component of ``docs``, the one with the smallest doc_id; all columns.

    Only rows that may have to go are shuffled with their texts; a filter of bounded size
    tells which. Rows without shingles all stay. Of rows that repeat the smallest doc_id
    within their component one stays. Components are told apart by their roots, so rows of
    different components all stay, also if they have no doc_id or the same one.
    """
    rows = cut(decided(docs), "jaccard-decided")
    repeated = rows.where("size > 0").groupBy("doc_id", "root").count().where("count > 1").select("doc_id")
    doubtful = rows.where("NOT (doc_id <=> component_id)").select("doc_id").union(repeated).distinct()
    bits, _ = wanted_filter(cut(doubtful, "jaccard-doubtful"), "doc_id")
    names = docs.columns

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~may_want(bits, batch.column("doc_id"))))

    def unsure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(may_want(bits, batch.column("doc_id"))))
            for part in wb.chunks(iter([some]), "text"):
                key = pa.array(Sets(part.column("text")).key.view(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, key], [*names, "_jd_key"])

    schema = T.StructType([*docs.schema.fields, T.StructField("_jd_key", T.LongType())])
    facts = rows.select(F.col("doc_id").alias("_jd_id"), F.col("key").alias("_jd_of"), "size", "component_id", "root").distinct()
    facts = facts.select(
        "_jd_id", "_jd_of", F.col("size").alias("_jd_size"), F.col("component_id").alias("_jd_component"), F.col("root").alias("_jd_root")
    )
    maybe = docs.mapInArrow(unsure, schema)
    joined = maybe.join(facts, (maybe["_jd_key"] == facts["_jd_of"]) & maybe["doc_id"].eqNullSafe(facts["_jd_id"]))
    kept = joined.where(F.col("doc_id").eqNullSafe(F.col("_jd_component")))
    once = kept.where("_jd_size > 0").dropDuplicates(["_jd_root"])
    return docs.mapInArrow(sure, docs.schema).union(once.select(*names)).union(kept.where("_jd_size = 0").select(*names))
