"""Benchmark decontamination as a prefix-filtered set join.

An item's windows are sets of short shingles. A document that holds a window holds all of its
shingles, so its rarest shingle, by counts over all documents, is a sufficient prefix: windows
are joined to documents on that one alone. The shingle's place in the window bounds where the
window must start and that it must end within the document; the words are then compared.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.llm import wordbytes as wb
from postlens.operators.materialize import cut

WINDOW = 13
SHINGLE = 5
BLOCK_WINDOWS = 250_000  # windows held by a matcher at once; more are matched block after block
CHAINED = 4  # matchers that work on one reading of the texts, each in a process of its own
COUNTED = 8_000_000  # distinct shingles counted in one reading of the texts, 64 MB; overlapping windows share theirs
HIT_PERCENT = 5

HITS = T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("size", T.LongType()), T.StructField("item", T.LongType())])
)
_ADDED = {
    "n_words": T.LongType(), "n_hit": T.LongType(), "n_items": T.LongType(), "items_sha256": T.StringType(),
    "contaminated": T.BooleanType(),
}


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in wb.chunks(batches, "text"):
        words = wb.Words(part.column("text"), wb.ALPHANUMERIC)
        hashes = words.hashes()
        ids = part.column("item_id").to_pylist()
        out: list[tuple] = []
        for row, item in enumerate(ids):
            first, count = int(words.first[row]), int(words.count[row])
            size = min(WINDOW, count)
            for start in range(first, first + count - size + 1) if size else ():
                k = min(SHINGLE, size)
                grams = wb.window_hash(hashes, np.arange(start, start + size - k + 1), k).view(np.int64)
                out.append((item, size, words.text_of(start, start + size), grams.tolist()))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        types = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["item_id", "size", "words", "grams"]
        )


class _Lookup:
    """Membership of hashes in a sorted array, with a bitmap for the many that are absent."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.low = np.uint64((1 << min(26, max(20, len(self.keys).bit_length() + 3))) - 1)
        self.seen = np.zeros(int(self.low) + 1, bool)
        self.seen[(self.keys & self.low).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` that are keys, and which key each is."""
        maybe = np.flatnonzero(self.seen[(hashes & self.low).astype(np.int64)])
        at = np.searchsorted(self.keys, hashes[maybe])
        at[at == len(self.keys)] = 0
        real = self.keys[at] == hashes[maybe] if len(self.keys) else np.zeros(len(at), bool)
        return maybe[real], at[real]


def _count_grams(keys: np.ndarray, lengths: list[int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(keys)
        seen = np.zeros(len(lookup.keys), np.int64)
        for part in wb.chunks(batches, "text"):
            words = wb.Words(part.column("text"), wb.ALPHANUMERIC)
            hashes = words.hashes()
            for k in lengths:
                starts, _ = wb.windows_at(words.first, k)
                _, key = lookup.find(wb.window_hash(hashes, starts, k))
                np.add.at(seen, key, 1)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lookup.keys[some].view(np.int64)), pa.array(seen[some])], ["gram", "n"]
        )

    return count


def _matcher(prefixes: list[tuple], names: list[str], first_block: bool, last_block: bool):
    """``prefixes``: (gram, place in the window, size, words, item). The last block's matcher gives the verdict."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_gram: dict[int, list[tuple]] = defaultdict(list)
        for gram, place, size, text, item in prefixes:
            by_gram[gram].append((place, size, bytes(text), item))
        lookup = _Lookup(np.array(list(by_gram), np.int64).view(np.uint64))
        lengths = sorted({min(SHINGLE, p[2]) for p in prefixes})
        for part in wb.chunks(batches, "text"):
            words = wb.Words(part.column("text"), wb.ALPHANUMERIC)
            hashes = words.hashes()
            hits: list[set] = [set() for _ in range(part.num_rows)] if first_block else [
                {(h["start"], h["size"], h["item"]) for h in row} for row in part.column("_dc_hits").to_pylist()
            ]
            for k in lengths:
                starts, count = wb.windows_at(words.first, k)
                found, _ = lookup.find(grams := wb.window_hash(hashes, starts, k))
                rows = np.repeat(np.arange(len(count)), count)[found]
                for row, at, gram in zip(rows.tolist(), starts[found].tolist(), grams[found].view(np.int64).tolist(), strict=True):
                    low, high = int(words.first[row]), int(words.first[row + 1])
                    for place, size, text, item in by_gram[gram]:
                        begin = at - place
                        if begin >= low and begin + size <= high and words.text_of(begin, begin + size) == text:
                            hits[row].add((begin - low, size, item))
            columns = [part.column(n) for n in names]
            listed = [[{"start": a, "size": b, "item": c} for a, b, c in sorted(h)] for h in hits]
            if last_block:
                yield pa.RecordBatch.from_arrays([*columns, *_digest(words.count.tolist(), listed)], [*names, *_ADDED])
            else:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64()), ("item", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(listed, kind)], [*names, "_dc_hits"])

    return match


def _digest(n_words: list[int], hits: list[list[dict]]) -> list[pa.Array]:
    """Columns of the verdict on each document, from its hits in order of their start."""
    rows = []
    for words, found in zip(n_words, hits, strict=True):
        n_hit, covered = 0, 0
        for h in found:
            n_hit += max(0, h["start"] + h["size"] - max(covered, h["start"]))
            covered = max(covered, h["start"] + h["size"])
        items = sorted({str(h["item"]) for h in found})
        sha = hashlib.sha256(",".join(items).encode()).hexdigest()
        rows.append((words, n_hit, len(items), sha, n_hit > 0 and 100 * n_hit >= HIT_PERCENT * words))
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    return [pa.array(c, t) for c, t in zip(columns, types, strict=True)]


def _rarity(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``(gram, n)``: how often the shingles of the windows occur in the documents, 0 left out.

    One reading of the texts counts ``COUNTED`` distinct shingles, far more than the usual
    benchmarks have together; beyond that, each reading counts its share of the hashes.
    """
    grams = cut(windows.select(F.explode("grams").alias("gram")).distinct(), "benchmark-shingles")
    lengths = [r["size"] for r in windows.select(F.least("size", F.lit(SHINGLE)).alias("size")).distinct().collect()]
    rounds = max(1, -(-grams.count() // COUNTED))
    counted = docs.sparkSession.createDataFrame([], "gram long, n long")
    for r in range(rounds):
        keys = grams.where(F.pmod("gram", F.lit(rounds)) == r).toPandas()["gram"].to_numpy(np.int64)
        counted = counted.union(docs.select("text").mapInArrow(_count_grams(keys.view(np.uint64), sorted(lengths)), "gram long, n long"))
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def contamination(docs: DataFrame, items: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_words, n_hit, n_items, items_sha256, contaminated``; every row stays.

    ``keep`` names the columns to return (all but those five by default). Null or empty
    texts have no words and no hits; items without an id, a text or a word take no part;
    repeated items and windows count once per item_id. Without any items nothing is hit.

    The texts are read once to count shingles and once to match them. Windows are matched in
    blocks of ``BLOCK_WINDOWS``, ``CHAINED`` of them on one reading: the memory of a task
    does not grow with the benchmark beyond that, as texts and hits so far are then written
    out and read again. Documents are never shuffled.
    """
    keep = [c for c in docs.columns if c not in _ADDED] if keep is None else keep
    slots = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    windows = slots.mapInArrow(_item_windows, "item_id long, size int, words binary, grams array<long>")
    spot = F.pmod(F.xxhash64("words"), F.lit(1 << 30))
    windows = cut(windows.distinct().withColumn("spot", spot), "benchmark-windows")
    placed = windows.select("item_id", "size", "words", "spot", F.posexplode("grams").alias("place", "gram"), F.size("grams").alias("of"))
    ranked = placed.join(_rarity(docs, windows), "gram").groupBy("item_id", "size", "words", "spot", "of").agg(
        F.count("*").alias("known"), F.min(F.struct("n", "place", "gram")).alias("rarest")
    )
    # A window with a shingle that no document has cannot occur.
    possible = ranked.where("known = of").select("rarest.gram", "rarest.place", "size", "words", "item_id", "spot")
    possible = cut(possible, "benchmark-prefixes")
    blocks = max(1, -(-possible.count() // BLOCK_WINDOWS))
    passing = docs.select(*dict.fromkeys([*keep, "text"]))
    for b in range(blocks):
        block = possible.where(F.pmod("spot", F.lit(blocks)) == b)
        prefixes = [(r["gram"], r["place"], r["size"], bytes(r["words"]), r["item_id"]) for r in block.collect()]
        last = b == blocks - 1
        names = keep if last else list(dict.fromkeys([*keep, "text"]))
        added = [T.StructField(n, t) for n, t in _ADDED.items()] if last else [T.StructField("_dc_hits", HITS)]
        schema = T.StructType([*[docs.schema[n] for n in names], *added])
        passing = passing.mapInArrow(_matcher(prefixes, names, not b, last), schema)
        if b % CHAINED == CHAINED - 1 and not last:
            passing = cut(passing, "contamination-so-far")
    return passing
