"""Source divergence audit: how far the word use of a source is from that of its language and of other sources.

Every partition folds its documents into hash stripes, one per (lang, term): the number of
documents with the term and its occurrences by source. Stripes are written out when they grow
large and merged by key. A merged stripe holds all that is known of a term, so it gives the
term's share of every divergence by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm import wordbytes as wb
from postlens.operators.materialize import cut

MIN_DOCS = 30  # documents of a language that must have a term
PRIOR = 5  # added to every count
DIGITS = 3  # a share is told in units of 1000 ** -DIGITS
TOP_TERMS = 50
HELD_ENTRIES = 1_500_000  # counts by (term, lang, source) that a task holds before it writes its stripes out
MERGE_ROWS = 50_000  # stripes merged at once
BATCH_ROWS = 5000
BUCKET_ENTRIES = 1 << 15  # counts compared at once
TILE_SOURCES = 512  # sources of a language compared with all others at once

_STRIPE = "lang string, term string, docs long, sources array<string>, counts array<long>"
_FOUND = "lang string, source string, part string, item string, value long"
LETTERS = np.zeros(256, bool)  # after lower-casing: a-z and every byte of a character outside ASCII
LETTERS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Stripes:
    """Stripes of the documents folded so far: ``(lang, term) -> documents, {source: occurrences}``.

    Every run of texts adds its distinct terms and, for each (term, lang, source), documents and
    occurrences; ``spill`` hashes the runs' terms together and adds up what is equal.
    """

    def __init__(self):
        self.terms: list[pa.Array] = []
        self.cells: list[tuple[np.ndarray, ...]] = []  # term, group, documents, occurrences
        self.groups: dict[tuple[str, str], int] = {}
        self.entries = 0

    def fold(self, texts: pa.Array, langs: list[str], sources: list[str]) -> None:
        words = wb.Words(texts, LETTERS)
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources, strict=True)], np.int64)
        if not len(words.start):
            return
        offsets = np.concatenate(([0], np.cumsum(words.end - words.start))).astype(np.int64)
        letters = np.ascontiguousarray(words.data[LETTERS[words.data]])
        every = pa.LargeStringArray.from_buffers(len(words.start), pa.py_buffer(offsets), pa.py_buffer(letters))
        coded = every.dictionary_encode()
        n = len(coded.dictionary)
        cell, times = np.unique(words.row() * n + coded.indices.to_numpy(), return_counts=True)
        cell, at = np.unique(group[cell // n] * n + cell % n, return_inverse=True)
        docs, occurrences = np.bincount(at), np.bincount(at, times)
        self.terms.append(coded.dictionary)
        self.cells.append((cell % n, cell // n, docs.astype(np.int64), occurrences.astype(np.int64)))
        self.entries += len(cell)

    def spill(self) -> Iterator[pa.RecordBatch]:
        if not self.entries:
            return
        coded = pa.concat_arrays(self.terms).dictionary_encode()
        code = coded.indices.to_numpy()
        begin = np.cumsum([0, *[len(t) for t in self.terms]])
        names = sorted(self.groups)
        lang_of = np.unique([g[0] for g in names], return_inverse=True)[1]
        place = np.empty(len(names), np.int64)
        for i, g in enumerate(names):
            place[self.groups[g]] = i
        term = np.concatenate([code[b + c[0]] for b, c in zip(begin, self.cells, strict=False)]).astype(np.int64)
        group, docs, occurrences = (np.concatenate([c[k] for c in self.cells]) for k in (1, 2, 3))
        cell, at = np.unique(term * len(names) + place[group], return_inverse=True)
        docs, occurrences = (np.bincount(at, x).astype(np.int64) for x in (docs, occurrences))
        term, group = cell // len(names), cell % len(names)
        yield from _batches(
            term * len(names) + lang_of[group], coded.dictionary.take(pa.array(term)),
            pa.array([g[0] for g in names], pa.string()).take(pa.array(group)), docs,
            pa.array([g[1] for g in names], pa.string()).take(pa.array(group)), occurrences,
        )
        self.terms, self.cells, self.groups, self.entries = [], [], {}, 0


def _batches(
    key: np.ndarray, term: pa.Array, lang: pa.Array, docs: np.ndarray, source: pa.Array, count: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """A stripe for each run of equal keys, of rows that tell a source's documents and occurrences."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    ends = np.concatenate((edge, [len(key)])).astype(np.int32)
    stripes = pa.RecordBatch.from_arrays(
        [
            lang.take(pa.array(edge)), term.take(pa.array(edge)).cast(pa.string()), pa.array(np.add.reduceat(docs, edge)),
            pa.ListArray.from_arrays(ends, source), pa.ListArray.from_arrays(ends, pa.array(count)),
        ],
        ["lang", "term", "docs", "sources", "counts"],
    )
    for i in range(0, stripes.num_rows, BATCH_ROWS):
        yield stripes.slice(i, BATCH_ROWS)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stripes of a partition; a term may come more than once."""
    stripes = Stripes()
    for part in wb.chunks(batches, "text"):
        stripes.fold(part.column("text"), part.column("lang").to_pylist(), part.column("source").to_pylist())
        if stripes.entries > HELD_ENTRIES:
            yield from stripes.spill()
    yield from stripes.spill()


def _merged(held: list[pa.RecordBatch], min_docs: int, last: bool) -> tuple[list[pa.RecordBatch], list[pa.RecordBatch]]:
    """Whole stripes with enough documents, and the last stripe (none of it at the end), as more of it may come."""
    table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    lang, term = table.column("lang"), table.column("term")
    n = table.num_rows
    same = pc.and_(pc.equal(lang.slice(1), lang.slice(0, n - 1)), pc.equal(term.slice(1), term.slice(0, n - 1)))
    stripe = np.concatenate(([0], np.cumsum(~same.to_numpy(zero_copy_only=False)))).astype(np.int64)
    docs = np.bincount(stripe, table.column("docs").to_numpy()).astype(np.int64)
    good = docs >= min_docs
    if not last:
        good[-1] = True
    rows = table.filter(pa.array(good[stripe]))
    stripe = stripe[good[stripe]]
    if not rows.num_rows:
        return [], []
    sources, counts = rows.column("sources"), rows.column("counts")
    size = pc.list_value_length(sources).to_numpy()
    coded = sources.flatten().dictionary_encode()
    k = len(coded.dictionary)
    cell, at = np.unique(np.repeat(stripe, size) * k + coded.indices.to_numpy(), return_inverse=True)
    # Counts of merged stripes may be large: sums stay integers.
    count = np.zeros(len(cell), np.int64)
    np.add.at(count, at, counts.flatten().to_numpy())
    first = np.searchsorted(stripe, cell // k)
    begins = np.concatenate(([True], cell[1:] // k != cell[:-1] // k))
    found = list(
        _batches(
            cell // k, rows.column("term").take(pa.array(first)), rows.column("lang").take(pa.array(first)),
            np.where(begins, docs[cell // k], 0), coded.dictionary.take(pa.array(cell % k)), count,
        )
    )
    if last:
        return found, []
    tail = found[-1].slice(found[-1].num_rows - 1, 1)
    return [*found[:-1], found[-1].slice(0, found[-1].num_rows - 1)], [tail]


def _merge(min_docs: int):
    """One stripe per (lang, term), which arrive one after another, of terms with enough documents."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(pa.RecordBatch.from_arrays(batch.columns, ["lang", "term", "docs", "sources", "counts"]))
            if sum(b.num_rows for b in held) > MERGE_ROWS:
                done, held = _merged(held, min_docs, last=False)
                yield from done
        if held:
            yield from _merged(held, min_docs, last=True)[0]

    return merge


def stripes(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(lang, term, docs, sources, counts)`` of the terms in at least ``min_docs`` documents of a language.

    A task gives a term once for each time that it writes its stripes out, however often
    the term occurs, so a very common term is as many rows as there are such times.
    """
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")]
    folded = docs.select(*blank).mapInArrow(_fold, _STRIPE)
    return folded.repartition("lang", "term").sortWithinPartitions("term", "lang").mapInArrow(_merge(min_docs), _STRIPE)


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(1000 ** DIGITS * counts / total) by long division: exact while 1000 * total fits 64 bits."""
    out, left = np.zeros(np.broadcast(counts, total).shape, np.int64), counts + np.zeros_like(total)
    for _ in range(DIGITS):
        left = left * 1000
        out = out * 1000 + left // total
        left = left % total
    return out + 1


def _diverge(top: int):
    def run(key: tuple, stripes: pa.Table, groups: pa.Table) -> pa.Table:
        """Parts of the divergences of a tile of sources, from a bucket of terms."""
        lang, tile = key[0].as_py(), key[2].as_py()
        found: dict[str, list] = {"lang": [], "source": [], "part": [], "item": [], "value": []}
        if stripes.num_rows and groups.num_rows:
            names, n = zip(*sorted(zip(groups.column("g_source").to_pylist(), groups.column("n").to_pylist(), strict=True)), strict=True)
            code = {s: i for i, s in enumerate(names)}
            kept = groups.column("kept")[0].as_py()
            terms, sizes = stripes.column("term").to_pylist(), [len(x) for x in stripes.column("counts").to_pylist()]
            at = np.repeat(np.arange(len(terms)), sizes)
            source = np.array([code[s] for x in stripes.column("sources").to_pylist() for s in x], np.int64)
            count = np.array([c for x in stripes.column("counts").to_pylist() for c in x], np.int64)
            n = np.array(n, np.int64)
            mine = range(tile * TILE_SOURCES, min(len(names), (tile + 1) * TILE_SOURCES))
            sums = np.zeros((len(mine), len(names)), np.int64)
            best: list[list[tuple[int, str]]] = [[] for _ in mine]
            step = max(1, (1 << 21) // len(names))
            order = np.searchsorted(at, np.arange(0, len(terms) + step, step))
            for lo, (a, b) in zip(range(0, len(terms), step), zip(order, order[1:], strict=False), strict=False):
                here = np.zeros((min(step, len(terms) - lo), len(names)), np.int64)
                here[at[a:b] - lo, source[a:b]] = count[a:b]
                p = shares(here + PRIOR, n + PRIOR * kept)
                q = shares(here.sum(1) + PRIOR, n.sum() + PRIOR * kept)
                for k, s in enumerate(mine):
                    sums[k] += np.abs(p - p[:, s : s + 1]).sum(0)
                    over = np.flatnonzero((here[:, s] > 0) & (p[:, s] > q))
                    best[k] += [(-int(p[i, s] - q[i]), terms[lo + i]) for i in over]
                    if len(best[k]) > 4 * top:
                        best[k] = _first(best[k], top)
            for k, s in enumerate(mine):
                rows = [("pair", names[j], int(sums[k, j])) for j in range(len(names)) if j != s]
                rows += [("term", term, -value) for value, term in _first(best[k], top)]
                for part, item, value in rows:
                    for column, x in zip(found, (lang, names[s], part, item, value), strict=True):
                        found[column].append(x)
        kinds = [pa.string()] * 4 + [pa.int64()]
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(found.items(), kinds, strict=True)})

    return run


def _first(found: list[tuple[int, str]], top: int) -> list[tuple[int, str]]:
    """The first by (value descending, term by its UTF-8 bytes)."""
    return sorted(found, key=lambda x: (x[0], x[1].encode()))[:top]


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every (lang, source) that occurs.

    Terms are runs of letters and of characters outside ASCII, A-Z lower-cased; a language
    keeps those in at least ``min_docs`` of its documents. Each source and the language
    itself give every kept term a share p of its smoothed counts, in billionths, plus one. Part
    ``pair``: the sum of the differences of p to each other source of the language, zero
    where no term is kept. Part ``term``: the ``top`` terms that the source has a larger p
    for than its language. Ranks count from 1 in each part, value descending, ties by the
    item's UTF-8 bytes.

    Null text, lang and source are read as empty; texts without terms still make their group
    occur; rows that repeat are documents of their own; a source alone in its language has
    no pairs. Empty input gives an empty result; other columns are not read.
    """
    merged = cut(stripes(docs, min_docs), "audit-stripes")
    each = merged.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e")).select("lang", "e.sources", "e.counts")
    sums = each.groupBy("lang", F.col("sources").alias("source")).agg(F.sum("counts").alias("n"))
    seen = docs.groupBy(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).agg(F.count("*").alias("rows"))
    groups = seen.join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    kept = merged.groupBy("lang").agg(F.count("*").alias("kept"), F.sum(F.size("counts")).alias("entries"))
    kept = kept.withColumn("buckets", F.ceil(F.col("entries") / BUCKET_ENTRIES).cast("int"))
    several = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE_SOURCES).cast("int").alias("tiles"))
    groups, facts = cut(groups, "audit-groups"), cut(kept.join(several, "lang"), "audit-langs")

    def all_of(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    key = ["lang", "bucket", "tile"]
    dealt = merged.join(facts, "lang").withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int"))
    left = dealt.withColumn("tile", all_of("tiles")).select(*key, "term", "sources", "counts")
    told = groups.join(facts, "lang").withColumn("bucket", all_of("buckets")).withColumn("tile", all_of("tiles"))
    right = told.select(*[F.col(c).alias(f"g_{c}") for c in (*key, "source")], "n", "kept")
    found = left.groupBy(*key).cogroup(right.groupBy(*[f"g_{c}" for c in key])).applyInArrow(_diverge(top), _FOUND)
    found = cut(found, "audit-found")

    # The pairs of sources are the result itself, so that is all this join gives.
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(other, "lang").where("source <> item")
    summed = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.join(summed, ["lang", "source", "item"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")
    )
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).cast("int")
    terms = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(terms)
