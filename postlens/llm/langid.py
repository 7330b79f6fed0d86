"""Language identification: known words first, then ever shorter character n-grams.

A word seen in training is scored by its log frequency in each language. Any other word backs
off to its character n-grams of length ``LONGEST``; if none of them was seen, to one shorter,
and so on. A text takes the language with the largest sum over its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.llm import wordbytes as wb
from postlens.llm.sample import bounded, fold, lowest
from postlens.operators.materialize import cut

TRAIN_DOCS = 1500  # training documents of each language, at most; chosen by a hash of the id
LONGEST = 5
SMOOTH = 0.5
UNDETERMINED = "und"
_EDGE = 0x5F  # marks both ends of a word

LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _grams(words: wb.Words, pick: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the byte n-grams of the picked words, ends marked, and the word of each."""
    length = words.end[pick] - words.start[pick] + 2
    begin = np.cumsum(length) - length
    at = np.arange(int(length.sum())) - np.repeat(begin, length)
    source = np.repeat(words.start[pick] - 1, length) + at
    data = words.data[np.clip(source, 0, max(0, len(words.data) - 1))].copy()
    data[begin] = _EDGE
    data[begin + length - 1] = _EDGE
    starts, count = wb.windows_at(np.concatenate((begin, [int(length.sum())])), n)
    return wb.window_hash(wb.mix64(data.astype(np.uint64)), starts, n), np.repeat(np.arange(len(pick)), count)


def _words(texts: pa.Array) -> wb.Words:
    return wb.Words(pc.utf8_lower(pc.fill_null(texts, "")), LETTERS)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, lang, n) of each run of texts."""
    for part in wb.chunks(batches, "text"):
        words, langs = _words(part.column("text")), part.column("lang").to_pylist()
        if not len(words.start):
            continue
        offsets = np.concatenate(([0], np.cumsum(words.end - words.start))).astype(np.int64)
        letters = np.ascontiguousarray(words.data[LETTERS[words.data]])
        coded = pa.LargeStringArray.from_buffers(len(words.start), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
        names = sorted(set(langs))
        code = np.array([names.index(x) for x in langs], np.int64)[words.row()]
        cell, n = np.unique(code * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [
                coded.dictionary.take(pa.array(cell % len(coded.dictionary))).cast(pa.string()),
                pa.array(names, pa.string()).take(pa.array(cell // len(coded.dictionary))), pa.array(n.astype(np.int64)),
            ],
            ["word", "lang", "n"],
        )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, feature, lang, n) of distinct (word, lang) rows: the word has kind 0 and its own count, its n-grams count once."""
    for part in wb.chunks(batches, "word"):
        words = wb.Words(part.column("word"), LETTERS, lower=False)
        every = np.arange(len(words.start))
        found = [(0, words.hashes(), every, part.column("n").to_numpy())]
        for k in range(1, LONGEST + 1):
            feature, word = _grams(words, every, k)
            found.append((k, feature, word, np.ones(len(feature), np.int64)))
        for k, feature, word, n in found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(feature), k, np.int32)), pa.array(feature.view(np.int64)), part.column("lang").take(pa.array(word)), pa.array(n)],
                ["kind", "feature", "lang", "n"],
            )


class Model:
    """Log frequencies by language of the known features of each kind."""

    def __init__(self, langs: list[str], prior: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]]):
        self.langs, self.prior, self.tables = langs, prior, tables

    def known(self, kind: int, features: np.ndarray) -> np.ndarray:
        """Row of each feature in the table of its kind, or -1."""
        keys = self.tables[kind][0]
        if not len(keys):
            return np.full(len(features), -1)
        at = np.searchsorted(keys, features)
        at[at == len(keys)] = 0
        return np.where(keys[at] == features, at, -1)

    def word_scores(self, words: wb.Words, first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """A row of log scores for each distinct word."""
        out = np.zeros((len(hashes), len(self.langs)))
        at = self.known(0, hashes)
        out[at >= 0] = self.tables[0][1][at[at >= 0]]
        left = np.flatnonzero(at < 0)
        for k in range(LONGEST, 0, -1):
            if not len(left):
                break
            gram, word = _grams(words, first[left], k)
            at = self.known(k, gram)
            word, at = word[at >= 0], at[at >= 0]
            n = np.bincount(word, minlength=len(left))
            seen = n > 0
            for c in range(len(self.langs)):
                sums = np.bincount(word, self.tables[k][1][at, c], minlength=len(left))
                out[left[seen], c] = sums[seen] / n[seen]
            left = left[~seen]
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        words = _words(texts)
        distinct, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        scores, row = self.word_scores(words, first, distinct), words.row()
        total = np.tile(self.prior, (len(texts), 1))
        for c in range(len(self.langs)):
            total[:, c] += np.bincount(row, scores[inverse, c], minlength=len(texts))
        best = total.argmax(1) if self.langs else np.zeros(len(texts), int)
        calm = (total - total.max(1, keepdims=True)) / np.sqrt(np.maximum(words.count, 1))[:, None]
        share = np.exp(calm)
        score = share[np.arange(len(texts)), best] / share.sum(1)
        return [self.langs[b] for b in best], np.where(has_letter(texts, words), score, 0.0)


def has_letter(texts: pa.Array, words: wb.Words) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_letter = np.concatenate((np.zeros(1, np.int64), np.cumsum((words.data >= 0x61) & (words.data <= 0x7A))))
    out = np.diff(ascii_letter[words.at]) > 0
    for i in np.flatnonzero(~out & (words.count > 0)):
        out[i] = any(c.isalpha() for c in texts[i].as_py())
    return out


def train(docs: DataFrame) -> Model:
    """A model from a bounded sample of the documents with a language outside the held-out fold.

    The sample has up to ``TRAIN_DOCS`` documents of each language, so that a rare one is
    learned too, and all words and n-grams of the sample are kept. N-grams are counted once
    for each distinct word of a language, wherever its documents lie.
    """
    keys = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 4) != 2)).select("doc_id", "lang")
    # Written out, so that its real size decides whether it is broadcast.
    chosen = cut(lowest(keys, TRAIN_DOCS, 7, "lang"), "language-sample")
    sample = bounded(docs, chosen, ["doc_id", "lang"])
    words = sample.select("text", "lang").mapInArrow(_count_words, "word string, lang string, n long")
    words = words.groupBy("word", "lang").agg(F.sum("n").alias("n"))
    counted = words.mapInArrow(_features, "kind int, feature long, lang string, n long")
    counted = cut(counted.groupBy("kind", "feature", "lang").agg(F.sum("n").alias("n")), "language-counts")
    sums = counted.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in sums})
    code = {x: i for i, x in enumerate(langs)}
    whole = np.zeros((LONGEST + 1, max(1, len(langs))))
    for r in sums:
        whole[r["kind"], code[r["lang"]]] = r["n"]
    coded = F.array_position(F.lit(langs), F.col("lang")).cast("int") - 1 if langs else F.lit(0)
    tables = []
    for kind in range(LONGEST + 1):
        mine = counted.where(F.col("kind") == kind).select("feature", coded.alias("lang"), "n").toArrow()  # of the bounded sample
        keys_k, at = np.unique(mine.column("feature").to_numpy().view(np.uint64), return_inverse=True)
        count = np.full((len(keys_k), len(langs)), SMOOTH)
        np.add.at(count, (at, mine.column("lang").to_numpy()), mine.column("n").to_numpy().astype(float))
        tables.append((keys_k, np.log(count / (whole[kind, : len(langs)] + SMOOTH * (len(keys_k) + 1)))))
    words = whole[0, : len(langs)]
    return Model(langs, np.log((words + 1) / (words.sum() + max(1, len(langs)))), tables)


def identify(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``; every row stays.

    ``keep`` names the columns to return (all by default; columns of the new names are
    replaced). A text that is null or has no letter is ``und`` with score 0, as is every text
    when no document could be learned from. The score is the share of the predicted
    language when the log scores are divided by the square root of the number of words.
    Ties go to the language that sorts first.
    """
    model = train(docs)
    added = {"held_out": T.BooleanType(), "lang_pred": T.StringType(), "score": T.DoubleType()}
    keep = [c for c in docs.columns if c not in added] if keep is None else keep

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in wb.chunks(batches, "text"):
            texts = part.column("text")
            if model.langs:
                langs, score = model.predict(texts)
                langs = [x if s > 0 else UNDETERMINED for x, s in zip(langs, score, strict=True)]
            else:
                langs, score = [UNDETERMINED] * part.num_rows, np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*[part.column(n) for n in keep], part.column("_li_held"), pa.array(langs, pa.string()), pa.array(score)],
                [*keep, *added],
            )

    schema = T.StructType([*[docs.schema[n] for n in keep], *[T.StructField(n, t) for n, t in added.items()]])
    held = docs.select(*dict.fromkeys([*keep, "text"]), (fold(F.col("doc_id"), 4) == 2).alias("_li_held"))
    return held.mapInArrow(label, schema)
