"""Deleted interpolation: a bigram language model whose weights depend on how often the context was seen.

p(w | v) = a * c(v w) / c(v) + b * c(w) / N + c / (V + 1), where (a, b, c) belong to the
bucket of log2 c(v). The weights come from expectation-maximisation over held-out counts: every
training token is predicted with its own occurrence deleted from the counts.

Counts are exact and distributed. A run of documents asks for each of its distinct words and
word pairs once, in one sorted binary per bucket of hashes. A bucket adds up what all runs
brought and answers each of them; the answers meet the run again, which then knows the count of
every token it holds. A frequent word is one number per run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm import wordbytes as wb
from postlens.llm.sample import fold
from postlens.operators.materialize import cut

RUN_BYTES = 8 << 20  # text of a run of documents; a longer document is a run of its own
BUCKET_KEYS = 2_000_000
EM_ROUNDS = 30
_END, _BEGIN = np.uint64(0x0E0F), np.uint64(0x0B0F)  # marks around a text
_BINS = 24  # steps of held-out probabilities per factor of ten
_LOW = 12  # factors of ten below one
_CELLS = _BINS * _LOW + 2  # the last one is a probability of zero
_BUCKETS = 64


def _runs(batches: Iterator[pa.RecordBatch], run_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``run_bytes`` of text, so that words repeat within them."""
    held, size = [], 0
    for part in wb.chunks(batches, "text", min(run_bytes, wb.CHUNK_BYTES)):
        held.append(part)
        size += part.column("text").nbytes
        if size >= run_bytes:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, token before it, text) of every token, the end of each text counted as one."""
    words = wb.Words(texts, wb.NOT_SPACE)
    n = words.count + 1
    end = np.cumsum(n) - 1
    token = np.empty(int(n.sum()), np.uint64)
    inner = np.ones(len(token), bool)
    inner[end] = False
    token[inner] = words.hashes()
    token[end] = _END
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.concatenate(([0], end[:-1] + 1)) if len(end) else []] = _BEGIN
    return token, before, np.repeat(np.arange(len(n)), n)


def _pair(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return wb.mix64(wb.mix64(before + np.uint64(17)) + token)


def _packed(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, their bytes in planes: leading zeros then compress away."""
    steps = np.diff(values, prepend=np.zeros(1, values.dtype)).astype(np.uint64)
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def _small(values: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs."""
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(values) or values.max() <= np.iinfo(t).max)
    return np.array([np.dtype(kind).itemsize], np.uint8).tobytes() + values.astype(kind).tobytes()


def _counts(blob: bytes) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[blob[0]]
    return np.frombuffer(blob, kind, offset=1).astype(np.int64)


def _split(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted keys; buckets are equal ranges of the hash."""
    width = np.uint64((1 << 64) // buckets + 1)
    return np.searchsorted(keys, np.arange(buckets, dtype=np.uint64) * width).tolist() + [len(keys)]


def _named(batches: Iterator[pa.RecordBatch], run_bytes: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs and their names: a hash of the rows in order, the same whenever the input is read."""
    for part in _runs(batches, run_bytes):
        ids = part.column("row_id").to_numpy().view(np.uint64)
        at = np.arange(len(ids), dtype=np.uint64)
        yield int(wb.mix64(np.array([np.sum(wb.mix64(ids + wb.mix64(at)))], np.uint64)).view(np.int64)[0]), part


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    names = ["run", "bucket", "kind", "keys", "counts"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _rows(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[tuple]]:
    """Groups of rows that agree in their first ``by`` of (bucket, kind), or in run where ``by`` is 0."""
    now, held = None, []
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("run", "bucket", "kind", "keys", "counts")), strict=True):
            key = r[1 : 1 + by] if by else r[0]
            if key != now and held:
                yield held
                held = []
            now = key
            held.append(r)
    if held:
        yield held


def _ask(buckets: int, run_bytes: int):
    """(run, bucket, kind, keys, own counts): the distinct words (kind 0) and pairs (kind 1) of a run."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, part in _named(batches, run_bytes):
            token, before, row = _tokens(part.column("text"))
            train = ~part.column("held").to_numpy(zero_copy_only=False).astype(bool)[row]
            out = []
            for kind, keys in ((0, token), (1, _pair(before, token))):
                distinct, inverse = np.unique(keys, return_inverse=True)
                own = np.bincount(inverse, train, minlength=len(distinct)).astype(np.int64)
                edge = _split(distinct, buckets)
                for b, (i, j) in enumerate(zip(edge, edge[1:], strict=False)):
                    if j > i:
                        out.append((name, b, kind, _packed(distinct[i:j]), _small(own[i:j])))
            yield _blobs(out)

    return ask


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up a bucket and answers every question; kinds 2 and 3 hold its sum and number of counted keys."""
    for held in _rows(batches, 2):
        asked = [_unpacked(k) for *_, k, _ in held]
        keys, own = np.concatenate(asked), np.concatenate([_counts(c) for *_, c in held])
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        total = np.add.reduceat(own[order], np.flatnonzero(new))
        answer = np.empty(len(keys), np.int64)
        answer[order] = total[np.cumsum(new) - 1]
        ends = np.cumsum([len(a) for a in asked]).tolist()
        out = [
            (run, bucket, kind, b"", _small(answer[end - len(mine) : end]))
            for (run, bucket, kind, _, _), mine, end in zip(held, asked, ends, strict=True)
        ]
        sums = np.array([total.sum(), np.count_nonzero(total)], np.int64).tobytes()
        yield _blobs([*out, (0, held[0][1], held[0][2] + 2, sums, b"")])


def _body(run_bytes: int):
    """A run with its texts, to meet the answers; bucket -1."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, part in _named(batches, run_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(part)
            yield _blobs([(name, -1, 0, sink.getvalue().to_pybytes(), b"")])

    return body


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, held, size, words, pairs): per run its documents, and the counts of all their tokens."""
    for rows in _rows(batches, 0):
        answers = {(r[2], r[1]): r[4] for r in rows if r[1] >= 0}  # equal runs have equal answers
        counts = [[_counts(answers[k]) for k in sorted(answers) if k[0] == kind] for kind in (0, 1)]
        for body in (r[3] for r in rows if r[1] < 0):
            part = pa.ipc.open_stream(body).read_all().combine_chunks().to_batches()[0]
            token, before, row = _tokens(part.column("text"))
            found = []
            for keys, known in ((token, counts[0]), (_pair(before, token), counts[1])):
                _, inverse = np.unique(keys, return_inverse=True)
                found.append(_small(np.concatenate(known)[inverse]))
            size = np.bincount(row, minlength=part.num_rows).astype(np.int64)
            ids, held = part.column("doc_id"), part.column("held")
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([x.to_pylist()], pa.list_(x.type)) for x in (ids, held, pa.array(size))), *(pa.array([x], pa.binary()) for x in found)],
                ["doc_id", "held", "size", "words", "pairs"],
            )


class _Run:
    """A run of documents with the global counts of its tokens."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.doc_id, self.held, size = (batch.column(c)[i].values for c in ("doc_id", "held", "size"))
        self.size = size.to_numpy()
        self.row = np.repeat(np.arange(len(self.size)), self.size)
        self.train = ~self.held.to_numpy(zero_copy_only=False).astype(bool)[self.row]
        self.token, self.pair = (_counts(batch.column(c)[i].as_py()) for c in ("words", "pairs"))
        self.first = np.zeros(len(self.token), bool)
        self.first[np.cumsum(self.size) - self.size] = True

    def context(self, documents: int) -> np.ndarray:
        """Count of what stands before each token; a beginning was seen once per training document."""
        out = np.empty_like(self.token)
        out[1:] = self.token[:-1]
        out[self.first] = documents
        return out


def _by_run(handle):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from handle(_Run(batch, i))

    return each


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)


def _cell(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        at = np.floor(-np.log10(p) * _BINS)
    return np.where(p > 0, np.clip(at, 0, _BINS * _LOW), _CELLS - 1).astype(np.int64)


def _deleted(tokens: int, documents: int):
    """(bucket, pair cell, word cell, n) of training tokens, each with its own occurrence deleted."""

    def handle(run: _Run) -> Iterator[pa.RecordBatch]:
        context = run.context(documents)
        context, pair, token = context[run.train] - 1, run.pair[run.train] - 1, run.token[run.train] - 1
        two = pair / np.maximum(context, 1)
        one = token / max(1, tokens - 1)
        key = (_bucket(context) * _CELLS + _cell(two)) * _CELLS + _cell(one)
        cell, n = np.unique(key, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    return _by_run(handle)


def learn(cells: np.ndarray, n: np.ndarray, types: int) -> np.ndarray:
    """Weights (pair, word, uniform) per bucket, from counts of held-out probabilities by cell.

    Probabilities are those of the middle of a cell. A bucket that no training token fell
    into takes the weights over all buckets.
    """

    def middle(cell: np.ndarray) -> np.ndarray:
        return np.where(cell == _CELLS - 1, 0.0, 10.0 ** (-(cell + 0.5) / _BINS))

    bucket, two, one = cells // _CELLS**2, middle(cells // _CELLS % _CELLS), middle(cells % _CELLS)
    parts = np.stack((two, one, np.full(len(cells), 1 / (types + 1))), 1)

    def mixture(use: np.ndarray) -> np.ndarray:
        weights = np.full(3, 1 / 3)
        for _ in range(EM_ROUNDS):
            share = parts[use] * weights
            share /= share.sum(1, keepdims=True)
            weights = (share * n[use, None]).sum(0)
            weights /= weights.sum()
        weights = np.maximum(weights, 1e-6)
        return weights / weights.sum()

    everything = np.ones(len(cells), bool)
    out = np.tile(mixture(everything) if len(cells) else np.array([0.0, 0.5, 0.5]), (_BUCKETS + 1, 1))
    for b in np.unique(bucket):
        out[b] = mixture(bucket == b)
    return out


def _scores(tokens: int, types: int, documents: int, weights: np.ndarray):
    def handle(run: _Run) -> Iterator[pa.RecordBatch]:
        context = run.context(documents)
        mix = weights[_bucket(context)]
        p = mix[:, 0] * run.pair / np.maximum(context, 1) + mix[:, 1] * run.token / max(1, tokens) + mix[:, 2] / (types + 1)
        n = len(run.size)
        base = np.bincount(run.row, np.log10((run.token + 1) / (tokens + types + 1)), minlength=n)
        known = np.bincount(run.row, run.token > 0, minlength=n).astype(np.int64)
        score = np.bincount(run.row, np.log10(p), minlength=n)
        yield pa.RecordBatch.from_arrays(
            [
                run.doc_id, run.held, pa.array(run.size.astype(np.int64)), pa.array(known),
                pa.array(np.full(n, tokens, np.int64)), pa.array(base), pa.array(score),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return _by_run(handle)


def score(docs: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row of ``docs``.

    Null and empty texts consist of the end alone. Without training documents every count is
    zero: ``base_score`` is 0 and the model is uniform. Word identity is 64 bits of hash.
    """
    held = docs.select(
        F.xxhash64("doc_id", "text").alias("row_id"), F.col("doc_id").cast("long"), "text",
        (fold(F.col("doc_id"), 7) == 2).alias("held"),
    )
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(12, -(-size // 4 // BUCKET_KEYS))
    shape = "run long, bucket int, kind int, keys binary, counts binary"
    questions = held.mapInArrow(_ask(partitions, run_bytes), shape).repartition(partitions, "bucket", "kind")
    answers = cut(questions.sortWithinPartitions("bucket", "kind").mapInArrow(_answer, shape), "lm-answers")
    tokens, types = 0, 0
    for r in answers.where("kind = 2").select("keys").collect():  # one row per bucket
        sums = np.frombuffer(r["keys"], np.int64)
        tokens, types = tokens + int(sums[0]), types + int(sums[1])
    documents = held.where("NOT held").select("row_id").count()
    meeting = held.mapInArrow(_body(run_bytes), shape).unionByName(answers.where("kind < 2"))
    meeting = meeting.repartition(partitions, "run").sortWithinPartitions("run")
    runs = cut(
        meeting.mapInArrow(
            _meet, "doc_id array<long>, held array<boolean>, size array<long>, words binary, pairs binary"
        ),
        "lm-runs",
    )
    deleted = runs.mapInArrow(_deleted(tokens, documents), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    table = deleted.toPandas()  # at most _BUCKETS * _CELLS ** 2 rows, whatever the input
    weights = learn(table["cell"].to_numpy(np.int64), table["n"].to_numpy(np.int64), types)
    return runs.mapInArrow(
        _scores(tokens, types, documents, weights),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
