"""Chat formatting in budgeted windows of whole turns.

Prefix sums of the turns' tokens choose spans of turns that fit a budget. Every window begins
with the conversation's system turn, then repeats a limited history of the turns before its
span; what is repeated carries no loss. Each turn is the target span of exactly one window, and
assistant turns of the span carry loss.

Prefix sums run over all turns in the order (conversation, turn), by range partitions, so one
long conversation is summed in parts. It is then cut into stretches of a bounded number of
tokens, each the work of one group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.operators.materialize import cut

BUDGET = 2048  # tokens of a window; a longer turn has a window of its own
HISTORY = 512  # tokens of turns repeated before a span, at most
STRETCH = 64 * BUDGET  # tokens of a conversation formatted as one group
MARK_TOKENS = 4
OPEN, CLOSE, ESCAPE = "<|im_start|>", "<|im_end|>", "\\"
LOSS_ROLE, SYSTEM_ROLE = "assistant", "system"


def escape(text: str) -> str:
    """No text contains a mark: a backslash goes before every backslash and every ``<|``'s bar."""
    return text.replace(ESCAPE, ESCAPE * 2).replace("<|", "<" + ESCAPE + "|")


def unescape(text: str) -> str:
    out, at = [], 0
    while (found := text.find(ESCAPE, at)) >= 0:
        out += [text[at:found], text[found + 1 : found + 2]]
        at = found + 2
    return "".join([*out, text[at:]])


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its body begins and ends."""
    head = f"{OPEN}{escape(role).replace(chr(10), ESCAPE + 'n')}\n"
    body = escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, int, int]]:
    """(role, begin, end of the body) of every turn of a formatted window."""
    out, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(CLOSE + "\n", line)
        out.append((_role(formatted[at + len(OPEN) : line]), line + 1, end))
        at = end + len(CLOSE) + 1
    return out


def _role(written: str) -> str:
    out, at = [], 0
    while (found := written.find(ESCAPE, at)) >= 0:
        out += [written[at:found], "\n" if written[found + 1 : found + 2] == "n" else written[found + 1 : found + 2]]
        at = found + 2
    return "".join([*out, written[at:]])


def spans(tokens: list[int], fixed: int, past: list[int], budget: int, history: int) -> list[tuple[int, int, int]]:
    """(first repeated, first, end) of windows over turns after those of ``past``.

    Positions count from the first turn of ``past``. A span takes turns while the budget
    lasts; the repeated turns before it are those that fit ``history`` and leave room for its
    first turn.
    """
    whole = [*past, *tokens]
    ends = [0]
    for t in whole:
        ends.append(ends[-1] + t)
    out, first = [], len(past)
    while first < len(whole):
        room = min(history, budget - fixed - whole[first])
        back = first
        while back > 0 and ends[first] - ends[back - 1] <= room:
            back -= 1
        end = first + 1
        while end < len(whole) and fixed + ends[end + 1] - ends[back] <= budget:
            end += 1
        out.append((back, first, end))
        first = end
    return out


def _format(budget: int, history: int):
    """Windows of one stretch after another; rows arrive by (conversation, stretch, place)."""
    names = ["has_id", "conv_id", "stretch", "place", "part", "role", "text", "tokens"]

    def windows(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
        system = [r for r in rows if r[4] == 0]
        past = [r for r in rows if r[4] == 1]
        new = [r for r in rows if r[4] == 2]
        if key[2] == 0 and system:
            new, lead = [*system, *new], 1
        else:
            lead = 0
        fixed = sum(r[7] for r in system)
        out = []
        body = new[lead:]
        plan = spans([r[7] for r in body], fixed, [r[7] for r in past], budget, history) or ([(0, 0, 0)] if lead else [])
        turns = [*past, *body]
        for w, (back, first, end) in enumerate(plan):
            text, masks = [], []
            at, repeated = 0, 0
            opening = bool(lead) and w == 0  # the system turn's own place
            for r, target in [(s, opening) for s in system] + [(r, i >= first) for i, r in enumerate(turns[back:end], back)]:
                piece, begin, stop = turn_text(r[5], r[6])
                if target and r[5] == LOSS_ROLE:
                    masks.append([at + begin, at + stop])
                repeated += not target
                text.append(piece)
                at += len(piece)
            out.append((key[1] if key[0] else None, key[2], w, repeated, "".join(text), masks))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(
            [pa.array([list(x) for x in c] if i == 5 else c, k) for i, (c, k) in enumerate(zip(columns, kinds, strict=True))],
            ["conv_id", "stretch", "window", "repeated", "formatted", "loss"],
        )
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if r[:3] != now and held:
                    yield windows(now, held)
                    held = []
                now = r[:3]
                held.append(r)
        if held:
            yield windows(now, held)

    return each


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to every row of a sorted partition the tokens before it within the partition."""
    done = 0
    for batch in batches:
        before = []
        for t in batch.column("tokens").to_pylist():
            before.append(done)
            done += t
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64())], [*batch.schema.names, "before"])


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, stretch: int = STRETCH) -> DataFrame:
    """``(conv_id, stretch, window, repeated, formatted, loss)`` from ``turns(conv_id, turn, role, text)``.

    ``formatted`` is the window's text, its first ``repeated`` turns repeat earlier ones, and
    ``loss`` lists [begin, end) character ranges of the assistant texts to learn. Windows of a
    conversation are in the order of (stretch, window). Rows are ordered by turn, those
    of one turn by role and a hash of the text, so that the order of files decides nothing; a
    null turn comes first; repeated rows are turns of their own. A null role or text is empty; null conv_ids form one conversation. A system turn is
    the first turn with that role at the head of a conversation; any other is an ordinary
    turn. Tokens are white-space words plus ``MARK_TOKENS``.
    """
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+"))
    rows = turns.select(
        F.col("conv_id").isNotNull().alias("has_id"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        (F.coalesce(words, F.lit(0)) + MARK_TOKENS).cast("long").alias("tokens"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("copy"),
    )
    order = ["has_id", "conv_id", F.col("turn").asc_nulls_first(), "role", "tie", "copy"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.withColumn("mid", F.monotonically_increasing_id())
    schema = "has_id boolean, conv_id long, role string, text string, tokens long, mid long, before long"
    summed = cut(placed.select("has_id", "conv_id", "role", "text", "tokens", "mid").mapInArrow(_running, schema), "chat-turns")
    part = F.shiftright("mid", 33)
    sums = summed.groupBy(part.alias("p")).agg(F.sum("tokens").alias("n")).collect()  # one row per partition
    total, offsets = 0, []
    for r in sorted(sums, key=lambda r: r["p"]):
        offsets.append((r["p"], total))
        total += r["n"]
    start = turns.sparkSession.createDataFrame(offsets, "p long, offset long")
    key = ["has_id", "conv_id"]
    global_ = summed.join(F.broadcast(start), part == F.col("p")).withColumn("before", F.col("before") + F.col("offset")).drop("p", "offset")
    heads = global_.groupBy(*key).agg(
        F.min("before").alias("zero"), F.max("before").alias("last"), F.min("mid").alias("head"),
        F.min_by(F.struct("role", "tokens"), "mid").alias("lead"),
    )
    lead = F.when(F.col("lead.role") == SYSTEM_ROLE, F.col("lead.tokens")).otherwise(0)
    heads = heads.select(*key, "zero", "last", F.when(lead > 0, F.col("head")).alias("system"), lead.alias("lead"))
    known = global_.join(heads, key)
    is_system = F.col("mid") == F.coalesce("system", F.lit(-1))
    at = F.col("before") - F.col("zero") - F.col("lead")
    after = at + F.col("tokens")

    def stretch_of(x: Column) -> Column:
        return F.floor(x / stretch).cast("long")

    last = stretch_of(F.greatest(F.col("last") - F.col("zero") - F.col("lead"), F.lit(0)))
    # A turn belongs to the stretch it begins in; the system turn goes to all, and a turn that
    # ends within ``history`` of a later stretch's beginning goes there as history.
    mine = stretch_of(F.greatest(at, F.lit(0)))
    also = stretch_of(after + history)
    shares = F.when(is_system, F.transform(F.sequence(F.lit(0), last), lambda s: F.struct(s.cast("long").alias("stretch"), F.lit(0).alias("part"))))
    shares = shares.otherwise(
        F.concat(
            F.array(F.struct(mine.alias("stretch"), F.lit(2).alias("part"))),
            F.when(
                (also > mine) & (also <= last), F.array(F.struct(also.alias("stretch"), F.lit(1).alias("part")))
            ).otherwise(F.array().cast("array<struct<stretch: bigint, part: int>>")),
        )
    )
    dealt = known.select(*key, "role", "text", "tokens", F.col("mid").alias("place"), F.inline(shares))
    grouped = dealt.repartition(*key, "stretch").sortWithinPartitions(*key, "stretch", "place")
    grouped = grouped.select("has_id", "conv_id", "stretch", "place", "part", "role", "text", "tokens")
    return grouped.mapInArrow(
        _format(budget, history), "conv_id long, stretch long, window long, repeated long, formatted string, loss array<array<long>>"
    )


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of one conversation after another, read from its windows in order; only hashes are held."""
    now, state = None, None

    def row(key, s) -> tuple:
        return (key[1], s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4])

    out: list[tuple] = []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "repeated", "formatted", "loss")]
        for conv, repeated, formatted, loss in zip(*columns, strict=True):
            if (key := (conv is not None, conv)) != now:
                if now is not None:
                    out.append(row(now, state))
                now, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[4] += len(formatted)
            for role, begin, end in read_turns(formatted)[repeated:]:
                state[0] += 1
                state[1].update(f"{role}\n{unescape(formatted[begin:end])}\n".encode("utf-8", "surrogatepass"))
            for begin, end in loss:
                text = unescape(formatted[begin:end])
                state[2] += len(text)
                state[3].update(text.encode("utf-8", "surrogatepass"))
        if len(out) >= 1000:
            yield _digests(out)
            out = []
    if now is not None:
        out.append(row(now, state))
    yield _digests(out)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows hold: turns once, text under loss, characters formatted.

    A digest runs over a whole conversation in order, so its windows meet in one task, which
    reads them one at a time.
    """
    sorted_ = windows.repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "window")
    return sorted_.mapInArrow(
        _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
