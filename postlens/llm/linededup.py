"""Remove repeated passages, found over the whole corpus: overlapping three-line windows, or any stretch of words.

Only DataFrame functions are used. ``dedup_lines`` compares lines, so it also finds short
passages but only those cut alike; ``dedup_passages`` finds every repeated stretch of
``PASSAGE_WORDS`` words, wherever it begins and whatever its lines are. A line here is a piece of text that ends at a newline, at
the end of a sentence, or after ``MAX_LINE_WORDS`` words, with the white space behind it, so
that a passage without newlines still spans several lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.operators.materialize import cut

MAX_LINE_WORDS = 16
PASSAGE_WORDS = 51
GRAM_WORDS = 16  # of a fingerprint
_GRAMS = PASSAGE_WORDS - GRAM_WORDS + 1  # in a passage; the smallest is its fingerprint
_SPACE = r"\t\n\x0B\f\r\x20"
_BLANK = r"\t\x0B\f\r\x20"  # white space within a line
LINE = rf"(?:[^{_SPACE}]*[^{_SPACE}.!?][{_BLANK}]+){{0,{MAX_LINE_WORDS - 1}}}[^{_SPACE}]+[{_SPACE}]*|[{_SPACE}]+"
WORD = rf"[^{_SPACE}]+"
PIECE = rf"\A[{_SPACE}]*[^{_SPACE}]+[{_SPACE}]*|[^{_SPACE}]+[{_SPACE}]*|[{_SPACE}]+"
_KEY = ["_ld_id", "_ld_hash"]
FILTER_WORDS = 1 << 18  # longs in the filter of documents with repeats: it only saves shuffling


def lines_of(text: Column) -> Column:
    """Pieces that joined together give the text again; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(LINE), F.lit(0)), F.array().cast("array<string>"))


def _which(docs: DataFrame) -> Column:
    """What tells the texts of one doc_id apart: a hash of the text, or 0 throughout where no doc_id has two texts.

    It goes wherever a window goes, and hashes do not compress; so it is left out where doc_id alone names a document.
    """
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"))
    several = hashed.groupBy("doc_id").agg(F.min("h").alias("least"), F.max("h").alias("most")).where("least <> most")
    return F.lit(0).cast("long") if several.isEmpty() else F.xxhash64("text")


def _windows(docs: DataFrame, which: Column) -> DataFrame:
    """``(h1, h2, _ld_id, _ld_hash, pos)`` per window of three lines.

    Every line is hashed once, and a window's hashes are made of those of its lines.
    """
    bare = lambda line: F.xxhash64(F.rtrim(line, F.lit("\t\n\x0b\f\r ")))
    hashed = docs.select(F.col("doc_id").alias("_ld_id"), which.alias("_ld_hash"), F.transform(lines_of(F.col("text")), bare).alias("lines"))

    def window(i: Column) -> Column:
        three = [F.get("lines", i + k) for k in range(3)]
        return F.struct(F.xxhash64(*three).alias("h1"), F.hash(*three).alias("h2"), i.alias("pos"))

    starts = F.when(F.size("lines") >= 3, F.sequence(F.lit(0), F.size("lines") - 3)).otherwise(F.array().cast("array<int>"))
    # Outer: else the planner asks for the windows' number first, and cuts and hashes all lines twice.
    return hashed.select(*_KEY, F.inline_outer(F.transform(starts, window))).where("pos IS NOT NULL")


def _covered(starts: Column, width: int = 3) -> Column:
    """Flags, from piece 0 on, of the pieces that the windows of ``width`` at the sorted ``starts`` cover."""
    before = F.concat(F.array(F.lit(-width)), F.slice(starts, 1, F.size(starts) - 1))
    runs = F.zip_with(
        starts, before,
        lambda at, last: F.concat(
            F.array_repeat(F.lit(False), F.greatest(F.lit(0), at - last - width)),
            F.array_repeat(F.lit(True), F.least(F.lit(width), at - last)),
        ),
    )
    return F.flatten(runs)


def _with_starts(docs: DataFrame, which: Column, starts: DataFrame) -> DataFrame:
    """``docs`` with ``_ld_starts``, null where a document has none; only texts that may have some are shuffled.

    The filter is bits by a hash of the key, broadcast at a bounded size: it lets every document of
    ``starts`` pass, and some others, which the join then leaves without.
    """
    words = min(FILTER_WORDS, max(1 << 10, 1 << (starts.count() // 4).bit_length()))

    def place(*key: str) -> tuple[Column, Column]:
        spot = F.pmod(F.xxhash64(*key), F.lit(words * 64))
        return F.floor(spot / 64).cast("long"), F.pmod(spot, F.lit(64)).cast("int")

    word, bit = place(*_KEY)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bits = starts.groupBy(word.alias("_ld_word")).agg(F.bit_or(one).alias("_ld_bits"))
    out = docs.withColumn("_ld_h", which)
    word, bit = place("doc_id", "_ld_h")
    told = out.withColumn("_ld_word", word).join(F.broadcast(bits), "_ld_word", "left").drop("_ld_word")
    may = F.coalesce(F.getbit("_ld_bits", bit) == 1, F.lit(False))
    some, none = told.where(may).drop("_ld_bits"), told.where(~may).drop("_ld_bits")
    found = some.join(starts, some["doc_id"].eqNullSafe(starts["_ld_id"]) & (some["_ld_h"] == starts["_ld_hash"]), "left")
    return found.drop(*_KEY).unionByName(none.withColumn("_ld_starts", F.lit(None).cast("array<int>"))).drop("_ld_h")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with later occurrences of repeated windows cut out of ``text``; every row stays.

    The first occurrence is the one with the smallest (doc_id, 64-bit hash of the text, position),
    null doc_id first. Lines covered by any later occurrence go; the rest is joined
    unchanged, so a document without repeats keeps its text byte for byte, and one that
    repeats others throughout is left with an empty text. Adds ``n_lines`` and
    ``n_removed``. Windows count whatever the length of their lines, so three short lines that
    repeat go as well. Texts of fewer than three lines, null and empty texts stay as they are.
    Rows equal in doc_id and text count as one occurrence. Window identity is 96 bits of
    hash. A window that very many documents share meets its single first occurrence in a
    join whose large partitions Spark can split.
    """
    which = _which(docs)
    windows = cut(_windows(docs, which), "line-windows")
    many = windows.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1")
    repeated = cut(windows.join(many, "h1"), "line-repeats")
    firsts = (
        repeated.groupBy("h1", "h2").agg(F.min(F.struct(*_KEY, "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    later = repeated.join(firsts, ["h1", "h2"]).where(~F.struct(*_KEY, "pos").eqNullSafe(F.col("first")))
    starts = cut(later.groupBy(*_KEY).agg(F.array_sort(F.collect_set("pos")).alias("_ld_starts")), "line-starts")
    out = _with_starts(docs, which, starts)
    lines = F.arrays_zip(lines_of(F.col("text")).alias("line"), F.col("_ld_flags").alias("gone"))
    kept = F.array_join(F.transform(F.filter("_ld_lines", lambda x: ~F.coalesce(x["gone"], F.lit(False))), lambda x: x["line"]), "")
    hit = F.col("_ld_starts").isNotNull()
    return (
        out.withColumn("_ld_flags", F.when(hit, _covered(F.col("_ld_starts"))).otherwise(F.array().cast("array<boolean>")))
        .withColumn("_ld_lines", lines)
        .withColumn("n_lines", F.size("_ld_lines").cast("long"))
        .withColumn("n_removed", F.size(F.filter("_ld_flags", lambda x: x)).cast("long"))
        .withColumn("text", F.when(hit, kept).otherwise(F.col("text")))
        .drop("_ld_starts", "_ld_flags", "_ld_lines")
    )


def pieces_of(text: Column) -> Column:
    """Words with the white space behind them (the first also before it); joined together they give the text again."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), F.array().cast("array<string>"))


def _hashes(text: Column) -> Column:
    return F.transform(pieces_of(text), lambda x: F.xxhash64(F.trim(x, F.lit("\t\n\x0b\f\r "))))


def _starts(array: str, width: int) -> Column:
    """1-based places in ``array`` where ``width`` of its members begin."""
    places = F.size(array) - (width - 1)
    return F.when(places > 0, F.sequence(F.lit(1), places)).otherwise(F.array().cast("array<int>"))


def _stretches(docs: DataFrame, which: Column) -> DataFrame:
    """``(mark, at, n, again, _ld_id, _ld_hash)``: runs of ``n`` passages, from word ``at`` on, with one fingerprint.

    The fingerprint of a passage is the smallest hash of its grams, so equal passages have
    equal ones wherever they are. Every array is used more than once in the next step, or
    the planner would compute it anew for each member.
    """
    hashed = docs.select(F.col("doc_id").alias("_ld_id"), which.alias("_ld_hash"), _hashes(F.col("text")).alias("words"))
    grams = F.transform(_starts("words", GRAM_WORDS), lambda i: F.xxhash64(F.slice("words", i, GRAM_WORDS)))
    marks = F.transform(_starts("grams", _GRAMS), lambda i: F.array_min(F.slice("grams", i, _GRAMS)))
    begins = F.filter(_starts("marks", 1), lambda i: (i == 1) | (F.get("marks", i - 1) != F.get("marks", i - 2)))

    def run(begin: Column, i: Column) -> Column:
        end = F.coalesce(F.get("begins", i + 1), F.size("marks") + 1)
        here = F.slice("grams", begin, end - begin + (_GRAMS - 1))
        again = F.size(F.filter(here, lambda x: x == F.get("marks", begin - 1))) > 1
        return F.struct(F.get("marks", begin - 1).alias("mark"), (begin - 1).alias("at"), (end - begin).alias("n"), again.alias("again"))

    marked = hashed.select(*_KEY, grams.alias("grams")).select(*_KEY, "grams", marks.alias("marks")).select(*_KEY, "grams", "marks", begins.alias("begins"))
    # Outer: else the planner asks for the arrays' sizes first, and computes all of them twice.
    return marked.select(*_KEY, F.inline_outer(F.transform("begins", run))).where("mark IS NOT NULL")


def _passages(docs: DataFrame, which: Column) -> DataFrame:
    """``(h1, h2, _ld_id, _ld_hash, pos)`` of the passages whose fingerprint occurs more than once."""
    stretches = cut(_stretches(docs, which), "passage-stretches")
    # Passages that overlap their own repeats have the gram more than once in one run.
    times = F.sum(F.when(F.col("again"), 2).otherwise(1))
    many = stretches.groupBy("mark").agg(times.alias("times")).where("times > 1").select("mark")
    spots = stretches.join(many, "mark").groupBy(*_KEY).agg(F.collect_set(F.struct("at", "n")).alias("spots"))
    texts = docs.select("doc_id", "text", which.alias("_ld_h"))
    found = texts.join(spots, texts["doc_id"].eqNullSafe(spots["_ld_id"]) & (texts["_ld_h"] == spots["_ld_hash"]))
    places = F.flatten(F.transform("spots", lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1)))
    passage = lambda pos: F.slice("words", pos + 1, PASSAGE_WORDS)
    window = lambda pos: F.struct(F.xxhash64(passage(pos)).alias("h1"), F.hash(passage(pos)).alias("h2"), pos.alias("pos"))
    hashed = found.select(*_KEY, places.alias("places"), _hashes(F.col("text")).alias("words"))
    return hashed.select(*_KEY, F.inline_outer(F.transform("places", window))).where("pos IS NOT NULL")


def dedup_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with later occurrences of every stretch of ``PASSAGE_WORDS`` words cut out of ``text``; every row stays.

    Words are separated by white space and compared as they are; the white space may differ.
    Of the occurrences of a stretch, also overlapping ones, the first is the one with the
    smallest (doc_id, 64-bit hash of the text, word), null doc_id first. Words covered by any
    later occurrence go, with the white space behind them. Passages longer than
    ``PASSAGE_WORDS`` go whole, as each of their stretches repeats; shorter ones stay. Adds
    ``n_words`` and ``n_removed``. Rows equal in doc_id and text count as one occurrence.
    Only passages with a fingerprint that occurs again are indexed word by word; equal ones
    always are. Identity is 96 bits of hash.
    """
    which = _which(docs)
    passages = cut(_passages(docs, which), "passage-windows")
    firsts = (
        passages.groupBy("h1", "h2").agg(F.min(F.struct(*_KEY, "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    later = passages.join(firsts, ["h1", "h2"]).where(~F.struct(*_KEY, "pos").eqNullSafe(F.col("first")))
    starts = cut(later.groupBy(*_KEY).agg(F.array_sort(F.collect_set("pos")).alias("_ld_starts")), "passage-starts")
    out = _with_starts(docs, which, starts)
    hit = F.col("_ld_starts").isNotNull()
    pieces = F.arrays_zip(pieces_of(F.col("text")).alias("piece"), F.col("_ld_flags").alias("gone"))
    kept = F.array_join(F.transform(F.filter(pieces, lambda x: ~F.coalesce(x["gone"], F.lit(False))), lambda x: x["piece"]), "")
    return (
        out.withColumn("_ld_flags", F.when(hit, _covered(F.col("_ld_starts"), PASSAGE_WORDS)).otherwise(F.array().cast("array<boolean>")))
        .withColumn("n_words", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
        .withColumn("n_removed", F.size(F.filter("_ld_flags", lambda x: x)).cast("long"))
        .withColumn("text", F.when(hit, kept).otherwise(F.col("text")))
        .drop("_ld_starts", "_ld_flags")
    )
