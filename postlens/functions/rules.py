"""Compilers from rule data to expressions.

Rule tables become SQL text (``*_sql``, handed to ``F.expr`` as a whole, since building a
table of hundreds of patterns call by call costs more than running it): ordered first-match
rules, multi-label pattern sets, gazetteers, point tables and bands.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = set(".^$*+?{}[]\\|()")


def _tokens(pattern: str) -> list[tuple[str, str]]:
    """Pieces of a regex: ('text' | 'other' | 'open' | 'close' | 'or' | 'repeat', source).

    A class, an escape and a quantifier are one piece each. Only a backslash before a sign
    that is no letter or digit stands for that sign; any other escape is 'other'.
    """
    out: list[tuple[str, str]] = []
    i = 0
    while i < len(pattern):
        c, end, kind = pattern[i], i + 1, "other"
        if c == "\\":
            follower = pattern[i + 1 : i + 2]
            end = i + 2
            if follower == "Q":
                stop = pattern.find("\\E", end)
                end = len(pattern) if stop < 0 else stop + 2
            elif follower in "pPxNkuc0" and follower:
                body = re.compile(r"\{[^}]*\}|<[^>]*>|[0-9A-Fa-f]{1,4}|[A-Za-z@\[-_]").match(pattern, end)
                end = body.end() if body else end
            elif follower and not follower.isalnum():
                kind = "text"
        elif c == "[":
            depth = 0
            while end <= len(pattern):
                d = pattern[end - 1]
                if d == "\\":
                    end += 1
                elif d == "[":
                    depth += 1
                    end += pattern[end : end + 1] == "^"
                    end += pattern[end : end + 1] == "]"
                elif d == "]":
                    depth -= 1
                    if depth == 0:
                        break
                end += 1
            end = min(end, len(pattern))
        elif c == "(":
            kind = "open"
            inside = re.compile(r"\(\?[^()]*?[:=!>)]").match(pattern, i)
            if inside:
                end = inside.end()
                kind = "flags" if inside.group().endswith(")") else "open"
        elif c == ")":
            kind = "close"
        elif c == "|":
            kind = "or"
        elif c in "?*+":
            kind = "repeat"
            while pattern[end : end + 1] in ("?", "+") and end < len(pattern):
                end += 1
        elif c == "{":
            body = re.compile(r"\{\d+(,\d*)?\}[?+]?").match(pattern, i)
            if body:
                end, kind = body.end(), "repeat"
        elif c not in _SPECIAL:
            kind = "text"
        out.append((kind, pattern[i:end]))
        i = end
    return out


def split_alternatives(pattern: str) -> list[str]:
    """Split at the ``|`` signs that stand outside every group and class.

    A pattern with inline flags is one part, as they would hold for the parts after them.
    """
    pieces = _tokens(pattern)
    if any(kind == "flags" for kind, _ in pieces):
        return [pattern]
    parts, depth = [""], 0
    for kind, source in pieces:
        depth += (kind == "open") - (kind == "close")
        if kind == "or" and depth == 0:
            parts.append("")
        else:
            parts[-1] += source
    return parts


def required_literal(pattern: str) -> str:
    """The longest plain text every match of ``pattern`` must contain ('' if there is none).

    Only characters outside every group and class count, and none that a quantifier follows:
    what is left is a necessary condition, cheap to test first. A pattern with inline flags
    or alternatives outside groups has none.
    """
    pieces = _tokens(pattern)
    if any(kind == "flags" for kind, _ in pieces):
        return ""
    runs, run, depth = [], "", 0
    for n, (kind, source) in enumerate(pieces):
        if kind == "or" and depth == 0:
            return ""
        depth += (kind == "open") - (kind == "close")
        repeated = n + 1 < len(pieces) and pieces[n + 1][0] == "repeat"
        if kind == "text" and depth == 0 and not repeated:
            run += source[-1]
        else:
            runs.append(run)
            run = ""
    return max([*runs, run], key=len)


def text_literal(text: str) -> str:
    quote = '"' if "'" in text else "'"
    return f"r{quote}{text}{quote}"


def let_sql(value: str, name: str, body: str) -> str:
    """Name an intermediate value: it is computed once and appears once in the plan."""
    return f"transform(array({value}), {name} -> {body})[0]"


def matches_sql(text: str, pattern: str) -> str:
    """Does the regex occur in the text? Word boundaries and classes are Unicode-aware.

    Scanning for the required literal costs a fraction of running the regex, so the regex
    only ever runs on rows that contain it.
    """
    tests = []
    for part in split_alternatives(pattern):
        literal = required_literal(part)
        if literal == part:
            tests.append(f"contains({text}, {text_literal(part)})")
            continue
        regex = f"{text} RLIKE {text_literal('(?U)' + part)}"
        tests.append(f"(contains({text}, {text_literal(literal)}) AND {regex})" if literal else regex)
    return " OR ".join(tests)


def any_match(text: Column, patterns: Iterable[str]) -> Column:
    """One alternation over short strings (titles, names, places)."""
    return text.rlike("(?U)" + "|".join(patterns))


def any_match_sql(text: str, patterns: Iterable[str]) -> str:
    return f"{text} RLIKE {text_literal('(?U)' + '|'.join(patterns))}"


def any_match_long_sql(text: str, patterns: Iterable[str]) -> str:
    """The same test for long texts, pattern by pattern behind its required literal."""
    return "(" + " OR ".join(matches_sql(text, p) for p in patterns) + ")"


def contains_any_sql(text: str, words: Iterable[str]) -> str:
    """Gazetteer lookup: does any of the plain words occur as a substring?"""
    escaped = ("".join("\\" + c if c in _SPECIAL else c for c in w) for w in words)
    return f"{text} RLIKE {text_literal('|'.join(escaped))}"


def multi_label_sql(text: str, labels: Mapping[str, Sequence[str]]) -> str:
    """Array of every label with a matching pattern, in the order of the table."""
    cases = [f"CASE WHEN {any_match_long_sql(text, ps)} THEN '{k}' END" for k, ps in labels.items()]
    return f"array_compact(array({', '.join(cases)}))"


def _clause_sql(tokens: str, text: str, clause: Mapping, flags: Mapping[str, bool]) -> str | None:
    if "flag" in clause and not flags.get(clause["flag"], True):
        return None

    def has(word: str) -> str:
        return f"contains({tokens}, ' {word} ')"

    tests = [has(w) for w in clause.get("all", [])]
    tests += ["(" + " OR ".join(has(w) for w in words) + ")" for words in clause.get("any", [])]
    tests += [f"NOT {has(w)}" for w in clause.get("none", [])]
    if "phrase" in clause:
        tests.append(f"contains({text}, {text_literal(clause['phrase'])})")
    return "(" + " AND ".join(tests) + ")"


def first_label_sql(cases: Iterable[tuple[str, str]], default: str) -> str:
    """``CASE WHEN``: the first case that holds gives the label."""
    return "CASE " + " ".join(f"WHEN {test} THEN '{label}'" for label, test in cases) + f" ELSE '{default}' END"


def token_rules_sql(tokens: str, text: str, rules, default: str, **flags: bool) -> str:
    """Ordered rules over a padded token string (see ``text.padded_tokens``) and the raw text."""
    cases = []
    for label, clauses in rules:
        tests = [t for t in (_clause_sql(tokens, text, c, flags) for c in clauses) if t]
        if tests:
            cases.append((label, " OR ".join(tests)))
    return first_label_sql(cases, default)


def pattern_rules_sql(subjects: Mapping[str, Callable[[Sequence[str]], str]], rules, default: str) -> str:
    """Ordered ``(label, subject, patterns)`` rules; a subject maps patterns to a test."""
    return first_label_sql([(label, subjects[s](ps)) for label, s, ps in rules], default)


def points_sql(label: str, table: Mapping[str, float]) -> str:
    """Points of a label, 0 for labels outside the table, NULL for NULL."""
    arms = " ".join(f"WHEN '{key}' THEN {float(value)}D" for key, value in table.items())
    return f"CASE WHEN {label} IS NOT NULL THEN CASE {label} {arms} ELSE 0D END END"


def band_sql(value: str, bands: Iterable[tuple[float, object]], default: str) -> str:
    """The entry of the highest lower bound not above the value."""

    def shown(entry: object) -> str:
        return f"'{entry}'" if isinstance(entry, str) else f"{float(entry)}D"

    ordered = sorted(bands, key=lambda b: b[0], reverse=True)
    return "CASE " + " ".join(f"WHEN {value} >= {lo} THEN {shown(e)}" for lo, e in ordered) + f" ELSE {default} END"


def clamp_sql(value: str, lo: float, hi: float) -> str:
    """Bound a value; NULL stays NULL (``greatest``/``least`` alone would skip it)."""
    return let_sql(value, "v", f"CASE WHEN v IS NOT NULL THEN greatest({float(lo)}D, least({float(hi)}D, v)) END")


def clamp(value: Column, lo: float, hi: float) -> Column:
    bounded = F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), value))
    return F.when(value.isNotNull(), bounded)
