"""String normalisers. Everything stays a built-in expression, so it runs inside codegen."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens.packs import food_au as pack

# The Unicode white space set, spelled out because ``\s`` alone is ASCII in Java and RE2.
WS = r"[\t-\r\x1C-\x20\x85\p{Z}]"
# Runs that need rewriting: any with white space other than a blank, or two blanks and more.
_WS_RUN = r" *[\t-\r\x1C-\x1F\x85\p{Z}&&[^ ]]" + WS + r"*| {2,}"
_NOT_WORD = r"[^\p{L}\p{N}_\s]"
_TRAILING_GROUPS = r"(?:[\(\[\{][^\)\]\}]*[\)\]\}]" + WS + r"*)+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name an intermediate value: it is computed once and appears once in the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squash(text: Column) -> Column:
    """Collapse white space runs to one blank and trim."""
    return F.trim(F.regexp_replace(text, _WS_RUN, " "))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


_ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}


def decode_entities(text: Column) -> Column:
    """Decode HTML entities once, left to right; unknown ones stay as they are."""
    table = F.expr("map(" + ", ".join(f"'{n}', '\\u{ord(c):04x}'" for n, c in _ENTITIES.items()) + ")")

    def named(part: Column, position: Column) -> Column:
        name = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        return F.struct(part.alias("part"), (position == 0).alias("first"), name.alias("name"))

    def numbered(p: Column) -> Column:
        name = p["name"]
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10).cast("int")).when(
            name.startswith("#"), F.substring(name, 2, 8).cast("int")
        )
        return F.struct(p["part"].alias("part"), p["first"].alias("first"), name.alias("name"), code.alias("code"))

    def decoded(p: Column) -> Column:
        code, above = p["code"], p["code"] - 0x10000
        pair = F.concat(
            F.hex(F.lit(0xD800) + F.shiftright(above, 10)), F.hex(F.lit(0xDC00) + above.bitwiseAND(F.lit(0x3FF)))
        )
        units = F.when(code < 0x10000, F.lpad(F.hex(code), 4, "0")).otherwise(pair)
        char = F.when((code > 0) & (code < 0x110000), F.decode(F.unhex(units), "UTF-16BE")).otherwise(
            F.try_element_at(table, p["name"])
        )
        rest = F.substr(p["part"], F.length(p["name"]) + 2)
        plain = F.concat(F.lit("&"), p["part"])
        return F.when(p["first"], p["part"]).otherwise(F.coalesce(F.concat(char, rest), plain))

    parts = F.transform(F.transform(F.split(text, "&", -1), named), numbered)
    return F.array_join(F.transform(parts, decoded), "")


# Head, comments and raw-text elements carry no visible text.
_INVISIBLE = (
    r"(?is)<head\b.*?</head\s*>|<!--.*?-->|<(script|style)\b.*?</\1\s*>|<!doctype[^>]*>|</?[a-z][^>]*>"
)


def clean_text(html: Column) -> Column:
    """Visible text of an HTML fragment or plain string; '' for NULL."""
    text = F.coalesce(html, F.lit(""))
    stripped = F.when(text.contains("<"), F.regexp_replace(text, _INVISIBLE, " ")).otherwise(text)
    # Most texts have no entity, and taking a text apart costs more than all else here.
    return squash(F.when(text.contains("&"), decode_entities(stripped)).otherwise(stripped))


def normalize_title(title: Column) -> Column:
    text = F.replace(F.lower(F.coalesce(title, F.lit(""))), F.lit("&"), F.lit(" and "))
    text = F.regexp_replace(F.regexp_replace(text, WS + "+$", ""), _TRAILING_GROUPS, "")
    return squash(F.regexp_replace(text, _NOT_WORD, " "))


def description_hash(description: Column, squashed: bool = False) -> Column:
    """SHA-256 of the lowercased, white-space-squashed text; NULL hashes like ''."""
    text = F.lower(F.coalesce(description, F.lit("")))
    return F.sha2(text if squashed else squash(text), 256)


def _drop_words(text: Column, words: list[str], extra=None) -> Column:
    def keep(token: Column) -> Column:
        test = (token != "") & ~token.isin(words)
        return test & extra(token) if extra else test

    return F.array_join(F.filter(F.split(text, " "), keep), " ")


def normalize_company(name: Column) -> Column:
    """Company key: punctuation removed, legal and region words dropped."""
    text = F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("&"), F.lit(" and "))
    return _drop_words(squash(F.regexp_replace(text, _NOT_WORD, "")), pack.COMPANY_STOP_TOKENS)


def title_core(normalized_title: Column) -> Column:
    """Role words of a normalised title: arrangement words and bare numbers dropped."""
    return _drop_words(
        F.coalesce(normalized_title, F.lit("")), pack.TITLE_NOISE_TOKENS, lambda t: ~t.rlike(r"^\p{Nd}+$")
    )


def city_key(location: Column) -> Column:
    return squash(F.lower(F.substring_index(F.coalesce(location, F.lit("")), ",", 1)))


def padded_tokens(text: Column) -> Column:
    """``' tok tok '``: the ``[a-z0-9]+`` tokens, so that ``' word '`` tests membership."""
    tokens = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))
    return F.concat(F.lit(" "), tokens, F.lit(" "))


def token_set(text: Column) -> Column:
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(tokens))


def title_tail_location(title: Column) -> Column:
    """A short last segment after ' - ' reads as a place; '' otherwise."""
    tail = F.trim(F.substring_index(title, " - ", -1))
    short = (F.instr(title, " - ") > 0) & F.length(tail).between(1, 40)
    return F.when(short, tail).otherwise(F.lit(""))
