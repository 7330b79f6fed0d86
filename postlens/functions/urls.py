"""URL helpers: canonical form, query parameters, ids, resolution against a base."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens.functions.text import blank_to_null


def strip_query(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def absolute(href: Column, base: Column) -> Column:
    """Prefix relative hrefs with the base site; absolute ones stay."""
    root = F.regexp_replace(base, "/+$", "")
    return (
        F.when(F.coalesce(href, F.lit("")) == "", F.lit(""))
        .when(href.startswith("http://") | href.startswith("https://"), href)
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(root, F.lit("/"), href))
    )


def canonical(href: Column, base: Column) -> Column:
    """Absolute URL without query and fragment, so tracking variants collapse."""
    return strip_query(absolute(href, base))


def _without_dots(url: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of the path; none climbs above the site."""
    site = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    rest = F.substr(url, F.length(site) + 1)
    path = F.regexp_extract(rest, r"^([^?#]*)", 1)

    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.array_append(kept, part))

    parts = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")))
    folded = F.aggregate(parts, F.array(F.lit("")), step)
    folder = F.when(path.rlike(r"/\.{1,2}$"), F.array_append(folded, F.lit(""))).otherwise(folded)
    resolved = F.concat(site, F.array_join(folder, "/"), F.substr(rest, F.length(path) + 1))
    return F.when((site != "") & path.rlike(r"/\.{1,2}(/|$)"), resolved).otherwise(url)


def join(base: Column, href: Column) -> Column:
    """Resolve a link found on page ``base`` (scheme-relative, root, query, relative forms, dot segments)."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = strip_query(base)
    folder = F.when(page == site, F.concat(site, F.lit("/"))).otherwise(F.regexp_replace(page, "[^/]*$", ""))
    resolved = (
        F.when((F.coalesce(base, F.lit("")) == "") | href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("./"), F.concat(folder, F.substr(href, F.lit(3))))
        .otherwise(F.concat(folder, href))
    )
    return _without_dots(resolved)


def set_query_param(url: Column, key: str, value: Column) -> Column:
    """Set ``key=value`` in the query string, dropping earlier values of the key."""
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    plain = F.regexp_replace(url, r"#.*$", "")
    path = F.regexp_replace(plain, r"\?.*$", "")
    query = F.when(F.contains(plain, F.lit("?")), F.regexp_replace(plain, r"^[^?]*\?", "")).otherwise(F.lit(""))
    kept = F.filter(
        F.split(query, "&"), lambda p: (p != "") & (p != key) & ~p.startswith(key + "=")
    )
    pair = F.concat(F.lit(key + "="), value.cast("string"))
    return F.concat(path, F.lit("?"), F.array_join(F.array_append(kept, pair), "&"), fragment)


# Id shapes of the boards' links.
SEEK_ID = r"/job/(\d+)"
JORA_ID = r"-([0-9a-fA-F]{32})$"
LINKEDIN_URN = r"(?i)urn:li:jobPosting:(\d+)"
LINKEDIN_VIEW = r"(?i)/jobs/view/(?:[^/?#]*?-)?(\d+)"


def job_id(url: Column, kind: str, urn: Column | None = None) -> Column:
    """The posting id a board's link carries, NULL if it has none."""
    path = strip_query(url)

    def pick(pattern: str) -> Column:
        return blank_to_null(F.regexp_extract(path, pattern, 1))

    if kind == "seek":
        return pick(SEEK_ID)
    if kind == "jora":
        return pick(JORA_ID)
    from_urn = blank_to_null(F.regexp_extract(urn, LINKEDIN_URN, 1)) if urn is not None else F.lit(None)
    return F.coalesce(from_urn, pick(LINKEDIN_VIEW))
