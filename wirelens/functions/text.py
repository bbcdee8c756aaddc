"""Text expressions. Regular expressions are Unicode-aware throughout."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often then looks at it."""
    return F.transform(F.array(value), then)[0]


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with more columns, each computed once a row, whatever looks at it later.

    As the one element of an array that is unpacked again, they are not copied into filters and projections above.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def matches(text: Column, *patterns: str) -> Column:
    """Whether any of the patterns is found in text."""
    return text.rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns))


def extract(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(text, f"(?U){pattern}", group)


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(group))


def replace(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, f"(?U){pattern}", by)


def position(text: Column, pattern: str) -> Column:
    """Characters before the first match; null without one."""
    return F.when(matches(text, pattern), F.length(F.regexp_extract(text, f"(?sU)^(.*?)(?:{pattern})", 1)))


def before(text: Column, pattern: str) -> Column:
    """The text before the first match; empty without one."""
    return F.regexp_extract(text, f"(?sU)^(.*?)(?:{pattern})", 1)


def without_first(text: Column, pattern: str) -> Column:
    """The text without its first match."""
    return F.regexp_replace(text, f"(?sU)^(.*?)(?:{pattern})", "$1")


def fold(text: Column) -> Column:
    """Lower case for comparison; the sharp s as two letters."""
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))


def squeeze(text: Column) -> Column:
    """White space collapsed to single spaces, none at the ends; null as empty."""
    return F.trim(replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def strip_tags(html: Column) -> Column:
    return replace(html, "<[^>]+>", " ")


#: The entities that feeds use in descriptions. A numeric or rarer entity goes through unescape_all().
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&apos;": "'", "&laquo;": "«", "&raquo;": "»", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&amp;": "&"}


def unescape(text: Column) -> Column:
    """The usual entities as characters, & last."""
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), text)


def unescape_all(text: Column) -> Column:
    """All HTML entities as characters, by Arrow batches; for texts that hold others than ENTITIES."""
    import html

    def convert(batch: pa.Array) -> pa.Array:
        return pa.array([None if t is None else html.unescape(t) for t in batch.to_pylist()], pa.string())

    return F.arrow_udf(convert, "string")(text)


def clean_description(text: Column, every_entity: bool = False) -> Column:
    """A feed's description as plain text: entities first, so that escaped tags go too."""
    plain = (unescape_all if every_entity else unescape)(F.coalesce(text, F.lit("")))
    return squeeze(strip_tags(plain))


def escape_html(text: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, F.coalesce(text, F.lit("")))


def escape_xml(text: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def normalize_title(title: Column) -> Column:
    """Lower case, punctuation as spaces, white space collapsed."""
    return squeeze(replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\w\s]", " "))


def host(url: Column) -> Column:
    """Lower-case host with port, without a leading www."""
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))), r"^www\.", "")


def path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def absolute_url(base: Column, href: Column) -> Column:
    """href as seen from base, by the rules of URL resolution."""
    from urllib.parse import urljoin

    def join(bases: pa.Array, hrefs: pa.Array) -> pa.Array:
        return pa.array([urljoin(b or "", h or "") for b, h in zip(bases.to_pylist(), hrefs.to_pylist(), strict=True)], pa.string())

    return F.arrow_udf(join, "string")(base, href)


def paragraphs(text: Column) -> Column:
    """Stripped non-empty parts between blank lines."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?U)\n\s*\n")
    return F.filter(F.transform(parts, lambda p: replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def lead(text: Column, n: int, limit: int) -> Column:
    """The first n paragraphs joined by a space, at most limit characters."""
    return F.substring(F.array_join(F.slice(paragraphs(text), 1, n), " "), 1, limit)


def first_present(*texts: Column) -> Column:
    """The first text that is neither null nor empty, else an empty one."""
    return F.coalesce(*[F.when(F.length(t) > 0, t) for t in texts], F.lit(""))


# ---------------------------------------------------------------- light stemming and tokens


def stem(token: Column, suffixes: tuple[str, ...], roles: tuple[str, ...]) -> Column:
    """Folded token without its longest inflection suffix, then without a role suffix; at least four letters stay."""
    bare = F.trim(F.replace(fold(token), F.lit("ё"), F.lit("е")), F.lit("-"))

    def cut(t: Column, options: tuple[str, ...]) -> Column:
        found = t
        for n in sorted({len(o) for o in options}):  # the longest is looked for first
            ends = F.right(t, F.lit(n)).isin(*[o for o in options if len(o) == n])
            found = F.when((F.length(t) >= n + 4) & ends, F.substring(t, F.lit(1), F.length(t) - n)).otherwise(found)
        return found

    return let(bare, lambda b: let(cut(b, suffixes), lambda c: cut(c, roles)))


def sorted_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))
