"""Reply parsing, tag cleaning and validation as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.config import (
    LINES_PER_REPLY,
    MAX_TEXT_CHARS,
    TAGS_PER_SNIPPET,
    Profile,
)

# --- fixed values: white space as browsers define it --------------------------
SPACE = (
    r"\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a"
    r"\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# ----------------------------------------------------------------------------


def truncate_text(text: Column, limit: int = MAX_TEXT_CHARS) -> Column:
    """Text as a model sees it: cut at ``limit`` characters and marked as cut."""
    cut = F.concat(F.substring(text, 1, limit), F.lit("..."))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def unicode_trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def clean_tag(line: Column, profile: Profile) -> Column:
    """Drop white space, then every character the profile does not keep."""
    packed = F.regexp_replace(line, rf"[{SPACE}]+", "")
    return F.regexp_replace(packed, profile.dropped, "")


def valid_tag(tag: Column, profile: Profile) -> Column:
    return tag.rlike(profile.valid)


def parse_reply(
    reply: Column, profile: Profile, max_lines: int = LINES_PER_REPLY
) -> Column:
    """Valid tags of a model reply, in order.

    The first ``max_lines`` usable lines are taken before cleaning, so a line
    that turns out invalid still uses up its place.
    """
    lines = F.transform(F.split(reply, "\n", -1), unicode_trim)
    usable = F.filter(
        lines,
        lambda s: (s != "") & ~s.contains(":") & (s != profile.none_word),
    )
    cleaned = F.transform(
        F.slice(usable, 1, max_lines), lambda s: clean_tag(s, profile)
    )
    return F.filter(
        cleaned,
        lambda s: (F.length(s) <= profile.max_length) & valid_tag(s, profile),
    )


def combine_passes(*passes: Column, limit: int = TAGS_PER_SNIPPET) -> Column:
    """Tags of all facets in facet order: duplicates go first, then the limit."""
    return F.slice(F.array_distinct(F.concat(*passes)), 1, limit)


def words(text: Column) -> Column:
    """Lower-cased runs of letters of the whole text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)
