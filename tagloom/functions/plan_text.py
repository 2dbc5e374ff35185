"""From a planner's free-text reply to a structured merge plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.text import SPACE, unicode_trim

PLAN_GROUPS = (
    "array<struct<primary_tag_id: bigint, primary_tag_name: string, "
    "merge_tag_ids: array<bigint>, reason: string>>"
)

# --- fixed values: where the JSON of a reply is looked for --------------------
FENCED_OBJECT = rf"```(?:json)?[{SPACE}]*(\{{[\s\S]*?\}})[{SPACE}]*```"
BARE_OBJECT = r"(\{[\s\S]*\})"
# --- fixed values: what is scrubbed from it, in this order --------------------
LINE_COMMENT = r"//[^\n\r]*"
BLOCK_COMMENT = r"/\*[\s\S]*?\*/"
COMMA_BEFORE_CLOSE = rf",([{SPACE}]*[}}\]])"
FINAL_COMMA = rf",[{SPACE}]*\z"
# ----------------------------------------------------------------------------


def extract_json(reply: Column) -> Column:
    """The fenced object, else the outermost braces, else NULL."""
    trimmed = unicode_trim(reply)
    fenced = F.nullif(F.regexp_extract(trimmed, FENCED_OBJECT, 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(trimmed, BARE_OBJECT, 1), F.lit(""))
    return F.coalesce(fenced, bare)


def scrub_json(text: Column) -> Column:
    for pattern, kept in (
        (LINE_COMMENT, ""),
        (BLOCK_COMMENT, ""),
        (COMMA_BEFORE_CLOSE, "$1"),
        (FINAL_COMMA, ""),
    ):
        text = F.regexp_replace(text, pattern, kept)
    return unicode_trim(text)


def _is_number(value: Column) -> Column:
    return F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")


def _whole_number(value: Column) -> Column:
    """A JSON number without a fraction as a bigint, else NULL."""
    number = F.when(_is_number(value), F.try_variant_get(value, "$", "double"))
    return F.when(number == F.floor(number), number.cast("bigint"))


def _group(entry: Column) -> Column:
    merged = F.transform(
        F.try_variant_get(entry, "$.merge_tag_ids", "array<variant>"), _whole_number
    )
    return F.struct(
        _whole_number(F.try_variant_get(entry, "$.primary_tag_id", "variant"))
        .alias("primary_tag_id"),
        F.try_variant_get(entry, "$.primary_tag_name", "string").alias("primary_tag_name"),
        F.filter(merged, lambda i: i.isNotNull()).alias("merge_tag_ids"),
        F.try_variant_get(entry, "$.reason", "string").alias("reason"),
    )


def parse_plan(reply: Column) -> Column:
    """Merge groups of a reply; an empty array for anything unreadable.

    A value of the wrong type spoils nothing but itself: a text among the merge
    ids goes, a group with a text as its primary id has a NULL there. The object
    is parsed inside brackets, so that text behind it makes it unreadable.
    """
    text = scrub_json(extract_json(reply))
    parsed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    entries = F.try_variant_get(parsed, "$[0].consolidations", "array<variant>")
    only_one = F.try_variant_get(parsed, "$[1]", "variant").isNull()
    groups = F.when(only_one, F.transform(entries, _group)).cast(PLAN_GROUPS)
    return F.coalesce(groups, F.array().cast(PLAN_GROUPS))
