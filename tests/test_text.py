import pytest
from pyspark.sql import functions as F

from tagloom.config import CJK2, WORD
from tagloom.functions import text
from tagloom.functions.similarity import similarity

CLEANED = [
    ("激情", "激情", True),
    ("- 激情", "激情", True),
    ("**激情**", "激情", True),
    ("激情，", "激情", True),
    ("激情🔥", "激情", True),
    ("激 情", "激情", True),
    ("1.激情", "1激情", False),
    ("激情。", "激情。", False),
    ("「激情」", "「激情」", False),
    ("A激情", "A激情", False),
    ("场所：卧室", "场所卧室", False),
    ("𠀀𠀁", "", False),
    ("情", "情", False),
]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column.alias("r")).first()["r"]


def test_clean_and_validate(spark):
    rows = spark.createDataFrame(CLEANED, "line string, cleaned string, valid boolean")
    got = rows.select(
        "line",
        text.clean_tag(F.col("line"), CJK2).alias("c"),
        text.valid_tag(text.clean_tag(F.col("line"), CJK2), CJK2).alias("v"),
    ).collect()
    assert {(r["line"], r["c"], r["v"]) for r in got} == set(CLEANED)


def test_trim_knows_all_white_space(spark):
    odd = "".join(map(chr, (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0xA0, 0x1680, 0x2003,
                            0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
    assert one(spark, f"{odd}a b{odd}", text.unicode_trim(F.col("c"))) == "a b"


@pytest.mark.parametrize("reply, tags", [
    ("激情\n卧室", ["激情", "卧室"]),
    ("1. x\n激情\n\n场所:卧室\n无\n温柔\n长长长\n后来", ["激情", "温柔"]),
    ("激情\n激情", ["激情", "激情"]),
    ("", []),
    ("无", []),
])
def test_first_four_usable_lines_are_taken_before_cleaning(spark, reply, tags):
    assert one(spark, reply, text.parse_reply(F.col("c"), CJK2)) == tags


def test_combining_removes_duplicates_before_the_limit_and_keeps_case(spark):
    first = F.array(*[F.lit(f"t{i}") for i in range(8)])
    second = F.array(*[F.lit(x) for x in ("t0", "T0", "a", "b", "c", "d")])
    got = one(spark, "", text.combine_passes(first, second))
    assert got == [f"t{i}" for i in range(8)] + ["T0", "a", "b", "c"]


def test_truncation_marks_only_cut_texts(spark):
    assert one(spark, "x" * 2000, text.truncate_text(F.col("c"))) == "x" * 2000
    assert one(spark, "x" * 2001, text.truncate_text(F.col("c"))) == "x" * 2000 + "..."


@pytest.mark.parametrize("a, b, expected", [
    ("abc", "abc", 1.0), ("", "", 1.0), ("kitten", "sitting", 1 - 3 / 7),
    ("abcde", "abcdf", 0.8), ("abcd", "abce", 0.75), ("", "ab", 0.0),
])
def test_similarity(spark, a, b, expected):
    assert one(spark, a, similarity(F.col("c"), F.lit(b))) == pytest.approx(expected)
    assert one(spark, b, similarity(F.col("c"), F.lit(a))) == pytest.approx(expected)


def test_word_profile_rejects_line_ends(spark):
    assert not one(spark, "words\n", text.valid_tag(F.col("c"), WORD))
    assert one(spark, "words", text.valid_tag(F.col("c"), WORD))
