"""Every registered query against its SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import check_queries as check  # noqa: E402
import __spark_entry__ as registry  # noqa: E402
from tagloom.registry import views  # noqa: E402
from tagloom.registry.oracle import oracle_sql  # noqa: E402
from tagloom.registry.queries import QUERIES as OWN  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return check.connect(SF)


def test_every_query_has_its_sql():
    assert set(OWN) == set(oracle_sql())
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", list(OWN))
def test_query_equals_sql(spark, db, name):
    sql = registry.oracle_sql()[name]
    verdict = check.compare(spark, db, name, registry.queries()[name], sql, SF)
    assert verdict in ("", "no rows on either side")


def test_labels_are_not_broadcast(spark, tmp_path):
    """Before, the driver built a table of all labels, many times their file's size."""
    spark.createDataFrame(
        [(1, "abcdefg", "en", "s", 7), (2, "x", "en", "s", 1), (3, "y", "de", "s", 1)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(
        [(1, 1, 0), (1, 0, 0), (3, None, 1)], "doc_id bigint, quality int, toxic int"
    ).write.parquet(f"{tmp_path}/labels.parquet")
    snippets = views.snippets(spark, str(tmp_path))
    assert "Broadcast" not in snippets._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["id"], r["tags"] or "") for r in snippets.collect())
    assert got == [("0000000001", "[1]"), ("0000000001", "[]"), ("0000000002", ""), ("0000000003", "")]
