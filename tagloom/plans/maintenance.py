"""Consolidating, clearing and reporting on a table store."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.config import CJK2, Profile
from tagloom.operators import consolidate as ops
from tagloom.operators import reports
from tagloom.operators.integrity import cascade
from tagloom.operators.merge_plans import (
    merge_mapping,
    plan_groups,
    renames,
    resolve_overlaps,
    valid_groups,
)
from tagloom.session import materialize
from tagloom.sources.tables import TableStore


@dataclass(frozen=True)
class Consolidation:
    mapping: DataFrame        # what merges into what
    dropped: DataFrame        # mentions that do not merge, and why
    renames: DataFrame        # suggested names and whether they apply
    report: DataFrame         # one row per group
    applied: bool


def consolidate(
    store: TableStore,
    replies: DataFrame | None = None,
    groups: DataFrame | None = None,
    profile: Profile = CJK2,
    dry_run: bool = False,
) -> Consolidation:
    """Merge tags by planner replies or by groups of a similarity planner.

    All groups are applied together and published once, with the forest of all merges
    so far; only buckets that hold a merging tag are rewritten. With ``dry_run`` the
    same plan and report come back and nothing is changed.
    """
    before = store.snapshot()
    tags, pairs, snippets = before.tags, before.snippet_tags, before.snippets
    if groups is None:
        if replies is None:
            raise ValueError("consolidate needs planner replies or groups")
        groups = valid_groups(plan_groups(replies), tags)
    resolved = materialize(resolve_overlaps(groups), "resolved")
    mapping = materialize(merge_mapping(resolved), "mapping")
    named = materialize(renames(mapping, tags, profile), "renames")
    report = materialize(
        ops.consolidation_report(mapping, pairs, snippets), "consolidation"
    )
    if not dry_run and not mapping.isEmpty():
        holders = materialize(
            ops.touched(pairs, mapping).select("snippet_id").distinct(), "holders"
        )
        merging = mapping.select(F.explode(F.array("merge_id", "primary_id")))
        touched = {
            "snippets": before.touched("snippets", holders),
            "tags": before.touched("tags", merging),
            "snippet_tags": before.touched("snippet_tags", holders),
        }
        some_snippets, some_tags, some_pairs = (before.read(t, touched[t]) for t in touched)
        store.publish({
            "snippets": ops.rewrite_arrays(some_snippets, pairs, mapping),
            "tags": ops.rename_tags(ops.rollup_usage(some_tags, mapping), named),
            "snippet_tags": ops.remap_pairs(some_pairs, mapping),
        }, touched=touched, merges=ops.merge_forest(before.merges, mapping))
    dropped = resolved.where(F.col("verdict") != "merge")
    return Consolidation(mapping, dropped, named, report, not dry_run)


def clear_tags(store: TableStore, confirm: bool = False) -> DataFrame:
    """Remove all tags from everything and say what was there.

    Ids of removed tags are not given out again. Results that a stream found before
    are void and will not be folded in.
    """
    if not confirm:
        raise ValueError("clearing all tags needs confirm=True")
    before = store.init_tables()
    snippets, tags = before.snippets, before.tags
    removed = materialize(reports.clear_summary(snippets, tags), "cleared")
    store.publish({
        "snippets": cleared(snippets),
        "tags": tags.limit(0),
        "snippet_tags": before.snippet_tags.limit(0),
    }, clear=True)
    return removed


def delete_rows(
    store: TableStore, snippets: DataFrame | None = None, tags: DataFrame | None = None
) -> None:
    """Delete snippets and tags by ``id``, and every pair that names one of them.

    Unknown ids change nothing. Lists of tags in snippets stay, as only pairs refer to
    tags; ids of deleted tags are not given out again. Only buckets that hold a deleted
    row or pair are rewritten.
    """
    before = store.init_tables()
    gone = {
        name: materialize(ids.select("id").distinct(), "gone")
        for name, ids in (("snippets", snippets), ("tags", tags)) if ids is not None
    }
    if not gone:
        return

    def left(name: str, buckets: set[int] | None = None) -> DataFrame:
        rows = before.read(name, buckets)
        return rows.join(gone[name], "id", "left_anti").select(*rows.columns) if name in gone else rows

    touched = {name: before.touched(name, ids) for name, ids in gone.items()}
    frames = {name: left(name, touched[name]) for name in gone}
    pairs = before.snippet_tags
    holders = [
        pairs.join(ids.withColumnRenamed("id", key), key, "left_semi").select("snippet_id")
        for key, ids in (("snippet_id", gone.get("snippets")), ("tag_id", gone.get("tags")))
        if ids is not None
    ]
    touched["snippet_tags"] = before.touched("snippet_tags", reduce(DataFrame.unionByName, holders))
    some = before.read("snippet_tags", touched["snippet_tags"])
    frames["snippet_tags"] = cascade(some, left("snippets"), left("tags"))
    store.publish(frames, touched=touched)


def cleared(snippets: DataFrame) -> DataFrame:
    return snippets.withColumn("tags", F.lit(None).cast("string"))


def status(store: TableStore) -> DataFrame:
    now = store.snapshot()
    return reports.status(now.snippets, now.tags)


def queue_status(store: TableStore) -> DataFrame:
    now = store.snapshot()
    return reports.queue_status(now.snippets, now.tags)


def list_tags(store: TableStore) -> DataFrame:
    return reports.list_tags(store.read_tags())
