"""Conversations brought into the order ``(s?(ua)+)?`` by the cheapest edits.

The roles read so far leave one of four states: nothing yet, after the system, after
the user, after the assistant. From each state only one role can be inserted or given
to a row, so a state and the edits' initials say what the repaired rows are.

The cheapest edits come from a dynamic program over a conversation's rows. Its
backward pass keeps the states' costs only at every square-root-of-n-th row. The
forward pass goes from checkpoint to checkpoint, works a block's costs out again from
the checkpoint behind it, and at each row takes the least initial among the edits that
lose nothing.

Texts never come together. Rows are sorted by ranges, so that a long conversation
spans several tasks; the program only needs one letter per row (as long as the audit
that it returns), and repaired texts are hashed row by row as they stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import inf, isqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import long_hash, travels_with_tasks, worker_cache
from tagloom.operators.paging import POSITION_BITS
from tagloom.session import materialize

BLANK = r"[\x20\x09-\x0D]"
ENDS = r"[.!?]"

# States: nothing yet, after the system, after the user, after the assistant.
USER_NEXT = (True, True, False, True)
GIVEN = tuple(2 if user else 3 for user in USER_NEXT)  # by insertions and new roles
END_COSTS = (0, 4, 2, 0)  # with the insertions that are still needed
DELETE, REROLE, INSERT = 3, 2, 2

# A row's letter: initial of its role, and its fault.
INITIALS = "sua"
FAULTS = ("none", "truncated", "blank", "duplicate")
LETTERS = {chr(65 + 4 * i + f): (i, f) for i in range(4) for f in range(4)}


def _kept(state: int, initial: int) -> int | None:
    """The state after a row that stays as it is, if its role may come here."""
    if initial == 0:
        return 1 if state == 0 else None
    if initial == 1:
        return 2 if USER_NEXT[state] else None
    return 3 if initial == 2 and state == 2 else None


#: By letter: may the row stay, does staying cost one, state after keeping by state.
RULES = {
    letter: (fault < 2, int(fault == 1), tuple(_kept(s, initial) for s in range(4)))
    for letter, (initial, fault) in LETTERS.items()
}


def costs_before(letter: str, after: tuple) -> tuple:
    """Costs from each state in front of a row, given those behind it."""
    stays, extra, kept = RULES[letter]
    own = []
    for state in range(4):
        least = DELETE + after[state]
        if stays:
            least = min(least, REROLE + extra + after[GIVEN[state]])
            if kept[state] is not None:
                least = min(least, extra + after[kept[state]])
        own.append(least)
    # one or two insertions in front of the row
    user, done = min(own[2], INSERT + own[3]), min(own[3], INSERT + own[2])
    return min(own[0], INSERT + user), min(own[1], INSERT + user), user, done


def cheapest_edits(letters: str) -> tuple[int, str]:
    """Cost and initials (Delete, Insert, Keep, Rerole) of the cheapest edits.

    Among equally cheap ones the initials are the least as text. No rows: no edits.
    """
    n = len(letters)
    step = isqrt(n) + 1
    checkpoints = {}
    costs = END_COSTS
    for i in range(n, -1, -1):
        if i < n:
            costs = costs_before(letters[i], costs)
        if i % step == 0 or i == n:
            checkpoints[i] = costs
    total, state, audit = costs[0], 0, []
    for first in range(0, n, step):
        last = min(first + step, n)
        block = [checkpoints[last]]
        for i in range(last - 1, first - 1, -1):
            block.append(costs_before(letters[i], block[-1]))
        block.reverse()
        for i in range(first, last):
            here, after = block[i - first], block[i - first + 1]
            stays, extra, kept = RULES[letters[i]]
            while True:
                given = GIVEN[state]
                if DELETE + after[state] == here[state]:
                    audit.append("D")
                elif INSERT + here[given] == here[state]:
                    audit.append("I")
                    state = given
                    continue
                elif kept[state] is not None and stays and extra + after[kept[state]] == here[state]:
                    audit.append("K")
                    state = kept[state]
                else:
                    audit.append("R")
                    state = given
                break
    while END_COSTS[state]:
        audit.append("I")
        state = GIVEN[state]
    return int(total), "".join(audit)


def findings(letters: str) -> tuple:
    """Counts of blank, duplicate and truncated rows and of illegal neighbours; edits."""
    faults = [LETTERS[x][1] for x in letters]
    initials = [LETTERS[x][0] for x in letters]
    legal = {(0, 1), (1, 2), (2, 1)}
    illegal = sum(pair not in legal for pair in zip(initials, initials[1:]))
    return faults.count(2), faults.count(3), faults.count(1), illegal, *cheapest_edits(letters)


class Replay:
    """Repaired rows of one conversation, from its edits and its rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _given(self) -> str:
        role = "user" if USER_NEXT[self.state] else "assistant"
        self.state = GIVEN[self.state]
        return role

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """``edit, role, text`` of what is inserted before the row, and the row's own."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            initial = INITIALS.find(role[:1]) if role else -1
            self.state = _kept(self.state, initial)
        yield edit, self._given() if edit == "R" else role, text

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at: self.at + 1] == "I":
            self.at += 1
            yield "I", self._given(), ""


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with one fault in most of them, by a checksum of ``conv_id:turn``.

    Of twenty remainders 0 drops the row, 1 empties its text, 2 takes ``.!?`` out, 3
    repeats it, 4 makes it the user's. Null reads as one space.
    """
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", ""))
    return (
        conversations
        .select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"),
                kind.alias("kind"))
        .where(kind != 0)
        .select(
            "conv_id", "turn",
            F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
            text.otherwise(F.col("text")).alias("text"),
            F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
        )
        .drop("copy")
    )


def in_order(rows: DataFrame) -> DataFrame:
    """Rows with ``at``, which grows along each conversation; written once.

    Order is turn (nulls first), then role and text. Ranges are cut between rows, also
    within a conversation.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "text", "_row"]
    filled = (F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text"))
    return materialize(
        rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *filled)
        .withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("_row")
        .withColumn("at", F.monotonically_increasing_id()),
        "turns",
    )


def row_letters(ordered: DataFrame) -> DataFrame:
    """``conv_id``, ``at`` and the letter of each row.

    A row's first fault counts: blank, role and text seen before, no end mark. What was
    seen is compared by hashes of 128 bits; only repeated ones are joined back.
    """
    stripped = F.regexp_replace("text", f"{BLANK}+$", "")
    solid = F.length(stripped) > 0
    seen = [
        F.when(solid, long_hash(F.col("role"), F.col("text"))).alias("h1"),
        F.when(solid, long_hash(F.lit(1), F.col("text"), F.col("role"))).alias("h2"),
    ]
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    rows = ordered.select(
        F.col("conv_id"), "at", *seen,
        F.when(F.length("role") > 0, (initial + 3) % 4).otherwise(3).alias("initial"),
        F.when(~solid, 2).when(F.substring(stripped, -1, 1).rlike(ENDS), 0).otherwise(1)
        .alias("fault"),
    )
    firsts = (
        rows.where(F.col("h1").isNotNull())
        .groupBy(F.col("conv_id").alias("_c"), F.col("h1").alias("_1"), F.col("h2").alias("_2"))
        .agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    same = (
        F.col("conv_id").eqNullSafe(F.col("_c"))
        & (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2"))
    )
    fault = F.when(F.col("at") > F.col("first"), 3).otherwise(F.col("fault"))
    return rows.join(firsts, same, "left").select(
        "conv_id", "at", F.char(65 + 4 * F.col("initial") + fault).alias("letter")
    )


def conversation_letters(letters: DataFrame) -> DataFrame:
    """One text of letters per conversation: first per range of rows, then joined."""
    def joined(place: str, value: str) -> Column:
        pairs = F.sort_array(F.collect_list(F.struct(place, value)))
        return F.array_join(F.transform(pairs, lambda x: x[value]), "")

    return (
        letters.withColumn("range", F.shiftright("at", POSITION_BITS))
        .groupBy("conv_id", "range").agg(joined("at", "letter").alias("letters"))
        .groupBy("conv_id").agg(joined("range", "letters").alias("letters"))
    )


COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def repair_plans(ordered: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """Counts, cost and edits of every one of ``conv_ids``, with or without rows."""
    kind = T.StructType(
        [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("audit", T.StringType())]
    )

    @F.pandas_udf(kind)
    def plan(letters: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(map(findings, letters), columns=[*COUNTS, "audit"])

    turns = ordered.groupBy(F.col("conv_id").alias("_t")).agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps")
    )
    plans = (
        conversation_letters(row_letters(ordered))
        .select(F.col("conv_id").alias("_p"), plan("letters").alias("plan"))
    )
    ids = conv_ids.select("conv_id").distinct()
    return (
        ids.join(turns, ids.conv_id.eqNullSafe(F.col("_t")), "left")
        .join(plans, ids.conv_id.eqNullSafe(F.col("_p")), "left")
        .select(
            "conv_id", F.coalesce("gaps", F.lit(0)).cast("bigint").alias("gaps"),
            *(F.coalesce(F.col(f"plan.{c}"), F.lit(0)).cast("bigint").alias(c) for c in COUNTS),
            F.coalesce("plan.audit", F.lit("")).alias("audit"),
        )
    )


def _streamed(plans: DataFrame, ordered: DataFrame, carried: list[str]) -> DataFrame:
    """Each conversation's plan, followed by its rows, in one task's stream."""
    heads = plans.select(
        "conv_id", F.lit(-1).cast("bigint").alias("at"), F.lit("").alias("role"),
        F.col("audit").alias("text"), *carried,
    )
    rows = ordered.select(
        "conv_id", "at", "role", "text", *(F.lit(None).cast("bigint").alias(c) for c in carried)
    )
    return heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "at")


def repaired_rows(plans: DataFrame, ordered: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text`` of all rows that stay or are inserted."""
    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, place, run = None, 0, Replay("")
        names = ["conv_id", "place", "edit", "role", "text"]
        for batch in batches:
            out = []
            for own, at, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                made = run.inserted() if at < 0 else run.row(role, text)
                for edit, *shown in made:
                    if edit != "D":
                        out.append((conv_id, place, edit, *shown))
                        place += 1
                if at < 0:
                    conv_id, place, run = own, 0, Replay(text)
            yield _batch(out, names, batch.schema.field(0).type)
        out = [(conv_id, place + k, *made) for k, made in enumerate(run.inserted())]
        yield _batch(out, names, id_type)

    id_type = _arrow_type(plans)
    schema = T.StructType([
        plans.schema["conv_id"], T.StructField("place", T.LongType()),
        *(T.StructField(c, T.StringType()) for c in ("edit", "role", "text")),
    ])
    return _streamed(plans, ordered, []).mapInArrow(replay, schema)


def _arrow_type(plans: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(plans.schema["conv_id"].dataType)


def _batch(rows: list[tuple], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    texts, longs = ("edit", "role", "text", "audit", "repaired_sha256"), pa.int64()
    columns = list(zip(*rows)) or [()] * len(names)
    types = [id_type, *(pa.string() if n in texts else longs for n in names[1:])]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def repair_conversations(
    rows: DataFrame, conv_ids: DataFrame | None = None
) -> DataFrame:
    """One row per conversation: its faults, its cheapest edits, a hash of the outcome.

    ``rows`` has ``conv_id, turn, role, text``; other columns aren't read. ``conv_ids``
    adds conversations without rows, which have zeros, no edits and the hash of the
    empty text. Null roles and texts read as one space; rows without a turn come first
    and don't count for ``gaps``; rows without a conversation are one together. Rows of
    one turn are in order of role and text; a row equal to an earlier one is a
    duplicate. A role that begins with none of ``sua`` can't be kept. Texts may be as
    long as a row can be. An empty table gives no rows.

    Rows of one conversation are hashed in one task, as their hash follows their order,
    a row at a time.
    """
    ordered = in_order(rows)
    ids = ordered if conv_ids is None else conv_ids
    plans = materialize(repair_plans(ordered, ids), "repair-plans")
    carried = ["gaps", *COUNTS]
    names = ["conv_id", *carried, "audit", "repaired_sha256"]
    id_type = _arrow_type(plans)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("conversations")
        head = run = hashed = None
        n = 0

        def take(made) -> None:
            nonlocal n
            for edit, role, text in made:
                if edit != "D":
                    hashed.update(f"{chr(10) if n else ''}{role}:{text}".encode())
                    n += 1

        def end() -> tuple:
            take(run.inserted())
            return (*head, run.audit, hashed.hexdigest())

        for batch in batches:
            out = []
            for own, at, role, text, *counts in zip(*(c.to_pylist() for c in batch.columns)):
                if at >= 0:
                    take(run.row(role, text))
                    continue
                if run is not None:
                    out.append(end())
                head, run, hashed, n = (own, *counts), Replay(text), hashlib.sha256(), 0
            yield _batch(out, names, id_type)
        if run is not None:
            yield _batch([end()], names, id_type)

    schema = T.StructType([
        plans.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in carried),
        T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType()),
    ])
    return _streamed(plans, ordered, carried).mapInArrow(digest, schema)


travels_with_tasks(__name__)
