"""Conversation repair against exhaustive search and a plain program per conversation."""

import hashlib
import itertools
import re
import zlib

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.llm import QUERIES
from tagloom.llm.conversation_repair import (
    LETTERS, Replay, cheapest_edits, in_order, repair_conversations, repair_plans, repaired_rows,
)

SF = "/root/testdata/sf0.001"
ROLES = {0: "system", 1: "user", 2: "assistant", 3: "other"}
ORDERED = re.compile("(s?(ua)+)?")


def by_trial(letters):
    """Every choice of edits, with up to two insertions at each place."""
    fills = [()] + [(a,) for a in "ua"] + list(itertools.product("ua", repeat=2))
    best = None
    rows = [LETTERS[x] for x in letters]
    options = []
    for initial, fault in rows:
        own = [("D", "", 3)]
        if fault < 2:
            extra = int(fault == 1)
            own.append(("K", "sua?"[initial], extra))
            own += [("R", r, 2 + extra) for r in "ua"]
        options.append(own)
    for gaps in itertools.product(fills, repeat=len(rows) + 1):
        for edits in itertools.product(*options):
            roles = "".join(gaps[0])
            audit, cost = "I" * len(gaps[0]), 2 * sum(map(len, gaps))
            for gap, (edit, role, price) in zip(gaps[1:], edits):
                roles += role + "".join(gap)
                audit += edit + "I" * len(gap)
                cost += price
            if ORDERED.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def by_suffixes(letters):
    """The least (cost, initials) of each suffix and role before it."""
    next_of = {"": "u", "s": "u", "u": "a", "a": "u"}
    after = {"": (0, ""), "a": (0, ""), "u": (2, "I"), "s": (4, "II")}
    for letter in reversed(letters):
        initial, fault = LETTERS[letter]
        own = {}
        for role in next_of:
            cost, audit = after[role]
            found = [(cost + 3, "D" + audit)]
            if fault < 2:
                extra = int(fault == 1)
                cost, audit = after[next_of[role]]
                found.append((cost + 2 + extra, "R" + audit))
                kept = "sua?"[initial]
                if kept == next_of[role] or (kept, role) == ("s", ""):
                    cost, audit = after[kept]
                    found.append((cost + extra, "K" + audit))
            own[role] = min(found)
        for _ in range(2):
            for role, given in next_of.items():
                cost, audit = own[given]
                own[role] = min(own[role], (cost + 2, "I" + audit))
        after = own
    return after[""]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(sorted(LETTERS)), max_size=3))
def test_edits_equal_exhaustive_search(letters):
    letters = "".join(letters[:2]) if len(letters) == 3 and letters[0] < "I" else "".join(letters)
    assert cheapest_edits(letters) == by_trial(letters) == by_suffixes(letters)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(sorted(LETTERS)), max_size=60))
def test_checkpoints_change_nothing(letters):
    assert cheapest_edits("".join(letters)) == by_suffixes("".join(letters))


def test_a_very_long_conversation():
    letters = "ABEFIJMN" * 25_000
    cost, audit = cheapest_edits(letters)
    roles, run = "", Replay(audit)
    for letter in letters:
        roles += "".join(r[0] for e, r, _ in run.row(ROLES[LETTERS[letter][0]], "") if e != "D")
    roles += "".join(r[0] for _, r, _ in run.inserted())
    assert ORDERED.fullmatch(roles) and run.at == len(audit)
    costs = {"D": 3, "I": 2, "R": 2, "K": 0}
    assert cost >= sum(costs[e] for e in audit)


def damaged(rows):
    out = []
    for conv_id, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv_id, turn))
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv_id, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def expected(conv_ids, rows):
    out = {}
    for conv_id in conv_ids:
        own = [r[1:] for r in rows if r[0] == conv_id]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        letters, seen, counts = "", set(), [0, 0, 0, 0]
        for _, role, text in own:
            solid = text.strip(" \t\n\x0b\x0c\r")
            if not solid:
                fault = 2
            elif (role, text) in seen:
                fault = 3
            else:
                fault = int(solid[-1] not in ".!?")
            seen.add((role, text))
            counts[fault] += 1
            initial = "sua".find(role[0]) if role else -1
            letters += chr(65 + 4 * (initial if initial >= 0 else 3) + fault)
        initials = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = by_suffixes(letters)
        run, lines = Replay(audit), []
        for _, role, text in own:
            lines += [f"{r}:{t}" for e, r, t in run.row(role, text) if e != "D"]
        lines += [f"{r}:{t}" for _, r, t in run.inserted()]
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv_id] = (gaps, counts[2], counts[3], counts[1], illegal, cost, audit, sha)
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def as_dict(df):
    return {r.conv_id: tuple(r[n] for n in NAMES) for r in df.collect()}


def test_query_equals_plain_program(spark):
    source = pd.read_parquet(f"{SF}/conversations.parquet")
    rows = list(source[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None))
    got = as_dict(QUERIES["op13_conversation_repair"](spark, SF))
    assert got == expected(source.conv_id.unique().tolist(), damaged(rows))


ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello"),
    (1, 5, "assistant", "Hello"), (1, None, "user", "x."),
    (2, 0, "user", " \t"), (2, 1, None, None), (2, 2, "", "role is missing."),
    (None, 0, "user", "q?"), (None, 1, "assistant", "a."), (None, 1, "assistant", "a."),
    (3, None, "User", "case."), (3, None, "narrator", "b."),
    (4, 0, "user", "long " * 200_000 + "."), (4, 1, "assistant", "é。"),
]


def filled(rows):
    return [(c, t, *(" " if v is None else v for v in rest)) for c, t, *rest in rows]


def test_nulls_ties_long_texts_and_other_columns(spark):
    schema = "conv_id long, turn long, role string, text string, at long, audit string"
    rows = spark.createDataFrame([(*r, 7, "x") for r in ROWS], schema)
    more = spark.createDataFrame([(9,), (1,), (None,)], "conv_id long")
    got = as_dict(repair_conversations(rows, rows.select("conv_id").union(more)))
    assert got == expected([1, 2, None, 3, 4, 9], filled(ROWS))
    assert got[9] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows_give_the_hash(spark):
    rows = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    ordered = in_order(rows)
    plans = repair_plans(ordered, rows)
    shown = repaired_rows(plans, ordered).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("rows"))
    got = {
        r.conv_id: hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in r.rows).encode()).hexdigest()
        for r in shown.collect()
    }
    want = {c: v[-1] for c, v in expected([1, 2, None, 3, 4], filled(ROWS)).items()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got == {c: sha for c, sha in want.items() if sha != empty}


def test_one_conversation_over_many_ranges(spark):
    rows = [(5, t, ("user", "assistant")[t % 2], f"say {t % 300}.") for t in range(2_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        ordered = in_order(df.repartition(8))
        assert ordered.select(F.shiftright("at", 33)).distinct().count() > 4
        assert as_dict(repair_conversations(df.repartition(8))) == expected([5], rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty_table_and_text_ids(spark):
    rows = spark.createDataFrame([("a", 0, "user", "q?")], "conv_id string, turn int, role string, text string")
    assert repair_conversations(rows.limit(0)).collect() == []
    assert [(r.conv_id, r.cost, r.audit) for r in repair_conversations(rows).collect()] == [("a", 2, "KI")]
