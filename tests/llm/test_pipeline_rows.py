"""Stages of the pipeline on small tables: new texts, null and repeated ids."""

import corpus_pipeline as p

SCHEMA = "doc_id bigint, text string, n_chars bigint, source string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, len(t or ""), f"s{i}") for i, t in rows], SCHEMA)


def brute_line_dedup(rows):
    """Lines of ten characters and more stay in the document of the smallest id."""
    owner = {}
    for i, text in sorted(rows):
        for line in text.split("\n"):
            owner.setdefault(line.strip().lower(), i)
    for i, text in rows:
        lines = text.split("\n")
        kept = [x for x in lines if len(x.strip()) < 10 or owner[x.strip().lower()] == i]
        if len(kept) == len(lines) or "\n".join(kept):
            yield i, "\n".join(kept)


def test_line_dedup_gives_new_texts_and_lengths(spark):
    rows = [(1, "a line that comes back\nown line of the first"),
            (2, "A line that comes back \nown line of the second\nshort"),
            (3, "own line of the second"), (4, "short\na line that comes back"), (5, "")]
    got = p.drop_repeated_lines(spark, table_of(spark, rows), "")
    want = [(i, t, len(t), f"s{i}") for i, t in brute_line_dedup(rows)]
    assert sorted(map(tuple, got.collect())) == want
    assert (got.columns, want[1][1]) == (["doc_id", "text", "n_chars", "source"],
                                         "own line of the second\nshort")


LONG = " ".join(f"word{i}" for i in range(60))
NEAR = LONG.replace("word59", "other")
# several rows without an id, an id whose rows are equal, and one whose rows differ
ROWS = [
    (1, f"{LONG}\ncommon line of many"), (2, "common line of many\nits own line, too"),
    (None, "first of those without id"), (None, "other of those without id"),
    (None, "other of those without id"), (None, "common line of many"),
    (3, "a row that stands twice"), (3, "a row that stands twice"),
    (4, f"{LONG} x\nand what follows here"), (4, f"quite another text of one id {' '.join(map(str, range(30)))}"),
]


def pairs(df):
    return sorted(((r["doc_id"] or 0, r["text"]) for r in df.collect()))


def test_line_dedup_keeps_rows(spark):
    got = p.drop_repeated_lines(spark, table_of(spark, ROWS), "")
    want = [(i or 0, "its own line, too" if i == 2 else t) for i, t in ROWS]
    assert pairs(got) == sorted(want)
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())


def test_near_copies_keep_rows(spark):
    rows = [*ROWS, (5, NEAR), (6, NEAR), (6, NEAR), (None, NEAR)]
    got = p.one_of_each_group(spark, table_of(spark, rows), "")
    want = [(i or 0, t) for i, t in rows if i not in (5, 6)]
    assert pairs(got) == sorted(want)


def test_sets_without_id_and_of_repeated_ids(spark):
    from tagloom.llm.ngram_join import similar_components

    rows = [(None, "a b c d"), (None, "e f g h"), (None, "a b c d"),
            (1, "a b c d"), (1, "e f g h"), (2, "e f g h"), (3, "e f g h"), (3, "a b c d")]
    got = similar_components(table_of(spark, rows), size=3, percent=90).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == [
        (0, 2, 0), (0, 2, 0), (1, 4, 1), (2, 2, 2), (3, 4, 1)]


def test_mixing_keeps_rows(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = ROWS + [(None, f"text {i} without an id") for i in range(200)]
    got = p.mix_sources(spark, table_of(spark, rows), str(tmp_path)).collect()
    assert {len(r) for r in got} == {4} and all(r["n_chars"] == len(r["text"]) for r in got)
    mixed = p.mix_documents(
        table_of(spark, rows), p.domains(labels), p.WEIGHTS, p.GROWTH).collect()
    assert len(mixed) == len(rows) and len(got) == sum(r["copies"] for r in mixed)
    # rates are rounded up for some texts without an id and down for others
    rates = [r["rate"] for r in mixed if r["doc_id"] is None]
    apart = [r["text"] for r in got if r["doc_id"] is None]
    assert abs(len(apart) - sum(rates)) < 40 and min(rates) > 0 and max(rates) % 1 > 0
    assert {r["copies"] - int(r["rate"]) for r in mixed if r["doc_id"] is None} == {0, 1}
    assert sum(r["text"] == "a row that stands twice" for r in got) % 2 == 0


def test_other_stages_keep_rows(spark, tmp_path):
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = table_of(spark, ROWS)
    assert pairs(p.drop_toxic(spark, docs, str(tmp_path))) == sorted((i or 0, t) for i, t in ROWS)
    assert p.encode(spark, docs, "").count() == len(ROWS)
