from tagloom.llm import ngram_join as n


def test_only_members_differences_become_rows(spark):
    """Before, those of every pair with a hub did, also of pairs in no open family."""
    cut = spark.createDataFrame(
        [(i, 4, part, grams) for i, parts in {
            1: ([1, 2], [8, 9]), 2: ([1, 3], [8, 9]), 3: ([5, 6], [7, 9]),
        }.items() for part, grams in enumerate(parts)],
        "id long, n long, part int, grams array<long>",
    )
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    got = {(r["a"], r["b"]): r["overlap"] for r in n.overlaps(pairs, cut).collect()}
    assert got == {(1, 2): 3, (1, 3): 1}
    members = spark.createDataFrame([(1, 2, 2, 1)], "a long, b long, id long, family long")
    rows = n.differences(members, cut).select("id", "family", "gram").collect()
    assert sorted(tuple(r) for r in rows) == [(2, 1, 2), (2, 1, 3)]
