from tagloom.llm import components as c


def test_components_broadcast_nothing(spark, monkeypatch):
    """Before, every round kept broadcasts of its labels in the driver's memory."""
    plans = []

    def kept(df, name, base=c.materialize):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return base(df, name)

    monkeypatch.setattr(c, "materialize", kept)
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8)], "a long, b long")
    got = {r["id"]: r["component"] for r in c.components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7}
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)
