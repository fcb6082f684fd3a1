"""Variants are many more rows than Spark takes them for, so their join must not pass the driver."""
from dossier.llm import simhash


def test_no_variants_are_collected_in_the_driver(spark, monkeypatch):
    plans, whole = [], simhash.components

    def seen(edges):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return whole(edges)

    monkeypatch.setattr(simhash, "components", seen)
    items = spark.createDataFrame([(0,), (1,), (3,), (1 << 40,), (0xFFFF,)], "node long")
    found = {r["node"]: r["root"] for r in simhash.linked(items).collect()}
    assert found == {0: 0, 1: 0, 3: 0, 1 << 40: 0, 0xFFFF: 0xFFFF}
    assert "SortMergeJoin" in plans[-1] and "BroadcastHashJoin" not in plans[-1]


def test_rounds_too_large_to_send_are_sorted(spark, monkeypatch):
    plans, whole = [], simhash.components
    monkeypatch.setattr(simhash, "SENT_ROWS", 0)
    monkeypatch.setattr(simhash, "components", lambda edges: (
        plans.append(edges._jdf.queryExecution().executedPlan().toString()), whole(edges))[1])
    items = spark.range(40).select((2 ** 20 * simhash.F.col("id")).alias("node"))
    found = {r["node"]: r["root"] for r in simhash.linked(items).collect()}
    assert len(plans) == 2 and not any("BroadcastHashJoin" in p for p in plans)
    assert set(found.values()) == {0}
