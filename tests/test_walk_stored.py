import os

from sparkloom import lineage
from sparkloom.operators import graph


def test_stored_edges_are_laid_out_once_with_their_shares(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 3.0), ("b", "a", 1.0)], "src string, dst string, weight double")
    adj = lineage.stored(edges, "adjacency")
    home = lineage.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(home))
    placed = lineage.laid_out(adj.select("src", "dst", "weight"), of=adj, then=graph.transition)
    assert {(r["src"], r["dst"], r["p"]) for r in placed.collect()} == {("a", "b", 0.25), ("a", "c", 0.75), ("b", "a", 1.0)}
    assert set(os.listdir(home)) == before
    again = placed.where("p > 0")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in again[: again.index("InMemoryRelation")]
    placed.unpersist()
