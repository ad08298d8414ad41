from sparkloom.operators import fuse
from sparkloom.schemas import GraphConfig


def test_kinds_take_no_objects(spark):
    rows = [("a", "b", "y", 1, "s"), ("b", "a", "x", 1, "s"), ("a", "c", "y", 2, "s"), ("a", "c", "no", 1, "s")]
    edges = spark.createDataFrame(rows, "src string, dst string, kind string, rank int, source string")
    few = fuse.fuse(edges, GraphConfig(source_alpha={"y": 0.5, "x": 0.5}))
    assert "ObjectHashAggregate" not in few._jdf.queryExecution().executedPlan().toString()
    many = fuse.fuse(edges, GraphConfig(source_alpha={"y": 0.5, "x": 0.5} | {f"k{i}": 1.0 for i in range(70)}))
    for found in (few, many):
        assert {(r["src"], r["dst"]): r["kinds"] for r in found.collect()} == {("a", "b"): ["x", "y"], ("a", "c"): ["y"]}
