import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import fuse, graph
from sparkloom.schemas import GraphConfig

EDGE = "src string, dst string, kind string, rank int, source string"
LOOSE = GraphConfig(min_weight=0.0)


def edges(spark, *rows):
    full = [(a, b, k, r, s[0] if s else "goodreads_ucsd") for a, b, k, r, *s in rows]
    return spark.createDataFrame(full, EDGE)


def fused(spark, rows, config=LOOSE, books=None):
    found = fuse.fuse(edges(spark, *rows), config, books).collect()
    return {(r["src"], r["dst"]): r for r in found}


def test_rank_weights(spark):
    """The reciprocal of the binary logarithm of rank + 2."""
    found = spark.range(1, 51).select("id", fuse.rank_weight(F.col("id").cast("int")).alias("w")).collect()
    assert all(r["w"] == pytest.approx(math.log(2) / math.log(r["id"] + 2), rel=1e-12) for r in found)
    assert [r["w"] for r in found] == sorted((r["w"] for r in found), reverse=True)
    with pytest.raises(Exception, match="rank must be"):
        spark.createDataFrame([(0,)], "rank int").select(fuse.rank_weight(F.col("rank"))).collect()


def test_directions_and_kinds(spark):
    """The stronger direction is the weight, their difference its asymmetry; kinds add up within a direction."""
    alpha = GraphConfig().source_alpha
    w = {r: 1 / math.log2(r + 2) for r in (3, 4, 9)}
    one = fused(spark, [("q", "p", "gr_similar", 4)])["p", "q"]
    assert one["weight"] == pytest.approx(alpha["gr_similar"] * w[4], rel=1e-12) and one["dir_asym"] == 1
    both = fused(spark, [("p", "q", "gr_similar", 9), ("q", "p", "gr_similar", 4)])["p", "q"]
    assert both["weight"] == pytest.approx(alpha["gr_similar"] * w[4], rel=1e-12) and both["dir_asym"] == pytest.approx(1 - w[9] / w[4], rel=1e-12)
    kinds = fused(spark, [("p", "q", "az_also_viewed", 3), ("p", "q", "gr_similar", 9), ("q", "p", "az_also_bought", 4)])["p", "q"]
    there, back = alpha["az_also_viewed"] * w[3] + alpha["gr_similar"] * w[9], alpha["az_also_bought"] * w[4]
    assert kinds["weight"] == pytest.approx(max(there, back), rel=1e-12) and kinds["dir_asym"] == pytest.approx(1 - min(there, back) / max(there, back), rel=1e-12)
    assert kinds["kinds"] == ["az_also_bought", "az_also_viewed", "gr_similar"]
    same = fused(spark, [("p", "q", "gr_similar", 9), ("q", "p", "gr_similar", 9)])["p", "q"]
    assert same["dir_asym"] == 0


def test_what_does_not_count(spark):
    assert not fused(spark, [("a", "a", "gr_similar", 1), ("a", "b", "odd", 1), ("a", "b", "gr_similar", 51)])
    assert not fused(spark, [("a", "b", "ol_subject", 1), ("c", "d", "az_also_viewed", 3)], GraphConfig())
    assert fused(spark, [("c", "d", "az_also_viewed", 2)], GraphConfig())["c", "d"]["weight"] == pytest.approx(0.05)


def test_leaves_go_in_one_pass(spark):
    rows = [("b", "c", "gr_similar", 1), ("c", "d", "gr_similar", 1), ("b", "d", "gr_similar", 1), ("d", "leaf", "gr_similar", 1)]
    assert set(fused(spark, rows, GraphConfig(min_weight=0, drop_leaves=True))) == {("b", "c"), ("c", "d"), ("b", "d")}


def test_unknown_ratings_pass_any_threshold(spark):
    books = spark.createDataFrame([("big", 500000), ("mid", 800), ("small", 3), ("unknown", None)], "work_id string, ratings_count long")
    rows = [("big", x, "gr_similar", 1) for x in ("mid", "small", "unknown")] + [("small", "unknown", "gr_similar", 1)]
    assert set(fused(spark, rows, GraphConfig(min_weight=0, min_ratings=100), books)) == {("big", "mid"), ("big", "unknown")}
    assert len(fused(spark, rows, GraphConfig(min_weight=0, min_ratings=0), books)) == 4
    with pytest.raises(ValueError):
        fused(spark, rows, GraphConfig(min_ratings=5))


def plain(rows, config):
    directed, kinds = {}, {}
    for a, b, k, r, _ in rows:
        if r <= config.max_rank and k in config.source_alpha and a != b:
            directed.setdefault((a, b), []).append(config.source_alpha[k] / math.log2(2 + r))
            kinds.setdefault((min(a, b), max(a, b)), set()).add(k)
    out = {}
    for a, b in kinds:
        there, back = (sum(directed.get(p, [0])) for p in ((a, b), (b, a)))
        if max(there, back) >= config.min_weight:
            out[a, b] = (max(there, back), 1 - min(there, back) / max(there, back), sorted(kinds[a, b]))
    return out


@pytest.mark.parametrize("config", [GraphConfig(), LOOSE, GraphConfig(max_rank=10), GraphConfig(min_weight=0.2)])
def test_random_edges_against_plain_fusion(spark, config):
    rng = random.Random(0)
    rows = {}
    for _ in range(400):
        key = (f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", rng.choice(["gr_similar", "az_also_bought", "az_also_viewed", "ol_subject", "odd"]), rng.choice("xy"))
        rows[key] = rng.randint(1, 60)
    flat = [(a, b, k, r, s) for (a, b, k, s), r in rows.items()]
    rng.shuffle(flat)
    got = {p: (r["weight"], r["dir_asym"], r["kinds"]) for p, r in fused(spark, flat, config).items()}
    want = plain(flat, config)
    assert set(got) == set(want)
    for p in got:
        assert got[p][:2] == pytest.approx(want[p][:2], rel=1e-9, abs=1e-12) and got[p][2] == want[p][2]


def test_graph_basics(spark):
    f = spark.createDataFrame([("a", "b", 0.2), ("a", "c", 0.9), ("a", "d", 0.5), ("b", "z", 0.0)], "src string, dst string, weight double")
    assert [r["neighbour"] for r in graph.neighbours(f, "a").collect()] == ["c", "d", "b"]
    assert [r["neighbour"] for r in graph.neighbours(f, "c").collect()] == ["a"] and graph.neighbours(f, "none").count() == 0
    adj = graph.adjacency(f)
    degree = {r["node"]: (r["degree"], r["weighted_degree"]) for r in graph.degrees(adj).collect()}
    assert degree["a"][0] == 3 and degree["b"] == (1, 0.2) and degree["z"] == (0, 0.0)
    assert {(r["src"], r["dst"]): r["p"] for r in graph.transition(adj).collect()}["z", "b"] == 0
    assert [(r["node"], r["idx"]) for r in graph.node_index(f).orderBy("idx").collect()] == list(zip("abcdz", range(5), strict=True))
    ids = spark.createDataFrame([("a",), ("c",), ("nowhere",), ("a",)], "node string")
    assert [(r["src"], r["dst"]) for r in graph.subgraph(f, ids).collect()] == [("a", "c")]
    assert graph.graph_counts(f).first().asDict() == {"n_nodes": 5, "n_edges": 4}
