import itertools
import math
import random

import pytest

from sparkloom.operators import connect, graph, paths


def adj(spark, pairs):
    return graph.adjacency(spark.createDataFrame([(min(a, b), max(a, b), float(w)) for a, b, w in pairs], "src string, dst string, weight double"))


def simple_paths(pairs, a, b):
    near = {}
    for x, y, w in pairs:
        near.setdefault(x, {})[y] = w
        near.setdefault(y, {})[x] = w

    def go(path):
        if path[-1] == b:
            yield path
        else:
            for n in near.get(path[-1], {}):
                if n not in path:
                    yield from go([*path, n])

    return [(p, [near[x][y] for x, y in zip(p, p[1:], strict=False)]) for p in go([a])]


def random_pairs(seed, n=8, p=0.4):
    rng = random.Random(seed)
    return [(f"n{i}", f"n{j}", round(rng.uniform(0.05, 1), 3)) for i in range(n) for j in range(i + 1, n) if rng.random() < p]


@pytest.mark.parametrize("seed", range(3))
def test_costs_widths_and_bounded_paths_against_all_paths(spark, seed):
    pairs = random_pairs(seed)
    a = adj(spark, pairs)
    found = {(r["source"], r["node"]): r for r in paths.shortest_paths(paths.costs(a), ["n0", "n1"]).collect()}
    wide = {(r["source"], r["node"]): r["width"] for r in paths.widest(paths.costs(a), ["n0"]).collect()}
    names = sorted({n for x, y, _ in pairs for n in (x, y)})
    reach = {h: {r["node"]: r for r in paths.joined_walks(a, spark.createDataFrame([("n0",)], "target string"), names, h).collect()} for h in (1, 2, 3, 4)}
    for target in sorted({n for x, y, _ in pairs for n in (x, y)} - {"n0"}):
        every = simple_paths(pairs, "n0", target)
        if not every:
            assert ("n0", target) not in found
            continue
        assert math.exp(-found["n0", target]["cost"]) == pytest.approx(max(math.prod(w) for _, w in every), rel=1e-9)
        assert wide["n0", target] == max(min(w) for _, w in every)
        for hops, short in reach.items():
            near = [math.prod(w) for p, w in every if len(p) <= hops + 1]
            assert (target in short) == bool(near)
            if near:
                got = short[target]
                assert math.exp(-got["cost"]) == pytest.approx(max(near), rel=1e-9) and got["path"][0] == target and got["path"][-1] == "n0"
                assert len(got["path"]) == got["hops"] + 1 <= hops + 1


@pytest.mark.parametrize("seed", range(2))
def test_goals_bound_the_search_and_change_nothing(spark, seed):
    pairs = random_pairs(seed + 40, 9, 0.35)
    costs = paths.costs(adj(spark, pairs))
    goals = ["n0", "n3", "n7"]
    whole = {(r["source"], r["node"]): (r["cost"], list(r["path"])) for r in paths.shortest_paths(costs, goals).collect()}
    some = {(r["source"], r["node"]): (r["cost"], list(r["path"])) for r in paths.shortest_paths(costs, goals, goals).collect()}
    assert {k: v for k, v in some.items() if k[1] in goals} == {k: v for k, v in whole.items() if k[1] in goals}
    assert {r["source"] for r in paths.closure(costs, []).collect()} == set()


def test_explanations(spark):
    """A direct tie that is weaker than a detour, one that isn't, and a third seed out of reach."""
    pairs = [("red", "via", 0.8), ("via", "goal", 0.7), ("red", "goal", 0.5), ("blue", "goal", 0.3), ("green", "a1", 0.9), ("a1", "a2", 0.9), ("goal", "rim", 0.2)]
    a = adj(spark, pairs)
    targets = spark.createDataFrame([("goal",), ("rim",)], "target string")
    got = {}
    for r in paths.explain_paths(a, targets, ["red", "blue", "green", "goal"]).orderBy("target", "place").collect():
        got.setdefault(r["target"], []).append((r["seed_id"], list(r["path"]), round(r["strength"], 9), r["hops"]))
    assert got["goal"] == [("red", ["red", "via", "goal"], 0.56, 2), ("blue", ["blue", "goal"], 0.3, 1)]
    assert got["rim"] == [("goal", ["goal", "rim"], 0.2, 1), ("red", ["red", "via", "goal", "rim"], 0.112, 3), ("blue", ["blue", "goal", "rim"], 0.06, 2)]
    one = targets.limit(1)
    assert [r["seed_id"] for r in paths.explain_paths(a, one, ["red", "blue"], max_paths=1).collect()] == ["red"]
    assert [list(r["path"]) for r in paths.explain_paths(a, one, ["red"], max_hops=1).collect()] == [["red", "goal"]]
    assert paths.explain_paths(a, targets, [], 3).count() == 0 and paths.explain_paths(a, targets, ["red"], max_paths=0).count() == 0


def test_objectives(spark):
    """The best product is direct, the best weakest edge has a stop on its way."""
    a = adj(spark, [("oak", "elm", 0.45), ("oak", "ash", 0.6), ("ash", "elm", 0.65), ("elm", "fir", 0.9)])
    assert connect.connect(a, ["oak", "elm"]).connectors == ()
    wide = connect.connect(a, ["oak", "elm"], objective="widest")
    assert wide.connectors == ("ash",) and wide.legs[0].bottleneck == 0.6 and wide.min_edge_weight == 0.6
    with pytest.raises(ValueError):
        connect.connect(a, ["oak", "elm"], objective="odd")


def test_weight_floor(spark):
    """Under the floor the strongest way (0.12 * 0.95) is closed; the rest of a ladder stays."""
    ladder = [("p", "thin", 0.12), ("thin", "q", 0.95), ("p", "l1", 0.5), ("l1", "l2", 0.5), ("l2", "l3", 0.5), ("l3", "q", 0.5)]
    a = adj(spark, ladder)
    assert connect.connect(a, ["p", "q"]).connectors == ("thin",)
    assert connect.connect(a, ["p", "q"], min_edge_weight=0.2).connectors == ("l1", "l2", "l3")
    assert connect.connect(a, ["p", "q"], min_edge_weight=0.7).unjoined == ("p", "q")


def test_hop_cap_refuses_and_never_shortens(spark):
    ring = [f"k{i:02}" for i in range(12)]
    a = adj(spark, [(x, y, 0.7) for x, y in zip(ring, ring[1:] + ring[:1], strict=True)])
    got = connect.connect(a, ["k00", "k05"], max_hops=4)
    assert got.skeletons == () and got.capped == (("k00", "k05", 5, 4),) and got.unjoined == ("k00", "k05")
    assert set(connect.connect(a, ["k00", "k05"], max_hops=5).skeletons[0].nodes) == {*ring[:6]}
    part = connect.connect(a, ["k00", "k02", "k07"], max_hops=4)
    assert set(part.skeletons[0].nodes) == {"k00", "k01", "k02"} and part.unjoined == ("k07",)
    assert connect.connect(a, ["k00", "k01"], max_hops=0).unjoined == ("k00", "k01")


def test_two_groups_missing_and_duplicates(spark):
    a = adj(spark, [("a", "b", 0.5), ("c", "m", 0.5), ("m", "d", 0.5)])
    got = connect.connect(a, ["a", "b", "c", "d", "a", "zz", "zz"])
    assert got.terminals == ("a", "b", "c", "d") and got.missing == ("zz",) and len(got.skeletons) == 2 and got.unjoined == ()
    assert {s.terminals: s.connectors for s in got.skeletons} == {("a", "b"): (), ("c", "d"): ("m",)}
    assert connect.connect(a, ["a"]).skeletons == ()


@pytest.mark.parametrize("seed", range(3))
def test_skeletons_are_trees_within_twice_the_best(spark, seed):
    pairs = [p for p in random_pairs(seed + 10, 7, 0.5)]
    names = sorted({n for x, y, _ in pairs for n in (x, y)})
    terminals = names[:3]
    got = connect.connect(adj(spark, pairs), terminals)
    cost = {(a, b): -math.log(w) for a, b, w in pairs}
    for s in got.skeletons:
        assert len(s.edges) == len(s.nodes) - 1
        groups = connect.Groups()
        for x, y, _ in s.edges:
            assert groups.join(x, y)
        assert len({groups.root(t) for t in s.terminals}) == 1
        best = math.inf
        for n in range(len(s.terminals) - 1, len(names)):
            for some in itertools.combinations(cost, n):
                g = connect.Groups()
                if all(g.join(x, y) for x, y in some) and len({g.root(t) for t in s.terminals}) == 1:
                    best = min(best, sum(cost[e] for e in some))
        assert s.cost <= 2 * best + 1e-9


def test_components(spark):
    edges = [(f"c{i:02}", f"c{i + 1:02}") for i in range(30)] + [("x", "y"), ("z", "z")]
    got = {r["node"]: r["component"] for r in paths.components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert {v for k, v in got.items() if k.startswith("c")} == {"c00"} and got["y"] == "x"


def test_full_weight_edges_and_empty_sets(spark):
    a = adj(spark, [("a", "b", 1.0), ("b", "c", 1.0)])
    assert connect.connect(a, ["a", "c"]).connectors == ("b",)
    assert connect.connect(a, []).terminals == ()
    assert connect.without_loose_ends([("a", "b"), ("b", "c"), ("c", "d")], {"a", "b"}) == [("a", "b")]
