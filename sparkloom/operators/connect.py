"""The smallest structure that joins a few items: a Steiner tree by the metric-closure method.

Paths are found on the cluster; what follows works on as many nodes as the paths have.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import paths

PRODUCT, WIDEST = "product", "widest"
MAX_HOPS = 8


@dataclass(frozen=True)
class Leg:
    """One route of the closure's tree."""

    source: str
    target: str
    path: tuple[str, ...]
    cost: float
    strength: float
    bottleneck: float

    @property
    def hops(self) -> int:
        return len(self.path) - 1

    @property
    def waypoints(self) -> tuple[str, ...]:
        return self.path[1:-1]


@dataclass(frozen=True)
class Skeleton:
    """A tree over terminals that reach each other."""

    terminals: tuple[str, ...]
    connectors: tuple[str, ...]
    edges: tuple[tuple[str, str, float], ...]
    legs: tuple[Leg, ...]
    cost: float

    @property
    def nodes(self) -> tuple[str, ...]:
        return self.terminals + self.connectors

    @property
    def strength(self) -> float:
        return math.exp(-self.cost)


@dataclass(frozen=True)
class Connections:
    """``capped`` has (source, target, hops, max_hops) of pairs whose cheapest path is too long."""

    terminals: tuple[str, ...]
    missing: tuple[str, ...] = ()
    skeletons: tuple[Skeleton, ...] = ()
    unjoined: tuple[str, ...] = ()
    capped: tuple[tuple[str, str, int, int], ...] = ()
    max_hops: int = MAX_HOPS
    objective: str = PRODUCT
    min_edge_weight: float = 0.0
    titles: dict[str, str] = field(default_factory=dict)

    @property
    def nodes(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(n for s in self.skeletons for n in s.nodes))

    @property
    def edges(self) -> tuple[tuple[str, str, float], ...]:
        return tuple(dict.fromkeys(e for s in self.skeletons for e in s.edges))

    @property
    def connectors(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(n for s in self.skeletons for n in s.connectors))

    @property
    def legs(self) -> tuple[Leg, ...]:
        return tuple(leg for s in self.skeletons for leg in s.legs)


class Groups:
    """Disjoint sets of names."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def root(self, name: str) -> str:
        path = [name]
        while (above := self.up.get(path[-1], path[-1])) != path[-1]:
            path.append(above)
        for x in path:
            self.up[x] = path[-1]
        return path[-1]

    def join(self, a: str, b: str) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[b] = a
        return a != b


def spanning_forest(edges: Iterable[tuple[float, str, str]]) -> list[tuple[str, str]]:
    """Edges (cost, a, b) of a minimum spanning forest, ties by name."""
    groups = Groups()
    return [(a, b) for _, a, b in sorted(edges) if groups.join(a, b)]


def without_loose_ends(edges: list[tuple[str, str]], keep: set[str]) -> list[tuple[str, str]]:
    """Cut off ends that are no terminals until none is left."""
    while True:
        count: dict[str, int] = defaultdict(int)
        for edge in edges:
            for node in edge:
                count[node] += 1
        loose = {n for n, c in count.items() if c == 1} - keep
        if not loose:
            return edges
        edges = [e for e in edges if not loose.intersection(e)]


def weakest_needed(cost_edges: DataFrame, terminals: Sequence[str]) -> float:
    """The least width over pairs of terminals that can be joined."""
    found = paths.widest(cost_edges, terminals).where(F.col("node").isin(*terminals) & (F.col("source") != F.col("node")))
    return found.agg(F.min("width")).first()[0] or 0.0


def connect(adj: DataFrame, terminals: Sequence[str], max_hops: int = MAX_HOPS, objective: str = PRODUCT, min_edge_weight: float = 0.0) -> Connections:
    """Join ``terminals`` over ``adj``: one skeleton per group that reaches each other.

    The objective ``product`` wants the largest product of weights, ``widest`` first the strongest
    possible weakest edge. A pair whose cheapest path has more than ``max_hops`` is refused, never
    given a costlier shorter path.
    """
    if objective not in (PRODUCT, WIDEST):
        raise ValueError(f"unknown objective {objective!r}")
    asked = list(dict.fromkeys(terminals))
    known = {r["src"] for r in adj.where(F.col("src").isin(*asked or [""])).select("src").distinct().collect()}
    present = tuple(t for t in asked if t in known)
    base = {"terminals": present, "missing": tuple(t for t in asked if t not in known), "max_hops": max_hops, "objective": objective}
    if len(present) < 2 or max_hops < 1:
        return Connections(**base, unjoined=present if len(present) > 1 else (), min_edge_weight=min_edge_weight)
    floor = min_edge_weight
    if objective == WIDEST:
        floor = max(floor, weakest_needed(paths.costs(adj, floor), present))
    cost_edges = paths.costs(adj, floor)
    order = {t: i for i, t in enumerate(present)}
    routes: dict[tuple[str, str], tuple[float, list[str]]] = {}
    capped = []
    # pairs of a few terminals
    for row in sorted(paths.closure(cost_edges, present).where("path is not null").collect(), key=lambda r: (order[r["source"]], order[r["target"]])):
        a, b, path = row["source"], row["target"], list(row["path"])
        if order[a] < order[b]:
            if len(path) - 1 > max_hops:
                capped.append((a, b, len(path) - 1, max_hops))
            else:
                routes[a, b] = row["cost"], path
    groups = Groups()
    for a, b in routes:
        groups.join(a, b)
    members: dict[str, list[str]] = defaultdict(list)
    for t in present:
        members[groups.root(t)].append(t)
    chosen = spanning_forest((cost, a, b) for (a, b), (cost, _) in routes.items())
    on_paths = sorted({n for pair in chosen for n in routes[pair][1]})
    among = cost_edges.where(F.col("src").isin(*on_paths or [""]) & F.col("dst").isin(*on_paths or [""]) & (F.col("src") < F.col("dst")))
    weights = {(r["src"], r["dst"]): (r["weight"], r["cost"]) for r in among.collect()}  # between nodes of a few paths

    def weight(a: str, b: str) -> float:
        return weights[min(a, b), max(a, b)][0]

    skeletons = []
    for group in members.values():
        if len(group) > 1:
            skeletons.append(_skeleton(group, [(p, routes[p][1]) for p in chosen if p[0] in group], weights, weight))
    alone = {g[0] for g in members.values() if len(g) == 1}
    return Connections(**base, skeletons=tuple(skeletons), unjoined=tuple(t for t in present if t in alone), capped=tuple(capped), min_edge_weight=floor)


def _skeleton(group: list[str], legs: list, weights: dict, weight) -> Skeleton:
    made, union = [], set(group)
    for (a, b), path in legs:
        steps = [weight(x, y) for x, y in zip(path, path[1:], strict=False)]
        cost = -sum(map(math.log, steps))
        made.append(Leg(a, b, tuple(path), cost, math.exp(-cost), min(steps)))
        union.update(path)
    inner = spanning_forest((cost, a, b) for (a, b), (_, cost) in weights.items() if a in union and b in union)
    tree = without_loose_ends(inner, set(group))
    edges = tuple(sorted((a, b, weight(a, b)) for a, b in tree))
    connectors = tuple(sorted({n for e in tree for n in e} - set(group)))
    return Skeleton(tuple(group), connectors, edges, tuple(sorted(made, key=lambda x: (x.source, x.target))), -sum(math.log(w) for _, _, w in edges))
