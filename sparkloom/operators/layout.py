"""Force-directed positions of a small subgraph, and their fit into a viewport."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.schemas import LayoutConfig


#: Fixed values of the published force model: tolerance to swinging, largest share of the global speed
#: and of the distance-free speed of a node, and growth of the speed in a step.
TOLERANCE, NODE_SPEED, FREE_SPEED, GROWTH = 1.0, 0.1, 10.0, 1.5
GOLDEN_ANGLE = np.pi * (3 - np.sqrt(5))


def _forces(at: np.ndarray, mass: np.ndarray, ends: np.ndarray, weight: np.ndarray, config: LayoutConfig) -> np.ndarray:
    """Degree-weighted repulsion, linear attraction along edges, gravity of constant strength."""
    x, y = at.T
    gap_x, gap_y = np.subtract.outer(x, x), np.subtract.outer(y, y)
    push = config.scaling_ratio * np.outer(mass, mass) / np.maximum(gap_x * gap_x + gap_y * gap_y, 1e-6)
    force = np.stack([(push * gap_x).sum(axis=1), (push * gap_y).sum(axis=1)], axis=1)
    for one, other in (ends, ends[::-1]):
        for c in (0, 1):
            force[:, c] -= np.bincount(one, weight * (at[one, c] - at[other, c]), minlength=len(at))
    return force - config.gravity * mass[:, None] * at / np.maximum(np.hypot(x, y), 1e-6)[:, None]


def force_layout(n: int, edges: Sequence[tuple[int, int, float]], config: LayoutConfig = LayoutConfig()) -> np.ndarray:
    """(n, 2) positions around their centre, the same for the same seed.

    The force model of Jacomy and others (2014) with its adaptive speeds: a node that swings, whose force
    turns between steps, is slowed, and the whole moves as fast as its traction outweighs its swinging.
    Nodes start on a sunflower spiral, those of most edges in the middle, turned by the seed."""
    ends = np.array([(a, b) for a, b, _ in edges], np.int64).reshape(-1, 2).T
    weight = np.array([w for *_, w in edges], float)
    degree = np.bincount(ends.reshape(-1), minlength=n)[:n]
    mass = degree + 1.0
    ring = np.empty(n)
    ring[np.argsort(-degree, kind="stable")] = np.arange(n)
    angle = ring * GOLDEN_ANGLE + config.seed % 360
    at = np.sqrt(ring)[:, None] * np.stack([np.cos(angle), np.sin(angle)], axis=1) * config.scaling_ratio
    if n < 2:
        return np.zeros((n, 2))
    last, speed = np.zeros((n, 2)), 1.0
    for _ in range(config.iterations):
        force = _forces(at, mass, ends, weight, config)
        swing, traction = np.linalg.norm(force - last, axis=1), np.linalg.norm(force + last, axis=1) / 2
        wanted = TOLERANCE * (mass @ traction) / max(mass @ swing, 1e-9)
        speed = min(wanted, GROWTH * speed)
        own = NODE_SPEED * speed / (1 + speed * np.sqrt(swing))
        own = np.minimum(own, FREE_SPEED / np.maximum(np.linalg.norm(force, axis=1), 1e-9))
        at = at + own[:, None] * force
        last = force
    return at - at.mean(axis=0)


def fit_viewport(at: np.ndarray, width: float = 1000.0, height: float = 1000.0, padding: float = 40.0) -> np.ndarray:
    """Positions centred in the viewport, both axes by one factor; a single place is only moved."""
    at = np.array(at, float).reshape(-1, 2)
    if len(at):
        size = np.array([width, height])
        span = np.ptp(at, axis=0)
        at -= at.min(axis=0) + span / 2
        if span.any():
            room = (size - 2 * padding).clip(0)
            at *= np.divide(room, span, out=np.full(2, np.inf), where=span > 0).min()
        at += size / 2
    return at


def layout(fused: DataFrame, ids: Sequence[str], config: LayoutConfig = LayoutConfig(), **viewport: float) -> dict[str, tuple[float, float]]:
    """Positions of the first ``max_nodes`` of ``ids`` in their induced subgraph."""
    ids = list(dict.fromkeys(ids))[: config.max_nodes]
    place = {x: i for i, x in enumerate(ids)}
    rows = fused.where(F.col("src").isin(*ids or [""]) & F.col("dst").isin(*ids or [""])).select("src", "dst", "weight").orderBy("src", "dst").collect()
    found = force_layout(len(ids), [(place[r["src"]], place[r["dst"]], r["weight"]) for r in rows], config)
    return {x: (float(a), float(b)) for x, (a, b) in zip(ids, fit_viewport(found, **viewport), strict=True)}


def normalized_positions(points: DataFrame, width: float = 1000.0, height: float = 1000.0, padding: float = 40.0) -> DataFrame:
    """``points(node, x, y)`` fitted into the viewport by aggregates, for point sets of any size."""
    box = points.agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("low", F.min), ("high", F.max))))
    factors = [F.when(F.col(f"high_{c}") > F.col(f"low_{c}"), F.lit(max(room - 2 * padding, 0.0)) / (F.col(f"high_{c}") - F.col(f"low_{c}"))) for c, room in (("x", width), ("y", height))]
    scaled = box.withColumn("scale", F.coalesce(F.least(*factors), F.lit(1.0)))  # one row
    at = {c: (F.col(c) - (F.col(f"low_{c}") + F.col(f"high_{c}")) / 2) * F.col("scale") + room / 2 for c, room in (("x", width), ("y", height))}
    return points.crossJoin(scaled).select("node", at["x"].alias("x"), at["y"].alias("y"))
