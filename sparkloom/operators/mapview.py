"""What a map of recommendations shows, and its standalone picture."""

from __future__ import annotations

from collections.abc import Sequence
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import graph
from sparkloom.operators.layout import layout
from sparkloom.schemas import LayoutConfig

NEIGHBOURS_PER_SEED = 6
LABEL_CHARS = 42


def members(seeds: Sequence[str], required: Sequence[str], recommended: Sequence[str], fused: DataFrame, max_nodes: int, per_seed: int = NEIGHBOURS_PER_SEED) -> list[str]:
    """Seeds, then what must be shown, then recommendations, then each seed's strongest neighbours,
    cut at ``max_nodes``."""
    near = [r["neighbour"] for s in seeds for r in graph.neighbours(fused, s, per_seed).collect()]
    return list(dict.fromkeys([*seeds, *required, *recommended, *near]))[:max_nodes]


def payload(fused: DataFrame, books: DataFrame, seeds: Sequence[str], required: Sequence[str] = (), recommended: dict[str, float] | None = None, labels: DataFrame | None = None, config: LayoutConfig = LayoutConfig()) -> dict:
    """Nodes (id, title, role, x, y, score, community) and edges of the induced subgraph."""
    recommended = recommended or {}
    ids = members(seeds, required, sorted(recommended, key=lambda i: (-recommended[i], i)), fused, config.max_nodes)
    at = layout(fused, ids, config)
    titles = {r["work_id"]: r["title"] for r in books.where(F.col("work_id").isin(*ids or [""])).select("work_id", "title").collect()}
    groups = {r["node"]: r["community"] for r in labels.where(F.col("node").isin(*ids or [""])).collect()} if labels is not None else {}
    role = {i: "seed" if i in seeds else "connector" if i in required else "recommendation" if i in recommended else "context" for i in ids}
    inside = fused.where(F.col("src").isin(*ids or [""]) & F.col("dst").isin(*ids or [""])).orderBy("src", "dst").collect()
    return {
        "nodes": [{"id": i, "title": titles.get(i, i), "role": role[i], "x": at[i][0], "y": at[i][1], "score": recommended.get(i), "community": groups.get(i)} for i in ids],
        "edges": [{"source": r["src"], "target": r["dst"], "weight": r["weight"]} for r in inside],
    }


def render_svg(view: dict, size: int = 1000) -> str:
    """The payload as one HTML page that fetches nothing; hubs are drawn last, above the rest."""
    at = {n["id"]: (n["x"], n["y"]) for n in view["nodes"]}
    degree = {i: sum(i in (e["source"], e["target"]) for e in view["edges"]) for i in at}
    top = max([e["weight"] for e in view["edges"]], default=1.0) or 1.0
    out = [f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Map</title></head><body><svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {size} {size}">']
    for e in view["edges"]:
        (a, b), (c, d), share = at[e["source"]], at[e["target"]], e["weight"] / top
        out.append(f'<line x1="{a:.1f}" y1="{b:.1f}" x2="{c:.1f}" y2="{d:.1f}" stroke="#888" stroke-opacity="{0.15 + 0.6 * share:.2f}" stroke-width="{0.5 + 2.5 * share:.2f}"/>')
    colours = {"seed": "#c0392b", "connector": "#8e44ad", "recommendation": "#2471a3", "context": "#7f8c8d"}
    for n in sorted(view["nodes"], key=lambda n: (degree[n["id"]], n["id"])):
        title = n["title"] if len(n["title"]) <= LABEL_CHARS else n["title"][: LABEL_CHARS - 1] + "…"
        out.append(f'<g><circle cx="{n["x"]:.1f}" cy="{n["y"]:.1f}" r="{4 + degree[n["id"]] ** 0.5:.1f}" fill="{colours[n["role"]]}"/><text x="{n["x"] + 8:.1f}" y="{n["y"]:.1f}" font-size="11">{escape(title)}</text></g>')
    return "\n".join([*out, "</svg></body></html>"])
