"""The whole engine over one store: ingest, build, recommend, bridges, connect, stats, maps."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import centrality, community, fuse, graph, mapview, rank, refs
from sparkloom.operators import connect as joining
from sparkloom.operators.seeds import resolve_seeds
from sparkloom.operators.store import Store, search_titles
from sparkloom.schemas import GraphConfig, LayoutConfig, RecommendConfig
from sparkloom.sources.enrich import EnrichmentSource, subject_edges

#: Weight floor of the comparison's second variant.
COMPARE_FLOOR = 0.15
#: Settings of map drawings: their subgraphs are dense, so they get more room and steps.
MAP_VIEW = LayoutConfig(iterations=500, scaling_ratio=14.0)
#: Seed sets of a route report that names none, and seeds in each.
PROBES, PROBE_SEEDS = 3, 2


class NotBuilt(RuntimeError):
    """The store has no graph, or no communities, yet."""


@dataclass
class Engine:
    spark: SparkSession
    root: str
    read_only: bool = False

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.root, self.read_only)

    # -- ingest and build -------------------------------------------------

    def ingest(self, source) -> dict[str, int]:
        """Upsert a source's books and edges, resolve what can be resolved, and note the progress.

        Running it again with the same dump changes nothing."""
        books, edges = source.books(self.spark), source.edges(self.spark)
        self.store.add_books(books)
        self.store.add_edges(edges)
        resolved, dropped = refs.resolve_refs(self.store.table("edges_raw"), self.store.table("aliases"), self.store.table("books"))
        lost = dropped.first()["dropped"]
        self.store.replace("edges_raw", resolved)
        n_books, n_edges = books.count(), edges.count()
        self.store.mark_ingest(source.name, getattr(source, "path", ""), n_books, n_books, n_edges)
        return {"books": n_books, "edges": n_edges, "unresolved": lost}

    def enrich(self, source: EnrichmentSource, limit: int | None = None) -> None:
        self.store.replace("books", source.enrich(self.store.table("books"), limit))

    def add_subject_edges(self, min_shared: int = 2, max_subject_size: int = 200) -> None:
        self.store.add_edges(subject_edges(self.store.table("books"), min_shared, max_subject_size))

    def build(self, config: GraphConfig = GraphConfig(), communities: bool = True, betweenness: bool = False, resolution: float = 1.0, k_samples: int = 500) -> dict[str, int]:
        """Fuse, measure, find and label communities; rewrites the graph's tables."""
        self.store.replace("edges_fused", fuse.fuse(self.store.table("edges_raw"), config, self.store.table("books")))
        fused = self.fused()
        if fused.isEmpty():
            raise NotBuilt("no edge is left at these settings")
        adj = graph.adjacency(fused)
        metrics = graph.degrees(adj).withColumnRenamed("node", "work_id")
        labels = community.detect_communities(fused, resolution) if communities else self.spark.createDataFrame([], "node string, community int")
        between = centrality.betweenness(adj, k_samples) if betweenness else self.spark.createDataFrame([], "node string, betweenness double")
        metrics = metrics.join(labels.withColumnRenamed("node", "work_id"), "work_id", "left").join(between.withColumnRenamed("node", "work_id"), "work_id", "left")
        self.store.replace("node_metrics", metrics)
        books = self.store.table("books").select(F.col("work_id").alias("node"), "title", "subjects")
        found = self.labels()
        members = found.join(books, "node", "left").select("community", F.coalesce("title", "node").alias("title"), F.coalesce("subjects", F.array().cast("array<string>")).alias("subjects"))
        self.store.replace("communities", community.label_communities(members).join(community.community_sizes(found), "community"))
        return graph.graph_counts(fused).first().asDict()

    # -- stored tables ----------------------------------------------------

    def books(self) -> DataFrame:
        return self.store.table("books")

    def fused(self) -> DataFrame:
        return self.store.table("edges_fused")

    def labels(self) -> DataFrame:
        return self.store.table("node_metrics").where("community is not null").select(F.col("work_id").alias("node"), "community")

    def _graph(self) -> DataFrame:
        fused = self.fused()
        if fused.isEmpty():
            raise NotBuilt("the graph is empty: build it first")
        return fused

    # -- questions --------------------------------------------------------

    def search(self, query: str, limit: int = 20) -> list[dict]:
        return [r.asDict() for r in search_titles(self.books(), query, limit).select("work_id", "title", "authors", "year", "ratings_count").collect()]

    def recommend(self, seeds: Sequence[str], n: int = 20, config: RecommendConfig = RecommendConfig()) -> rank.RecommendResult:
        started = time.time()
        found = rank.recommend(seeds, self.books(), self._graph(), n, config, self.labels())
        return replace(found, timings={"seconds": time.time() - started})

    def bridges(self, seeds: Sequence[str] = (), top_n: int = 20) -> dict:
        """Items between communities, of the seeds' communities if seeds are given."""
        labels = self.labels()
        if labels.isEmpty():
            raise NotBuilt("there are no communities: build the graph first")
        matches, unresolved = resolve_seeds(list(seeds), self.books()) if seeds else ([], [])
        ids = [m.work_id for m in matches]
        touching = sorted({r["community"] for r in labels.where(F.col("node").isin(*ids or [""])).collect()})
        found = community.bridges(graph.adjacency(self._graph()), labels, top_n, touching)
        named = found.join(self.books().select(F.col("work_id").alias("node"), "title", "authors"), "node", "left")
        names = {r["community"]: r["label"] for r in self.store.table("communities").collect()}
        rows = [
            {"work_id": r["node"], "title": r["title"] or r["node"], "authors": list(r["authors"] or ()), "score": r["score"], "communities": list(r["communities"]), "community_labels": [names.get(c, "") for c in r["communities"]]}
            for r in named.orderBy(F.desc("score"), "node").collect()
        ]
        return {"seed_communities": touching, "seed_titles": [m.title for m in matches], "unresolved": unresolved, "bridges": rows}

    def connect(self, seeds: Sequence[str], max_hops: int = joining.MAX_HOPS, objective: str = joining.PRODUCT, min_edge_weight: float = 0.0) -> tuple[joining.Connections, list[str]]:
        """The structure that joins the seeds, with titles, and the seeds that resolved to nothing."""
        matches, unresolved = resolve_seeds(list(seeds), self.books())
        found = joining.connect(graph.adjacency(self._graph()), [m.work_id for m in matches], max_hops, objective, min_edge_weight)
        ids = list(dict.fromkeys([*found.terminals, *found.missing, *found.nodes]))
        rows = self.books().where(F.col("work_id").isin(*ids or [""])).select("work_id", "title").collect()
        return replace(found, titles={i: i for i in ids} | {r["work_id"]: r["title"] for r in rows}), unresolved

    def compare(self, seeds: Sequence[str], max_hops: int = joining.MAX_HOPS, floor: float = COMPARE_FLOOR) -> dict[str, joining.Connections]:
        """The same seeds by product, by product above a floor, and by the widest route."""
        return {
            "product": self.connect(seeds, max_hops)[0],
            "product_floor": self.connect(seeds, max_hops, min_edge_weight=floor)[0],
            "widest": self.connect(seeds, max_hops, joining.WIDEST)[0],
        }

    def probes(self) -> list[list[str]]:
        """Seed sets across communities: the most rated titles of the largest ones, paired in turn."""
        rated = self.labels().join(self.books().select(F.col("work_id").alias("node"), "title", "ratings_count"), "node").where("title is not null")
        sizes = self.store.table("communities").select("community", "size")
        best = rated.groupBy("community").agg(F.max_by("title", F.struct(F.coalesce("ratings_count", F.lit(-1)), "node")).alias("title"))
        top = [r["title"] for r in best.join(sizes, "community").orderBy(F.desc("size"), "community").limit(PROBES + PROBE_SEEDS - 1).collect()]
        return [top[i : i + PROBE_SEEDS] for i in range(len(top) - PROBE_SEEDS + 1)]

    def route_report(self, sets: Sequence[Sequence[str]] = (), max_hops: int = joining.MAX_HOPS, floor: float = COMPARE_FLOOR) -> str:
        """Markdown of the three variants for each seed set (without any: ``probes``), with times."""
        out = ["# Routes", ""]
        for seeds in sets or self.probes():
            if len(seeds) < 2:
                raise ValueError(f"a seed set needs two titles: {', '.join(seeds)}")
            out += [f"## {', '.join(seeds)}", "", "| variant | route | hops | strength | weakest | seconds |", "|-|-|-|-|-|-|"]
            for name, args in {"product": {}, "product_floor": {"min_edge_weight": floor}, "widest": {"objective": joining.WIDEST}}.items():
                started = time.time()
                found, _ = self.connect(seeds, max_hops, **args)
                took = time.time() - started
                for leg in found.legs:
                    out.append(f"| {name} | {' → '.join(found.titles.get(x, x) for x in leg.path)} | {leg.hops} | {leg.strength:.4f} | {leg.bottleneck:.4f} | {took:.1f} |")
                if not found.legs:
                    out.append(f"| {name} | none | | | | {took:.1f} |")
            out.append("")
        return "\n".join(out)

    def subgraph(self, seeds: Sequence[str], n: int = 40, config: RecommendConfig = RecommendConfig(), view: LayoutConfig = MAP_VIEW) -> dict:
        """What a map shows; the items that join the seeds are shown whatever their rank."""
        found = self.recommend(seeds, n, config)
        ids = [m.work_id for m in found.matches]
        joined = joining.connect(graph.adjacency(self._graph()), ids).connectors if len({*ids}) > 1 else ()
        return mapview.payload(self._graph(), self.books(), ids, joined, {r.work_id: r.score for r in found.recommendations}, self.labels(), view)

    def export_map(self, seeds: Sequence[str], n: int = 40) -> str:
        return mapview.render_svg(self.subgraph(seeds, n))

    def neighbours(self, work_id: str, limit: int = 25) -> list[dict]:
        near = graph.neighbours(self.fused(), work_id, limit)
        named = near.join(self.books().select(F.col("work_id").alias("neighbour"), "title"), "neighbour", "left")
        return [r.asDict() for r in named.orderBy(F.desc("weight"), "neighbour").collect()]

    def lookup(self, id_type: str, id_value: str) -> str | None:
        """The work that an outer id is an alias of."""
        row = self.store.table("aliases").where((F.col("id_type") == id_type) & (F.col("id_value") == id_value)).first()
        return row["work_id"] if row else None

    def networkx(self):
        """The fused graph for networkx, where that is installed; for graphs that fit one process."""
        import networkx

        found = networkx.Graph()
        for r in self.fused().select("src", "dst", "weight").toLocalIterator():
            found.add_edge(r["src"], r["dst"], weight=r["weight"])
        return found

    def book(self, work_id: str) -> dict | None:
        row = self.books().where(F.col("work_id") == work_id).first()
        return row.asDict() if row else None

    def stats(self) -> dict:
        """Rows of all tables, degree statistics and the ten largest communities."""
        degree = graph.degree_stats(graph.adjacency(self.fused())).first().asDict() if self.store.exists("edges_fused") else {}
        top = self.store.table("communities").orderBy(F.desc("size"), "community").limit(10).collect()
        return {"counts": {r["table"]: r["n"] for r in self.store.counts().collect()}, "degree": degree, "communities": [r.asDict() for r in top]}


def as_text(found: rank.RecommendResult) -> str:
    """Recommendations as lines, each with the explanations that speak for it."""
    out = [f"not found: {x}" for x in found.unresolved]
    for i, r in enumerate(found.recommendations, 1):
        out.append(f"{i}. {r.title}" + (f" ({', '.join(r.authors)})" if r.authors else ""))
        out += [f"   {e['text']}" for e in r.explanations]
    return "\n".join(out)


def as_json(value: object) -> str:
    """Results as JSON text."""
    return json.dumps(asdict(value) if hasattr(value, "__dataclass_fields__") else value, ensure_ascii=False, default=str)
