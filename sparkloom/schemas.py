"""Tables of the item graph, its enumerations and settings."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Edge kinds with the trust of each.
KIND_ALPHA = {"gr_similar": 0.6, "az_also_bought": 0.3, "az_also_viewed": 0.1, "ol_subject": 0.05}
#: Sources with the alias type that their references resolve through.
REF_ID_TYPE = {
    "goodreads_ucsd": "goodreads_id",
    "amazon_meta": "asin",
    "amazon_reviews_2023": "asin",
    "openlibrary": "openlibrary_id",
    "demo": "demo_id",
}

BOOKS = (
    "work_id string, title string, title_norm string, authors array<string>, year int, isbn13 string, asin string, goodreads_id string, "
    "openlibrary_id string, series string, avg_rating double, ratings_count long, subjects array<string>"
)
EDGES_RAW = "src string, dst string, kind string, rank int, source string"
EDGES_FUSED = "src string, dst string, weight double, dir_asym double, kinds array<string>"
ALIASES = "id_type string, id_value string, work_id string"
NODE_METRICS = "work_id string, degree int, weighted_degree double, community int, betweenness double"
COMMUNITIES = "community int, label string, size int"
INGEST_STATE = "source string, artifact string, rows_done long, books_added long, edges_added long, completed boolean, updated_at timestamp"

#: Keys of the stored tables.
KEYS = {
    "books": ["work_id"],
    "edges_raw": ["src", "dst", "kind", "source"],
    "edges_fused": ["src", "dst"],
    "aliases": ["id_type", "id_value"],
    "node_metrics": ["work_id"],
    "communities": ["community"],
    "ingest_state": ["source", "artifact"],
}
TABLES = {
    "books": BOOKS, "edges_raw": EDGES_RAW, "edges_fused": EDGES_FUSED, "aliases": ALIASES,
    "node_metrics": NODE_METRICS, "communities": COMMUNITIES, "ingest_state": INGEST_STATE,
}


def columns(ddl: str) -> list[tuple[str, str]]:
    """Names and types of one of the tables above."""
    return [tuple(c.split(" ", 1)) for c in ddl.split(", ")]


@dataclass(frozen=True)
class GraphConfig:
    """How raw lists become the fused graph. A falsy ``min_ratings`` means no filter."""

    source_alpha: dict[str, float] = field(default_factory=lambda: dict(KIND_ALPHA))
    min_weight: float = 0.05
    drop_leaves: bool = False
    max_rank: int = 50
    min_ratings: int | None = None


@dataclass(frozen=True)
class RecommendConfig:
    """Settings of the ranking pipeline."""

    ppr_alpha: float = 0.15
    ppr_tol: float = 1e-8
    ppr_max_iter: int = 200
    hub_beta: float = 0.25
    mmr_lambda: float = 0.7
    exclude_same_author: bool = False
    max_explanations: int = 3


@dataclass(frozen=True)
class LayoutConfig:
    iterations: int = 200
    seed: int = 1917
    scaling_ratio: float = 2.0
    gravity: float = 1.0
    max_nodes: int = 800


def ref(source: str, raw_id: str) -> str:
    """A namespaced reference to an id of a source."""
    if not raw_id:
        raise ValueError("a reference needs an id")
    return f"{source}:{raw_id}"


def split_ref(text: str) -> tuple[str, str]:
    """Source and id of a reference, split at its first colon."""
    source, _, raw_id = text.partition(":")
    if not raw_id:
        raise ValueError(f"not a reference: {text!r}")
    return source, raw_id
