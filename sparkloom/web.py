"""A thin HTTP layer over the engine, on the standard library."""

from __future__ import annotations

import json
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlparse

from sparkloom.engine import Engine, NotBuilt
from sparkloom.operators.connect import PRODUCT, WIDEST
from sparkloom.schemas import RecommendConfig

PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>Item graph</title></head><body>
<form action="/map"><input name="seeds" placeholder="titles, separated by commas"><button>Map</button></form></body></html>"""


class BadRequest(ValueError):
    """An argument is missing or out of range."""


def bounded(values: dict, name: str, low: float, high: float, default, kind=int):
    try:
        value = kind(values.get(name, default))
    except (TypeError, ValueError):
        raise BadRequest(f"{name} must be a number") from None
    if not low <= value <= high:
        raise BadRequest(f"{name} must be between {low} and {high}")
    return value


def seeds_of(values: dict) -> list[str]:
    given = values.get("seeds") or []
    found = [s.strip() for s in (given.split(",") if isinstance(given, str) else given) if s.strip()]
    if not found:
        raise BadRequest("seeds are missing")
    return found


def config_of(values: dict) -> RecommendConfig:
    return RecommendConfig(
        hub_beta=bounded(values, "beta", 0, 1, 0.25, float), mmr_lambda=bounded(values, "lambda", 0, 1, 0.7, float), exclude_same_author=bool(values.get("exclude_same_author", False))
    )


def answer(engine: Engine, method: str, path: str, values: dict) -> tuple[int, object]:
    """Status and body of a request; a text body is HTML."""
    parts = [unquote(p) for p in path.strip("/").split("/") if p]
    try:
        if method == "GET" and not parts:
            return 200, PAGE
        if method == "GET" and parts == ["map"]:
            return 200, engine.export_map(seeds_of(values))
        if parts[:1] != ["api"]:
            return 404, {"detail": "not found"}
        if method == "GET" and parts[1:] == ["search"]:
            query = values.get("q", "").strip()
            return 200, {"results": engine.search(query, bounded(values, "limit", 1, 100, 10)) if query else []}
        if method == "POST" and parts[1:] == ["recommend"]:
            return 200, asdict(engine.recommend(seeds_of(values), bounded(values, "n", 1, 200, 20), config_of(values)))
        if method == "POST" and parts[1:] == ["subgraph"]:
            return 200, engine.subgraph(seeds_of(values), bounded(values, "n", 1, 400, 40), config_of(values))
        if method == "GET" and parts[1:2] == ["book"] and len(parts) in (3, 4):
            book = engine.book(parts[2])
            if book is None:
                return 404, {"detail": "unknown item"}
            if parts[3:] == ["neighbors"]:
                return 200, {"neighbors": engine.neighbours(parts[2], bounded(values, "limit", 1, 200, 25))}
            return (200, book) if len(parts) == 3 else (404, {"detail": "not found"})
        if method == "GET" and parts[1:] == ["bridges"]:
            seeds = [s.strip() for s in values.get("seeds", "").split(",") if s.strip()]
            return 200, engine.bridges(seeds, bounded(values, "top_n", 1, 200, 20))
        if method == "GET" and parts[1:] == ["connections"]:
            objective = values.get("objective", PRODUCT)
            if objective not in (PRODUCT, WIDEST):
                raise BadRequest("unknown objective")
            found, unresolved = engine.connect(seeds_of(values), bounded(values, "max_hops", 1, 20, 8), objective, bounded(values, "min_edge_weight", 0, 1, 0.0, float))
            return 200, asdict(found) | {"unresolved": unresolved}
        if method == "GET" and parts[1:] == ["stats"]:
            return 200, engine.stats()
    except BadRequest as problem:
        return 422, {"detail": str(problem)}
    except NotBuilt as problem:
        return 409, {"detail": str(problem)}
    return 404, {"detail": "not found"}


def serve(engine: Engine, port: int = 8000) -> None:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, method: str, values: dict) -> None:
            status, body = answer(engine, method, urlparse(self.path).path, values)
            html = isinstance(body, str)
            raw = (body if html else json.dumps(body, ensure_ascii=False, default=str)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=utf-8" if html else "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:  # noqa: N802
            self._send("GET", {k: v[-1] for k, v in parse_qs(urlparse(self.path).query).items()})

        def do_POST(self) -> None:  # noqa: N802
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                values = json.loads(raw or b"{}")
            except ValueError:
                values = {}
            self._send("POST", values if isinstance(values, dict) else {})

    ThreadingHTTPServer(("127.0.0.1", port), Handler).serve_forever()
