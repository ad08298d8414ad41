"""Command line over the engine: python -m sparkloom.cli --root DIR COMMAND ..."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from sparkloom.engine import COMPARE_FLOOR, Engine, NotBuilt, as_json, as_text
from sparkloom.schemas import GraphConfig, RecommendConfig
from sparkloom.sources.dumps import BlockDump, CorpusFile, ProductDump, WorksDump
from sparkloom.sources.enrich import EnrichmentSource


def split_seeds(text: str) -> list[str]:
    return [s for s in map(str.strip, text.split(",")) if s]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparkloom")
    top.add_argument("--root", required=True, help="folder of the store's tables")
    commands = top.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest")
    ingest.add_argument("kind", choices=["works", "blocks", "products", "corpus", "enrich"])
    ingest.add_argument("path", nargs="?")
    ingest.add_argument("--authors")
    ingest.add_argument("--limit", type=int)
    build = commands.add_parser("build")
    build.add_argument("--min-weight", type=float, default=0.05)
    build.add_argument("--max-rank", type=int, default=50)
    build.add_argument("--min-ratings", type=int)
    build.add_argument("--drop-leaves", action="store_true")
    build.add_argument("--no-communities", action="store_true")
    build.add_argument("--betweenness", action="store_true")
    for name in ("recommend", "map", "bridges", "connect", "route-report"):
        command = commands.add_parser(name)
        command.add_argument("--seeds", default="", help="titles, separated by commas")
        command.add_argument("-n", type=int, default=20)
        command.add_argument("--out")
        command.add_argument("--beta", type=float, default=0.25)
        command.add_argument("--lambda", dest="lambda_", type=float, default=0.7)
        command.add_argument("--exclude-same-author", action="store_true")
        command.add_argument("--objective", default="product")
        command.add_argument("--min-edge-weight", type=float, default=0.0)
        command.add_argument("--max-hops", type=int, default=8)
        command.add_argument("--compare", action="store_true")
        command.add_argument("--floor", type=float, default=COMPARE_FLOOR, help="weight floor of the comparison's second variant")
        command.add_argument("--text", action="store_true", help="lines with explanations instead of JSON")
    commands.add_parser("stats")
    web = commands.add_parser("web")
    web.add_argument("--port", type=int, default=8000)
    return top


def source(args: argparse.Namespace):
    makers = {"works": lambda: WorksDump(args.path, args.authors), "blocks": lambda: BlockDump(args.path), "products": lambda: ProductDump(args.path), "corpus": lambda: CorpusFile(args.path)}
    return makers[args.kind]()


def run(args: argparse.Namespace, engine: Engine) -> str:
    seeds = split_seeds(getattr(args, "seeds", ""))
    config = RecommendConfig(hub_beta=args.beta, mmr_lambda=args.lambda_, exclude_same_author=args.exclude_same_author) if hasattr(args, "beta") else None
    if args.command == "ingest" and args.kind == "enrich":
        engine.enrich(EnrichmentSource(), args.limit)
        return ""
    if args.command == "ingest":
        return as_json(engine.ingest(source(args)))
    if args.command == "build":
        return as_json(engine.build(GraphConfig(min_weight=args.min_weight, max_rank=args.max_rank, min_ratings=args.min_ratings, drop_leaves=args.drop_leaves), not args.no_communities, args.betweenness))
    if args.command == "recommend":
        found = engine.recommend(seeds, args.n, config)
        return as_text(found) if args.text else as_json(found)
    if args.command == "map":
        return engine.export_map(seeds, args.n)
    if args.command == "bridges":
        return as_json(engine.bridges(seeds, args.n))
    if args.command == "connect":
        if args.compare:
            return "\n".join(as_json(x) for x in engine.compare(seeds, args.max_hops, args.floor).values())
        return as_json(engine.connect(seeds, args.max_hops, args.objective, args.min_edge_weight)[0])
    if args.command == "route-report":
        return engine.route_report([split_seeds(s) for s in args.seeds.split(";") if s.strip()], args.max_hops, args.floor)
    if args.command == "web":
        from sparkloom.web import serve

        serve(engine, args.port)
        return ""
    return as_json(engine.stats())


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("sparkloom").getOrCreate()
    try:
        out = run(args, Engine(spark, args.root, read_only=args.command not in ("ingest", "build")))
    except (NotBuilt, FileNotFoundError, ValueError) as problem:
        print(f"error: {problem}", file=sys.stderr)
        return 1
    if getattr(args, "out", None):
        Path(args.out).write_text(out)
    elif out:
        print(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
