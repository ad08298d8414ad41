import json

import pytest
from pyspark.sql import functions as F

from sparkloom import cli, schemas
from sparkloom.engine import Engine, NotBuilt, as_json, as_text
from sparkloom.operators import store
from sparkloom.schemas import GraphConfig
from sparkloom.sources.dumps import CorpusFile
from sparkloom.streaming import ingest
from sparkloom.web import answer

SF = [f"s{i}" for i in range(5)]
LIT = [f"l{i}" for i in range(5)]


def corpus():
    books = [{"id": i, "title": f"Star {n} <saga>", "authors": [f"A{n}"], "year": 1960 + n, "subjects": ["space"]} for n, i in enumerate(SF)]
    books += [{"id": i, "title": f"Manor {n}", "authors": [f"B{n}"], "year": 1800 + n, "subjects": ["romance"]} for n, i in enumerate(LIT)]
    edges = [{"src": a, "similar": [b for b in group if b != a]} for group in (SF, LIT) for a in group]
    return {"books": books, "edges": [*edges, {"src": "s0", "similar": ["l0", "nowhere"], "kind": "az_also_bought"}]}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("engine")
    (root / "corpus.json").write_text(json.dumps(corpus()))
    made = Engine(spark, str(root / "store"))
    with pytest.raises(NotBuilt):
        made.recommend(["Star 1"])
    assert made.ingest(CorpusFile(str(root / "corpus.json"))) == {"books": 10, "edges": 42, "unresolved": 1}
    before = {r["table"]: r["n"] for r in made.store.counts().collect()}
    made.ingest(CorpusFile(str(root / "corpus.json")))
    assert {r["table"]: r["n"] for r in made.store.counts().collect()} == before  # again changes nothing
    with pytest.raises(NotBuilt):
        made.build(GraphConfig(min_weight=99))
    assert made.build(betweenness=True) == {"n_nodes": 10, "n_edges": 21}
    return made


def test_stats(engine):
    got = engine.stats()
    assert got["counts"]["books"] == 10 and got["counts"]["edges_fused"] == 21 and got["degree"]["max"] == 5 and len(got["communities"]) == 2
    assert {c["label"].split(" / ")[0] for c in got["communities"]} <= {"space", "star", "saga", "manor", "romance"}
    between = {r["work_id"]: r["betweenness"] for r in engine.store.table("node_metrics").collect()}
    assert max(between, key=between.get) in ("s0", "l0")


def test_recommend_and_json(engine):
    got = engine.recommend(["Star 1"], 3)
    assert len(got.recommendations) == 3 and {r.work_id for r in got.recommendations} <= {*SF, *LIT} - {"s1"}
    assert json.loads(as_json(got))["matches"][0]["work_id"] == "s1"
    told = [e for r in got.recommendations for e in r.explanations]
    assert all(e["seed_title"].startswith("Star 1") and e["text"].startswith("←") for e in told) and any("directly linked" in e["text"] for e in told)
    assert told[0]["text"] in as_text(got) and len(as_text(got).splitlines()) >= 6


def test_lookups_and_a_store_that_only_reads(engine):
    assert engine.lookup("isbn13", "none") is None  # the corpus has no outer ids
    assert len(list(engine.store.rows("books"))) == 10
    reader = Engine(engine.spark, engine.root, read_only=True)
    assert reader.stats()["counts"]["books"] == 10
    with pytest.raises(PermissionError):
        reader.store.replace("books", reader.books())


def test_connect_and_report(engine):
    found, unresolved = engine.connect(["Star 1", "Manor 1", "qqq zzz"])
    assert found.connectors == ("l0", "s0") and unresolved == ["qqq zzz"] and found.titles["s0"].startswith("Star 0")
    assert set(engine.compare(["Star 1", "Manor 1"])) == {"product", "product_floor", "widest"}
    assert "Star 0" in engine.route_report([["Star 1", "Manor 1"]])


def test_bridges(engine):
    got = engine.bridges(["Star 1"], 5)
    assert {b["work_id"] for b in got["bridges"]} == {"s0", "l0"} and len(got["seed_communities"]) == 1


def test_map_and_payload(engine):
    view = engine.subgraph(["Star 1"], 4)
    assert {n["role"] for n in view["nodes"]} >= {"seed", "recommendation"} and view["edges"]
    page = engine.export_map(["Star 1"], 4)
    assert page.startswith("<!DOCTYPE html>") and "&lt;saga&gt;" in page and "src=" not in page


def test_http(engine):
    ask = lambda path, method="GET", **values: answer(engine, method, path, values)
    assert ask("/")[0] == 200 and ask("/nothing")[0] == 404
    assert [r["work_id"] for r in ask("/api/search", q="manor 2")[1]["results"]] == ["l2"] and ask("/api/search", q=" ")[1] == {"results": []}
    assert ask("/api/recommend", "POST", seeds=["Star 1"], n=2)[0] == 200
    assert ask("/api/recommend", "POST", seeds=["Star 1"], n=201)[0] == 422 and ask("/api/recommend", "POST")[0] == 422 and ask("/api/recommend", "POST", seeds="x", beta=2)[0] == 422
    assert ask("/api/book/s0")[1]["title"].startswith("Star 0") and ask("/api/book/none")[0] == 404
    assert ask("/api/book/s0/neighbors", limit="2")[1]["neighbors"][0]["weight"] > 0 and ask("/api/book/s0/other")[0] == 404
    assert ask("/api/connections", seeds="Star 1,Manor 1", objective="odd")[0] == 422 and ask("/api/connections", seeds="Star 1,Manor 1", max_hops="21")[0] == 422
    assert ask("/api/connections", seeds="Star 1,Manor 1")[1]["skeletons"] and ask("/api/stats")[0] == 200 and ask("/api/bridges", top_n="3")[0] == 200


def test_http_before_the_build(spark, tmp_path):
    empty = Engine(spark, str(tmp_path / "none"))
    assert answer(empty, "GET", "/api/bridges", {})[0] == 409 and answer(empty, "GET", "/api/connections", {"seeds": "a,b"})[0] == 409


def test_command_line(engine, capsys, tmp_path):
    run = lambda *args: cli.run(cli.parser().parse_args(["--root", engine.root, *args]), engine)
    assert json.loads(run("recommend", "--seeds", "Star 1", "-n", "2"))["recommendations"]
    assert json.loads(run("stats"))["counts"]["books"] == 10 and run("map", "--seeds", "Star 1").startswith("<!DOCTYPE")
    assert len(run("connect", "--seeds", "Star 1,Manor 1", "--compare").splitlines()) == 3 and "bridges" in run("bridges")
    assert cli.main(["--root", str(tmp_path / "x"), "connect", "--seeds", "a,b"]) == 1 and "error" in capsys.readouterr().err
    assert cli.split_seeds(" a, ,b,") == ["a", "b"]


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 9), ("b", 3), ("c", 4)], "k string, v int")
    once = store.upserted(old, new, ["k"], [F.asc("v")])
    assert {r["k"]: r["v"] for r in once.collect()} == {"a": 1, "b": 3, "c": 4}
    assert sorted(map(tuple, store.upserted(once, new, ["k"], [F.asc("v")]).collect())) == sorted(map(tuple, once.collect()))


def test_references():
    assert schemas.split_ref(schemas.ref("demo", "a:b")) == ("demo", "a:b")
    for bad in (lambda: schemas.ref("demo", ""), lambda: schemas.split_ref("plain")):
        with pytest.raises(ValueError):
            bad()


def test_stream_to_edges_twice(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:0{i % 6}:00", i % 3, "ab"[i % 2], 1.0, "{}") for i in range(24)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("t"))
    df.select("event_id", "ts", "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "events"))
    made = store.Store(spark, str(tmp_path / "store"))
    for run in ("one", "two"):  # a repeated run upserts the same keys
        ingest.ingest_edges(ingest.read_events(spark, str(tmp_path / "events")), made, str(tmp_path / run)).awaitTermination()
        assert {(r["src"], r["dst"], r["rank"]) for r in made.table("edges_raw").collect()} == {("a", "b", 1), ("b", "a", 1)}
