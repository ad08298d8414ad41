import gzip
import json

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import refs, store
from sparkloom.sources.dumps import BlockDump, CorpusFile, ProductDump, WorksDump
from sparkloom.sources.enrich import EnrichmentSource, parse_edition, publish_year, subject_edges


def works(tmp_path, rows, authors=()):
    path, names = tmp_path / "works.json.gz", tmp_path / "authors.json"
    with gzip.open(path, "wt") as out:
        out.write("\n".join(json.dumps(r) for r in rows) + "\n\n")
    names.write_text("\n".join(json.dumps(a) for a in authors))
    return str(path), str(names)


def book(book_id, title="T", similar=(), **more):
    base = {"book_id": book_id, "title": title, "title_without_series": "", "authors": [], "isbn": "", "isbn13": "", "asin": "", "publication_year": "", "average_rating": "", "ratings_count": "", "series": [], "similar_books": list(similar)}
    return base | more


def edge_set(df):
    return {(r["src"].split(":")[-1], r["dst"].split(":")[-1], r["kind"], r["rank"]) for r in df.collect()}


def test_works(spark, tmp_path):
    rows = [
        book("1", "Long (Series, #1)", ["2", "", "1", "3", "2"], title_without_series="Long", authors=[{"author_id": "9", "role": ""}, {"author_id": "404", "role": ""}, {"author_id": "58", "role": ""}], publication_year="1965.0", average_rating="4.2", ratings_count="100", series=["s1"], isbn13="978"),
        book("2", " Two ", ["77"], ratings_count="n/a"), book("3", "Three", ["1"]), book("4", "", ["1", "2"]),
    ]
    path, names = works(tmp_path, rows, [{"author_id": "58", "name": "Fifty"}, {"author_id": "9", "name": "Nine"}, {"author_id": "8", "name": ""}])
    source = WorksDump(path, names)
    got = {r["work_id"]: r for r in source.books(spark).collect()}
    assert set(got) == {"gr-1", "gr-2", "gr-3"}
    one = got["gr-1"]
    assert (one["title"], one["authors"], one["year"], one["avg_rating"], one["ratings_count"], one["series"]) == ("Long", ["Nine", "Fifty"], 1965, 4.2, 100, "s1")
    assert got["gr-2"]["title"] == "Two" and got["gr-2"]["ratings_count"] is None and got["gr-2"]["isbn13"] is None
    assert edge_set(source.edges(spark)) == {("1", "2", "gr_similar", 1), ("1", "3", "gr_similar", 4), ("2", "77", "gr_similar", 1), ("3", "1", "gr_similar", 1)}
    assert len(edge_set(WorksDump(path, max_rank=1).edges(spark))) == 3
    with pytest.raises(FileNotFoundError):
        WorksDump("/no/such/file")


def test_editions_collapse_and_references_resolve(spark, tmp_path):
    rows = [book("a1", "Dune", ["b1"], work_id="10", ratings_count="5"), book("a2", "Dune!", ["b1", "x"], work_id="10", ratings_count="50"), book("b1", "Other", ["a1", "a2"], work_id="11")]
    source = WorksDump(works(tmp_path, rows)[0])
    books = source.books(spark)
    assert {r["work_id"]: r["goodreads_id"] for r in books.collect()} == {"gr-10": "a2", "gr-11": "b1"}
    aliases = store.aliases_of(source.editions(spark))
    assert {r["id_value"]: r["work_id"] for r in aliases.collect()} == {"a1": "gr-10", "a2": "gr-10", "b1": "gr-11"}
    edges, dropped = refs.resolve_refs(source.edges(spark), aliases, books)
    assert edge_set(edges) == {("gr-10", "gr-11", "gr_similar", 1), ("gr-11", "gr-10", "gr_similar", 1)} and dropped.first()[0] == 1
    again, none = refs.resolve_refs(edges, aliases, books)
    assert edge_set(again) == edge_set(edges) and none.first()[0] == 0


def test_references_that_are_none(spark):
    edges = spark.createDataFrame([("plain", "odd:prefix", "k", 3, "s"), ("demo:w1", "plain", "k", 2, "s"), ("demo:gone", "plain", "k", 1, "s"), ("demo:w1", "demo:w1", "k", 1, "s")], "src string, dst string, kind string, rank int, source string")
    none = spark.createDataFrame([], "id_type string, id_value string, work_id string")
    got, dropped = refs.resolve_refs(edges, none, spark.createDataFrame([("w1",)], "work_id string"))
    assert {(r["src"], r["dst"]) for r in got.collect()} == {("plain", "odd:prefix"), ("w1", "plain")} and dropped.first()[0] == 1


BLOCKS = """# header
Total items: 4

Id:   1
ASIN: 0827229534
  title: Dune: The Graphic Novel
  group: Book
  similar: 5  A1  0827229534  A3
  categories: 2
  reviews: total: 2  downloaded: 2  avg rating: 4.5

Id: 2
ASIN: B2
  title: Movie
  group: DVD
  similar: 1 A1

Id: 3
ASIN: B3
  discontinued product


Id: 4
ASIN: A3
  title: Plain
  group: book
"""


def test_blocks(spark, tmp_path):
    (tmp_path / "meta.txt").write_text(BLOCKS)
    source = BlockDump(str(tmp_path / "meta.txt"))
    got = {r["work_id"]: r for r in source.books(spark).collect()}
    assert set(got) == {"az-0827229534", "az-A3"} and got["az-0827229534"]["title"] == "Dune: The Graphic Novel"
    assert (got["az-0827229534"]["avg_rating"], got["az-0827229534"]["ratings_count"], got["az-A3"]["avg_rating"]) == (4.5, 2, None)
    assert edge_set(source.edges(spark)) == {("0827229534", "A1", "az_also_bought", 1), ("0827229534", "A3", "az_also_bought", 3)}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("blank", ["", "  ", " \t", "  \n "])
def test_blocks_of_any_line_ends_over_any_splits(spark, tmp_path, end, blank):
    records = []
    for i in range(60):
        lines = [f"Id: {i}", f"ASIN: Z{i}", f"  title: Book {i}: part", "  group: Book", f"  similar: 1 Z{i + 1}", f"  reviews: total: {i} avg rating: 3.5"]
        records.append(end.join(lines + ["  discontinued product"] * (i % 10 == 9)))
    (tmp_path / "b.txt").write_bytes((end + blank.replace("\n", end) + end).join(["", *records, ""]).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64", "333", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {r["asin"]: (r["title"], r["ratings_count"]) for r in BlockDump(str(tmp_path / "b.txt")).books(spark).collect()}
            assert got == {f"Z{i}": (f"Book {i}: part", i) for i in range(60) if i % 10 != 9}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_products(spark, tmp_path):
    rows = [
        {"parent_asin": "P1", "title": "One", "author": {"name": "Object Name"}, "average_rating": 4.5, "rating_number": 10, "categories": ["Books", " "], "also_buy": ["P2", "P3", "P1"], "also_view": ["P4"]},
        {"asin": "P2", "title": "Two", "author": "Plain Name", "bought_together": ["P1"]}, {"asin": "P3", "title": "Three", "author": [{"name": "A"}, ["B", [{"name": "C"}]]]}, {"asin": "P5", "title": " "},
    ]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, rows)))
    source = ProductDump(str(tmp_path / "p.jsonl"))
    got = {r["asin"]: r for r in source.books(spark).collect()}
    assert {k: r["authors"] for k, r in got.items()} == {"P1": ["Object Name"], "P2": ["Plain Name"], "P3": ["A", "B", "C"]}
    assert got["P1"]["subjects"] == ["Books"] and got["P1"]["ratings_count"] == 10
    assert edge_set(source.edges(spark)) == {("P1", "P2", "az_also_bought", 1), ("P1", "P3", "az_also_bought", 2), ("P1", "P4", "az_also_viewed", 1), ("P2", "P1", "az_also_bought", 1)}


def test_corpus_file(spark, tmp_path):
    data = {"books": [{"id": "w1", "title": "One", "authors": ["A", ""], "year": 1999, "subjects": ["x"]}, {"id": "", "title": "no"}], "edges": [{"src": "w1", "similar": ["w2", "w1", "", "w3"]}, {"src": "w2", "similar": ["w1"], "kind": "az_also_viewed"}]}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(data))
    source = CorpusFile(str(path))
    assert [(r["work_id"], r["authors"], r["year"]) for r in source.books(spark).collect()] == [("w1", ["A"], 1999)]
    assert edge_set(source.edges(spark)) == {("w1", "w2", "gr_similar", 1), ("w1", "w3", "gr_similar", 4), ("w2", "w1", "az_also_viewed", 1)}
    path.write_text(json.dumps(data | {"edges": [{"src": "w1", "similar": ["w2"], "kind": "typo"}]}))
    with pytest.raises(Exception, match="unknown edge kind"):
        source.edges(spark).collect()


def test_enrichment(spark):
    def transport(url):
        isbn = url.rsplit("/", 1)[-1].removesuffix(".json")
        if isbn == "404":
            return 404, ""
        if isbn == "503":
            return 503, ""
        return 200, json.dumps({"title": "T", "key": "/books/OL1M", "publish_date": "June 1, 1965", "subjects": ["S", " "]})

    rows = [("a", "1", None, [], None, 5), ("b", "2", 1900, ["own"], None, 4), ("c", "404", None, [], None, 3), ("d", "503", None, [], None, 2), ("e", None, None, [], None, 1)]
    books = spark.createDataFrame(rows, "work_id string, isbn13 string, year int, subjects array<string>, openlibrary_id string, ratings_count long")
    source = EnrichmentSource("http://stub", transport, rate=0)
    got = {r["work_id"]: (r["year"], r["subjects"], r["openlibrary_id"]) for r in source.enrich(books).collect()}
    assert got == {"a": (1965, ["S"], "OL1M"), "b": (1900, ["own"], None), "c": (None, [], None), "d": (None, [], None), "e": (None, [], None)}
    assert {r["work_id"]: r["year"] for r in source.enrich(books, limit=0).collect()}["a"] is None
    for f in (source.books, source.edges):
        with pytest.raises(NotImplementedError):
            f(spark)


def test_editions_parse():
    assert publish_year("n.d.") is None and publish_year(None) is None and publish_year("in 2001?") == 2001
    assert parse_edition({"title": " "}) is None and parse_edition([]) is None
    assert parse_edition({"title": "T", "isbn_13": [" ", "978"]})["isbn13"] == "978"
    assert parse_edition({"title": "T"})["work_id"] == "ol-T"


def test_subject_edges(spark):
    rows = [("a", ["x", "y", "x"]), ("b", ["x", "y"]), ("c", ["x"]), ("d", None)]
    books = spark.createDataFrame(rows, "work_id string, subjects array<string>")
    assert edge_set(subject_edges(books)) == {("a", "b", "ol_subject", 1)}
    assert len(edge_set(subject_edges(books, min_shared=1))) == 3
    assert subject_edges(books, min_shared=1, max_subject_size=1).count() == 0
    broad = spark.range(10).select(F.col("id").cast("string").alias("work_id"), F.array(F.lit("all")).alias("subjects"))
    assert subject_edges(broad, 1, 5).count() == 0
