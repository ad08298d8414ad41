import pytest
from pyspark.sql import functions as F

from sparkloom.functions import clean, identity
from sparkloom.functions.fuzzy import lcs, partial_ratio, ratio, weighted_ratio
from sparkloom.operators.seeds import resolve_seed, resolve_seeds, seed_score


@pytest.mark.parametrize(
    "title,key",
    [
        ("Emma (Penguin Classics, no. 3)", "emma"), ("Walden: or, Life in the Woods", "walden"), ("A Tale of Two Cities", "tale of two cities"), ("Götter und Gräber", "gotter und graber"),
        ("Catch-22", "catch 22"), ("Gulliver's Travels", "gullivers travels"), ("Middlemarch - A Study of Provincial Life", "middlemarch"),
        ("Ulysses [1922 text", "ulysses"), (": Nothing before it", "nothing before it"), ("", ""), (None, ""), ("The", ""), ("Nana -- a novel", "nana"), ("An  Ideal,   Husband", "ideal husband"),
    ],
)
def test_title_keys(title, key):
    assert identity.title_key(title) == key


@pytest.mark.parametrize("author,key", [("Austen, Jane", "jane austen"), ("E.T.A. Hoffmann", "eta hoffmann"), ("Émile Zola", "emile zola"), ("", ""), (None, "")])
def test_author_keys(author, key):
    assert identity.author_key(author) == key


def test_work_ids():
    a = identity.work_key("Dune (Dune Chronicles, #1)", ["Herbert, Frank", "Someone"])
    assert a == identity.work_key("Dune", ["Frank Herbert"]) and a.startswith("w-dune-") and len(a) == len("w-dune-") + 16
    assert identity.work_key("!!!", []).count("-") == 1


def test_columns(spark):
    rows = [
        ("0306406152", "9780306406157"), ("0-306-40615-2", "9780306406157"), ("0306406153", None), ("080442957X", "9780804429573"), ("080442957x", "9780804429573"),
        ("978-0-306-40615-7", "9780306406157"), ("9780306406158", None), ("0000000000", None), ("0000000000000", None), ("", None), (None, None), ("12345", None), ("97803064061X7", None),
    ]
    df = spark.createDataFrame(rows, "raw string, want string").withColumn("got", identity.canonical_isbn(F.col("raw")))
    assert [r["raw"] for r in df.collect() if r["got"] != r["want"]] == []
    asins = spark.createDataFrame([("B00ABCDEFG", True), (" b00abcdefg ", True), ("0306406152", False), ("030640615X", False), ("B00", False), (None, False), ("B00ABCDEF!", False)], "a string, want boolean")
    assert all(r["got"] == r["want"] for r in asins.withColumn("got", identity.looks_like_asin(F.col("a"))).collect())
    dirty = spark.createDataFrame([("1965",), ("1965.0",), (" 1965.9\t",), ("",), ("  ",), ("n/a",), (None,), ("1e3",)], "x string")
    got = dirty.select(clean.int_or_null(F.col("x")), clean.double_or_null(F.col("x")), clean.text_or_null(F.col("x"))).collect()
    assert [r[0] for r in got] == [1965, 1965, 1965, None, None, None, None, 1000]
    assert [r[1] for r in got][:3] == [1965.0, 1965.0, 1965.9] and [r[2] for r in got][3:7] == [None, None, "n/a", None]
    both = df.select(identity.normalize_title("raw"), identity.make_work_id(F.lit("Dune"), F.array(F.lit("Frank Herbert")))).first()
    assert both[0] == "0306406152" and both[1] == identity.work_key("Dune", ["Frank Herbert"])


def test_ratios():
    assert lcs("", "abc") == 0 and lcs("abcbdab", "bdcaba") == 4
    assert ratio("abcd", "abcd") == 100 and partial_ratio("atomic", "atomic habits") == 100
    assert weighted_ratio("atomic habits", "atomic") == pytest.approx(90)
    assert weighted_ratio("", "x") == 0 and weighted_ratio("dune herbert", "herbert dune") == pytest.approx(95)


CANDIDATES = [("w1", "Dune (Dune Chronicles, #1)", ["Frank Herbert"]), ("w2", "Dune Messiah", ["Frank Herbert"]), ("w3", "Hyperion", ["Dan Simmons"]), ("w4", "Foundation", ["Isaac Asimov"]), ("w5", "Harry Potter and the Philosopher's Stone", ["J.K. Rowling"])]


@pytest.mark.parametrize("query,want", [("Dune", "w1"), ("dune herbert", "w1"), ("foundation asimov", "w4"), ("foundaton", "w4"), ("harry potter", "w5"), ("dune messiah", "w2"), ("zzzz qqqq", None)])
def test_resolve(query, want):
    found = resolve_seed(query, CANDIDATES)
    assert found.work_id == want and found.resolved == (want is not None)


def test_ties_go_to_the_callers_order_and_are_told():
    same = [("z", "Dune - The Official Comic Book", ["A"]), ("a", "Dune", ["B"])]
    found = resolve_seed("Dune", same)
    assert found.work_id == "z" and found.alternatives == (("z", "Dune - The Official Comic Book — A"), ("a", "Dune — B"))
    assert resolve_seed("x", []).work_id is None
    assert seed_score("jo", "Other", ["Jo"]) == weighted_ratio("jo", "other") / 100  # two letters name nobody


def test_tiers(spark):
    books = spark.createDataFrame([(w, t, identity.title_key(t), a, n) for (w, t, a), n in zip(CANDIDATES, [9, 8, 7, None, 5], strict=True)], "work_id string, title string, title_norm string, authors array<string>, ratings_count long")
    matches, unresolved = resolve_seeds(["Dune", "hyperion xqz", "foundaton", "qqqq wwww"], books)
    assert [m.work_id for m in matches] == ["w1", "w3", "w4"] and unresolved == ["qqqq wwww"]
