import random

import pytest

from sparkloom.llm import near_dup
from tests.llm import helpers


def brute(rows, words=4):
    """Components by comparing all pairs of sets."""
    sets = {}
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def check(spark, rows, words=4):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(df, words).collect()}
    assert got == brute(rows, words)


def edited(base, n, rng):
    words = base.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("seed", range(2))
def test_groups_chains_and_shared_passages(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = " ".join(rng.choices(vocabulary, k=rng.choice([3, 4, 12, 60, 150])))
        rows += [(0, edited(base, rng.choice([0, 0, 1, 2, 3]), rng)) for _ in range(rng.choice([1, 2, 9]))]
    chain = " ".join(f"c{i}" for i in range(100))
    for _ in range(15):  # each near the last, far from the first
        chain = edited(chain, 1, rng)
        rows.append((0, chain))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(0, passage + " " + " ".join(rng.choices(vocabulary, k=50))) for _ in range(25)]
    rng.shuffle(rows)
    check(spark, [(i * 3, t) for i, (_, t) in enumerate(rows)])


def test_blocks_of_a_bucket(spark, monkeypatch):
    """A hub and copies that are near it but not near each other, over several blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = random.Random(5)
    base = " ".join(f"h{i}" for i in range(150))
    check(spark, [(i, edited(base, rng.randint(2, 6), rng)) for i in range(60)])


def test_rows_of_a_hot_bucket_grow_with_its_strangers_only(spark):
    n = 20 * near_dup.BLOCK
    members = spark.range(n).selectExpr("7L as key", "id as rep", "case when id < 3 then id + 1000000 else 5L end as comp")
    placed = near_dup.placed_members(members)
    blocks = 20
    assert placed.count() == (n - 3) + 3 * (blocks + 1)
    groups = placed.groupBy("key", "i", "j").count().agg({"count": "max"}).first()[0]
    assert groups < 2 * near_dup.BLOCK
    # every pair that may be linked meets in one group: strangers with all
    meet = placed.alias("x").join(placed.alias("y"), ["key", "i", "j"]).where("x.rep < y.rep and x.comp != y.comp and (x.own != y.own or i = j)")
    assert meet.select("x.rep", "y.rep").distinct().count() == meet.count() == 3 * (n - 3) + 3


def test_rows_of_one_doc_id_are_documents_of_their_own(spark):
    base = " ".join(f"r{i}" for i in range(80))
    rows = [(1, base), (1, "quite another text of this id"), (1, None), (2, base), (2, "something else that only two has"), (3, base), (3, base), (0, "zero has this"), (0, "zero has this")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(near_dup.near_duplicates(docs).collect(), key=str)
    assert [(r["doc_id"], r["component_id"]) for r in got if r["n_shingles"] > 50] == [(1, 1), (2, 1), (3, 1), (3, 1)]
    left = sorted(near_dup.one_of_each(docs).collect(), key=str)
    assert sorted(map(tuple, left), key=str) == sorted([(0, "zero has this"), (1, base), (1, "quite another text of this id"), (1, None), (2, "something else that only two has")], key=str)


def test_threshold_is_exact(spark):
    # sets of 9 and 10 shingles sharing 8 or 9: 8/11 and 9/10; and 80 of 100
    a = [f"t{i}" for i in range(93)]
    rows = [(1, " ".join(a)), (2, " ".join([*a[:83], *[f"z{i}" for i in range(10)]])), (3, " ".join(a[:82]))]
    check(spark, rows)
    check(spark, [(5, "a b c d"), (6, "A  b\tC\nd"), (7, "a b c"), (8, "a b c"), (9, "a\x0bb\x0cc"), (10, "a\x1cb c")])


def test_edges(spark):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(helpers.documents(spark), 4).collect()}
    assert {(0, 0, 0, True), (1, 0, 1, True), (2, 0, 2, True), (7, 97, 6, False), (8, 97, 6, False), (9, 97, 6, False), (21, 2, 21, True)} <= got
    assert (None, 0, None, True) in got or any(d is None and c is None and k for d, _, c, k in got)
    assert near_dup.near_duplicates(helpers.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        near_dup.near_duplicates(helpers.empty(spark), part=50)


def test_one_of_each(spark):
    docs = helpers.documents(spark)
    left = near_dup.one_of_each(docs)
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 5, 6, 10, 11, 21] and ids.count(None) == 1


def test_star_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    got = {r["node"]: r["component"] for r in near_dup.star_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    assert got == {n: root(n) for e in edges if e[0] != e[1] for n in e}


def test_no_links(spark):
    assert near_dup.star_components(spark.createDataFrame([], "a long, b long")).count() == 0
