import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sparkloom.llm import sharding
from tests.llm import helpers


def test_two_way_differencing_is_the_classic_one():
    # 8, 7, 6, 5, 4 differences to 2
    tuples = np.array([[0, x] for x in (8, 7, 6, 5, 4)])
    places, sums = sharding.difference(tuples)
    assert sorted(sums.tolist()) == [14, 16]
    back = [sum(t[j] for t, p in zip(tuples, places, strict=True) for j in range(2) if p[j] == k) for k in range(2)]
    assert back == sums.tolist()


@pytest.mark.parametrize("n,k", [(0, 3), (1, 3), (7, 4), (500, 40)])
def test_places_give_the_sums(n, k):
    rng = np.random.default_rng(n)
    tuples = np.zeros((n, k), np.int64)
    tuples[:, -1] = rng.integers(1, 10_000, n)
    places, sums = sharding.difference(tuples)
    back = np.zeros(k, np.int64)
    np.add.at(back, places.reshape(-1), tuples.reshape(-1))
    assert back.tolist() == sums.tolist()
    if n == 500:
        assert sums.max() - sums.min() < 100


def test_batches_stay_even():
    sizes = np.random.default_rng(3).integers(20, 5000, 1000)
    own, sums = sharding._differenced_batches(sizes, 10, 64)
    assert np.bincount(own, sizes, 10).tolist() == sums.tolist()
    assert sums.max() - sums.min() < 200


def plain_differencing(sizes, k):
    """The method on lists of (sums, contents), without permutations."""
    parts = [[(0, ())] * (k - 1) + [(s, (i,))] for i, s in enumerate(sizes)]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1][0] - p[0][0])
        a, b = parts.pop(), parts.pop()
        parts.append(sorted(((x + y, c + d) for (x, c), (y, d) in zip(a, reversed(b), strict=True)), key=lambda t: t[0]))
    return sorted(s for s, _ in parts[0])


def best_spread(sizes, k):
    """The least difference of largest and smallest sum over all ways to share the sizes."""
    best = sum(sizes)
    for way in itertools.product(range(k), repeat=len(sizes)):
        sums = np.bincount(way, sizes, k)
        best = min(best, sums.max() - sums.min())
    return best


@pytest.mark.parametrize("seed", range(6))
def test_against_plain_differencing_and_all_partitions(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.permutation(np.arange(1, 400))[:8]  # no ties
    for k in (2, 3):
        own, sums = sharding._differenced_batches(np.sort(sizes)[::-1], k, 100)
        assert sorted(sums.tolist()) == plain_differencing(np.sort(sizes)[::-1].tolist(), k)
        assert best_spread(sizes, k) <= sums.max() - sums.min() <= best_spread(sizes, k) + sizes.max() / 2


def test_rounds_of_merges_and_any_width(spark):
    rng = np.random.default_rng(9)
    rows = [(f"g{i}", int(n)) for i, n in enumerate(rng.integers(20, 9000, 3000))]
    groups = spark.createDataFrame(rows, "group_key string, bytes long")
    got = {}
    for width in ("3", "7"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", width)
        got[width] = {r["group_key"]: r["shard"] for r in sharding.assign_groups(groups, 7, batch=50, fan=4).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got["3"] == got["7"] and len(got["3"]) == 3000
    sums = np.bincount([got["3"][k] for k, _ in rows], [n for _, n in rows], 7)
    assert sums.max() - sums.min() < 0.001 * sums.mean()  # fifty groups at once, three rounds


def test_documents(spark):
    docs = helpers.documents(spark)
    got = sharding.shard_documents(docs, 5).collect()
    assert len(got) == docs.count() and {r["law"] for r in got} == {"bytes"}
    slots, shard_of = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        shard_of[r["text_crc32"], r["size"]].add(r["shard"])
        assert r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shard_of.values())
    sizes = sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got)
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert sizes == want


def test_balance_with_a_third_of_copies_of_small_texts(spark):
    rows = [(i, "same text" if i % 3 == 0 else "t" * (i * 37 % 900)) for i in range(600)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4).groupBy("shard").sum("size").collect()
    sums = [r[1] for r in got]
    assert len(sums) == 4 and max(sums) - min(sums) < 900


def test_empty(spark):
    assert sharding.shard_documents(helpers.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_groups(spark.createDataFrame([], "group_key string, bytes long"), 0)
