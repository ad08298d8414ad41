from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.sources import star, together


def brute(lines, most):
    groups = defaultdict(set)
    for g, o, i in lines:
        if None not in (g, o, i):
            groups[g].add((o, i))
    n = defaultdict(Counter)
    for held in groups.values():
        for o, i in held:
            n[str(i)].update(str(j) for p, j in held if p != o and j != i)
    return {(i, j, r) for i, c in n.items() for r, (j, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:most], 1)}


def drawn(seed, n=3000):
    r = np.random.default_rng(seed)
    items = np.concatenate([r.integers(-12, 120, n // 2), r.integers(900, 11_000, n - n // 2)])
    rows = list(zip((r.zipf(1.5, n) % 60).tolist(), r.integers(0, 300, n).tolist(), items.tolist(), strict=True))
    return rows + rows[:50] + [(None, 1, 2), (1, None, 2), (1, 2, None)]


@pytest.mark.parametrize("together_rows", [7, 1 << 20])
def test_most_together(spark, monkeypatch, together_rows):
    monkeypatch.setattr(together, "TOGETHER", together_rows)
    rows = drawn(3, 600 if together_rows == 7 else 3000)
    found = together.most_together(spark.createDataFrame(rows, "grp long, own long, item long"), 9)
    assert sorted(map(tuple, found.collect())) == sorted(brute(rows, 9))


def test_codes_sort_as_texts():
    keys = np.array([0, -1, -10, 1, 10, 100, 2, 19, 9, -9, 123456789012345, 99999999999999999, -1234567890123456])
    codes = together.coded(keys, 17)
    assert [str(k) for k in keys[np.argsort(codes)]] == sorted(map(str, keys.tolist()))
    assert together.decoded(codes, 17).tolist() == keys.tolist()


def test_pairs_under_way_follow_the_lines(spark):
    """A customer with many lines has the square of them in pairs; no pass may hold them all."""
    lines = spark.range(200).select(F.lit(1).cast("long").alias("grp"), F.col("id").alias("own"), (F.col("id") * 7).alias("item"))
    turns, make = [], together.partners

    def spied(held, width, turn, of):
        arrays = make(held, width, turn, of)
        turns.append(arrays.agg(F.sum(F.octet_length("others"))).first()[0] or 0)
        return arrays

    together.partners = spied
    try:
        assert together.most_together(lines, 3).count() == 600
    finally:
        together.partners = make
    assert sum(turns) == 4 * 200 * 199 and max(turns) <= 200 * together.LINE_BYTES * 4 and len(turns) > 10


def test_long_keys_and_no_lines(spark, tmp_path):
    rows = [(1, 1, 10**17 + 1), (1, 2, 10**17 + 2), (2, 3, 5), (2, 3, 6)]
    lines = spark.createDataFrame(rows, "grp long, own long, item long")
    assert together.most_together(lines, 5) is None
    assert {(r["src"], r["dst"], r["rank"]) for r in star._listed(lines, "k", "s").collect()} == brute(rows, 5)
    assert together.most_together(lines.limit(0), 5).count() == 0
