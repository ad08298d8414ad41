import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from sparkloom.llm import mixing
from tests.llm import helpers


def plain_targets(totals, weights):
    """Share, hold at three times the size, share the excess again."""
    left, held = sum(totals.values()), {}
    free = dict(weights)
    while True:
        share = {s: left * w / sum(free.values()) for s, w in free.items()} if free else {}
        over = [s for s, t in share.items() if t > 3 * totals[s]]
        if not over:
            return held | share
        for s in over:
            held[s] = 3 * totals[s]
            left -= held[s]
            del free[s]


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_mix(rows):
    sizes = [words(r[1]) for r in rows]
    totals = Counter()
    for r, n in zip(rows, sizes, strict=True):
        totals[r[3]] += n
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    targets = plain_targets(totals, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    return sizes, totals, targets


@pytest.mark.parametrize("seed", range(3))
def test_against_plain_mix(spark, seed):
    import random

    random.seed(seed)
    rows = [(i, " ".join(["w"] * random.randint(0, 60)), "en", random.choice([None, "a", "b", "B", "zz", "é"] if seed else [None]), 0) for i in range(400)]
    rows += [(1000 + i, "x " * 5, "en", "rare", 0) for i in range(3)]
    sizes, totals, targets = plain_mix(rows)
    got = {r["doc_id"]: r for r in mixing.mix_report(spark.createDataFrame(rows, helpers.SCHEMA)).collect()}
    taken = defaultdict(int)
    for r, n in zip(rows, sizes, strict=True):
        own = got[r[0]]
        assert own["size"] == n and own["source_size"] == totals[r[3]]
        assert math.isclose(own["target"], targets[r[3]], rel_tol=1e-9, abs_tol=1e-9)
        assert own["taken"] == own["copies"] * n and own["taken"] <= 3 * n
        taken[r[3]] += own["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 31, (s, taken[s], t)


def test_rounding_follows_the_hash_order(spark):
    rows = [(i, "w " * 10, "en", s, 0) for i, s in enumerate(["a"] * 30 + ["b"] * 90)]
    got = {r["doc_id"]: r["copies"] for r in mixing.mix_report(spark.createDataFrame(rows, helpers.SCHEMA)).collect()}
    order = sorted(range(30), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    first = [got[i] for i in order]
    assert first == sorted(first, reverse=True)


def test_edge_rows_and_reruns(spark):
    docs = helpers.documents(spark)
    a = sorted(map(tuple, mixing.mix_report(docs).collect()), key=str)
    assert a == sorted(map(tuple, mixing.mix_report(docs).collect()), key=str) and len(a) == docs.count()
    copies = mixing.mix_report(docs).collect()
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in copies)


def test_empty_and_wordless(spark):
    assert mixing.mix_report(helpers.empty(spark)).count() == 0
    none = spark.createDataFrame([(1, None, "en", "a", 0), (2, " ", "en", None, 0)], helpers.SCHEMA)
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix_report(none).collect()] == [(0, 0.0, 0)] * 2


def held_rates(target, cells, theta):
    """Rates of cells (a, b, n) that take ``target`` tokens, by bisection."""
    tilt = [math.exp(theta[a] + theta[b]) for a, b, _ in cells]
    low, high = 0.0, 3 / min(tilt)
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if sum(n * min(3, c * e) for (*_, n), e in zip(cells, tilt, strict=True)) < target else (low, c)
    return [min(3, high * e) for e in tilt]


@pytest.mark.parametrize("seed", range(3))
def test_newton_finds_the_dual_optimum(spark, seed):
    import random

    rng = random.Random(seed)
    sources = []
    for i in range(6):
        cells = [(a, b, float(rng.randint(1, 900))) for a in range(3) for b in (3, 4) if rng.random() < 0.8] or [(0, 3, 5.0)]
        size = sum(n for *_, n in cells)
        sources.append((f"s{i}", size * rng.choice([0.01, 0.5, 1.2, 2.5, 2.97]), cells))
    total = sum(n for *_, cells in sources for *_, n in cells)
    wanted = [0.0] * 5
    goal = sum(t for _, t, _ in sources) / total
    for *_, cells in sources:
        for a, b, n in cells:
            wanted[a] += goal * n
            wanted[b] += goal * n
    df = spark.createDataFrame(sources, "source string, target double, cells array<struct<a:int,b:int,n:double>>")
    theta = mixing.covariate_tilts(df, wanted, total)
    gradient = [0.05 * total * x - w for x, w in zip(theta, wanted, strict=True)]
    for _, target, cells in sources:
        found = held_rates(target, cells, theta)
        assert math.isclose(sum(r * n for r, (*_, n) in zip(found, cells, strict=True)), target, rel_tol=1e-9)
        for r, (a, b, n) in zip(found, cells, strict=True):
            gradient[a] += r * n
            gradient[b] += r * n
    # a zero gradient of a convex function is its minimum
    assert max(map(abs, gradient)) < 1e-6 * total and max(map(abs, theta)) > 1e-3
    got = {r["source"]: [x["w"] / x["n"] for x in r["tilted"]] for r in mixing.tilted_cells(df, theta).collect()}
    for name, target, cells in sources:
        assert got[name] == pytest.approx(held_rates(target, cells, theta), rel=1e-9)


def test_covariates_move_towards_the_corpus(spark):
    """Sources differ in language; weights alone would change the languages' shares more."""
    rows = [(i, "w " * (10 + i % 50), "de" if i % 10 < (8 if i % 2 else 2) else "en", "ab"[i % 2], 0) for i in range(800)]
    plan = mixing.copy_plan(mixing.sized(spark.createDataFrame(rows, helpers.SCHEMA))).collect()
    by = {(r["source"], r["lang"]): r["rate"] for r in plan}
    assert by["a", "de"] != pytest.approx(by["a", "en"], rel=1e-3) and all(0 < r["rate"] <= 3 for r in plan)


def test_lone_and_wordless_sources(spark):
    rows = [(1, "w " * 1000, "en", "a", 0), (2, "w", "en", "b", 0), (3, None, None, "c", None), (4, "w " * 9, None, None, None)]
    got = {r["doc_id"]: r for r in mixing.mix_report(spark.createDataFrame(rows, helpers.SCHEMA)).collect()}
    assert got[2]["copies"] == 3 and got[4]["copies"] == 3 and got[3]["taken"] == 0 and got[1]["copies"] in (0, 1)


def test_texts_are_not_shuffled(spark):
    docs = helpers.documents(spark, extra=False)
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan
