import random

import pytest

from sparkloom.llm import decontaminate
from sparkloom.llm.decontaminate import Matcher, Pattern
from tests.llm import helpers


def plain_best(pattern, text):
    """Least edits of the pattern to any substring, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(60))
def test_myers_equals_the_table(seed):
    rng = random.Random(seed)
    pattern = "".join(rng.choices("abc ", k=rng.choice([1, 5, 30, 64, 65, 150])))
    text = "".join(rng.choices("abc ", k=rng.randint(0, 200)))
    best = plain_best(pattern, text)
    for budget in (best - 1, best, best + 3):
        if budget >= 0:
            hit = Pattern(pattern, budget).best(text)
            assert (hit is None) == (best > budget)
            assert hit is None or hit[0] == best


def edit(text, n, rng):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("xyz")
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, rng.choice("xyz"))
    return "".join(out)


@pytest.mark.parametrize("seed", range(12))
def test_all_matches_within_the_budget_are_found(seed):
    rng = random.Random(seed)
    items = [(i, " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(rng.randint(5, 30)))) for i in range(8)]
    matcher = Matcher(items, 0.1)
    text = " ".join(" ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(20)) + " " + edit(t, rng.randint(0, len(t) // 8), rng) for _, t in items)
    text = decontaminate.normalized(text)
    got = {i: d for i, d, _ in matcher(text)}
    for i, t in items:
        if len(t) >= decontaminate.SHORTEST:
            best = plain_best(t, text)
            assert got.get(i) == (best if best <= int(len(t) * 0.1) else None)


def test_query_and_filter(spark, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog and runs away"
    bench = spark.createDataFrame([(1, item), (2, item.upper()), (3, None), (4, ""), (5, "short one")], "item_id long, text string")
    rows = [(1, "Before. The QUICK  brown\nfox jumped over the lazy dog and runs away. After.", "en", "s", 0), (2, "nothing", None, None, None), (None, item, "en", "s", 0), (4, None, "en", "s", 0), (5, "Short  one", "en", "s", 0)]
    docs = spark.createDataFrame(rows, helpers.SCHEMA)
    for size in (decontaminate.PASS_BYTES, 40):  # one pass and several
        monkeypatch.setattr(decontaminate, "PASS_BYTES", size)
        got = sorted((r["doc_id"] or 0, r["item_id"], r["distance"]) for r in decontaminate.matches(docs, bench).collect())
        assert got == [(0, 1, 0), (0, 2, 0), (1, 1, 2), (1, 2, 2), (5, 5, 0)]
        assert sorted(r["doc_id"] for r in decontaminate.decontaminated(docs, bench).collect()) == [2, 4]
    many = helpers.documents(spark)
    assert decontaminate.decontaminated(many, bench).count() == many.count()
    assert decontaminate.matches(helpers.empty(spark), bench).count() == 0
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0


def test_short_items_are_found_inside_documents(spark):
    bench = spark.createDataFrame([(1, "Short one"), (2, "twenty-two characters!"), (3, "7"), (4, "")], "item_id long, text string")
    texts = ["before short  ONE, after", "a short ones", "xshort one", "so: twenty-two charactors! and", "route 7", "route 17", "shortone short one"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], helpers.SCHEMA)
    got = sorted((r["doc_id"], r["item_id"], r["distance"], r["end_char"]) for r in decontaminate.matches(docs, bench).collect())
    assert got == [(0, 1, 0, 16), (3, 2, 1, 26), (4, 3, 0, 7), (6, 1, 0, 18)]
    assert sorted(r["doc_id"] for r in decontaminate.decontaminated(docs, bench).collect()) == [1, 2, 5]


def test_a_pass_builds_its_automaton_once_and_ships_without_it():
    import pickle

    own = decontaminate.Pass([(1, "some benchmark item")], 0.05)
    assert own.matcher is own.matcher and own.matcher("so: some benchmark item.")
    assert "matcher" not in pickle.loads(pickle.dumps(decontaminate.Pass([(1, "x y")], 0.0))).__dict__
