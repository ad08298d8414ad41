"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may occur in a document with up to k = floor(n * RATE) edits. Cut in k + 1
pieces, it leaves at least one piece untouched, so an automaton over all pieces finds every place
where the item can be. Each place is verified with Myers' bit-parallel distance. A short item that may have no edit is found
where it stands between characters that are no letters or digits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import shared

#: Edits allowed per character of an item.
RATE = 0.05
#: Bytes of item texts that go to the workers at once; more items take more passes. Their automaton
#: takes about 64 times as much memory.
PASS_BYTES = 2_000_000
#: Shorter items (normalized) without an edit match only where no letter or digit adjoins.
SHORTEST = 24


def normalized(text: str | None) -> str:
    """Lower case, each run of white space as one space."""
    return " ".join((text or "").lower().split())


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 pieces (offset, text) of near equal length."""
    n = edits + 1
    cuts = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """An item prepared for Myers' search."""

    def __init__(self, text: str, edits: int):
        self.text, self.edits = text, edits
        self.masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(text):
            self.masks[c] |= 1 << i
        self.masks = dict(self.masks)

    def best(self, text: str) -> tuple[int, int] | None:
        """Least edits to a substring of ``text`` and where that ends (first such end), within the budget."""
        size = len(self.text)
        full, top = (1 << size) - 1, 1 << (size - 1)
        plus, minus, score = full, 0, size
        found, limit = None, self.edits + 1
        masks = self.masks
        for at, c in enumerate(text):
            equal = masks.get(c, 0)
            vertical = equal | minus
            across = (((equal & plus) + plus) ^ plus) | equal
            up = minus | (full & ~(across | plus))
            down = plus & across
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up = up << 1 & full
            down = down << 1 & full
            plus = down | (full & ~(vertical | up))
            minus = up & vertical
            if score < limit:
                found, limit = (score, at + 1), score
                if not score:
                    break
        return found


class Matcher:
    """All items of one pass over an automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.patterns: list[tuple[int, Pattern]] = []
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            if not text:
                continue
            own = len(self.patterns)
            self.patterns.append((item_id, Pattern(text, int(len(text) * rate))))
            for offset, piece in pieces(text, int(len(text) * rate)):
                places[piece].append((own, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, end) of the best match of each item in ``text``."""
        text = normalized(text)
        out: list[tuple[int, int, int]] = []
        if not self.patterns or not text:
            return out
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (size, places) in self.automaton.iter(text):
            for own, offset in places:
                starts[own].add(end + 1 - size - offset)
        for own, found in starts.items():
            item_id, pattern = self.patterns[own]
            if not pattern.edits and len(pattern.text) < SHORTEST:
                ends = (start + len(pattern.text) for start in sorted(found) if not text[max(0, start - 1) : start].isalnum())
                end = next((e for e in ends if not text[e : e + 1].isalnum()), None)
                if end is not None:
                    out.append((item_id, 0, end))
                continue
            best, covered = None, None
            for start in sorted(found):
                low, high = start - pattern.edits, start + len(pattern.text) + pattern.edits
                if covered is not None and high <= covered:
                    continue
                # neighbouring places share one window
                if covered is None or low > covered:
                    base = max(0, low)
                covered = high
                hit = pattern.best(text[max(base, low, 0) : max(0, high)])
                if hit and (best is None or hit[0] < best[0]):
                    best = hit[0], max(base, low, 0) + hit[1]
                    if not hit[0]:
                        break
            if best:
                out.append((item_id, *best))
        return out


class Pass:
    """The items of one pass; a worker builds their matcher once and keeps it while the broadcast lives."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items, self.rate = items, rate

    @cached_property
    def matcher(self) -> Matcher:
        return Matcher(self.items, self.rate)


def _passes(benchmark: DataFrame, rate: float) -> Iterator[tuple[Broadcast, bool]]:
    """The items, normalized, in broadcasts of about ``PASS_BYTES`` of texts, whatever their number,
    and whether there are several."""
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // PASS_BYTES
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        yield benchmark.sparkSession.sparkContext.broadcast(Pass([(r["item_id"], normalized(r["text"])) for r in own.collect()], rate)), n > 1


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, end_char) for each item of ``benchmark(item_id, text)`` that is in a
    document within its edits. Offsets count characters of the normalized text.

    Null and empty texts match nothing; a document of any length is searched whole; of several places
    of least distance, that of the first one found counts; repeated rows of ``docs`` give repeated
    matches; items of equal text match alike; further columns are ignored. No items or documents give
    no rows. Several passes are written one after another, so that a worker holds one automaton.
    """
    schema, out = "doc_id long, item_id long, distance int, end_char int", None
    for shipped, several in _passes(benchmark, rate):

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            matcher = shipped.value.matcher
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                    found = matcher(text.as_py())
                    if found:
                        doc_id = doc_id.as_py()
                        rows += [(doc_id, *x) for x in found]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                    columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "distance", "end_char"])

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        if several:
            found, _ = shared.staged(found, "edit-matches")
            shipped.destroy()
        out = found if out is None else out.union(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all their columns, whatever their names.

    Rows with a null or empty text hold none and stay; repeated rows share their fate."""
    before = None
    for shipped, several in _passes(benchmark, rate):

        def make(shipped=shipped):
            matcher = shipped.value.matcher
            return lambda texts: [not matcher(t.as_py()) for t in texts]

        docs = shared.rows_where(docs, make)
        if several:
            docs, path = shared.staged(docs, "edit-free")
            shipped.destroy()
            if before:
                shared.drop_paths(docs.sparkSession, before)
            before = path
    return docs
