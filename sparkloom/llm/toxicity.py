"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Texts are TF-IDF vectors over all their words; document frequencies come from all documents. Label
evidence is a weight: a word weighs the more, the further its G statistic over the labelled rows is
beyond chance on the toxic side. Boundary-marked character 5-grams with strong evidence are terms
too, so that inflected forms meet. Examples of equal vectors are one row of the index with a count
per label. Rows are cut into blocks. Terms of few rows are summed over their postings; for common
terms the index has the largest weight in each block. A search visits blocks in the order of their
bound and stops when the next bound can't reach the k-th similarity, so its result is exact. Votes
weigh with 1 / (distance + SOFT), and a logistic curve fitted on the examples, each left out of its
own vote, turns them into probabilities.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import shared

#: Labelled rows that are learnt from, at most; those of the smallest hash of doc_id.
MAX_EXAMPLES = 20_000
#: 5-grams expected to pass by chance, and the share of toxic documents that a 5-gram needs.
BY_CHANCE, LEAST_SHARE = 0.05, 0.5
#: G that a word reaches by chance (one in a hundred), and the most that evidence adds to a weight of 1.
CHANCE_G, MOST_EVIDENCE = 6.63, 100.0
GRAM = 5
BLOCK = 32
#: A term in more than one of so many rows is common.
COMMON = 16
#: Queries searched together, blocks that set a query's first limit, and blocks summed together.
QUERIES, FIRST, TOGETHER = 128, 8, 4
#: Single-precision sums of one pair differ by less.
ROUNDING = 1e-5
NEIGHBOURS = 16
SOFT = 0.05
#: Terms that a counting task holds before it hands on partial counts.
HELD_TERMS = 300_000
#: Words that a worker knows before it forgets those of the time before.
WORD_CACHE = 100_000

_LOGS = np.concatenate([[0.0], 1 + np.log(np.arange(1, 1 << 16))])
_ODD = re.compile(r"[^\w\x00-\x7f]")
_SPACED = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The lower-case words, runs of letters and digits, as UTF-8."""
    text = (text or "").lower()
    if not text.isascii():
        text = _ODD.sub(" ", text)
    return text.encode("utf-8", "surrogatepass").translate(_SPACED).split()


def word_terms(word: str) -> list[str]:
    """The word itself (marked ``=``) and its 5-grams with ``^`` and ``$`` at its ends."""
    marked = f"^{word}$"
    return ["=" + word, *{marked[i : i + GRAM] for i in range(max(1, len(marked) - GRAM + 1))}]


def terms_of(text: str | None) -> set[str]:
    found: set[str] = set()
    for word in set(words_of(text)):
        found.update(word_terms(word.decode("utf-8", "surrogatepass")))
    return found


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, toxic) of at most ``most`` labelled doc_ids that are not held out.

    Labels that are null are left out; a doc_id labelled both ways is toxic."""
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    once = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most ``most`` rows of two numbers; of rows with one doc_id, that of the smallest text counts
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 5, is 0; null is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, toxic, clean): documents of ``rows(doc_id, text, toxic)`` with each term; the term
    null counts all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            keys = list({**counts[0], **counts[1]})
            out = [pa.array(keys, pa.string()), *(pa.array([counts[k][t] for t in keys], pa.int64()) for k in (1, 0))]
            counts[0].clear(), counts[1].clear()
            return pa.RecordBatch.from_arrays(out, ["term", "toxic", "clean"])

        for batch in batches:
            for text, toxic in zip(batch.column(1), batch.column(2), strict=True):
                counts[bool(toxic.as_py())].update(terms_of(text.as_py()))
                counts[bool(toxic.as_py())][None] += 1
                if len(counts[0]) + len(counts[1]) > HELD_TERMS:
                    yield flush()
        yield flush()

    parts = rows.select("doc_id", "text", "toxic").mapInArrow(shared.releasing(run), "term string, toxic long, clean long")
    return parts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def word_key(word: bytes) -> int:
    """64-bit hash of a word, as the SQL function xxhash64 gives it (unsigned)."""
    return xxhash.xxh64_intdigest(word, 42)


def damped(counts: np.ndarray) -> np.ndarray:
    """1 + the logarithm of each count."""
    return _LOGS[counts] if counts.max(initial=0) < len(_LOGS) else 1 + np.log(counts)


class Terms:
    """All words of the examples, by sorted hash, then the 5-grams with evidence; their weights by place."""

    def __init__(self, keys: np.ndarray, grams: list[str], evidence: np.ndarray):
        self.keys, self.grams = keys, {g: len(keys) + i for i, g in enumerate(grams)}
        self.weights = evidence
        self.unseen = 1.0  # weight of a word of no example

    def __len__(self) -> int:
        return len(self.weights)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("vectorizer", "automaton")}

    def places(self, words: list[bytes]) -> np.ndarray:
        """Places of words, -1 for one of no example."""
        if not len(self.keys):
            return np.full(len(words), -1)
        own = np.fromiter(map(word_key, words), np.uint64, len(words))
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        return np.where(self.keys[at] == own, at, -1)

    @cached_property
    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for gram, place in self.grams.items():
            found.add_word(gram, place)
        found.make_automaton()
        return found

    def grams_of(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """The places of the 5-grams of those words that have any. No gram spans two words, as their
        marks are at a gram's ends only."""
        if not self.grams or not words:
            return {}
        joined = b"^" + b"$^".join(words) + b"$"
        text = joined.decode("utf-8", "surrogatepass")
        hits = [*self.automaton.iter(text)]
        if not hits:
            return {}
        starts = np.cumsum([0, *(len(w.decode("utf-8", "surrogatepass")) + 2 for w in words)])
        found: dict[bytes, set[int]] = {}
        for i, (_, place) in zip((np.searchsorted(starts, [end for end, _ in hits], "right") - 1).tolist(), hits, strict=True):
            found.setdefault(words[i], set()).add(place)
        return {w: sorted(x) for w, x in found.items()}

    @cached_property
    def vectorizer(self) -> Vectorizer:
        """One for all tasks of a worker, as words recur."""
        return Vectorizer(self)

    def weigh(self, seen: np.ndarray, n: int) -> None:
        """Take document frequencies over ``n`` documents into the weights."""
        self.weights = (np.log((n + 1) / (seen + 1)) + 1) * self.weights
        self.unseen = math.log((n + 1) / 2) + 1


def all_terms(counts: DataFrame) -> tuple[Terms, int, int]:
    """The terms with their label evidence, and the toxic and clean examples."""
    total = counts.where("term is null").agg(F.sum("toxic"), F.sum("clean")).first()
    toxic, clean = int(total[0] or 0), int(total[1] or 0)
    n = max(1, toxic + clean)
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")

    def part(seen: Column, whole: int, without: bool = False) -> Column:
        """What ``seen`` documents, of a label that has ``whole``, with or without the term add."""
        expected = (n - a - b if without else a + b) * (whole / n)
        return F.when((seen > 0) & (expected > 0), seen * F.log(seen / expected)).otherwise(0.0)

    tried = counts.where("term is not null")
    g = 2 * (part(a, toxic) + part(b, clean) + part(toxic - a, toxic, True) + part(clean - b, clean, True))
    least = 2 * math.log(max(1, tried.count()) / BY_CHANCE)
    scored = tried.withColumn("g", F.when(a * clean > b * toxic, g).otherwise(0.0))
    is_word = F.col("term").startswith("=")
    words = scored.where(is_word).select(F.xxhash64(F.expr("substring(term, 2)")).alias("key"), "g").toArrow()
    keys = words.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    strong = scored.where(~is_word & (F.col("g") >= least) & (a >= LEAST_SHARE * (a + b)))
    grams = sorted(tuple(r) for r in strong.select("term", "g").collect())
    evidence = 1 + np.clip(words.column(1).to_numpy()[order] - CHANCE_G, 0, MOST_EVIDENCE)
    evidence = np.concatenate([evidence, np.clip([x for _, x in grams], 0, MOST_EVIDENCE)])
    return Terms(keys[order], [t for t, _ in grams], evidence), toxic, clean


class Vectorizer:
    """Unit TF-IDF vectors over all words of a text; keeps the places of words between texts."""

    def __init__(self, terms: Terms):
        self.terms = terms
        self.known: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}  # words that were known before, until as many more are
        self.marked: dict[bytes, list[int]] = {}  # 5-grams of the words that have any

    def _meet(self, words: set[bytes]) -> None:
        """Learn those of ``words`` that are new."""
        if len(self.known) > WORD_CACHE:
            self.known, self.older = {}, self.known
            self.marked = {w: g for w, g in self.marked.items() if w in self.older}
        new = [*filterfalse(self.known.__contains__, words)]
        again = [*filter(self.older.__contains__, new)]
        self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
        if new := [*filterfalse(self.known.__contains__, new)]:
            self.known.update(zip(new, self.terms.places(new).tolist(), strict=True))
            self.marked.update(self.terms.grams_of(new))

    def _counted(self, words: Counter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found: Counter = Counter()
        for word in self.marked.keys() & words.keys():
            for place in self.marked[word]:
                found[place] += words[word]
        n = len(words) + len(found)
        places = np.fromiter(chain(map(self.known.__getitem__, words), found), np.int64, n)
        counts = np.fromiter(chain(words.values(), found.values()), np.int64, n)
        order = np.argsort(places)
        places, counts = places[order], counts[order]
        cut = int(np.searchsorted(places, 0))
        return places[cut:], counts[cut:], counts[:cut]

    def counts(self, texts: Iterable[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text, sorted places and their counts, and the counts of words of no example."""
        bags = [Counter(words_of(t)) for t in texts]
        self._meet(set().union(*bags))
        return [self._counted(b) for b in bags]

    def weights(self, places: np.ndarray, counts: np.ndarray, unseen: np.ndarray) -> np.ndarray:
        """Words of no example only lengthen the vector."""
        weights = damped(counts) * self.terms.weights[places]
        rest = damped(unseen) * self.terms.unseen
        return weights / math.sqrt(weights @ weights + rest @ rest) if len(places) else weights

    def __call__(self, texts: str | Iterable[str | None] | None) -> tuple[np.ndarray, np.ndarray] | list[tuple[np.ndarray, np.ndarray]]:
        """For each text, sorted places and weights; both empty without words of an example. Of one text alone, its own."""
        if texts is None or isinstance(texts, str):
            return self([texts])[0]
        return [(places, self.weights(places, counts, unseen)) for places, counts, unseen in self.counts(texts)]


def document_counts(docs: DataFrame, terms: Terms, shipped: Broadcast) -> tuple[np.ndarray, int]:
    """Documents of ``docs`` with each term, and all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = shipped.value, 0
        seen = np.zeros(len(own), np.int64)
        words: Counter = Counter()
        marked: dict[bytes, list[int]] = {}

        def take() -> None:
            """Add the words' documents to their places."""
            listed = list(words)
            places, times = own.places(listed), np.fromiter(words.values(), np.int64, len(words))
            np.add.at(seen, places[places >= 0], times[places >= 0])
            words.clear(), marked.clear()

        for batch in batches:
            n += batch.num_rows
            for at in range(0, batch.num_rows, QUERIES):
                bags = [set(words_of(t.as_py())) for t in batch.column(0)[at : at + QUERIES]]
                marked.update(own.grams_of([*filterfalse(words.__contains__, set().union(*bags))]))
                for bag in bags:
                    words.update(bag)
                    if found := marked.keys() & bag:
                        seen[[*{p for w in found for p in marked[w]}]] += 1
            if len(words) > WORD_CACHE:
                take()
        take()
        places = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([*places, len(own)], pa.int64()), pa.array([*seen[places], n], pa.int64())], ["place", "n"])

    parts = docs.select("text").mapInArrow(shared.releasing(run), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(len(terms) + 1, np.int64)
    seen[parts.column(0).to_numpy()] = parts.column(1).to_numpy()
    return seen[:-1], int(seen[-1])


@dataclass
class Index:
    """Inverted index of example vectors, with block maxima of its common terms."""

    cuts: np.ndarray  # postings of term t are cuts[t] to cuts[t + 1]
    postings: np.ndarray  # 64 bits each: the row, above the bits of its single-precision weight
    common: np.ndarray  # a term's place among the common ones, or -1
    dense: np.ndarray  # (rows, common terms): weights, rows filled up to whole blocks
    most: np.ndarray  # (common terms, blocks): each term's largest weight in the block
    votes: np.ndarray  # (rows, 2): clean and toxic examples of the row
    doc_ids: np.ndarray  # a row's smallest doc_id
    held: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))

    def __getstate__(self) -> tuple:
        """Small for shipping: the dense blocks are made again, postings are compressed."""
        small = [zlib.compress(x.tobytes(), 1) for x in (np.diff(self.cuts).astype(np.int32), (self.postings >> np.uint64(32)).astype(np.int32), self.postings.astype(np.uint32))]
        return small, self.votes, self.doc_ids

    def __setstate__(self, state: tuple) -> None:
        (sizes, rows, weights), votes, doc_ids = state
        cuts = np.concatenate([[0], np.cumsum(np.frombuffer(zlib.decompress(sizes), np.int32))])
        postings = np.frombuffer(zlib.decompress(rows), np.uint32).astype(np.uint64)
        np.left_shift(postings, np.uint64(32), out=postings)
        postings |= np.frombuffer(zlib.decompress(weights), np.uint32)
        self.__dict__.update(Index._filled(cuts, postings, votes, doc_ids).__dict__)
        shared.release_memory()  # unpacking takes as much again

    @staticmethod
    def _packed(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = rows.astype(np.uint64)
        np.left_shift(out, np.uint64(32), out=out)
        out |= weights.view(np.uint32)
        return out

    @classmethod
    def _filled(cls, cuts: np.ndarray, postings: np.ndarray, votes: np.ndarray, doc_ids: np.ndarray) -> Index:
        often = np.flatnonzero(np.diff(cuts) > len(votes) // COMMON)
        common = np.full(len(cuts) - 1, -1, np.int32)
        common[often] = np.arange(len(often))
        n_blocks = -(-len(votes) // BLOCK)
        dense = np.zeros((n_blocks * BLOCK, len(often)), np.float32)
        for i, t in enumerate(often):
            own = postings[cuts[t] : cuts[t + 1]]
            dense[(own >> np.uint64(32)).astype(np.int64), i] = own.astype(np.uint32).view(np.float32)
        return cls(cuts, postings, common, dense, dense.reshape(n_blocks, BLOCK, len(often)).max(axis=1).T.copy(), votes, doc_ids)

    @classmethod
    def build(cls, n_terms: int, vectors: list[tuple[np.ndarray, np.ndarray]], votes: np.ndarray, doc_ids: np.ndarray) -> Index:
        """From the rows' sparse vectors; the list is emptied."""
        # rows of the same leading terms side by side make tight block bounds
        order = sorted(range(len(vectors)), key=lambda i: vectors[i][0][np.argsort(-vectors[i][1], kind="stable")[:8]].tolist())
        sizes = [len(vectors[i][0]) for i in order]
        term = np.concatenate([np.zeros(0, np.int32), *(vectors[i][0].astype(np.int32) for i in order)])
        packed = cls._packed(np.repeat(np.arange(len(order), dtype=np.uint32), sizes), np.concatenate([np.zeros(0, np.float32), *(vectors[i][1].astype(np.float32) for i in order)]))
        vectors.clear()  # as large again
        cuts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=n_terms)[:n_terms])])
        return cls._filled(cuts, packed[np.argsort(term, kind="stable")], votes[order], doc_ids[order])

    @cached_property
    def starts(self) -> np.ndarray:
        """(terms, 2): where the postings of each term start and end."""
        return np.stack([self.cuts[:-1], self.cuts[1:]], axis=1)

    @cached_property
    def rows(self) -> np.ndarray:
        """The row of each posting."""
        return (self.postings >> np.uint64(32)).astype(np.int64)

    @cached_property
    def weights(self) -> np.ndarray:
        """The weight of each posting."""
        return self.postings.astype(np.uint32).view(np.float32)

    @cached_property
    def listed(self) -> list[list[float]]:
        return self.votes.tolist()

    def _rare(self, places: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Each row's sum over the postings of terms that are not common; arrays are used again, as fresh
        ones of this size cost more than the sums."""
        low, high = self.cuts[places], self.cuts[places + 1]
        total = int((high - low).sum())
        if not total:
            return np.zeros(len(self.dense), np.float32)
        if total > len(self.held):
            self.held = np.empty(2 * total, np.uint64)
        own = self.held[:total]
        np.concatenate([self.postings[x:y] for x, y in zip(low.tolist(), high.tolist(), strict=True)], out=own)
        gains = np.repeat(weights, high - low)
        gains *= own.view(np.float32)[::2]
        np.right_shift(own, np.uint64(32), out=own)
        return np.bincount(own.view(np.int64), gains, minlength=len(self.dense))

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        """For each query (places, weights), the ``k`` rows of largest cosine (above 0), ties by row:
        (cosine, row). Exact: of all blocks, only those whose bound is below the k-th largest of the
        rows in the most promising blocks are left out."""
        out: list[list[tuple[float, int]]] = []
        n_blocks = self.most.shape[1]
        for at in range(0, len(queries), QUERIES):
            some = queries[at : at + QUERIES]
            if not n_blocks:
                out += [[] for _ in some]
                continue
            sums, often = np.empty((len(some), len(self.dense)), np.float32), np.zeros((len(some), len(self.most)), np.float32)
            for i, (places, weights) in enumerate(some):
                common = self.common[places]
                often[i, common[common >= 0]] = weights[common >= 0]
                sums[i] = self._rare(places[common < 0], weights[common < 0])
            bounds = sums.reshape(len(some), n_blocks, BLOCK).max(axis=2) + often @ self.most
            first = np.argpartition(-bounds, FIRST, axis=1)[:, :FIRST] if n_blocks > FIRST else np.tile(np.arange(n_blocks), (len(some), 1))
            kth = np.zeros(len(some), np.float32)
            for i, blocks in enumerate(first.tolist()):
                if len(blocks) * BLOCK >= k:
                    found = np.concatenate([sums[i, b * BLOCK : (b + 1) * BLOCK] + self.dense[b * BLOCK : (b + 1) * BLOCK] @ often[i] for b in blocks])
                    kth[i] = np.partition(found, -k)[-k]
            # a hair lower, as sums in another order and precision round differently
            kth = np.maximum(kth - ROUNDING, np.finfo(np.float32).tiny)
            needed = bounds >= kth[:, None]
            for low in range(0, n_blocks, TOGETHER):
                who = np.flatnonzero(needed[:, low : low + TOGETHER].any(axis=1))
                rows = slice(low * BLOCK, (low + TOGETHER) * BLOCK)
                part = sums[:, rows]
                if len(who) == len(some):
                    part += often @ self.dense[rows].T
                else:
                    found = part[who] + often[who] @ self.dense[rows].T
                    part[:] = 0
                    part[who] = found
            who, hits = np.nonzero(sums >= kth[:, None])
            found = np.round(sums[who, hits].astype(np.float64), 7)
            ends = np.searchsorted(who, np.arange(len(some) + 1)).tolist()
            for x, y in zip(ends, ends[1:], strict=False):
                best = np.lexsort((hits[x:y], -found[x:y]))[:k] + x
                out.append(list(zip(found[best].tolist(), hits[best].tolist(), strict=True)))
        return out


@dataclass
class Model:
    idf: Terms
    index: Index
    prior: float
    unknown: float  # probability without any word of an example
    slope: float
    offset: float
    shipped: Broadcast | None = None  # the model itself before its calibration

    def __getstate__(self) -> dict:
        return {**self.__dict__, "shipped": None}

    def nearest(self, texts: pa.Array, vectorize: Vectorizer) -> Iterator[list[tuple[float, int]]]:
        """The neighbours of each text; few texts are held as vectors at once."""
        for at in range(0, len(texts), QUERIES):
            yield from self.index.search(vectorize(texts[at : at + QUERIES].to_pylist()), NEIGHBOURS)

    def vote(self, near: list[tuple[float, int]], without: tuple[int, int] | None = None) -> float:
        """Log-odds of the distance-weighted votes; ``without`` takes one example (row, label) out."""
        toxic, total, votes = self.prior, 1.0, self.index.listed
        for cosine, row in near:
            weight = 1 / (max(0.0, 1 - cosine) + SOFT)
            clean, bad = votes[row]
            if without and without[0] == row:
                clean, bad = clean - (not without[1]), bad - without[1]
            toxic += weight * bad
            total += weight * (clean + bad)
        share = toxic / total
        return math.log(share / (1 - share))

    def score(self, near: list[tuple[float, int]]) -> float:
        if not near:
            return self.unknown
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.vote(near) + self.offset))))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_EXAMPLES) -> Model:
    """Learn from at most ``most`` labelled rows. Without any, every score is 0.5."""
    rows, rows_path = shared.staged(training_rows(docs, labels, most), "toxic-train")
    counts, counts_path = shared.staged(term_counts(rows), "toxic-terms")
    terms, toxic, clean = all_terms(counts)
    shipped = docs.sparkSession.sparkContext.broadcast(terms)  # bounded by the examples' words
    terms.weigh(*document_counts(docs, terms, shipped))
    prior = (toxic + 1) / (toxic + clean + 2)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectorize = shipped.value.vectorizer
        for batch in batches:
            keys = [np.stack(x[:2]).astype(np.int32).tobytes() for at in range(0, batch.num_rows, QUERIES) for x in vectorize.counts(batch.column(1)[at : at + QUERIES].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(2)], ["doc_id", "vector", "toxic"])

    made, made_path = shared.staged(rows.select("doc_id", "text", "toxic").mapInArrow(shared.releasing(vectors), "doc_id long, vector binary, toxic int"), "toxic-vectors")
    shipped.destroy()
    grouped: dict[bytes, list[int]] = {}
    for r in made.toLocalIterator():  # no more rows than examples
        own = grouped.setdefault(bytes(r["vector"]), [0, 0, r["doc_id"]])
        own[r["toxic"]] += 1
        own[2] = min(own[2], r["doc_id"])
    empty = grouped.pop(b"", [0, 0, 0])
    known = sorted(grouped)
    weigh = terms.vectorizer
    sparse = [(p.astype(np.int32), weigh.weights(p, n, n[:0]).astype(np.float32)) for p, n in map(_unpacked, known)]
    votes = np.array([grouped[v][:2] for v in known], np.float64).reshape(-1, 2)
    # the place in ``known`` stands for the doc_id until the rows are in order
    index = Index.build(len(terms), sparse, votes, np.arange(len(known)))
    row_of = {_digest(known[i]): row for row, i in enumerate(index.doc_ids.tolist())}
    index.doc_ids = np.array([grouped[known[i]][2] for i in index.doc_ids], np.int64)
    del grouped, known, sparse
    shared.release_memory()  # the driver has a JVM beside it
    model = Model(terms, index, prior, (empty[1] + prior) / (sum(empty[:2]) + 1), 1.0, 0.0)
    model.slope, model.offset = _calibrate(model, made, row_of)
    shared.drop_paths(docs.sparkSession, rows_path, counts_path, made_path)
    return model


def _unpacked(vector: bytes) -> tuple[np.ndarray, np.ndarray]:
    places, counts = np.frombuffer(vector, np.int32).reshape(2, -1).astype(np.int64)
    return places, counts


def _digest(vector: bytes) -> bytes:
    return hashlib.blake2b(vector, digest_size=16).digest()


def _calibrate(model: Model, made: DataFrame, row_of: dict[bytes, int]) -> tuple[float, float]:
    """Slope and offset of a logistic curve on the left-out votes of ``made(doc_id, vector, toxic)``,
    by Newton's method with a ridge towards the votes as they are."""
    context = made.sparkSession.sparkContext
    shipped = model.shipped = context.broadcast(model)  # bounded by the examples
    places_of = context.broadcast(row_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = shipped.value, places_of.value
        weigh = own.idf.vectorizer
        for batch in batches:
            vectors, toxic = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            near = own.index.search([(p, weigh.weights(p, n, n[:0])) for p, n in map(_unpacked, vectors)], NEIGHBOURS)
            xs = [own.vote(x, (rows[_digest(v)], t)) for x, v, t in zip(near, vectors, toxic, strict=True)]
            ys = [float(t) for t in toxic]
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.float64()), pa.array(ys, pa.float64())], ["x", "y"])

    # no more rows than examples; the shuffle deals them to all tasks
    spread = made.where(F.length("vector") > 0).select("vector", "toxic").repartition(shared.partitions(made.sparkSession))
    left_out = spread.mapInArrow(shared.releasing(run), "x double, y double").toArrow()
    places_of.destroy()
    x, y = (left_out.column(i).to_numpy() for i in (0, 1))
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    slope, offset = 1.0, 0.0
    for _ in range(25 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        g = np.array([((p - y) * x).sum() + 2 * (slope - 1), (p - y).sum() + 2 * offset])
        v = p * (1 - p)
        h = np.array([[(v * x * x).sum() + 2, (v * x).sum()], [(v * x).sum(), v.sum() + 2]])
        step = np.linalg.solve(h, g)
        slope, offset = max(0.05, slope - float(np.clip(step[0], -1, 1))), offset - float(np.clip(step[1], -2, 2))
    return slope, offset


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted, evidence (up to three nearest
    examples: doc_id, cosine, toxic_share). Null and empty texts have no terms: the score of such."""
    shipped, curve = model.shipped, (model.slope, model.offset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = replace(shipped.value, slope=curve[0], offset=curve[1])
        vectorize = own.idf.vectorizer
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic_share", pa.float64())]))
        votes, ids = own.index.listed, own.index.doc_ids.tolist()
        for batch in batches:
            scores, evidence = [], []
            for near in own.nearest(batch.column(1), vectorize):
                scores.append(own.score(near))
                evidence.append([{"doc_id": ids[r], "cosine": s, "toxic_share": votes[r][1] / sum(votes[r])} for s, r in near[:3]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array(evidence, kind)], ["doc_id", "held_out", "score", "evidence"])

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    out = rows.mapInArrow(shared.releasing(run), "doc_id long, held_out boolean, score double, evidence array<struct<doc_id:long,cosine:double,toxic_share:double>>")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on ``labels(doc_id, toxic)`` and score every row of ``docs(doc_id, text)``."""
    return scored(docs, fit(docs, labels))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    model = fit(docs, labels)
    shipped, curve = model.shipped, (model.slope, model.offset)
    del model  # the workers have it
    shared.release_memory()

    def make():
        own = replace(shipped.value, slope=curve[0], offset=curve[1])
        vectorize = own.idf.vectorizer
        return lambda texts: [own.score(near) < threshold for near in own.nearest(texts, vectorize)]

    return shared.rows_where(docs, make)
