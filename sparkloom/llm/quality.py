"""Quality by co-training two views of a document: its text, and its metadata.

The text view has hashed words, word pairs and trigrams of bytes of the whole text beside a few
statistics; the metadata view has language, source and stated length. The features of all documents
are made once and staged. Each view has a ridge-penalized logistic regression. In every round both
views score all unlabelled documents on the cluster; the ``TAKEN`` documents of each class that a
view is most confident of join the *other* view's training rows with that label. Afterwards,
labelled rows that no view was trained on calibrate each view, and a logistic curve over both
calibrated log-odds combines them. The fitted weights, some two thousand numbers, score every document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import shared

#: Labelled rows that are learnt from, at most; those of the smallest hash of doc_id.
MAX_LABELLED = 12_000
#: Rounds, and documents that a view labels in one, of each class.
ROUNDS, TAKEN = 4, 400
#: Probability from which a view's own label counts as confident.
CONFIDENT = 0.97
#: One labelled row in so many only calibrates.
CALIBRATION_FOLD = 4
#: Places of hashed words and pairs, and of hashed trigrams.
WORD_SLOTS, GRAM_SLOTS = 512, 512
SOURCE_SLOTS, LANG_SLOTS = 64, 16
#: Steps of a hashed count's logarithm, and the length of the hashed part of a vector.
STEPS, LENGTH = 16, 4.0
RIDGE = 1.0
#: Bytes of a text that are looked at together.
PIECE = 1 << 18

STATISTICS = (
    "bias", "log_words", "distinct_share", "top_share", "repeat_share", "upper_share", "digit_share", "symbol_share", "mark_share",
    "word_length", "long_share", "shout_share", "ended_share", "lines", "repeated_lines", "odd_ends", "url_share", "space_share",
)
N_STATS, N_HASHED = len(STATISTICS), WORD_SLOTS + GRAM_SLOTS
SPACE, LOWER, UPPER, DIGIT, SYMBOL, OTHER = range(6)
#: The kind of each byte; those of characters beyond ASCII are others and count as letters.
_KINDS = np.full(256, SYMBOL, np.uint8)
for _low, _high, _kind in ((9, 14, SPACE), (32, 33, SPACE), (48, 58, DIGIT), (65, 91, UPPER), (97, 123, LOWER), (128, 256, OTHER)):
    _KINDS[_low:_high] = _kind
_SPACES = re.compile(rb"[\x20\x09-\x0D]+")
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: tuple[np.ndarray, ...] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
N_META = 8 + SOURCE_SLOTS + LANG_SLOTS


def _pieces(raw: bytes) -> Iterator[bytes]:
    """``raw`` in pieces of about ``PIECE`` bytes, cut where a word ends."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw) and (found := _SPACES.search(raw, end)):
            end = found.end()
        else:
            end = len(raw)
        yield raw[at:end]
        at = end


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``_BASE`` and of its inverse, modulo 2**64."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, x, np.uint64))]) for x in (_BASE, _INVERSE))
    return _POWERS[0][:n], _POWERS[1][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of the whole text (zeros but for the constant without text), and ``N_HASHED`` logarithms
    of hashed counts in steps of 1 / ``STEPS`` (uint8). Words are told apart by 64-bit polynomial hashes."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    found = np.zeros(N_HASHED, np.int64)
    bytes_of = np.zeros(256, np.int64)
    shouts = plain = odd = 0
    hashes, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for piece in _pieces(raw):
        b = np.frombuffer(piece, np.uint8)
        kind = _KINDS[b]
        bytes_of += np.bincount(b, minlength=256)
        edge = np.flatnonzero(np.diff((kind != SPACE).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        start, end = edge[::2], edge[1::2]
        if not len(start):
            continue
        power, inverse = _powers(len(b))
        prefix = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(b * power, out=prefix[1:])
        own = _mixed((prefix[end] - prefix[start]) * inverse[start])
        hashes.append(own), lengths.append(end - start)
        inside = [np.add.reduceat(kind == k, start) for k in (LOWER, UPPER)]
        marks = np.add.reduceat((kind == DIGIT) | (kind == SYMBOL), start)
        shouts += int(((inside[0] == 0) & (inside[1] > 0)).sum())
        plain += int((marks == 0).sum())
        last = b[end - 1]
        odd += int(((_KINDS[last] == SYMBOL) & (last != 44) & (last != 46)).sum())
        # trigrams of bytes; white space of any kind counts as one space
        flat = np.where(kind == SPACE, np.uint8(32), b).astype(np.uint64)
        if len(flat) > 2:
            grams = _mixed(flat[:-2] * np.uint64(65_536) + flat[1:-1] * np.uint64(256) + flat[2:])
            found[WORD_SLOTS:] += np.bincount((grams % np.uint64(GRAM_SLOTS)).astype(np.int64), minlength=GRAM_SLOTS)
    words, lengths = np.concatenate(hashes), np.concatenate(lengths)
    n, size = max(1, len(words)), max(1, len(raw))
    if len(words):
        pairs = _mixed(words[:-1] * np.uint64(31) + words[1:])
        found[:WORD_SLOTS] += np.bincount((np.concatenate([words, pairs]) % np.uint64(WORD_SLOTS)).astype(np.int64), minlength=WORD_SLOTS)
    times = np.unique(words, return_counts=True)[1]
    lines = [x for x in text.split("\n") if x]
    upper = bytes_of[65:91].sum()
    letters = upper + bytes_of[97:123].sum()
    digits, spaces, marks = bytes_of[48:58].sum(), bytes_of[32] + bytes_of[9:14].sum(), bytes_of[[44, 46]].sum()
    symbols = bytes_of[33:128].sum() - letters - digits
    stats = (
        1, np.log1p(len(words)), len(times) / n, times.max(initial=0) / n, (words[1:] == words[:-1]).sum() / n, upper / max(1, letters), digits / size,
        (symbols - marks) / size, marks / size, lengths.mean() / 10 if len(words) else 0, (lengths > 16).sum() / n, shouts / n, plain / n,
        np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), odd / n, (text.count("://") + text.count("@")) / n, spaces / size,
    )
    steps = np.round(STEPS * np.where(found > 0, 1 + np.log2(np.maximum(found, 1)), 0))
    return np.array(stats, np.float32), np.minimum(steps, 255).astype(np.uint8)


def text_rows(stats: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Feature rows of the text view: statistics, and hashed parts of one length."""
    wide = hashed.astype(np.float32)
    norm = np.sqrt(np.einsum("ij,ij->i", wide, wide))
    wide *= (LENGTH / np.maximum(norm, 1e-6))[:, None]
    return np.concatenate([stats.astype(np.float32), wide], axis=1)


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Language and source, hashed with null as a value of its own, and the stated length."""
    out = np.zeros(N_META, np.float32)
    length = np.log1p(max(0, n_chars or 0))
    out[:8] = 1, n_chars is None, length / 10, (length / 10) ** 2, length < 4, length < 6, length > 8, length > 9.5
    out[8 + zlib.crc32((source or "\0").encode()) % SOURCE_SLOTS] = 1
    out[8 + SOURCE_SLOTS + zlib.crc32((lang or "\0").encode()) % LANG_SLOTS] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 200) -> np.ndarray:
    """Weights of a ridge-penalized logistic regression, by L-BFGS; the first column is a constant."""
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = (x @ w.astype(x.dtype)).astype(np.float64)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (penalty * w * w).sum()), (x.T @ (p - y).astype(x.dtype)).astype(np.float64) + penalty * w

    w = np.zeros(x.shape[1])
    loss, g = at(w)
    memory: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(g).max() < 1e-5 * max(1.0, len(y) ** 0.5):
            break
        q, kept = g.copy(), []
        for s, d, rho in reversed(memory):
            kept.append(rho * (s @ q))
            q -= kept[-1] * d
        q *= (memory[-1][0] @ memory[-1][1]) / (memory[-1][1] @ memory[-1][1]) if memory else 1 / max(1.0, np.abs(g).sum())
        for (s, d, rho), alpha in zip(memory, reversed(kept), strict=True):
            q += (alpha - rho * (d @ q)) * s
        slope, scale = g @ q, 1.0
        new, new_g = at(w - q)
        while new > loss - 1e-4 * scale * slope and scale > 1e-8:
            scale /= 2
            new, new_g = at(w - scale * q)
        if new >= loss:
            break
        s, d = -scale * q, new_g - g
        if s @ d > 1e-12:
            memory = [*memory[-9:], (s, d, 1 / (s @ d))]
        w, loss, g = w + s, new, new_g
    return w


def standardized(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and scales of the first ``n`` features; the first one is a constant and stays, as do the rest."""
    mean, scale = np.zeros(x.shape[1], np.float32), np.ones(x.shape[1], np.float32)
    mean[1:n], scale[1:n] = x[:, 1:n].mean(axis=0), x[:, 1:n].std(axis=0)
    return mean, np.where(scale < 1e-6, 1, scale).astype(np.float32)


@dataclass
class View:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.scaled(x).astype(np.float64) @ self.weights, -30, 30)

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.logit(x) + self.offset, -12, 12)


@dataclass
class CoTrained:
    text: View
    meta: View
    combined: np.ndarray  # constant, text, meta
    rounds: list[tuple[int, int]]  # pseudo-labels that the text and the meta view received

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.calibrated(text), self.meta.calibrated(meta)
        both = np.clip(self.combined[0] + self.combined[1] * a + self.combined[2] * b, -12, 12)
        return tuple(1 / (1 + np.exp(-x)) for x in (both, a, b))


#: Finds confident documents: given both views, for each view (text, meta) the features of both views
#: and the labels of the unlabelled rows that it is most confident of.
Pool = Callable[[View, View], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def co_train(text: np.ndarray, meta: np.ndarray, labels: np.ndarray, fold: np.ndarray, confident: Pool) -> CoTrained:
    """From labelled rows; those of ``fold`` only calibrate."""
    views = [View(*standardized(x, n), np.zeros(x.shape[1])) for x, n in ((text, N_STATS), (meta, N_META))]
    train, calibrate = ~fold, fold
    if len({*labels[calibrate]}) < 2:
        calibrate = train
    own = [(x[train], labels[train].astype(np.float64)) for x in (text, meta)]
    given: list[dict[bytes, tuple[np.ndarray, float]]] = [{}, {}]  # a view's pseudo-labelled rows, each once
    rounds = []
    for k in range(ROUNDS + 1):
        for v, (x, y), more in zip(views, own, given, strict=True):
            rows = np.concatenate([x, *(r[None] for r, _ in more.values())]) if more else x
            if len(rows):
                v.weights = logistic(v.scaled(rows).astype(np.float32), np.concatenate([y, [label for _, label in more.values()]]))
        if k == ROUNDS or not train.any():
            break
        before = [len(x) for x in given]
        for i, (some_text, some_meta, some_labels) in enumerate(confident(*views)):
            rows = (some_text, some_meta)[1 - i]
            for key, row, label in zip((some_text if i else some_meta), rows, some_labels, strict=True):
                given[1 - i].setdefault(key.tobytes() + row.tobytes(), (row, float(label)))
        rounds.append((len(given[0]) - before[0], len(given[1]) - before[1]))
        if not any(rounds[-1]):
            break
    y = labels[calibrate].astype(np.float64)
    logits = []
    for v, x in zip(views, (text, meta), strict=True):
        z = v.logit(x[calibrate])
        if len(y):
            v.offset, v.slope = logistic(np.stack([np.ones_like(z), z], 1), y, 0.1)
            v.slope = max(0.0, v.slope)
        logits.append(v.calibrated(x[calibrate]))
    combined = logistic(np.stack([np.ones_like(logits[0]), *logits], 1), y, 0.1) if len(y) else np.zeros(3)
    return CoTrained(views[0], views[1], combined, rounds)


FEATURES = "doc_id long, lang string, source string, n_chars long, stats binary, hashed binary"


NAMES = [x.split()[0] for x in FEATURES.split(", ")]


def text_featured(docs: DataFrame) -> DataFrame:
    """The text features of every row of ``docs`` beside its metadata; no shuffle, as features are about as
    large as texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_features(t.as_py()) for t in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array([x[i].tobytes() for x in found], pa.binary()) for i in (0, 1))], NAMES)

    return docs.select("doc_id", "lang", "source", F.col("n_chars").cast("long"), "text").mapInArrow(run, FEATURES)


def qualities(labels: DataFrame) -> DataFrame:
    """(doc_id, quality, fold) of labelled doc_ids; one labelled both ways is bad."""
    once = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    return once.withColumn("fold", F.pmod(F.xxhash64(F.col("doc_id") + 1), F.lit(CALIBRATION_FOLD)) == 0)


def featured(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text_featured`` with ``quality`` and ``fold`` of labelled doc_ids."""
    return text_featured(docs).join(qualities(labels), "doc_id", "left")


def _rows(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of both views."""
    column = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names) if c in ("lang", "source", "n_chars", "stats", "hashed")}
    stats = np.frombuffer(b"".join(column["stats"]), np.float32).reshape(-1, N_STATS)
    hashed = np.frombuffer(b"".join(column["hashed"]), np.uint8).reshape(-1, N_HASHED)
    meta = [meta_features(*x) for x in zip(column["lang"], column["source"], column["n_chars"], strict=True)]
    return text_rows(stats, hashed), np.array(meta, np.float32).reshape(-1, N_META)


def most_confident(staged: DataFrame, known: DataFrame) -> Pool:
    """Scores all rows of ``staged`` and fetches the few that are taken, none with a doc_id in ``known``. A task
    hands on all that are confident, doc_ids and probabilities alone, and the labelled ones are taken out of
    those; equal ones go by doc_id."""

    def pool(text_view: View, meta_view: View) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, valid = batch.column(0), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                for v, (view, x) in enumerate(zip((text_view, meta_view), _rows(batch), strict=True)):
                    p = np.round(1 / (1 + np.exp(-view.logit(x))), 9)
                    for c, sure in ((1, p), (0, 1 - p)):
                        own = np.flatnonzero((sure >= CONFIDENT) & valid)
                        columns = [pa.array(np.full(len(own), v, np.int32)), pa.array(np.full(len(own), c, np.int32)), ids.take(pa.array(own)), pa.array(sure[own])]
                        yield pa.RecordBatch.from_arrays(columns, ["view", "label", "doc_id", "sure"])

        scores = staged.select(*NAMES).mapInArrow(run, "view int, label int, doc_id long, sure double")
        scores, path = shared.staged(scores.join(known.select("doc_id"), "doc_id", "left_anti").select("view", "label", "doc_id", "sure"), "quality-sure", codec="zstd")
        chosen = None
        for v in (0, 1):
            for c in (0, 1):
                some = scores.where((F.col("view") == v) & (F.col("label") == c)).groupBy("view", "label", "doc_id").agg(F.max("sure").alias("sure")).orderBy(F.desc("sure"), "doc_id").limit(TAKEN)
                chosen = some if chosen is None else chosen.union(some)
        # at most 4 * TAKEN rows of four numbers, and as many feature rows
        listed = staged.select(*NAMES).join(F.broadcast(chosen.select("view", "label", "doc_id")), "doc_id").dropDuplicates(["view", "label", "doc_id"])
        found = listed.orderBy("view", "label", "doc_id").select("view", "label", *NAMES).toArrow()
        shared.drop_paths(staged.sparkSession, path)
        text, meta = _rows(found)
        view, label = (found.column(i).to_numpy() for i in (0, 1))
        return [(text[view == v], meta[view == v], label[view == v]) for v in (0, 1)]

    return pool


def fit(staged: DataFrame, labelled: int = MAX_LABELLED, labels: DataFrame | None = None) -> CoTrained:
    """Co-train on at most ``labelled`` labelled rows of ``staged`` and on confident rows among all that are
    unlabelled. Its labels are those that ``featured`` has added, or ``labels`` where it is from
    ``text_featured``. Without labels every score is 0.5."""
    own = staged.where("quality is not null").select("doc_id", "quality", "fold").distinct() if labels is None else qualities(labels)
    known, path = shared.staged(own, "quality-labels")
    # the sample is found by doc_ids alone, then its features are fetched
    some = known.join(staged.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    rows = staged.select(*NAMES).join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()  # bounded by the sample
    text, meta = _rows(rows)
    quality_, fold = (rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("quality", "fold"))
    if not len(rows):
        return CoTrained(View(*standardized(np.zeros((1, N_STATS + N_HASHED)), 0), np.zeros(N_STATS + N_HASHED)), View(*standardized(np.zeros((1, N_META)), 0), np.zeros(N_META)), np.zeros(3), [])
    model = co_train(text, meta, quality_.astype(np.int64), fold.astype(bool), most_confident(staged, known))
    shared.drop_paths(staged.sparkSession, path)
    return model


def scored(staged: DataFrame, model: CoTrained) -> DataFrame:
    """Per row of ``staged``: doc_id, score (probability of good quality), keep (score >= 0.5),
    text_score, meta_score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, text, meta = model.score(*_rows(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in ((both, pa.float64()), (both >= 0.5, pa.bool_()), (text, pa.float64()), (meta, pa.float64())))], ["doc_id", "score", "keep", "text_score", "meta_score"])

    return staged.select(*NAMES).mapInArrow(run, "doc_id long, score double, keep boolean, text_score double, meta_score double")


def quality(docs: DataFrame, labels: DataFrame, labelled: int = MAX_LABELLED) -> DataFrame:
    """Fit on ``labels(doc_id, quality)`` and score all of ``docs(doc_id, text, lang, source,
    n_chars)``. Nulls are values of their own, empty texts have zero statistics, texts of any length
    count whole, repeated rows score alike, further columns are ignored; a doc_id labelled both ways is
    bad; an empty table gives an empty one."""
    staged, _ = shared.staged(text_featured(docs), "quality-features", codec="zstd")
    return scored(staged, fit(staged, labelled, labels))
