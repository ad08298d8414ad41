"""Token-ID output: shards of patched frame-of-reference blocks.

A shard file holds consecutive documents of the corpus order. Its ids are cut into blocks of
``BLOCK`` values. Every block subtracts its minimum and packs the rest at the width that a chosen
percentile of its values needs; values that do not fit go to the block's exception list. The
footer indexes block starts and documents, so any document is read without decoding the shard.

File layout, little-endian::

    magic "PFB1"
    blocks   packed words (width * LANES * 8 bytes), exception places (uint16),
             exception values (uint32), one block after the other
    footer   block starts (uint64), minima (uint32), widths (uint8), exception counts (uint16),
             then per document: id valid (uint8), doc_id (int64), first id in the shard (uint64)
    tail     n_blocks, n_docs, n_ids (3 x uint64), footer start (uint64), magic

Blocks of the same width are packed and unpacked together: a block is a 64 x ``LANES`` matrix, and
row ``j`` of all blocks is shifted into its word at once.
"""

from __future__ import annotations

import array
import gc
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm import shared

MAGIC = b"PFB1"
LANES = 32
BLOCK = 64 * LANES
#: Share of a block's values that its packed width must hold.
PERCENTILE = 0.97
#: Ids after which a task starts its next shard file.
SHARD_IDS = 8_000_000
#: Blocks that are packed together.
GROUP = 64


def block_widths(rest: np.ndarray, percentile: float) -> np.ndarray:
    """Bits for the percentile of each row of ``rest`` (blocks x BLOCK), at least 1."""
    place = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    chosen = np.partition(rest, place, axis=1)[:, place]
    return np.maximum(1, np.ceil(np.log2(chosen.astype(np.float64) + 1)).astype(np.int64))


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(n, BLOCK) values below 2**width to (n, width * LANES) words."""
    rows = values.astype(np.uint64).reshape(-1, 64, LANES)
    out = np.zeros((len(rows), width, LANES), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[:, word] |= rows[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return out.reshape(len(rows), width * LANES)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """Inverse of ``pack``."""
    rows = words.reshape(-1, width, LANES)
    out = np.empty((len(rows), 64, LANES), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        value = rows[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (rows[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = value & mask
    return out.reshape(len(rows), BLOCK)


def _encoded_blocks(ids: np.ndarray, percentile: float) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The blocks of ``ids``, the last one filled up with its last id: bytes, minima, widths and exception counts."""
    n_blocks = -(-len(ids) // BLOCK)
    blocks = np.full((n_blocks, BLOCK), ids[-1], np.uint32)
    blocks.reshape(-1)[: len(ids)] = ids
    low = blocks.min(axis=1)
    rest = blocks - low[:, None]
    widths = block_widths(rest, percentile)
    outlier = rest >= (np.uint64(1) << widths.astype(np.uint64))[:, None]
    counts = outlier.sum(axis=1)
    packed: list[bytes] = [b""] * n_blocks
    kept = np.where(outlier, 0, rest)
    for width in np.unique(widths):
        which = np.flatnonzero(widths == width)
        for at, words in zip(which, pack(kept[which], int(width)), strict=True):
            packed[at] = words.tobytes()
    _, places = np.nonzero(outlier)
    patched, ends = rest[outlier], np.cumsum(counts)
    spans = [slice(end - n, end) for end, n in zip(ends, counts, strict=True)]
    bodies = [body + places[span].astype("<u2").tobytes() + patched[span].astype("<u4").tobytes() for body, span in zip(packed, spans, strict=True)]
    return bodies, low, widths, counts


def encode_shard(
    ids: np.ndarray, doc_ids: list[int | None], starts: np.ndarray, percentile: float = PERCENTILE
) -> bytes:
    """One shard file of ``ids`` (uint32); ``starts`` has the first id of each document."""
    n_blocks = -(-len(ids) // BLOCK)
    out, at, block_starts = [MAGIC], len(MAGIC), np.zeros(n_blocks, np.uint64)
    low, widths, counts = (np.zeros(n_blocks, kind) for kind in ("<u4", "u1", "<u2"))
    # a block stands for itself, so those under way are few, whatever the length of the shard
    for first in range(0, n_blocks, GROUP):
        some = slice(first, first + GROUP)
        bodies, low[some], widths[some], counts[some] = _encoded_blocks(ids[first * BLOCK : (first + GROUP) * BLOCK], percentile)
        for i, body in enumerate(bodies, first):
            block_starts[i] = at
            at += len(body)
            out.append(body)
    valid = np.array([d is not None for d in doc_ids], np.uint8)
    known = np.array([d or 0 for d in doc_ids], "<i8")
    out += [
        block_starts.astype("<u8").tobytes(), low.tobytes(), widths.tobytes(), counts.tobytes(),
        valid.tobytes(), known.tobytes(), starts.astype("<u8").tobytes(),
        np.array([n_blocks, len(doc_ids), len(ids), at], "<u8").tobytes(), MAGIC,
    ]
    return b"".join(out)


class Shard:
    """A shard file in memory: its index, and ids by range."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC or data[-4:] != MAGIC:
            raise ValueError("not a patched frame-of-reference shard")
        self.data = data
        n_blocks, n_docs, self.n_ids, at = (int(x) for x in np.frombuffer(data, "<u8", 4, len(data) - 36))

        def column(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.block_starts, self.low = column("<u8", n_blocks), column("<u4", n_blocks)
        self.widths, self.counts = column("u1", n_blocks), column("<u2", n_blocks)
        valid, known = column("u1", n_docs), column("<i8", n_docs)
        self.doc_ids = [int(d) if ok else None for ok, d in zip(valid, known, strict=True)]
        self.doc_starts = np.append(column("<u8", n_docs).astype(np.int64), self.n_ids)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end``; only their blocks are decoded."""
        first, last = start // BLOCK, -(-end // BLOCK)
        out = np.empty((max(0, last - first), BLOCK), np.uint32)
        for width in np.unique(self.widths[first:last]):
            which = first + np.flatnonzero(self.widths[first:last] == width)
            size = int(width) * LANES
            words = np.stack([np.frombuffer(self.data, "<u8", size, int(self.block_starts[i])) for i in which])
            out[which - first] = unpack(words, int(width))
        for i in first + np.flatnonzero(self.counts[first:last]):
            n, at = int(self.counts[i]), int(self.block_starts[i]) + int(self.widths[i]) * LANES * 8
            out[i - first, np.frombuffer(self.data, "<u2", n, at)] = np.frombuffer(self.data, "<u4", n, at + 2 * n)
        out += self.low[first:last, None]
        return out.reshape(-1)[start - first * BLOCK : end - first * BLOCK]


_LETTERS = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_DIGITS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
#: The published byte-level pre-tokenization, its classes spelt out for Latin letters.
_PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\s{_LETTERS}{_DIGITS}]+|\s+(?!\S)|\s+"
)
#: Texts with other characters go through the library's own pre-tokenizer.
_OTHER = re.compile("[^\t\n\r -~\u00a1-\u017f]")


def _byte_alphabet() -> dict[int, str]:
    """Byte to character of byte-level vocabularies: printable ones stand for themselves."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceIds(dict):
    """Ids of pre-tokens as little-endian uint32 bytes; one that is new is encoded by the model."""

    def __init__(self, model):
        super().__init__()
        self.encode, self.alphabet = model.tokenize, _byte_alphabet()

    def __missing__(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin-1").translate(self.alphabet)
        ids = self[piece] = array.array("I", [t.id for t in self.encode(mapped)]).tobytes()
        return ids


class CachedEncoder:
    """Byte-level BPE ids of whole texts as little-endian uint32 bytes.

    BPE works on one pre-token at a time, and corpora repeat theirs, so a task keeps the ids of
    about ``CACHE`` pre-tokens."""

    CACHE = 300_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = PieceIds(self.tokenizer.model)
        spec = json.loads(self.tokenizer.to_str())
        # the library takes the strings of added tokens out of a text first, so such texts go there whole
        added = [re.escape(t["content"]) for t in spec["added_tokens"] or () if t["content"]]
        self.added = re.compile("|".join(added) or r"(?!)")
        kind = spec["pre_tokenizer"] or {}
        self.plain = spec["normalizer"] is None and kind.get("type") == "ByteLevel" and kind["use_regex"] and not kind["add_prefix_space"]

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        ids_of = self.known.__getitem__
        if len(self.known) > self.CACHE:
            self.known.clear()
        for i, text in enumerate(texts):
            if self.plain and not _OTHER.search(text) and not self.added.search(text):
                out[i] = b"".join(map(ids_of, _PIECES.findall(text)))
        rest = [i for i, x in enumerate(out) if x is None]
        for i, one in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = array.array("I", one.ids).tobytes()
        return out


@lru_cache(maxsize=1)
def shared_encoder(path: str) -> CachedEncoder:
    """The encoder that all tasks of a Python worker use in turn."""
    return CachedEncoder(path)


def _put(folder: str, name: str, data: bytes) -> None:
    """Write beside, then move: a repeated attempt of the task leaves the same whole file."""
    target, path = fs.FileSystem.from_uri(folder)
    target.create_dir(path, recursive=True)
    beside = f"{path}/.{name}.{uuid.uuid4().hex}"
    with target.open_output_stream(beside) as out:
        out.write(data)
    try:
        target.move(beside, f"{path}/{name}")
    except OSError:  # some stores don't replace what an earlier attempt left
        target.delete_file(f"{path}/{name}")
        target.move(beside, f"{path}/{name}")


def _get(folder: str, name: str) -> bytes:
    target, path = fs.FileSystem.from_uri(folder)
    with target.open_input_stream(f"{path}/{name}") as source:
        return source.read()


def write_token_shards(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, percentile: float = PERCENTILE, shard_ids: int = SHARD_IDS
) -> DataFrame:
    """Tokenize ``docs(doc_id, text)`` into shard files below ``folder`` (a URI all executors see).

    Documents are range-partitioned by doc_id (nulls first, rows of one doc_id by a hash of the text), so the
    files' names in order give the corpus in ascending doc_id order. A null or empty text has the
    end id alone. Repeated rows are separate documents; further columns are ignored.

    Returns the manifest, one row per shard: shard, n_docs, n_ids, start (ids in earlier shards).
    """
    spark = docs.sparkSession
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    # the hash parts the rows of one doc_id, or of none
    ordered = ordered.repartitionByRange(shared.partitions(spark), "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.collect()
        shared.release_memory()  # of the task before, maybe of another stage
        encode = shared_encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        part, made = TaskContext.get().partitionId(), []
        parts: list[np.ndarray] = []
        names: list[int | None] = []
        sizes: list[int] = []

        def close() -> None:
            ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            parts.clear()
            starts = np.cumsum([0, *sizes])[:-1]
            name = f"part-{part:06d}-{len(made):05d}.pfb"
            _put(folder, name, encode_shard(ids, names, starts, percentile))
            made.append((name, len(names), len(ids)))
            names.clear(), sizes.clear()

        held = 0
        gc.disable()  # the loop makes millions of lists and no cycles
        try:
            for batch in batches:
                doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
                for at in range(0, len(doc_ids), 256):
                    for doc_id, raw in zip(doc_ids[at : at + 256], encode(texts[at : at + 256].to_pylist()), strict=False):
                        ids = np.frombuffer(raw + end, "<u4")
                        parts.append(ids), names.append(doc_id), sizes.append(len(ids))
                        held += len(ids)
                        if held >= shard_ids:
                            close()
                            held = 0
            if names:
                close()
        finally:
            gc.enable()
            encode.known.clear()  # the worker's next task may need its memory for something else
            shared.release_memory()
        if made:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*made, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)],
                ["shard", "n_docs", "n_ids"],
            )

    shards, _ = shared.staged(ordered.mapInArrow(write, "shard string, n_docs long, n_ids long"), "token-manifest")
    # one row per shard file, so this window holds as many rows as there are files
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the shards: doc_id, start, n_tokens, ids_crc32, shard."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(_get(folder, row["shard"]))
                if (len(shard.doc_ids), shard.n_ids) != (row["n_docs"], row["n_ids"]):
                    raise ValueError(f"{row['shard']} does not hold what the manifest says")
                starts, sums = shard.doc_starts, []
                ids, base = np.zeros(0, np.uint32), 0
                for i in range(len(shard.doc_ids)):
                    if starts[i + 1] > base + len(ids):
                        base = int(starts[i])
                        ids = shard.ids(base, max(int(starts[i + 1]), min(shard.n_ids, base + 512 * BLOCK)))
                    sums.append(zlib.crc32(ids[starts[i] - base : starts[i + 1] - base].astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, pa.int64()), pa.array(starts[:-1] + row["start"], pa.int64()),
                        pa.array(np.diff(starts), pa.int64()), pa.array(sums, pa.int64()),
                        pa.array([row["shard"]] * len(sums), pa.string()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                )

    spread = manifest.repartition(shared.partitions(manifest.sparkSession))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")


def token_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as shards and return what ``read_token_shards`` finds in them."""
    spark: SparkSession = docs.sparkSession
    folder = folder or shared.new_path(spark, "token-shards")
    if "://" not in folder and not folder.startswith(("/", "file:")):
        raise ValueError("folder must be an absolute path or a URI")
    return read_token_shards(write_token_shards(docs, folder, tokenizer, end_id), folder)
