"""Telephony audio columns: mu-law, A-law and IMA ADPCM to resampled 16-bit PCM.

Companded samples expand through 256-entry tables built from the G.711 rules. ADPCM is decoded
across blocks: all blocks of all streams of a batch step through their samples together, one numpy
operation per sample place instead of one per sample. A stream is whole and self-contained in its row.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import shared

PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17
TELEPHONE_RATE = 8000
#: Payloads are padded with zero bytes to a positive multiple of this.
FRAME = 64
#: Samples of a stream that are resampled and measured at once.
CHUNK = 1 << 20
#: Bytes of files that are decoded at once.
BATCH_BYTES = 1 << 20


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    step, place = (code & 0x70) >> 4, (code & 0x0F) << 4
    size = np.where(step == 0, place + 8, place + 0x108 << np.maximum(step - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


#: Index changes of IMA ADPCM.
INDEX_CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
#: Step sizes of IMA ADPCM.
STEP_SIZES = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97,
        107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796,
        876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428,
        4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350,
        22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)
_CODE = np.arange(16)
#: Change of the sample by step index and code.
_CHANGES = np.where(_CODE & 8, -1, 1) * sum((STEP_SIZES[:, None] >> shift) * ((_CODE >> bit & 1) if bit is not None else 1) for shift, bit in ((3, None), (2, 0), (1, 1), (0, 2)))
#: ADPCM blocks that are decoded together.
BLOCKS = 16_384


def _decoded_blocks(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM blocks of one size (rows), all blocks stepping through their samples together."""
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    codes = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), np.uint8)
    codes[0::2], codes[1::2] = blocks[:, 4:].T & 15, blocks[:, 4:].T >> 4
    samples = np.empty((len(codes) + 1, len(blocks)), np.int16)
    samples[0] = value
    for j, code in enumerate(codes):
        value = np.clip(value + _CHANGES[index, code], -32768, 32767)
        index = np.clip(index + INDEX_CHANGES[code], 0, 88)
        samples[j + 1] = value
    return samples.T


def decode_adpcm(streams: list[bytes], block_bytes: int) -> list[np.ndarray]:
    """Mono IMA ADPCM streams: blocks of a 4-byte header (first sample, step index) and packed nibbles.

    The blocks of all streams are decoded together, about ``BLOCKS`` at once; last short blocks to
    their own length."""
    if block_bytes < 5:
        raise ValueError("an ADPCM block has a header and samples")
    whole = [np.frombuffer(x, np.uint8, len(x) // block_bytes * block_bytes).reshape(-1, block_bytes) for x in streams]
    blocks = np.concatenate([np.zeros((0, block_bytes), np.uint8), *whole])
    samples = np.concatenate([np.zeros((0, 2 * block_bytes - 7), np.int16), *(_decoded_blocks(blocks[at : at + BLOCKS]) for at in range(0, len(blocks), BLOCKS))])
    out, at = [], 0
    for stream, own in zip(streams, whole, strict=True):
        parts = [samples[at : at + len(own)].reshape(-1)]
        short = np.frombuffer(stream, np.uint8, offset=own.size)
        if len(short) > 4:
            parts.append(_decoded_blocks(short[None])[0])
        out.append(np.concatenate(parts))
        at += len(own)
    return out


def wav(codec: int, rate: int, data: bytes, block_bytes: int = 1, bits: int = 8) -> bytes:
    """A RIFF file of one channel around ``data``."""
    head = struct.pack("<HHIIHHH", codec, 1, rate, rate * block_bytes, block_bytes, bits, 0)
    fact = struct.pack("<4sII", b"fact", 4, len(data))
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(head)) + head + fact + struct.pack("<4sI", b"data", len(data)) + data
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def parse_wav(media: bytes) -> tuple[int, int, int, memoryview]:
    """Codec, rate, block bytes and samples of a RIFF file."""
    view = memoryview(media)
    if len(view) < 12 or view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, head = 12, (0, 0, 0)
    while at + 8 <= len(view):
        name, size = struct.unpack_from("<4sI", view, at)
        at += 8
        if name == b"fmt ":
            codec, _, rate, _, block_bytes = struct.unpack_from("<HHIIH", view, at)
            head = (codec, rate, block_bytes)
        elif name == b"data":
            return *head, view[at : at + size]
        at += size + (size & 1)
    raise ValueError("the file has no data chunk")


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def decode(codec: int, data: bytes | memoryview, block_bytes: int = 1) -> np.ndarray:
    if codec in TABLES:
        return TABLES[codec][np.frombuffer(data, np.uint8)]
    if codec == ADPCM:
        return decode_adpcm([bytes(data)], block_bytes)[0]
    if codec == PCM:
        return np.frombuffer(data, "<i2")
    raise ValueError(f"codec {codec} is not a telephony codec")


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation at the new rate's instants, in fixed point; the last sample holds."""
    if rate == to or not len(pcm):
        return pcm.astype(np.int16)
    n = len(pcm) * to // rate
    out = np.empty(n, np.int16)
    for at in range(0, n, CHUNK):
        place = np.arange(at, min(n, at + CHUNK), dtype=np.int64) * rate
        left, part = place // to, place % to
        right = np.minimum(left + 1, len(pcm) - 1)
        a, b = pcm[left].astype(np.int64), pcm[right].astype(np.int64)
        out[at : at + len(place)] = (a * (to - part) + b * part) // to
    return out


def _between(even: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` samples between those at even places, halfway; the last sample holds."""
    after = np.append(even[1:], even[-1:])
    return ((even.astype(np.int32) + after) >> 1).astype(np.int16)[:n]


#: Values of each companding table in order, and the place of each 16-bit value among them, -1 without one.
_VALUES = {law: np.unique(TABLES[law]).astype("<i2") for law in (MULAW, ALAW)}
_PLACES = {law: np.full(1 << 16, -1, np.int16) for law in _VALUES}
for _law, _values in _VALUES.items():
    _PLACES[_law][_values.view(np.uint16)] = np.arange(len(_values))


def pack_pcm(pcm: np.ndarray) -> bytes:
    """16-bit samples without loss: those at even places, in a byte each where all are values of one
    companding table, and how the others differ from halfway between, if any does. ``unpack_pcm`` gives
    the samples back."""
    pcm = np.ascontiguousarray(pcm, "<i2")
    even, odd = np.ascontiguousarray(pcm[::2]), pcm[1::2]
    rest = odd - _between(even, len(odd))  # modulo 2**16
    law, body = 0, even
    for kind, places in _PLACES.items():
        found = places[even.view(np.uint16)]
        if (found >= 0).all():
            law, body = kind, found.astype(np.uint8)
            break
    other = bool(rest.any())
    return struct.pack("<BBQ", law, other, len(pcm)) + body.tobytes() + (rest.tobytes() if other else b"")


def unpack_pcm(packed: bytes | memoryview) -> np.ndarray:
    """Inverse of ``pack_pcm``."""
    law, other, n = struct.unpack_from("<BBQ", packed)
    body = np.frombuffer(packed, np.uint8 if law else "<i2", n - n // 2, 10)
    even = _VALUES[law][body] if law else body
    out = np.empty(n, np.int16)
    out[::2], out[1::2] = even, _between(even, n // 2)
    if other:
        out[1::2] += np.frombuffer(packed, "<i2", n // 2, 10 + body.nbytes)
    return out


def features(pcm: np.ndarray, rate: int) -> str:
    """Level, zero crossings and extremes of resampled PCM, with its checksum, as one string."""
    squares = sum(int((wide * wide).sum()) for at in range(0, len(pcm), CHUNK) for wide in [pcm[at : at + CHUNK].astype(np.int64)])
    energy = math.sqrt(squares / len(pcm)) if len(pcm) else 0.0
    crossings = int(((pcm[1:] < 0) != (pcm[:-1] < 0)).sum()) if len(pcm) else 0
    low, high = (int(pcm.min()), int(pcm.max())) if len(pcm) else (0, 0)
    return f"rate={rate};n={len(pcm)};rms={energy:.3f};zc={crossings};min={low};max={high};pcm={zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def decode_files(files: list[bytes | None]) -> list[tuple[int, np.ndarray, int] | str | None]:
    """For each RIFF file its codec, samples and rate, or what is wrong with it; ADPCM streams of one
    block size are decoded together."""
    out: list[tuple[int, np.ndarray, int] | str | None] = [None] * len(files)
    adpcm: dict[int, list[tuple[int, int, bytes]]] = {}
    for i, value in enumerate(files):
        if value is None:
            continue
        try:
            codec, rate, block_bytes, data = parse_wav(value)
            if not rate:
                raise ValueError("the file has no sample rate")
            if codec == ADPCM and block_bytes > 4:
                adpcm.setdefault(block_bytes, []).append((i, rate, bytes(data)))
            else:
                out[i] = codec, decode(codec, data, block_bytes), rate
        except (ValueError, struct.error) as problem:
            out[i] = str(problem)
    for block_bytes, own in adpcm.items():
        for (i, rate, _), pcm in zip(own, decode_adpcm([x[2] for x in own], block_bytes), strict=True):
            out[i] = ADPCM, pcm, rate
    return out


def _some(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose values in ``column`` are about ``BATCH_BYTES`` together, one row at least."""
    ends = np.cumsum([0 if not v.is_valid else len(v.as_buffer()) for v in batch.column(batch.schema.get_field_index(column))])
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES)) - at)
        yield batch.slice(at, n)
        at += n


def decode_media(media: DataFrame, rate: int = 16_000, packed: bool = False) -> DataFrame:
    """Add to ``media(media binary, ...)``: codec, n_samples, pcm (16-bit, ``rate``; ``packed`` by
    ``pack_pcm``), problem.

    Null media gives nulls; a file that is no telephony RIFF gives nulls too and its reason in
    ``problem``; a file without samples has empty pcm. Files of any length are decoded whole, equal
    files alike. Columns of those names in the input are replaced; others pass through."""
    added = {"codec": "int", "n_samples": "long", "pcm": "binary", "problem": "string"}
    kept = media.drop(*added)
    coded = pack_pcm if packed else lambda pcm: pcm.astype("<i2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _some(whole, "media"):
                files = [v.as_buffer().to_pybytes() if v.is_valid else None for v in batch.column(batch.schema.get_field_index("media"))]
                done = [(x[0], resample(x[1], x[2], rate)) if isinstance(x, tuple) else x for x in decode_files(files)]
                good = [x if isinstance(x, tuple) else None for x in done]
                more = [
                    pa.array([x and x[0] for x in good], pa.int32()), pa.array([x and len(x[1]) for x in good], pa.int64()),
                    pa.array([x and coded(x[1]) for x in good], pa.binary()), pa.array([x if isinstance(x, str) else None for x in done], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + "".join(f", {c} {t}" for c, t in added.items())
    return kept.mapInArrow(run, schema)


def dealt_codec(payload: bytes) -> int:
    """Mu-law, A-law or ADPCM by the payload's crc32, so that equal payloads are stored alike."""
    return (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]


def bytes_to_media(docs: DataFrame, codec: int | None = None, rate: int = TELEPHONE_RATE) -> DataFrame:
    """``docs(doc_id, text)`` as (doc_id, n_bytes, media): the text's UTF-8 bytes, zero-padded to a
    positive multiple of ``FRAME``, are the 8-bit codes of a companded RIFF file or the blocks of an
    ADPCM one, each of ``FRAME`` bytes; without ``codec`` by ``dealt_codec``. Null is empty, texts of
    any length are whole, equal texts are stored alike, repeated rows stay, further columns are ignored."""
    if codec is not None and codec not in (*TABLES, ADPCM):
        raise ValueError("bytes are stored as mu-law, A-law or ADPCM")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media, sizes = [], []
            for value in batch.column(1):
                data = bytes(value.as_buffer()) if value.is_valid else b""
                sizes.append(len(data))
                payload = data.ljust(max(FRAME, -(-len(data) // FRAME) * FRAME), b"\0")
                own = codec or dealt_codec(payload)
                media.append(wav(own, rate, payload, FRAME, 4) if own == ADPCM else wav(own, rate, payload))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_digests(stored: DataFrame) -> DataFrame:
    """``stored(media, ...)`` with the digests of the media and of the payload read back from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(batch.schema.get_field_index("media")):
                media = value.as_buffer()
                payload = parse_wav(media)[3]
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], [*batch.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema)
    return stored.mapInArrow(run, schema + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string")


def pcm_features(stored: DataFrame, rate: int = 16_000, packed: bool = False) -> DataFrame:
    """``stored(pcm, ...)`` with ``feature`` of the samples in place of ``pcm`` (``packed`` by ``pack_pcm``);
    null for null."""
    kept = stored.drop("pcm")
    others = kept.columns
    samples = unpack_pcm if packed else lambda raw: np.frombuffer(raw, "<i2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(samples(v.as_buffer()), rate) if v.is_valid else None for v in batch.column(batch.schema.get_field_index("pcm"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in others), pa.array(found, pa.string())], [*others, "feature"])

    return stored.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", feature string")


def store_texts_as_media(docs: DataFrame) -> DataFrame:
    """Write ``docs(doc_id, text)`` as media of all three codecs to the shared folder, read them back,
    write their resampled PCM there too, coded without loss, and return digests of the media and features
    of the PCM as read back.

    Null and empty texts have one frame of zero bytes; texts of any length are whole; equal texts have
    equal values; repeated rows and null doc_ids are rows like others; further columns are ignored; an
    empty table gives an empty one. Both tables stay for whoever uses them."""
    media, _ = shared.staged(bytes_to_media(docs), "media", codec="zstd", level=9)
    decoded = decode_media(media_digests(media.select("doc_id", "n_bytes", "media")), packed=True).drop("media", "n_samples", "problem")
    # a column for each codec, as samples of one kind compress better among themselves
    columns = {f"pcm_{c}": F.when(F.col("codec") == c, F.col("pcm")) for c in (MULAW, ALAW, ADPCM)}
    pcm, _ = shared.staged(decoded.withColumns(columns).drop("pcm", "codec"), "pcm", codec="zstd", level=9)
    out = pcm_features(pcm.withColumn("pcm", F.coalesce(*columns)).drop(*columns), packed=True)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.col("feature"))
