import hashlib
import zlib

import numpy as np
import pytest

from sparkloom.llm import media, shared
from tests.llm import helpers


def test_companding_tables():
    mulaw, alaw = media.mulaw_table(), media.alaw_table()
    # fixed points of the two laws
    assert mulaw[[0x00, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert alaw[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    assert (np.sort(np.unique(np.abs(mulaw.astype(int))))[1:] > 0).all() and len(np.unique(alaw)) == 256


def plain_adpcm(block):
    """One sample after the other."""
    value, index = int.from_bytes(block[:2], "little", signed=True), min(88, block[2])
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEP_SIZES[index])
            change = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                change += part if code & bit else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(media.INDEX_CHANGES[code])))
            out.append(value)
    return out


@pytest.mark.parametrize("size", [0, 3, 36, 256, 256 * 3, 256 * 3 + 40, 256 * 2 + 4])
def test_adpcm_equals_plain_decoding(size):
    data = np.random.default_rng(size).integers(0, 256, size).astype(np.uint8).tobytes()
    want = [s for at in range(0, size, 256) if len(data[at : at + 256]) == 256 or len(data[at : at + 256]) > 4 for s in plain_adpcm(data[at : at + 256])]
    assert media.decode_adpcm([data], 256)[0].tolist() == want
    together = media.decode_adpcm([data, b"", data[: size // 2], data], 256)
    assert together[0].tolist() == together[3].tolist() == want and not len(together[1])


def test_resample():
    pcm = np.array([0, 100, -100], np.int16)
    assert media.resample(pcm, 8000, 16000).tolist() == [0, 50, 100, 0, -100, -100]
    assert media.resample(pcm, 8000, 8000).tolist() == pcm.tolist()
    assert len(media.resample(pcm[:0], 8000, 16000)) == 0
    long = np.random.default_rng(0).integers(-32768, 32767, media.CHUNK + 999).astype(np.int16)
    place = np.arange(2 * len(long)) * 8000
    right = np.minimum(place // 16000 + 1, len(long) - 1)
    part = place % 16000
    want = (long[place // 16000].astype(int) * (16000 - part) + long[right].astype(int) * part) // 16000
    assert (media.resample(long, 8000, 16000) == want).all()


def test_decode_media_keeps_pcm_and_names_problems(spark):
    good = media.wav(media.ALAW, 8000, bytes(range(64)))
    adpcm = media.wav(media.ADPCM, 8000, bytes(256), 256, 4)
    df = spark.createDataFrame([(1, good), (2, None), (3, b"RIFF"), (4, adpcm), (5, media.wav(99, 8000, b"x"))], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in media.decode_media(df, 16_000).collect()}
    assert got[1]["n_samples"] == 128 and len(got[1]["pcm"]) == 256 and got[1]["codec"] == media.ALAW
    assert got[2]["pcm"] is None and got[2]["problem"] is None
    assert got[3]["pcm"] is None and "RIFF" in got[3]["problem"]
    assert got[4]["n_samples"] == 2 * 505 and "99" in got[5]["problem"]


def test_texts_as_media(spark):
    docs = helpers.documents(spark)
    got = media.store_texts_as_media(docs).collect()
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert len(got) == docs.count()
    by_text, seen = {}, set()
    for r in got:
        data = next((t or "").encode() for d, t in texts if d == r["doc_id"] and len((t or "").encode()) == r["n_bytes"])
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        codec = (media.MULAW, media.ALAW, media.ADPCM)[zlib.crc32(payload) % 3]
        whole = media.wav(codec, 8000, payload, 64, 4) if codec == media.ADPCM else media.wav(codec, 8000, payload)
        seen.add(codec)
        pcm = media.resample(media.decode(codec, payload, 64), 8000, 16000)
        assert r["feature"] == media.features(pcm, 16000)
        assert (r["media_bytes"], r["media_sha256"]) == (len(whole), hashlib.sha256(whole).hexdigest())
        assert by_text.setdefault(data, r["feature"]) == r["feature"]
    assert seen == {media.MULAW, media.ALAW, media.ADPCM}


def test_empty_and_codecs(spark):
    assert media.store_texts_as_media(helpers.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        media.bytes_to_media(helpers.empty(spark), codec=media.PCM)


def test_pcm_is_packed_without_loss():
    rng = np.random.default_rng(5)
    some = [np.zeros(0), [7], [-3, 9], rng.integers(-32768, 32768, 1001), rng.integers(-9, 9, 64), np.repeat([-32768, 32767], 50)]
    text = np.frombuffer(b"some words of a text " * 40, np.uint8)
    dealt = [media.resample(x, 8000, 16000) for x in (*(media.TABLES[c][text] for c in media.TABLES), media.decode_adpcm([text.tobytes()], 64)[0])]
    for pcm in (*some, *dealt):
        pcm = np.array(pcm, np.int16)
        back = media.unpack_pcm(media.pack_pcm(pcm))
        assert back.dtype == np.int16 and np.array_equal(back, pcm)
    assert all(len(media.pack_pcm(x)) < x.nbytes / 1.9 for x in dealt) and all(len(media.pack_pcm(x)) < x.nbytes / 3 for x in dealt[:2])


def test_the_query_stores_packed_pcm(spark, monkeypatch):
    tables, staged = {}, shared.staged
    monkeypatch.setattr(shared, "staged", lambda df, name, *more, **named: tables.setdefault(name, staged(df, name, *more, **named)))
    docs = spark.createDataFrame([(i, f"text number {i} " * 200) for i in range(30)], "doc_id long, text string")
    sizes = {r["doc_id"]: r["payload_bytes"] for r in media.store_texts_as_media(docs).collect()}
    rows = [(r["doc_id"], *(r[c] for c in r.asDict() if c.startswith("pcm") and r[c] is not None)) for r in tables["pcm"][0].collect()]
    # companded: 2 samples of 2 bytes for a byte; ADPCM: 4 samples
    assert len(rows) == 30 and all(len(pcm) < 4.1 * sizes[i] and len(media.unpack_pcm(pcm)) >= 2 * sizes[i] for i, pcm in rows)
    assert min(len(pcm) / sizes[i] for i, pcm in rows) < 1.1
