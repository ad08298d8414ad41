import random
import tracemalloc
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import queries, token_shards
from sparkloom.llm.token_shards import CachedEncoder, Shard, encode_shard
from tests.llm import helpers


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 10_001])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50257, n), np.full(n, 7), np.where(rng.random(n) < 0.01, 2**32 - 1, rng.integers(0, 9, n))):
        ids = ids.astype(np.uint32)
        shard = Shard(encode_shard(ids, [None, -5], np.array([0, n // 2])))
        assert (shard.ids(0, n) == ids).all()
        assert (shard.ids(n // 3, n // 2) == ids[n // 3 : n // 2]).all()
        assert shard.doc_ids == [None, -5] and shard.doc_starts.tolist() == [0, n // 2, n]


def test_outliers_go_to_exceptions():
    ids = np.arange(2048, dtype=np.uint32) % 16
    ids[5] = 2**31
    shard = Shard(encode_shard(ids, [1], np.array([0])))
    assert shard.widths.tolist() == [4] and shard.counts.tolist() == [1]


def test_packing_takes_little_memory():
    ids = np.minimum(np.random.default_rng(0).zipf(1.3, 1_000_000), 50_000).astype(np.uint32)
    tracemalloc.start()
    try:
        data = encode_shard(ids, [1], np.array([0]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 2 * ids.nbytes
    assert (Shard(data).ids(0, len(ids)) == ids).all()


def test_not_a_shard():
    with pytest.raises(ValueError):
        Shard(b"x" * 100)


def test_encoder_equals_the_library():
    path = queries.tokenizer_path()
    model = Tokenizer.from_file(path)
    random.seed(1)
    letters = [*map(chr, [*range(9, 14), *range(32, 127), *range(160, 400)]), "日", "😀", " ", " ", "\n", "'s", "\x1c"]
    texts = ["", "it's we'll I'D", "a  b\n\n c", "<|endoftext|> x", "plain<|endoftext|>", "<|endoftext|", "<|endoftext|><|endoftext|>", helpers.LONG] + ["".join(random.choices(letters, k=random.randint(0, 50))) for _ in range(3000)]
    for one, own in zip(model.encode_batch(texts, add_special_tokens=False), CachedEncoder(path)(texts), strict=True):
        assert np.array(one.ids, "<u4").tobytes() == own


def brute(rows):
    model = Tokenizer.from_file(queries.tokenizer_path())
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):  # no doc_id has two texts
        ids = model.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard_ids", [token_shards.SHARD_IDS, 50])
def test_against_brute_force(spark, tmp_path, shard_ids):
    docs = helpers.documents(spark)
    folder = str(tmp_path / "shards")
    manifest = token_shards.write_token_shards(docs, folder, queries.tokenizer_path(), 2, shard_ids=shard_ids)
    got = token_shards.read_token_shards(manifest, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_strings_of_special_tokens_are_the_librarys():
    assert np.frombuffer(CachedEncoder(queries.tokenizer_path())(["<|endoftext|>"])[0], "<u4").tolist() == [50256]


def test_rows_without_doc_id_are_dealt_out(spark, tmp_path):
    docs = spark.createDataFrame([(None, f"text {i}") for i in range(400)], "doc_id long, text string")
    manifest = token_shards.write_token_shards(docs, str(tmp_path / "none"), queries.tokenizer_path(), 2)
    assert manifest.where("n_docs < 250").count() == manifest.count() > 1


def test_empty_table(spark, tmp_path):
    assert token_shards.token_shards(helpers.empty(spark), queries.tokenizer_path(), 2, str(tmp_path / "none")).count() == 0


def test_relative_folder_is_refused(spark):
    with pytest.raises(ValueError):
        token_shards.token_shards(helpers.empty(spark), queries.tokenizer_path(), 2, "here")
