import base64
import hashlib
import os
import random
import tempfile
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from marketloom.llm import bpe, bytelevel, range_coder, token_files
from pyspark.sql import functions as F

from marketloom.llm.bpe import BytePairs, encode_and_decode, heap_fold, load_ranks
from marketloom.llm.token_counts import count_tokens, whole_tokens

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def classes(library):
    return np.frombuffer(bytelevel.class_table(library.pre_tokenizer), dtype=np.uint8)


def odd_strings(n, seed):
    rnd = random.Random(seed)
    parts = [*"aZé1½ \t\n\r'stmdrevl.!_", "\x85", "\xa0", "\u2003", "漢", "٣", "😀", "'s", "'ll", "'re", "  ", "\x1c", "<|endoftext|>"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_pre_tokens_are_the_library_s(library, classes):
    texts = odd_strings(3000, 1)
    pre = bytelevel.PreTokens(texts, classes)
    for i, t in enumerate(texts):
        got = [pre.words[w] for w in pre.which[pre.first[i]:pre.first[i + 1]]]
        assert got == [t[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(t)], repr(t)


def test_whole_tokens_are_single(library):
    proven = whole_tokens(library)
    assert len(proven) > 40_000 and all(len(library.encode(t, add_special_tokens=False).ids) == 1 for t in proven[::500])


def test_counts(spark, odd_docs, no_docs, library):
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd_strings(300, 2))], "doc_id long, text string")
    df = odd_docs.select("doc_id", "text").union(extra)
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
    got = count_tokens(df, JSON).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want and all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert count_tokens(no_docs, JSON).count() == 0
    # A tokenizer that the fast path does not cover is asked text by text.
    other = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r.doc_id: r.n_tokens for r in count_tokens(extra.limit(50), P.path("word_bpe_49k.json")).collect()}
    assert all(got[r.doc_id] == len(other.encode(r.text, add_special_tokens=False).ids) for r in extra.limit(50).collect() if r.doc_id in got)


def test_range_coder_round_trip():
    rng = np.random.default_rng(5)
    blocks = [np.minimum(rng.zipf(1.3, n) - 1, 999) for n in (0, 1, 2, 5000, 4096, 2048, 2049)] + [np.zeros(3000, dtype=int), np.full(10, 999), np.resize(rng.integers(0, 1000, 50), 4000)]
    data = range_coder.encode(blocks, 1000)
    for lanes in (1, 3, len(blocks)):  # the result does not depend on what is decoded together
        for i in range(0, len(blocks), lanes):
            for a, b in zip(range_coder.decode(data[i:i + lanes], [len(b) for b in blocks[i:i + lanes]], 1000), blocks[i:i + lanes], strict=True):
                assert np.array_equal(a, b)
    assert len(data[7]) < 200 and len(data[9]) < 1500  # repeats cost little
    assert range_coder.encode([], 10) == [] and range_coder.decode([], [], 10) == []


def test_damage_is_noticed(tmp_path, spark, odd_docs):
    path = str(tmp_path / "t")
    token_files.write_tokens(odd_docs, path, JSON)
    data = bytes(spark.read.parquet(path).filter("n_ids > 1000").first()["data"])
    assert len(token_files.decode_blocks([data])) == 1
    with pytest.raises(ValueError):
        token_files.decode_blocks([data[:40] + bytes([data[40] ^ 1]) + data[41:]])
    with pytest.raises(ValueError):
        token_files.decode_blocks([b"XXXX" + data[4:]])


def test_crc_join():
    a, b = b"some bytes", b"and others" * 99
    assert token_files.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b) and token_files.crc32_join(5, zlib.crc32(b""), 0) == 5


def test_token_files(spark, odd_docs, no_docs, library, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(odd_docs, path, JSON)
    got = sorted(token_files.token_index(spark, path).collect(), key=lambda r: r.start)
    ids = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
    rows = odd_docs.collect()
    assert [r.id for r in got] == sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x or 0))
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in {(len(x), zlib.crc32(x.tobytes())) for x in (ids(d.text) for d in rows if d.doc_id == r.id)}
        at += r.n_tokens
    assert at == sum(len(ids(d.text)) for d in rows) > 2 * token_files.BLOCK  # one document spans blocks
    token_files.write_tokens(no_docs, str(tmp_path / "none"), JSON)
    assert token_files.token_index(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("bounds", [{}, {"table_words": 10, "shard_bytes": 2_000}, {"table_words": 0}])
def test_byte_bpe(spark, odd_docs, no_docs, bounds):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = odd_strings(150, 3) + ["a" * 300, "ab" * 200, "é" * 99, "a" * 100_000, "Zm9vYmFy" * 2_000, " " * 50_000, "-" * 3_000 + "x"]
    rows = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    df = rows.selectExpr("doc_id", "text", "'mine' AS shard", "1 AS word", "'old' AS IDS")
    got = encode_and_decode(df, RANKS, P.PATTERN, **bounds)
    assert got.columns == ["doc_id", "text", "shard", "word", "ids", "decoded"]
    got = got.collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(r.doc_id), str(r.text)) for r in rows.collect())
    for r in got:
        assert r.ids == library.encode_ordinary(r.text or ""), repr(r.text)[:80]
        assert bytes(r.decoded) == (r.text or "").encode() and r.shard == "mine"
    assert encode_and_decode(no_docs, RANKS, P.PATTERN, **bounds).count() == 0


def test_heap_and_fold_agree(spark):
    coder = BytePairs(load_ranks(RANKS))
    rnd = random.Random(8)
    words = [bytes(rnd.choice(b" aeiouns\xc3\xa9t") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(bytearray(w),) for w in words], "word binary")
    for r in df.select("word", coder.fold(F.col("word")).alias("ids"), coder.decode(coder.fold(F.col("word"))).alias("back")).collect():
        assert r.ids == heap_fold(bytes(r.word), coder.singles, coder.pairs) and r.back == r.word


def test_other_patterns(spark):
    """A pattern that the numpy classes do not stand for, and pieces that merges do not lead to."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"xyz": 257}
    coder = BytePairs(ranks)
    assert coder.odd == {b"xyz": 257}
    library = tiktoken.Encoding("own", pat_str=r"[a-z]+|[0-9]", mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(1, "abab 12 xyz xyzab"), (2, "é 9")], "doc_id int, text string")
    path = os.path.join(tempfile.mkdtemp(), "ranks")
    with open(path, "w") as f:
        f.writelines(f"{base64.b64encode(k).decode()} {v}\n" for k, v in ranks.items())
    got = {r.text: r.ids for r in encode_and_decode(df, path, r"[a-z]+|[0-9]").collect()}
    assert got == {t: library.encode_ordinary(t) for t in got}


def test_digest_of_ids():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_word_table_is_laid_out_in_little_more_than_its_size():
    """All places at once took 24 bytes an id, which the driver could not spare in the pipeline."""
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 40, 300_000)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    h, flat = rng.permutation(300_000).astype(np.uint64), rng.integers(0, 50_000, offsets[-1]).astype("u2")
    tracemalloc.start()
    try:
        t = bpe.WordTable(h, flat, offsets)
        assert tracemalloc.get_traced_memory()[1] < 8 * len(flat)
    finally:
        tracemalloc.stop()
    at = np.argsort(h)
    for i in (0, 1, 65_535, 65_536, 299_999):
        assert t.flat[t.at[i]:t.at[i + 1]].tolist() == flat[offsets[at[i]]:offsets[at[i] + 1]].tolist()
