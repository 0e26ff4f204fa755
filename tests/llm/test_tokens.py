import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspur.llm import bpe, pretokens, token_store

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LIBRARY = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = "abcsStTmMdDrevl'' ' \n\t\r  12é́ß  ٣Ⅷ漢字🙂!?.$-_\x1c\x85"


def texts(n=3000, seed=1):
    rng = random.Random(seed)
    made = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [*made, None, "", "a" * 5000, "ab " * 3000, " " * 3000, "'" * 300, "hello'" * 50, "x're", "'ll", "  'll", "a 's", "<|endoftext|> <|x|>", "a<|endoftext|>b", "x<|endoftext|", "<|endoftext|><|endoftext|>"]


def reference():
    codec = bpe.ranks(MULTI)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def encoded(column, cache):
    return [ids[a:b].tolist() for ids, rows, _, _ in bpe.encode_column(column, cache, pretokens.classes_of_tiktoken()) for a, b in zip(rows, rows[1:])]


def test_ids_equal_the_library_s():
    given = texts()
    encoding = reference()
    assert encoded(pa.array(given, pa.string()), bpe.ranks(MULTI).cache) == [encoding.encode_ordinary(t or "") for t in given]


def test_a_full_cache_and_long_runs():
    codec = bpe.Ranks(MULTI)
    codec.cache = bpe.SliceCache(codec.merge_all, size=7)
    given = texts(200, 5)
    encoding = reference()
    assert encoded(pa.array(given, pa.string()), codec.cache) == [encoding.encode_ordinary(t or "") for t in given]


def thue_morse(n, a, b):
    return "".join((a, b)[bin(k).count("1") % 2] for k in range(n))


def test_unlike_slices_of_equal_hash_or_structure():
    given = [thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a"), thue_morse(128, "a", "b"), thue_morse(128, "b", "a")]
    encoding = reference()
    codec = bpe.Ranks(MULTI)
    assert encoded(pa.array(given), codec.cache) == [encoding.encode_ordinary(t) for t in given]
    words = ["".join(random.Random(k).choices("abcde", k=3 + k % 30)) for k in range(300)]
    hashed, bpe.word_hashes = bpe.word_hashes, lambda buf, starts, ends: np.full(len(starts), 7, np.uint64)
    try:  # every slice has the same hash
        codec = bpe.Ranks(MULTI)
        assert encoded(pa.array(words), codec.cache) == [encoding.encode_ordinary(t) for t in words]
        assert encoded(pa.array(words[::-1]), codec.cache) == [encoding.encode_ordinary(t) for t in words[::-1]]
    finally:
        bpe.word_hashes = hashed


def test_every_code_point_in_both_libraries():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    given = ["".join(f"1{c}a {c}" for c in points[at : at + 2048]) for at in range(0, len(points), 2048)]
    column, encoding, tokenizer = pa.array(given), reference(), Tokenizer.from_file(LIBRARY)
    assert encoded(column, bpe.Ranks(MULTI).cache) == encoding.encode_ordinary_batch(given)
    parts = token_store.encode_texts(column, LIBRARY, pretokens.classes_of_file(LIBRARY))
    ours = [ids[a:b].tolist() for ids, rows in parts for a, b in zip(rows, rows[1:])]
    assert ours == [e.ids for e in tokenizer.encode_batch(given, add_special_tokens=False)]


@pytest.mark.parametrize("width", [1, 3, 512])
def test_block_scan_is_the_automaton(width):
    rng = np.random.default_rng(0)
    code = rng.integers(0, 16, 4000).astype(np.uint8)
    move, mark = pretokens.tables()
    state, expected = pretokens.FRESH, []
    for c in code.tolist():
        expected.append(bool(mark[c * pretokens.STATES + state]))
        state = int(move[c * pretokens.STATES + state])
    assert pretokens.scan(code, width=width, lead=min(width, 2)).tolist() == expected


def test_encode_decode_columns(spark):
    given = texts(300, 2)
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(given)], "doc_id bigint, text string, ids int")
    ids = bpe.encode(df, MULTI)
    rows = {r.doc_id: r for r in ids.collect()}
    encoding = reference()
    for k, t in enumerate(given):
        assert rows[k].ids == encoding.encode_ordinary(t or "")
        raw = (t or "").encode()
        starts = [*rows[k].slice_starts, len(raw)]
        assert b"".join(raw[a:b] for a, b in zip(starts, starts[1:])) == raw and len(set(starts)) == len(starts)
    assert {r.doc_id: bytes(r.bytes) for r in bpe.decode(ids, MULTI).collect()} == {k: (t or "").encode() for k, t in enumerate(given)}
    for r in bpe.round_trip(df, MULTI).collect():
        own = encoding.encode_ordinary(given[r.doc_id] or "")
        assert r.n_tokens == len(own) and r.ids_sha256 == hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((given[r.doc_id] or "").encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), MULTI).count() == 0


def test_token_store(spark, tmp_path):
    given = texts(400, 3)
    order = list(range(len(given)))
    random.Random(0).shuffle(order)
    df = spark.createDataFrame([(k * 3, given[k], "x") for k in order], "doc_id bigint, text string, ids string").repartition(5)
    store = f"file://{tmp_path}/store"
    token_store.write(df, store, LIBRARY)
    tokenizer = Tokenizer.from_file(LIBRARY)
    start = 0
    rows = {r.doc_id: r for r in token_store.starts(token_store.index(spark, store)).collect()}
    for k, t in enumerate(given):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        r = rows[k * 3]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [r.doc_id for r in token_store.lookup(spark, store, [30, 31]).collect()] == [30]
    token_store.write(df.limit(0), store + "-empty", LIBRARY)
    assert token_store.starts(token_store.index(spark, store + "-empty")).count() == 0
    repeated = spark.createDataFrame([(5, "a"), (5, "a"), (None, "b")], "doc_id bigint, text string")
    token_store.write(repeated, store + "-odd", LIBRARY)
    odd = token_store.starts(token_store.index(spark, store + "-odd")).orderBy(F.asc_nulls_first("doc_id"), "start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in odd] == [(None, 0, 2), (5, 2, 2), (5, 4, 2)]


def test_new_slices_are_encoded_by_one_call(monkeypatch):
    """Odd slices, more than a call takes, as the library has each by itself."""
    import public_tokenizers
    from larkspur.llm import token_store

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, calls = token_store.library(path), []

    class Counted:
        def encode(self, texts, **kw):
            calls.append(len(texts))
            return library.encode(texts, **kw)

    monkeypatch.setattr(token_store, "library", lambda path: Counted())
    slices = [" ", "  ", "\n\n", " the", "é", " été", "\U0001f600\U0001f600", "'ll", "　", "a" * 300, "\x00", "...?!"] + [f" w{k}x" for k in range(2500)]
    encoded = token_store.library_cache.__wrapped__(path).encode([s.encode() for s in slices])
    assert [list(memoryview(e).cast("i")) for e in encoded] == [library.encode(s, add_special_tokens=False).ids for s in slices]
    assert calls == [2000, 512]
