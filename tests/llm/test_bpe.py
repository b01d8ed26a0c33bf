from __future__ import annotations

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from barsmith.llm import bpe
from barsmith.llm.common import read

from .edges import EDGE_SCHEMA, TEXTS, edge

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def pair():
    ranks = bpe.load_ranks(PATH)
    return bpe.Codec(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_strings(pair):
    codec, known = pair
    r = random.Random(1)
    parts = ["a", "b", "e", "th", "ing", " ", "  ", "\n", "é", "ß", "中文", "123", "don't", "!!", "\t", "\x1c", " ", "aaaa", "\U0001f600", " \n", "<|endoftext|>"]
    for _ in range(3000):
        x = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        ids, joined = codec.encode(x)
        assert ids == known.encode_ordinary(x) and joined == ",".join(map(str, ids)) and codec.decode(ids) == x.encode()


def test_long_piece_is_linear(pair):
    codec, known = pair
    x = "abcab" * 20_000
    assert codec.encode(x)[0] == known.encode_ordinary(x)


def test_query_against_the_library(spark, pair):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in read(spark, sf, "documents").collect()}
    for r in bpe.op3_bpe(spark, sf).collect():
        ids = pair[1].encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_round_trip_and_edges(spark):
    out = bpe.encode(edge(spark), PATH, P.PATTERN)
    rows = out.collect()
    assert len(rows) == len(TEXTS) and all(r.n_tokens == len(r.ids) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {0}
    back = sorted((r.doc_id or 0, bytes(r.bytes)) for r in bpe.decode(out, PATH, P.PATTERN).collect())
    assert back == sorted((i or 0, (t or "").encode()) for i, t, *_ in TEXTS)
    assert bpe.encode(spark.createDataFrame([], EDGE_SCHEMA), PATH, P.PATTERN).count() == 0


def test_words_are_encoded_once_with_and_without_marks(pair, monkeypatch):
    codec = bpe.Codec(pair[0].ranks, P.PATTERN)
    seen, plain = [], codec.encode_piece
    monkeypatch.setattr(codec, "encode_piece", lambda piece: (seen.append(piece), plain(piece))[1])
    for x in ("x tiontioxq tiontioxq, (tiontioxq) tiontioxq.", "y qzqzö, qzqzö qzqzö."):
        assert codec.encode(x)[0] == pair[1].encode_ordinary(x)
    assert seen.count(b" tiontioxq") == seen.count(" qzqzö".encode()) == 1


def test_small_caches_change_nothing(pair, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    monkeypatch.setattr(bpe, "GENERATION", 2)
    codec, r = bpe.Codec(pair[0].ranks, P.PATTERN), random.Random(2)
    for _ in range(300):
        x = " ".join(r.choice(["ab", "abé", "qx,", "don't", "K's", "x1", "ſ", "", "\tq", "a!b"]) for _ in range(r.randint(0, 20)))
        assert codec.encode(x) == (ids := pair[1].encode_ordinary(x), ",".join(map(str, ids)))
