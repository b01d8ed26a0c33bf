from __future__ import annotations

import hashlib
import random
import struct

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from barsmith.llm import wordbpe
from barsmith.llm.common import read

from .edges import EDGE_SCHEMA, TEXTS, docs, edge

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def known():
    return Tokenizer.from_file(PATH)


def expected(known, text):
    ids = known.encode(text, add_special_tokens=False).ids
    plain = known.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()


def test_query_against_the_library(spark, known):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in read(spark, sf, "documents").collect()}
    rows = wordbpe.op13_words(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(known, texts[r.doc_id])


def test_random_strings_in_small_blocks(spark, known):
    """Accents apart from their letters, special tokens, other white space, final sigma, signs and scripts."""
    r = random.Random(3)
    parts = ["a", "Be", "it's", "'LL", " ", "  ", "\n", "\x0b", "\x85", "\xa0", " ", "　", "é", "́", "ΣΑΣ", "İ", "ß", "中文", "١٢", "12", "don't", "--'s", "!!", "\t", "\x1c", "\x00", "\U0001f600", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", ";", "ﬁ", "​", "</w>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(600)]
    table = docs(spark, [(i, t, "a") for i, t in enumerate(texts)])
    rows = wordbpe.encode(table, PATH, block_chars=2000).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == expected(known, texts[row.doc_id])
        assert row.ids == known.encode(texts[row.doc_id], add_special_tokens=False).ids


def test_decode_joins_pieces(spark, known):
    out = wordbpe.encode(edge(spark), PATH)
    rows = out.collect()
    assert len(rows) == len(TEXTS) and {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {0}
    back = sorted((r.doc_id or 0, r.text) for r in wordbpe.decode(out, PATH).collect())
    assert back == sorted((i or 0, known.decode(known.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t, *_ in TEXTS)
    empty = spark.createDataFrame([], EDGE_SCHEMA)
    assert wordbpe.encode(empty, PATH).count() == 0 and wordbpe.decode(wordbpe.encode(empty, PATH), PATH).count() == 0
