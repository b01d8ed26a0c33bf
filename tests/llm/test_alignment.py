from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from barsmith.llm import alignment as A
from barsmith.llm.common import read

from .edges import EDGE_SCHEMA, LONG, TEXTS, docs, edge

RANKS, MODEL = P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def known():
    first = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    letters = {c: b for b, c in byte_letters().items()}
    names = {i: bytes(letters[c] for c in t) for t, i in first.get_vocab(with_added_tokens=False).items()}
    second = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return first, names, second


def byte_letters():
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def plain_groups(known, text):
    """Lists of (first ids, second ids), token by token."""
    first, names, second = known
    if not text:
        return []
    a = first.encode(" " + text, add_special_tokens=False).ids
    b = second.encode(text)
    spell = lambda i: bytes([int(m[1], 16)]) if (m := re.fullmatch(r"<0x(..)>", second.id_to_piece(i))) and second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
    parts = [names[i] for i in a], [spell(i) for i in b]
    if any(b"".join(x) != (" " + text).encode() for x in parts):
        return []
    ends = [list(np.cumsum([len(x) for x in p])) for p in parts]
    common = sorted(set(ends[0]) & set(ends[1]))
    out, done = [], [0, 0]
    for c in common:
        here = [bisect_right(e, c) for e in ends]
        out.append((a[done[0] : here[0]], b[done[1] : here[1]]))
        done = here
    return out


def plain(known, rows):
    groups = [plain_groups(known, t) for _, t in rows]
    count = Counter(p for g in groups for p in {(x, y) for a, b in g for x in a for y in b})
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (i, _), g in zip(rows, groups, strict=True):
        links = [(x, y) for a, b in g for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((i or 0, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out)


def got(df):
    return sorted((r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


PARTS = ["a", "The", "'s", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "　", "é", "é", "▁", "中文字", "١٢", "123", "don't", "--", "!!", "\x00", "\U0001f600", "<|endoftext|>", "<s>", "<0x41>", "aaaaaaaaa", "tokenization", "ing "]


def test_random_strings_in_small_ranges(spark, known):
    """Ranges of a few bytes: borders fall inside tokens, groups and characters, and long texts take several steps of the tree."""
    r = random.Random(2)
    rows = [(i, "".join(r.choice(PARTS) for _ in range(r.randint(0, 60)))) for i in range(150)]
    table = docs(spark, [(i, t, "a") for i, t in rows])
    want = plain(known, rows)
    assert got(A.align(table, RANKS, MODEL, P.PATTERN, size=7, frequent=50)) == want
    assert got(A.align(table, RANKS, MODEL, P.PATTERN, frequent=1)) == want


def test_composition_is_associative():
    r = random.Random(4)
    for _ in range(300):
        size = r.randint(1, 60)
        cut = lambda: np.array(sorted({*r.sample(range(1, size + 1), r.randint(0, size - 1)), size}))
        ea, eb = cut(), cut()
        a, b = (np.array([r.randint(0, 50_000) for _ in e], np.int32) for e in (ea, eb))
        whole = A.fragment(a, ea, b, eb)
        borders = sorted({0, size, *r.sample(range(size + 1), r.randint(0, min(size, 6)))})
        parts = []
        for lo, hi in zip(borders[:-1], borders[1:], strict=True):
            ka, kb = (ea > lo) & (ea <= hi), (eb > lo) & (eb <= hi)
            parts.append(A.fragment(a[ka], ea[ka], b[kb], eb[kb]))
        left = reduce(A.compose, parts, A.EMPTY)
        right = reduce(lambda y, x: A.compose(x, y), reversed(parts), A.EMPTY)
        mid = r.randint(0, len(parts))
        tree = A.compose(reduce(A.compose, parts[:mid], A.EMPTY), reduce(A.compose, parts[mid:], A.EMPTY))
        for found in (left, right, tree):
            assert all(np.array_equal(x, y) for x, y in zip(found, whole, strict=True))


def test_wide_groups_count_pairs_by_distinct_ids():
    r = random.Random(6)
    m, n = np.array([3, 120, 1, 90]), np.array([2, 100, 1, 80])
    a, b = (np.array([r.randint(0, 20) for _ in range(k.sum())], np.int32) for k in (m, n))
    want, i, j = Counter(), 0, 0
    for x, y in zip(m, n, strict=True):
        want.update((int(p), int(q)) for p in a[i : i + x] for q in b[j : j + y])
        i, j = i + x, j + y
    pairs, times = A.linked_pairs(a, m, b, n, 100)
    assert {(p // 100, p % 100): t for p, t in zip(pairs.tolist(), times.tolist(), strict=True)} == dict(want)


def test_query_against_plain(spark, known):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    assert got(A.op12_alignment(spark, sf)) == plain(known, rows)


def test_edges_and_long_texts(spark, known):
    rows = [(i, t) for i, t, *_ in TEXTS]
    assert got(A.align(edge(spark), RANKS, MODEL, P.PATTERN, size=500)) == plain(known, rows)
    assert A.align(spark.createDataFrame([], EDGE_SCHEMA), RANKS, MODEL, P.PATTERN).count() == 0
    solid = [(1, "長い文章" * 3000), (2, LONG.replace(" ", "")), (3, "a" * 5000), (4, " " * 3000)]
    assert got(A.align(docs(spark, [(i, t, "a") for i, t in solid]), RANKS, MODEL, P.PATTERN, size=1000)) == plain(known, solid)


def test_words_of_a_text_together_and_apart(monkeypatch):
    """Words encoded as one text have the ids that each has by itself, also where one of them is not spelt and the table holds two."""
    monkeypatch.setattr(A, "HELD", 2)
    raw = [open(P.path(n), "rb").read() for n in ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]
    words, r, calls = A.Words(*raw, P.PATTERN), random.Random(4), []
    alone = words.__missing__
    for k in range(200):
        text = " ".join(r.choice(["ab", "qzqz,", "don't", "é中文", "x\ty", "a|b", "12", "<0x41>", "tion" * 20, *(["ﬁ", "▁"] if k % 2 else [])]) for _ in range(r.randint(1, 12)))
        some = text.split(" ") if k % 5 else (text + "\n").split(" ")
        assert words.all(some) == [alone(w) for w in some]
    monkeypatch.setattr(A.Words, "__missing__", lambda self, w: calls.append(w))
    assert None not in words.all(["some", "plain", "words", "here"]) and not calls
