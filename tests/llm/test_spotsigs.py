from __future__ import annotations

import hashlib
import random
import re

from barsmith.llm import spotsigs as P
from barsmith.llm.common import read
from pyspark.sql import functions as F

from .edges import EDGE_SCHEMA, TEXTS, docs, edge, words

WORD = re.compile(P._WORD)


def plain_spots(text: str) -> set:
    w = WORD.findall(text.lower())
    content = [(i, x) for i, x in enumerate(w) if x not in P.ANCHORS]
    out = set()
    for i, x in enumerate(w):
        if x in P.ANCHORS:
            chain = [c for j, c in content if j > i][: P.CHAIN]
            if len(chain) == P.CHAIN:
                out.add((x, *chain))
    return out


def test_spots_by_brute_force(spark):
    texts = [r.text for r in read(spark, "/root/testdata/sf0.001", "documents").limit(60).collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", P.spots(F.col("t")).alias("s"))
    for r in df.collect():
        want = plain_spots(texts[r.i])
        if len(want) >= P.FEW:
            assert len(r.s) == len(want)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = sorted(((r.doc_id, r.text) for r in read(spark, sf, "documents").collect()), reverse=True)
    rows = {r.doc_id: r for r in P.op5_spotsigs(spark, sf).collect()}
    assert len(rows) == len(texts)
    for k, (i, t) in enumerate(texts):
        follow = texts[(k + 1) % len(texts)]
        half = len(t) // 2
        text = t[: len(t) - half] + follow[1][:half]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(text.encode()).hexdigest()) and r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        a, b = ({x[j : j + 8] for j in range(0, len(x), 8)} for x in (r.fingerprint, rows[follow[0]].fingerprint))
        assert abs(r.near_next - len(a & b) / len(a | b)) < 1e-9
        a, b = ({x[j : j + 8] for j in range(0, len(x), 8)} for x in (r.fingerprint, r.edited_fingerprint))
        assert abs(r.near_edited - len(a & b) / len(a | b)) < 1e-9


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for g in range(6):
        base = " ".join(rng.choice(["the", "of", "and"]) + " " + words(2, rng.randint(0, 10**6)) for _ in range(60)).split()
        for k in range(9):
            w = list(base)
            for _ in range(rng.randint(0, 7)):
                w[rng.randrange(len(w))] = words(1, rng.randint(0, 10**6))
            rows.append((100 * g + k, " ".join(w), "s"))
    df = docs(spark, rows)
    sets = {r.i: frozenset(r.s) for r in df.select(F.col("doc_id").alias("i"), P.spots(F.col("text")).alias("s")).collect()}
    label = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if len(a & b) / len(a | b) >= 0.8:
                    label[i] = label[j] = min(label[i], label[j])
    assert {r.id: r.class_id for r in P.near_duplicates(df).collect()} == label
    assert 6 < len(set(label.values())) < len(label)
    assert P.near_duplicates(edge(spark)).count() == len(TEXTS)
    assert P.near_duplicates(spark.createDataFrame([], EDGE_SCHEMA)).count() == 0


def test_edges(spark):
    rows = P.edited_fingerprints(edge(spark)).collect()
    assert len(rows) == len(TEXTS)
    same = {r.id: r.fingerprint for r in rows}
    assert same[2] == same[3] and same[6] == same[7] and same[6] != same[8]
    last = [r for r in rows if r.id is None]
    assert len(last) == 1 and last[0].next_id == 13 and {r.next_id for r in rows if r.id == 1} == {None}
    assert P.edited_fingerprints(spark.createDataFrame([], EDGE_SCHEMA)).count() == 0
    one = P.edited_fingerprints(edge(spark, TEXTS[:1])).collect()
    assert one[0].near_next == 1.0
