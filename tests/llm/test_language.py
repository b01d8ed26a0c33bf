from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from barsmith.llm import language as G
from barsmith.llm.common import fold, read

from .edges import EDGE_SCHEMA, TEXTS, edge


def plain_bundle(text: str) -> np.ndarray:
    gap, x = True, [0]
    for c in text.lower():
        if c.isalpha():
            x.append(ord(c))
            gap = False
        elif not gap:
            x.append(0)
            gap = True
    if not gap:
        x.append(0)
    v = {p: G.letter_vectors(np.array([p]), 1)[0].astype(int) for p in set(x)}
    total = np.zeros(G.DIM)
    for a, b, c in zip(x, x[1:], x[2:], strict=False):
        total += np.roll(v[a], 2) * np.roll(v[b], 1) * v[c]
    return total


def test_bundle_is_the_sum_of_bound_ngrams():
    texts = ["The cat, the hat", "über älles 12 x", "aaaa"]
    got, has = G.bundles(texts)
    assert has.all() and all(np.array_equal(g, plain_bundle(t)) for g, t in zip(got, texts, strict=True))


def test_many_ngrams_in_parts():
    text = " ".join(chr(97 + i % 26) + chr(97 + i // 26 % 26) + chr(97 + i // 676) for i in range(9000))
    assert np.array_equal(G.bundles([text])[0][0], plain_bundle(text))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = G_query(spark, sf).filter("held_out").join(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    good, n = out.agg(F.sum((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert good / n > 0.95


def G_query(spark, sf):
    return G.op1_language(spark, sf)


def test_edges(spark):
    protos = G.prototypes(edge(spark).filter(fold(F.col("doc_id")) != 0))
    out = G.identify(edge(spark), protos).collect()
    assert len(out) == len(TEXTS)
    none = {2, 3, 4, 10}
    assert {r.doc_id for r in out if r.lang_pred == "und"} == none and all(0 <= r.score <= 1 for r in out)
    empty = spark.createDataFrame([], EDGE_SCHEMA)
    assert G.prototypes(empty) == {} and G.identify(empty, {}).count() == 0
    assert {r.lang_pred for r in G.identify(edge(spark), {}).collect()} == {"und"}
