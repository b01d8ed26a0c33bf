from __future__ import annotations

import math
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from barsmith.llm import toxicity as X
from barsmith.llm.common import fold, read

from .edges import EDGE_SCHEMA, TEXTS, edge


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = read(spark, sf, "labels")
    out = X.op6_toxicity(spark, sf)
    rows = out.filter("held_out").join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").collect()
    y, p = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    order = p.argsort()
    rank = np.empty(len(p))
    rank[order] = np.arange(len(p))
    n = y.sum()
    assert (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n)) > 0.85
    assert ((p >= 0.5) == y).mean() > 0.95
    assert all((r.score >= 0.5) == bool(r.predicted) for r in out.take(50))


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1), (6, 0), (7, 0), (8, 1), (None, 1), (5, None), (8, 0)], "doc_id long, toxic int")
    model = X.train(edge(spark), labels.filter(fold(F.col("doc_id")) != 0))
    rows = X.score(edge(spark), model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    bare = X.train(edge(spark), empty)
    assert X.score(edge(spark), bare).count() == len(TEXTS)
    assert X.score(spark.createDataFrame([], EDGE_SCHEMA), model).count() == 0
    assert X.drop_toxic(edge(spark), model).columns == edge(spark).columns


PARAMETERS = dict(window_log=17, hash_log=17, chain_log=16, min_match=7, strategy=zstandard.STRATEGY_FAST, target_length=1, write_content_size=False, write_checksum=False, write_dict_id=False)


def made_corpus(seed):
    """(toxic, ordinary) texts of one vocabulary; three words stand in toxic texts only."""
    r = random.Random(seed)
    common = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9))) for _ in range(300)]
    bad = ["wretchedness", "scoundrels", "blackguard"]
    plain = lambda n: [r.choice(common) for _ in range(n)]
    toxic = [" ".join([*plain(r.randrange(5, 40)), *r.sample(bad, 2), *plain(9)]) for _ in range(90)]
    return toxic, [" ".join(plain(r.randrange(5, 60))) for _ in range(240)]


def plain_length(window, dictionary):
    """Bytes of a window compressed alone with a fresh compressor."""
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(**PARAMETERS), dict_data=d).compress(window))


def plain_features(text, toxic, ordinary):
    words = (text or "").lower().encode("utf-8", "replace").split()
    windows = [b"  " + b"  ".join(words[i : i + 12]) + b"  " for i in range(0, len(words), 12)]
    saved = sorted((plain_length(w, ordinary) - plain_length(w, toxic) for w in windows), reverse=True) or [0]
    mean = lambda x: sum(x) / len(x)
    share = lambda k: sum(s >= k for s in saved) / len(saved)
    count = lambda k: math.log(1 + sum(s >= k for s in saved))
    return [saved[0], mean(saved[:3]), mean(saved[:8]), mean(saved), share(2), share(4), share(6), count(3), count(5), math.log(1 + len(windows)), sum(saved) / len(saved) ** 0.5]


def test_features_by_brute_force():
    toxic, ordinary = made_corpus(1)
    pair = X.train_dictionaries(toxic, ordinary)
    scorer = X.Scorer(*pair)
    for text in [*toxic[:25], *ordinary[:25], *[t[1] for t in TEXTS], " ".join(toxic), None, ""]:
        assert scorer.features(text) == pytest.approx(plain_features(text, *pair), abs=1e-9)


def test_contrast_holds_just_the_marking_stretches():
    """Each stretch that the toxic dictionary adds is in a word of toxic texts only, and every such word is there."""
    toxic, ordinary = made_corpus(2)
    a, b = X.train_dictionaries(toxic, ordinary)
    size = next(k for k in range(len(a) + 1) if a[k:] == b[k:])
    spans = a[:size].decode().replace("  ", " ").split()
    assert size and len(a) == len(b)
    assert {"wretchedness", "scoundrels", "blackguard"} <= set(spans)
    seen = " ".join(ordinary)
    assert all(s not in seen for s in spans)


def test_calibration_by_brute_force():
    """Each part is measured with the others' dictionaries; the fit is the least of its loss; odds shift to those asked for."""
    toxic, ordinary = made_corpus(3)
    parts = [(toxic[k::3], ordinary[k::3]) for k in range(3)]
    model = X.calibrated(parts, math.log(7))
    x, y = [], []
    for k in range(3):
        others = [parts[j] for j in range(3) if j != k]
        pair = X.train_dictionaries([t for p in others for t in p[0]], [t for p in others for t in p[1]])
        x += [plain_features(t, *pair) for t in [*parts[k][1], *parts[k][0]]]
        y += [0.0] * len(parts[k][1]) + [1.0] * len(parts[k][0])
    assert (model.toxic, model.ordinary) == X.train_dictionaries([t for p in parts for t in p[0]], [t for p in parts for t in p[1]])
    x, y = np.array(x), np.array(y)
    z = np.c_[(x - x.mean(0)) / (x.std(0) + 1e-9), np.ones(len(x))]

    def loss(w):
        s = z @ w
        return np.sum(np.logaddexp(0, s) - y * s) + 0.05 / 2 * w @ w

    shift = math.log(7) - math.log(len(ordinary) / len(toxic))
    w = np.array([*model.weight[:-1], model.weight[-1] + shift])
    r = np.random.default_rng(4)
    assert all(loss(w) <= loss(w + d) + 1e-9 for size in (1e-3, 0.1, 1.0) for d in r.normal(size=(50, len(w))) * size)


def test_scores_and_drops_by_brute_force(spark):
    toxic, ordinary = made_corpus(5)
    model = X.calibrated([(toxic[k::3], ordinary[k::3]) for k in range(3)], 1.0)
    texts = [*toxic[:40], *ordinary[:40], None, "", toxic[0]]
    docs = spark.createDataFrame([(t, i, 0.5) for i, t in enumerate(texts)], "text string, doc_id long, score double").repartition(3)
    want = {}
    for i, t in enumerate(texts):
        x = plain_features(t, model.toxic, model.ordinary)
        s = sum((v - m) / k * w for v, m, k, w in zip(x, model.mean, model.scale, model.weight[:-1], strict=True)) + model.weight[-1]
        want[i] = 1 / (1 + math.exp(-max(-30, min(30, s))))
    got = {r.doc_id: r.score for r in X.score(docs, model).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    assert {r.doc_id for r in X.drop_toxic(docs, model).collect()} == {i for i, p in want.items() if p < 0.5}
    assert all(want[i] > 0.5 for i in range(40)) and sum(want[i] > 0.5 for i in range(40, 80)) < 4
