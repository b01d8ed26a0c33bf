from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barsmith.llm import mixing as M
from barsmith.llm.common import read

from .edges import EDGE_SCHEMA, TEXTS, edge


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_permutations(n):
    i = np.arange(n)
    out = M.permute(i, np.full(n, n), np.full(n, 12345))
    assert sorted(out.tolist()) == list(range(n))
    assert np.array_equal(M.permute(out, np.full(n, n), np.full(n, 12345), back=True), i)


def test_targets_reshare_what_exceeds():
    t = M.source_targets([10, 1000, 1000], [3, 1, 2])
    assert t[0] == 20 and sum(t) == pytest.approx(1.5 * 2010) and t[2] == pytest.approx(2 * t[1])
    assert M.source_targets([10, 100, 1000], [3, 1, 2])[:2] == [20, 200]
    assert M.source_targets([], []) == [] and M.source_targets([0, 0], [3, 1]) == [0, 0]


def test_totals_are_exact_and_reruns_agree(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    first = M.mix_counts(docs).collect()
    groups = defaultdict(int)
    src = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    want = {}
    for r in first:
        assert 0 <= r.taken <= 2 * r["size"]
        groups[src[r.id]] += r.taken
        want[src[r.id]] = r.target
    assert all(abs(groups[s] - want[s]) <= 1 for s in want)
    assert sorted(map(tuple, first)) == sorted(map(tuple, M.mix_counts(docs.repartition(7)).collect()))


def test_shards_draw_every_slot_once(spark):
    per = M.source_slots([1000, 130, 0, 5], [1400.0, 260.0, 0.0, 7.0], 64, 7)
    plan = M.dealing_plan(spark.createDataFrame(per), 6, 7).toPandas()
    assert plan.groupby("sid")["n"].sum().to_dict() == {s: n for s, n in zip(per["sid"], per["slots"], strict=True) if n}
    for _, g in plan.sort_values("shard").groupby("sid"):
        assert g["first"].tolist() == [0, *np.cumsum(g["n"])[:-1].tolist()]
    assert len({n for n, s in zip(plan["n"], plan["sid"], strict=True) if s == 0}) > 1, "shards differ"


def test_taken_by_brute_force(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    rows = M.mix(docs)[0].collect()
    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h")).collect()}
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in rows if r.source == s) for s in names]
    targets = M.source_targets(sizes, [M.WEIGHTS[i % 3] for i in range(len(names))])
    per = M.source_slots(sizes, targets, M.BLOCK, 7).set_index("sid")
    taken = dict.fromkeys(order, 0)
    for sid, name in enumerate(names):
        mine = [r for r in rows if r.source == name and r["size"]]
        groups = math.isqrt(sum(r.source == name for r in rows)) + 1
        stream = [r.id for r in sorted(mine, key=lambda r: (order[r.id] % groups, order[r.id])) for _ in range(r["size"])]
        blocks, slots, trim = per.loc[sid]
        for i in range(slots):
            at = int(M.permute([i % blocks], [blocks], [M._key(7, sid, i // blocks)])[0]) * M.BLOCK
            for d in stream[at : at + (trim if i == slots - 1 and trim else M.BLOCK)]:
                taken[d] += 1
    assert {r.id: r.taken for r in M.mix_counts(docs).collect()} == taken


def test_mixed_documents_hold_the_taken_words(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    counts = sum(r.taken for r in M.mix_counts(docs).collect())
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sum(len((r.text or "").split()) for r in rows) == counts and all(len(r.text) == r.n_chars for r in rows)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(set(r.text.split()) <= set(texts[r.doc_id].split()) for r in rows)


def test_edges(spark):
    out = M.mix_counts(edge(spark)).collect()
    assert len(out) == len(TEXTS)
    assert all(r["size"] == 0 and r.taken == 0 for r in out if r.id in (2, 3, 4))
    assert M.mix_counts(spark.createDataFrame([], EDGE_SCHEMA)).count() == 0
    assert M.mixed_documents(edge(spark)).columns == edge(spark).columns
