"""Each stage of the pipeline on its own input, against a plain restatement."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as C
from barsmith.llm import bpe, quality, simhash
from barsmith.llm.common import materialise, read

from .edges import edge
from .test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    out, docs = {"documents": read(spark, SF, "documents")}, read(spark, SF, "documents")
    for name, stage in C.STAGES:
        docs = materialise(stage(spark, docs, SF), f"test-{name}")
        out[name] = docs
    return out


def test_columns(stages):
    assert all(stages[n].columns == stages["documents"].columns for n, _ in C.STAGES[:-1])


def test_quality(stages):
    kept = {r.id for r in quality.quality_rules(stages["documents"]).filter("kept").collect()}
    assert {r.doc_id for r in stages["quality"].collect()} == kept


def test_toxicity_drops_only(stages):
    before, after = ({r.doc_id: r.text for r in stages[n].collect()} for n in ("quality", "toxicity"))
    assert after.items() <= before.items() and len(after) > 0.7 * len(before)


def test_near_duplicates(stages):
    """Groups are what is reachable over near fingerprints and over sketches, each pair of texts looked at."""
    before = {r.doc_id: r.text for r in stages["toxicity"].collect()}
    close = plain_components({i: plain_fingerprint(t) for i, t in sorted(before.items())})
    sketches = {i: np.array(simhash.sketch(t.encode().lower().split(), {})[0]) for i, t in sorted(before.items())}
    nibbles = {i: (s.view(np.uint64)[:, None] >> np.arange(0, 64, 4, dtype=np.uint64) & np.uint64(15)).ravel() for i, s in sketches.items()}
    group = dict(close)
    for i in before:
        for j in before:
            if i < j and group[i] != group[j] and (nibbles[i] != nibbles[j]).sum() <= simhash.APART:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    assert sorted(r.doc_id for r in stages["near_duplicates"].collect()) == sorted(i for i, c in group.items() if i == c)


def test_mixing(stages):
    before = {r.doc_id: len(r.text.split()) for r in stages["near_duplicates"].collect()}
    rows = stages["mixing"].collect()
    total = sum(len(r.text.split()) for r in rows)
    assert abs(total - 1.5 * sum(before.values())) <= 30
    assert all(len(r.text.split()) <= before[r.doc_id] for r in rows)


def test_tokens(stages):
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(C.public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest(), len(known.encode_ordinary(r.text))) for r in stages["mixing"].collect())
    assert sorted((r.doc_id, r.decoded_sha256, r.n_tokens) for r in stages["tokens"].collect()) == want


def test_run(spark, stages):
    assert C.run(spark, SF).count() == stages["tokens"].count()
    assert simhash is not None


def test_stages_take_awkward_tables(spark):
    """Nulls in every column, empty and long texts, repeated rows, an empty table, and columns named as the stages' own."""
    extra = {c: F.lit(1) for c in ("rid_", "row", "hash_", "gone_", "key_", "host_", "text_", "group_", "id_", "y", "place", "keep_", "shard", "sid", "slot")}
    table = edge(spark).withColumns(extra)
    for docs in (table, table.limit(0)):
        n = docs.count()
        for name, stage in C.STAGES:
            out = stage(spark, docs, SF)
            rows = out.collect()
            assert name == "tokens" or out.columns == docs.columns
            assert (len(rows) == n) if name == "tokens" else (n or not rows)
