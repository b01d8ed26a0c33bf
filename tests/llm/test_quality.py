from __future__ import annotations

import re
from collections import Counter

from barsmith.llm import quality as Q
from barsmith.llm.common import read

from .edges import EDGE_SCHEMA, TEXTS, docs, edge, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, inside = Counter(windows), set()
    for i, x in enumerate(windows):
        if n[x] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), failed


def test_counts_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in read(spark, sf, "documents").collect()}
    rows = Q.op4_quality(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_edges(spark):
    rows = Q.quality_rules(edge(spark)).collect()
    assert sorted((r.n_words, r.n_repeat_words) for r in rows) == sorted((counts(t)[0], counts(t)[4]) for _, t, *_ in TEXTS)
    assert not any(r.kept for r in rows if r.id in (2, 3, 4))
    assert Q.quality_rules(spark.createDataFrame([], EDGE_SCHEMA)).count() == 0
    kept = Q.keep_documents(edge(spark))
    assert kept.columns == edge(spark).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.id or 0 for r in rows if r.kept)


def corpus():
    banner = "Subscribe to our daily letter and share this page, 2024!"
    rows = [(i, banner.replace("2024", str(2000 + i)) + "\n" + words(100, 100 + i), "h") for i in range(30)]
    rows += [(100 + i, "\n".join([banner] * 9) + "\n" + words(30, 900 + i), "h") for i in range(3)]
    rows += [(200 + i, words(100, 5) + "\n" + words(90, 6), "h") for i in range(40)]  # copies of one document
    return rows + [(300, banner + "\n" + words(100, 77), "other")]


def test_frequent_lines(spark):
    rows = {r.id: r for r in Q.quality_rules(docs(spark, corpus())).collect()}
    assert all(rows[i].kept and rows[i].lost_chars > 0 for i in range(30))
    assert not any(rows[100 + i].kept for i in range(3)), "depleted"
    assert all(rows[200 + i].kept and rows[200 + i].lost_chars == 0 for i in range(40)), "copies do not make their lines frequent"
    assert rows[300].lost_chars == 0, "another host"
    kept = {r.doc_id: r.text for r in Q.keep_documents(docs(spark, corpus())).collect()}
    assert "Subscribe" not in kept[3] and kept[300].startswith("Subscribe") and 100 not in kept


def test_boilerplate_of_depleted_documents_is_frequent(spark):
    rows = []
    for group, (n, own) in enumerate(((60, 24), (150, 12), (5000, 4))):
        shared = [words(40, 50 + group), words(80 - own, 60 + group)]
        rows += [(10000 * group + i, "\n".join([*shared, words(own, 50000 * (group + 1) + i)]), f"h{group}") for i in range(n)]
    got = {r.id: r for r in Q.quality_rules(docs(spark, rows)).collect()}
    assert all(got[i].lost_chars > 0 and not got[i].kept for i, *_ in rows), "most of each is shared by distinct documents"


def test_near_copies_do_not_make_their_lines_frequent(spark):
    body = [words(40, k) for k in range(10)]
    rows = [(i, "\n".join([*body[: i % 10], body[i % 10] + f" {words(1, 700 + i)}", *body[i % 10 + 1 :]]), "h") for i in range(200)]
    assert all(r.kept and r.lost_chars == 0 for r in Q.quality_rules(docs(spark, rows)).collect())
