from __future__ import annotations

from collections import Counter

from barsmith.llm import licenses as S
from barsmith.llm.common import read

from .edges import EDGE_SCHEMA, TEXTS, edge, words


def plain_best(text, template):
    w, t = S.normal_words(text), S.normal_words(template)
    bag, best = Counter(zip(t, t[1:], strict=False)), 0.0
    marks = S.versions(t), S.MODIFIERS & set(t)
    for i in range(len(w)):
        seen = Counter()
        for j in range(i + 1, min(len(w), i + 3 * len(t) + 2)):
            seen[w[j - 1], w[j]] += 1
            if marks[0] <= set(w[i : j + 1]) and marks[1] == S.MODIFIERS & set(w[i : j + 1]):
                best = max(best, 2 * sum((seen & bag).values()) / (seen.total() + bag.total()))
    return best


def test_by_brute_force():
    r = words(30, 1)
    mit = S.TEMPLATES[2][1]
    near = mit.replace("free of charge", "at no cost").replace("merge, ", "").replace("sublicense", "resell")
    texts = [r, f"{r} {S.TEMPLATES[0][1]} {r}", f"{r}\n{near}\n{r}", "licensed under the the apache license version 2 0 and more", "", "the the of and"]
    some = tuple(x for x in S.TEMPLATES if len(x[1]) < 5000)
    scanner = S.Scanner(some)
    for text in texts:
        got = {x[3]: x[0] for x in scanner.scan(text)}
        for k, (_, template) in enumerate(some):
            best = plain_best(text, template)
            assert abs(got.get(k, 0.0) - (best if best >= S.LEAST else 0.0)) < 1e-9, (text[:40], template[:40])


def test_planted_notices(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in read(spark, sf, "documents").collect()}
    found = {r.doc_id: r.licenses for r in S.op9_licenses(spark, sf).collect()}
    for i, t in texts.items():
        for mark, name in (("under the MIT License", "MIT"), ("Apache License, Version 2.0", "Apache-2.0"), ("GNU General Public License, version 3", "GPL-3.0"), ("CC BY-NC 4.0", "CC-BY-NC-4.0")):
            assert (mark in t) == (name in found[i].split(",")), (i, mark)


def test_edges(spark):
    rows = S.scan(edge(spark)).collect()
    assert len(rows) == len(TEXTS) and {r.doc_id for r in rows if r.license} == {12}
    assert S.scan(spark.createDataFrame([], EDGE_SCHEMA)).count() == 0


def test_siblings_are_told_apart(spark):
    rows = [(i, words(20, i) + "\n" + text + "\n" + words(20, 99 + i), "en", "a") for i, (_, text) in enumerate(S.TEMPLATES)]
    got = {r.doc_id: (r.license, r.licenses) for r in S.scan(edge(spark, rows)).collect()}
    assert got == {i: (name, [name]) for i, (name, _) in enumerate(S.TEMPLATES)}
    assert {"BSD-3-Clause", "GPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "CC-BY-NC-SA-4.0", "CC-BY-SA-4.0"} <= {name for name, _ in got.values()}
    named = [t for n, t in S.TEMPLATES if n == "BSD-3-Clause"][0].replace("the copyright holder nor", "Example Inc. nor")
    assert S.scan(edge(spark, [(1, named, "en", "a")])).collect()[0].license == "BSD-3-Clause"


def test_versions_and_modifiers_must_agree(spark):
    lines = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "This work is licensed under the GNU General Public License, version 4.": None,
        "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution 2.0 International License.": None,
        "Licensed under the Apache License, Version 1.1.": None,
    }
    rows = [(i, words(20, i) + "\n" + text + "\n" + words(20, 99 + i), "en", "a") for i, text in enumerate(lines)]
    got = {r.doc_id: (r.license, r.licenses) for r in S.scan(edge(spark, rows)).collect()}
    assert got == {i: (name, [name] if name else []) for i, name in enumerate(lines.values())}
