from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from barsmith.llm import divergence as V

from .edges import EDGE_SCHEMA, TEXTS, edge

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, top=200):
    """The contract, restated: rows of (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(lang, source, [t.translate(LOWER) for t in TERM.findall(text)]) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in found}:
        docs = Counter(t for g, _, ts in found if g == lang for t in set(ts))
        kept = [t for t, n in docs.items() if n >= 3]
        count = defaultdict(Counter)
        for g, source, ts in found:
            if g == lang:
                count[source].update(t for t in ts if t in set(kept))
        total = sum(count.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        q, shares = p(total), {s: p(c) for s, c in count.items()}
        for s in shares:
            pairs = [(o, sum((shares[s][t] - shares[o][t]) ** 2 // shares[o][t] for t in kept)) for o in shares if o != s]
            terms = [(t, (shares[s][t] - q[t]) ** 2 // q[t]) for t in kept if count[s][t] > 0 and shares[s][t] > q[t]]
            for part, found_rows, most in (("pair", pairs, 10**9), ("term", terms, top)):
                for i, (item, value) in enumerate(sorted(found_rows, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, i))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


def got(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def made(n, sources, seed):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdéfgh" for b in "xyzüvw"] + ["İ", "ſ", "中文", "E"]
    return [(" ".join(r.choice(vocabulary[: r.randint(2, len(vocabulary))]) + r.choice([" ", "1", "_", ","]) for _ in range(r.randint(0, 30))), r.choice(["en", "fr", None]), f"s{r.randint(0, sources - 1)}" if r.random() < 0.9 else None) for _ in range(n)]


@pytest.mark.parametrize("sources", [3, 7])
def test_against_plain(spark, sources):
    """Blocks of two sources, chunks of ten terms and bands of ten rows, so that every way of splitting is taken."""
    rows = made(150, sources, sources)
    assert got(V.audit(table(spark, rows), top=5, held=40, band=10, chunk=10, block=2)) == plain(rows, 5)


def test_edges(spark):
    assert got(V.audit(edge(spark))) == plain([(t, lang, s) for _, t, lang, s in TEXTS])
    assert V.audit(spark.createDataFrame([], EDGE_SCHEMA)).count() == 0
    assert got(V.audit(table(spark, [(None, None, None), ("x", None, "a")]))) == [("", "", "pair", "a", 0, 1), ("", "a", "pair", "", 0, 1)]


def test_skyband_against_every_pair():
    r = random.Random(5)
    for _ in range(60):
        k = r.randint(1, 6)
        rows = sorted({f"t{r.randint(0, 60):02}": (r.randint(1, 8), r.randint(1, 8)) for _ in range(50)}.items(), key=lambda x: (-x[1][0], x[1][1], x[0]))
        above = lambda a, b: a != b and a[1][0] >= b[1][0] and a[1][1] <= b[1][1] and a[0] < b[0]
        want = [i for i, b in enumerate(rows) if sum(above(a, b) for a in rows) < k]
        assert V.skyband([x[1][1] for x in rows], [x[0] for x in rows], k) == want


def test_share_is_exact_for_large_counts(spark):
    counts = [(0, 7), (8_999_999_999, 9_100_000_000), (9_000_000_000, 9_100_000_001), (10**15, 3 * 10**15 + 1), (0, 0)]
    rows = spark.createDataFrame(counts, "n long, total long").select("n", "total", V.share(F.col("n"), F.col("total")).alias("p")).collect()
    assert all(r.p == (1 + 10**9 * (r.n + 1) // r.total if r.total else 1) for r in rows)
