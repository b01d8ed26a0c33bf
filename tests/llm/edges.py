"""A table of awkward documents: nulls in every column, empty and long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random

EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, kept boolean, fp long, rid long, h long, lines string, host string, n long, key long, t string, id long"


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


LONG = "\n".join(words(200, i) for i in range(100))
TEXTS = [
    (1, "the cat of the house and a dog in the garden " * 8, "en", "a"),
    (2, None, "en", "a"),
    (3, "", "de", None),
    (4, " \t\n ", None, "b"),
    (5, LONG, "en", "b"),
    (6, words(120, 1), "en", "a"),
    (7, words(120, 1), "en", "c"),
    (7, words(120, 1), "en", "c"),
    (8, words(120, 1) + " extra", None, None),
    (None, words(80, 2), "fr", "a"),
    (9, "é ß 中文 \U0001f600 naïve x", "fr", "d"),
    (10, "### $$$ 12345 !!!", "en", "d"),
    (11, "one", "en", "a"),
    (12, "Released under the MIT License.\n" + words(60, 3), "en", "a"),
    (13, words(60, 4) + "\n\n" + words(60, 4), "en", "a"),
]


def edge(spark, rows=None):
    data = [(i, t, lang, s, None if t is None else len(t), 0.5, 1, True, 1, 1, 1, "x", "h", 2, 3, "t", 4) for i, t, lang, s in (TEXTS if rows is None else rows)]
    return spark.createDataFrame(data, EDGE_SCHEMA)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
