"""Toxicity by compression distance: two zstandard dictionaries, window by window."""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, materialise, read

#: Bounds of the training sample: documents of either label, and the characters of one of them.
SAMPLE, SAMPLE_CHARS = 3000, 100_000
#: Characters of all of them together that reach the driver, about; windows of ordinary text that the common dictionary is trained on.
TOTAL_CHARS, COMMON_WINDOWS = 40_000_000, 100_000
#: Words in a window, bytes of the common dictionary and of a contrast dictionary, letters of a gram.
WINDOW, COMMON, CONTRAST, GRAM = 12, 32_768, 16_384, 5
#: Parts of the sample, each measured with dictionaries of the others for the calibration.
PARTS = 3
#: Ordinary words whose grams training holds at once.
WORDS_HELD = 100_000
#: Two bytes between words, so that a match of 7 bytes holds the start or the end of a short word.
GAP = b"  "


#: A gram marks toxic text if it is in so many times the toxic documents that its share of ordinary ones foretells, by so many deviations.
MORE, SURE = 2.0, 6.0


@dataclass(frozen=True)
class Model:
    """Dictionaries of toxic and ordinary text, and the calibration of window lengths to a probability."""

    toxic: bytes
    ordinary: bytes
    mean: tuple
    scale: tuple
    weight: tuple  # the last is the intercept


def _lines(text: str | None) -> list[bytes]:
    w = (text or "").lower().encode("utf-8", "replace").split()
    return [GAP + GAP.join(w[i : i + WINDOW]) + GAP for i in range(0, len(w), WINDOW)]


class Scorer:
    """Compares a text's windows under both dictionaries: how many bytes the toxic one saves."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        p = zstandard.ZstdCompressionParameters(window_log=17, hash_log=17, chain_log=16, min_match=7, strategy=zstandard.STRATEGY_FAST, target_length=1, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.pair = []
        for data in (ordinary, toxic):
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            self.pair.append(zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress)

    def features(self, text: str | None) -> list[float]:
        a, b = self.pair
        windows = _lines(text)
        saved = np.array([len(a(x)) - len(b(x)) for x in windows] or [0], float)
        saved[::-1].sort()
        n = len(saved)
        return [saved[0], saved[:3].mean(), saved[:8].mean(), saved.mean(), (saved >= 2).mean(), (saved >= 4).mean(), (saved >= 6).mean(), math.log1p((saved >= 3).sum()), math.log1p((saved >= 5).sum()), math.log1p(len(windows)), saved.sum() / math.sqrt(n)]


def _grams(word: bytes) -> list[bytes]:
    x = b" " + word + b" "
    return [x[i : i + GRAM] for i in range(len(x) - GRAM + 1)]


def _word_set(text: str) -> set[bytes]:
    return set(text.lower().encode("utf-8", "replace").split())


def _marked(word: bytes, grams: list[bytes], marks: set[bytes]) -> list[bytes]:
    """The stretches of a word, with a space at either end, that two or more marked grams cover."""
    out, start, end, count = [], 0, -1, 0
    at = [i for i, g in enumerate(grams) if g in marks]
    for i in [*at, len(word) + 99]:
        if i > end:
            if count >= 2:
                out.append((b" " + word + b" ")[start:end])
            start, count = i, 0
        end, count = i + GRAM, count + 1
    return out


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """(toxic, ordinary): both end in one dictionary trained on ordinary text; before it stand the stretches of words
    whose grams are far commoner in toxic documents, or as many bytes of ordinary text.

    What both share costs the same in both, so only toxic words change the difference in length.
    """
    seen = [Counter(), Counter()]
    for t in toxic:
        seen[0].update({g for w in _word_set(t) for g in _grams(w)})
    asked = {g: g for g, n in seen[0].items() if n >= 3}
    held: dict[bytes, tuple] = {}
    for t in ordinary:
        found = set()
        for w in _word_set(t):
            if (g := held.get(w)) is None:
                if len(held) > WORDS_HELD:
                    held.clear()
                g = held[w] = tuple(asked[x] for x in _grams(w) if x in asked)
            found.update(g)
        seen[1].update(found)
    rate = {g: (seen[1][g] + 0.5) / (len(ordinary) + 1) * len(toxic) for g in asked}
    marks = {g for g, e in rate.items() if seen[0][g] > MORE * e and seen[0][g] - e > SURE * math.sqrt(e + 0.5)}
    spans: Counter = Counter()
    for t in toxic:
        spans.update({span for w in _word_set(t) for span in _marked(w, _grams(w), marks)})
    chosen, size = [], 0
    for span, _ in sorted(spans.items(), key=lambda x: (-x[1], x[0])):
        if size + len(span) < CONTRAST:
            chosen.append(span.replace(b" ", GAP))
            size += len(chosen[-1])
    marked = GAP.join(reversed(chosen))
    samples = heapq.nsmallest(COMMON_WINDOWS, (x for t in ordinary for x in _lines(t)), key=zlib.crc32)
    try:
        common = zstandard.train_dictionary(COMMON, samples, k=32, d=8).as_bytes()[-COMMON:]
    except zstandard.ZstdError:  # too few samples to train on: their text itself
        common = b"".join(samples)[-COMMON:]
    plain = (common * (len(marked) // max(1, len(common)) + 1))[: len(marked)]
    return marked + common, plain + common


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[tuple, tuple, tuple]:
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w -= np.linalg.solve(hess, z.T @ (p - y) + ridge * w)
    return tuple(mean), tuple(scale), tuple(w)


def _sketch(text: str) -> int:
    """Least hash of the 3-word windows: mostly equal for near copies, so that a group of copies counts about once."""
    w = text.lower().encode("utf-8", "replace").split()
    return min((zlib.crc32(b" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0)


def train(texts: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learn from at most about ``sample`` documents of either label, chosen by a hash of the id, of up to ``sample_chars`` characters.

    Only the chosen ids are broadcast (about 2 * ``sample``) and only their texts reach the driver, about TOTAL_CHARS of
    them at most, fewer documents being chosen by the same hash where they are longer. Labels other than 0 and 1 and null
    ids are left out; of repeated ids the larger label and the least text count; without labels the model knows nothing.
    """
    one = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    n = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20)
    share = F.when(F.col("y") == 1, sample / max(n.get(1, 0), 1)).otherwise(sample / max(n.get(0, 0), 1))
    one = one.filter((place < share) & F.col("id").isNotNull()).select("id", "y", (place / share).alias("place"))
    short = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).filter(F.length("t") <= sample_chars)
    found = materialise(short.join(F.broadcast(one), "id").groupBy("id", "y", "place").agg(F.min("t").alias("t")), "toxicity-sample")
    chars = found.agg(F.sum(F.length("t"))).first()[0] or 0
    rows = sorted(found.filter(F.col("place") * chars <= TOTAL_CHARS).select("id", "t", "y").collect(), key=lambda r: (r["id"], r["t"]))
    rows = list({_sketch(r["t"]): r for r in reversed(rows)}.values())
    parts = [([r["t"] for r in rows[k::PARTS] if r["y"] == 1], [r["t"] for r in rows[k::PARTS] if r["y"] == 0]) for k in range(PARTS)]
    return calibrated(parts, math.log(max(n.get(0, 0), 1) / max(n.get(1, 0), 1)))


def calibrated(parts: list[tuple[list[str], list[str]]], log_odds: float) -> Model:
    """Parts of (toxic, ordinary) texts: each is measured with the dictionaries of the others to fit the calibration; the
    model's own dictionaries come from all. ``log_odds``: of ordinary to toxic where the model will be used."""
    x, y = [], []
    for k, part in enumerate(parts):
        others = parts[:k] + parts[k + 1 :]
        scorer = Scorer(*train_dictionaries([t for p in others for t in p[0]], [t for p in others for t in p[1]]))
        for label in (0, 1):
            x += [scorer.features(t) for t in part[1 - label]]
            y += [float(label)] * len(part[1 - label])
    toxic, ordinary = train_dictionaries([t for p in parts for t in p[0]], [t for p in parts for t in p[1]])
    mean, scale, weight = _fit(np.array(x or [[0.0] * 11]), np.array(y or [0.0]))
    shift = log_odds - math.log((len(y) - sum(y)) / sum(y)) if 0 < sum(y) < len(y) else 0.0
    return Model(toxic, ordinary, mean, scale, (*weight[:-1], weight[-1] - shift))


_scorers: dict[int, Scorer] = {}


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability of label 1 for every whole text; null and empty texts have no windows and score as such.

    A row per input row, in batches; the model (under 100 KB) goes with the task. Other columns are not read.
    """

    def work(batches):
        key = hash((model.toxic, model.ordinary))
        if key not in _scorers:
            _scorers[key] = Scorer(model.toxic, model.ordinary)
        scorer, w = _scorers[key], np.array(model.weight)
        for batch in batches:
            x = np.array([scorer.features(t.as_py()) for t in batch.column(1)]).reshape(-1, 11)
            z = np.clip((x - np.array(model.mean)) / np.array(model.scale) @ w[:-1] + w[-1], -30, 30)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-z)))], [id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(work, f"{id_col} {dict(docs.dtypes)[id_col]}, score double")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The documents that score below ``limit``, with all their columns; scored in the batches that carry them, without a join.

    Null and empty texts score as texts without windows, repeated rows alike; an empty table gives an empty one.
    """

    def work(batches):
        scorer, w = Scorer(model.toxic, model.ordinary), np.array(model.weight)
        for batch in batches:
            x = np.array([scorer.features(t.as_py()) for t in batch.column(text_col)]).reshape(-1, 11)
            z = np.clip((x - np.array(model.mean)) / np.array(model.scale) @ w[:-1] + w[-1], -30, 30)
            yield batch.filter(pa.array(1 / (1 + np.exp(-z)) < limit))

    return docs.mapInArrow(work, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from the labels outside the held-out fold."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = train(docs, labels.filter(fold(F.col("doc_id")) != 0))
    found = score(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
