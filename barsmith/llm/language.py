"""Language identification with hyperdimensional letter-trigram profiles."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, read

#: Dimensions, letters of an n-gram, most languages, and about how many documents of a language train its prototype.
DIM, GRAM, MAX_LANGUAGES, PER_LANGUAGE = 1024, 3, 500, 3000
#: Letters with vectors of their own in one batch are numbered below this; text is cut into blocks of so many characters.
BLOCK = 1 << 20
#: Combining marks are numbered from here, letters below: a text of marks alone has no letter.
MARKS = 0x110000


def letter_vectors(points: np.ndarray, seed: int) -> np.ndarray:
    """A random vector of +1 and -1 for each code point, the same wherever it is asked for (0 is the gap between words)."""
    lanes = np.arange(DIM // 64, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (lanes + np.uint64(seed * 1_000_003 + 1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        for _ in range(2):
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.unpackbits(x.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


_fold_table: list[np.ndarray] = []


def _folded(points: np.ndarray) -> np.ndarray:
    """Lower-case letters as they are, marks above all letters, everything else 0."""
    if not _fold_table:
        table = np.zeros(0x110000, np.int32)
        for i in range(0x110000):
            c = chr(i)
            if unicodedata.category(c)[0] in "LM":
                low = c.lower()
                table[i] = (ord(low) if len(low) == 1 else i) + MARKS * (unicodedata.category(c)[0] == "M")
        _fold_table.append(table)
    return _fold_table[0][points]


def _stream(text: str) -> np.ndarray:
    """Letters of the text, a single 0 for each gap and at both ends."""
    parts = []
    for at in range(0, len(text), BLOCK):
        parts.append(_folded(np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)))
    x = np.concatenate([[0], *parts, [0]]).astype(np.int32)
    return x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))]


def bundles(texts: list[str | None], seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of the texts, whether each has a letter): the sum of a text's n-gram vectors.

    An n-gram's vector binds its letters' vectors, each rotated by its place, by multiplication. Equal n-grams are
    counted first and their vectors made once for all texts together.
    """
    streams = [_stream(t or "") for t in texts]
    has = np.array([bool(((s > 0) & (s < MARKS)).any()) for s in streams], bool)
    letters, flat = np.unique(np.concatenate([np.zeros(1, np.int32), *streams]), return_inverse=True)
    flat, base = flat[1:].astype(np.int64), len(letters)
    sizes = np.array([len(s) for s in streams])
    owner = np.repeat(np.arange(len(streams)), sizes)
    codes = np.zeros(max(0, len(flat) - GRAM + 1), np.int64)
    for k in range(GRAM):
        codes = codes * base + flat[k : k + len(codes)]
    within = owner[: len(codes)] == owner[GRAM - 1 :] if len(codes) else np.zeros(0, bool)
    grams, which = np.unique(codes[within], return_inverse=True)
    rows, vectors = owner[: len(codes)][within], letter_vectors(letters, seed)
    out = np.zeros((len(texts), DIM), np.float32)
    step = 4096
    order = np.argsort(which, kind="stable") if len(grams) > step else None
    for at in range(0, len(grams), step):
        part, bound = grams[at : at + step], np.ones((min(step, len(grams) - at), DIM), np.int8)
        for k in range(GRAM - 1, -1, -1):
            bound *= np.roll(vectors[part % base], GRAM - 1 - k, axis=1)
            part = part // base
        if order is None:
            mine, col = rows, which
        else:
            lo, hi = np.searchsorted(which, [at, at + step], sorter=order)
            mine, col = rows[order[lo:hi]], which[order[lo:hi]] - at
        width = len(bound)
        counts = np.bincount(mine * width + col, minlength=len(texts) * width).reshape(len(texts), width)
        out += counts.astype(np.float32) @ bound.astype(np.float32)
    return out, has


def _groups(texts: list[str | None], chars: int = 1 << 20, most: int = 256):
    """Slices of the list of about ``chars`` characters, so that memory stays bounded."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars or i + 1 - at >= most:
            yield texts[at : i + 1]
            at, held = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def prototypes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Each language's bundle of its documents' unit vectors, from about ``per_language`` of them chosen by a hash of the id.

    Tasks send one vector per language; sums of DIM numbers per language (at most MAX_LANGUAGES, checked) reach the driver.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = known.groupBy(lang_col).agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(n) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    if not n:
        return {}
    share = F.element_at(F.create_map(*[F.lit(x) for r in n for x in (r[0], per_language / r["n"])]), F.col(lang_col))
    chosen = known.filter(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) < share * (1 << 20))

    def work(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            for part in _groups(texts):
                v, has = bundles(part)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                for lang, x, ok in zip(langs[at : at + len(part)], v, has, strict=True):
                    if ok:
                        sums[lang] = sums.get(lang, 0) + x.astype(np.float64)
                at += len(part)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    parts = chosen.select(lang_col, text_col).mapInArrow(work, "lang string, v array<double>")
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).toPandas()
    out = {}
    for lang, g in summed.groupby("lang"):
        v = np.zeros(DIM)
        v[g["i"].to_numpy()] = g["x"].to_numpy()
        out[str(lang)] = np.round(v / max(np.linalg.norm(v), 1e-9), 9)
    return out


def identify(docs: DataFrame, protos: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): the prototype of the largest cosine, ties to the first name; ``und`` with score 0 without letters.

    A row per input row from its whole text, null and empty texts included; nothing is shuffled, other columns are not
    read. Without prototypes every text is ``und``.
    """
    names = sorted(protos)
    table = np.array([protos[k] for k in names], np.float32).reshape(len(names), DIM)

    def work(batches):
        for batch in batches:
            langs, scores = [], []
            for part in _groups(batch.column(1).to_pylist()):
                v, has = bundles(part)
                if not names:
                    has[:] = False
                cos = np.round(v @ table.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9), 5) if names else np.zeros((len(part), 1))
                best = cos.argmax(1)
                langs += [names[b] if ok else "und" for b, ok in zip(best, has, strict=True)]
                scores += np.where(has, np.clip(cos.max(1), 0, 1), 0).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(work, f"{id_col} {dict(docs.dtypes)[id_col]}, lang_pred string, score double")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    protos = prototypes(docs.filter(fold(F.col("doc_id")) != 0))
    found = identify(docs, protos)
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
