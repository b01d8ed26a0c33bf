"""Cross-tokenizer alignment: where the tokens of two vocabularies end together, and which pairs of them link most often."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read

#: Characters of a text that one task encodes at once, and bytes of a fragment's range; longer texts are spread over tasks.
RANGE = 32_768
#: Ranges that a step of the tree reduction composes.
FAN = 8
#: Words in each of the two generations of a worker's table (about 120 MB in all).
HELD = 120_000
#: Pairs whose counts are sent to every task (4 MB); the others meet their counts in a join.
FREQUENT = 262_144
#: Characters that a worker encodes before it hands rows on.
SLICE = 1_000_000
#: Links of one group from which its pairs are counted by distinct ids.
WIDE = 4096

BLANK = "▁"
BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: A text may be cut before a space that follows no white space: no token of either vocabulary crosses from there into a space.
CUT = re.compile(r"(?<=\S) ")
CROSSED = re.compile(r"\s ")

#: A token's code is its id and what stands after it: the marks of the groups' text, in this order.
LAST, SECOND = 1 << 16, 2 << 16
MARKS = (",", "|", ",", ";")


class Fragment(NamedTuple):
    """The tokens of both vocabularies that end in one range of a text's bytes.

    ``head`` are the tokens up to the first place where both end, which close a group that began before the range; ``codes``
    the groups closed inside it; ``tail`` the tokens after the last such place. Without one, all tokens are in ``head`` and
    ``cut`` is false. ``ok`` is false where tokens do not spell the text.
    """

    head_a: np.ndarray
    head_b: np.ndarray
    codes: np.ndarray
    tail_a: np.ndarray
    tail_b: np.ndarray
    cut: bool
    ok: bool


NONE = np.zeros(0, np.int32)
EMPTY = Fragment(NONE, NONE, NONE, NONE, NONE, False, True)
FIELDS = ", ".join(f"{x} array<int>" for x in Fragment._fields[:5]) + ", cut boolean, ok boolean"


def group_codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One group: its ids of the first vocabulary, then those of the second, the last of each marked; nothing for no ids."""
    out = np.concatenate([a, b + SECOND]).astype(np.int32)
    if len(out):
        out[[len(a) - 1, -1]] |= LAST
    return out


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two adjacent ranges; associative, with EMPTY as its unit.

    Tokens of the left range never end with tokens of the right one, so what was open meets and no new group can close in it.
    """
    join = np.concatenate
    ok = x.ok and y.ok
    if not x.cut:
        return Fragment(join([x.head_a, y.head_a]), join([x.head_b, y.head_b]), y.codes, y.tail_a, y.tail_b, y.cut, ok)
    a, b = join([x.tail_a, y.head_a]), join([x.tail_b, y.head_b])
    if not y.cut:
        return Fragment(x.head_a, x.head_b, x.codes, a, b, True, ok)
    return Fragment(x.head_a, x.head_b, join([x.codes, group_codes(a, b), y.codes]), y.tail_a, y.tail_b, True, ok)


def fragment(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> Fragment:
    """The fragment of the tokens that end in one range, from their ids and the bytes where they end."""
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    if not len(common):
        return Fragment(a, b, NONE, NONE, NONE, False, True)
    a_from, a_to = np.searchsorted(a_ends, common[[0, -1]], "right")
    b_from, b_to = np.searchsorted(b_ends, common[[0, -1]], "right")
    a_in, b_in, ea, eb = a[a_from:a_to], b[b_from:b_to], a_ends[a_from:a_to], b_ends[b_from:b_to]
    a_group, b_group = np.searchsorted(common, ea), np.searchsorted(common, eb)
    codes = np.empty(len(a_in) + len(b_in), np.int32)
    # a group's first ids stand before its second ones: each id comes after its own kind and what its group puts before it
    codes[np.arange(len(a_in)) + np.searchsorted(eb, common[a_group - 1], "right")] = a_in + LAST * (ea == common[a_group])
    codes[np.arange(len(b_in)) + np.searchsorted(ea, common[b_group], "right")] = b_in + SECOND + LAST * (eb == common[b_group])
    return Fragment(a[:a_from], b[:b_from], codes, a[a_to:], b[b_to:], True, True)


class Words(dict):
    """Word without the space before it -> ids of both vocabularies as bytes, None where they do not spell it; those used of late."""

    def __init__(self, ranks: bytes, model: bytes, pattern: str):
        import sentencepiece
        import tiktoken

        table = {base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks.splitlines())}
        self.first = tiktoken.Encoding("first", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.first_bytes = {i: t for t, i in table.items()}
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        if any(re.search(rf"[^{BLANK}]{BLANK}", p) for p in pieces):
            raise ValueError("pieces cross from a word into a blank, so texts cannot be cut there")
        self.second_bytes = [bytes([int(m[1], 16)]) if (m := BYTE.fullmatch(p)) and self.second.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.blank = self.second.piece_to_id(BLANK)
        self.sizes = np.zeros(max(self.first_bytes) + 1, np.int64), np.array([len(x) for x in self.second_bytes], np.int64)
        for i, t in self.first_bytes.items():
            self.sizes[0][i] = len(t)

        self.before: dict = {}

    def __missing__(self, word: str):
        a = self.first.encode_ordinary(" " + word)
        b = self.second.encode(word) if word else [self.blank]
        return (np.array(a, np.int32).tobytes(), np.array(b, np.int32).tobytes()) if self.spelt(word, a, b) else None

    def spelt(self, text: str, a: list[int], b: list[int]) -> bool:
        return b"".join(map(self.first_bytes.__getitem__, a)) == (" " + text).encode() == b"".join(map(self.second_bytes.__getitem__, b))

    def encoded(self, words: list[str]) -> list:
        """Ids of the words of one text, in their order, each without white space at its end unless it is the last.

        Words that no table holds are encoded as one text, which is cut again where they end: no token crosses from one into
        the space before the next. Each by itself if the tokens do not spell that text.
        """
        text = " ".join(words)
        a, b = self.first.encode_ordinary(" " + text), self.second.encode(text)
        if "" in words or not self.spelt(text, a, b):
            return [self.__missing__(w) for w in words]
        ends = np.cumsum([len(w) for w in words] if text.isascii() else [len(w.encode()) for w in words]) + np.arange(1, len(words) + 1)
        parts = []
        for ids, sizes in zip((a, b), self.sizes, strict=True):
            ids = np.array(ids, np.int32)
            to = (4 * np.searchsorted(np.cumsum(sizes[ids]), ends, "right")).tolist()
            raw = ids.tobytes()
            parts.append([raw[i:j] for i, j in zip([0, *to], to, strict=False)])
        return list(zip(*parts, strict=True))

    def all(self, words: list[str]) -> list:
        """Ids of each word of one text."""
        if len(self) >= HELD:
            self.before = dict(self)
            self.clear()
        new = [w for w in dict.fromkeys(words) if w not in self]
        for w in new:
            if w in self.before:
                self[w] = self.before[w]
        if new := [w for w in new if w not in self]:
            self.update(zip(new, self.encoded(new), strict=True))
        found = list(map(self.__getitem__, words))
        for w in new:
            if len(w) >= 64:
                del self[w]
        return found

    def fragments(self, text: str, start: int = 0, size: int | None = None) -> list[tuple[int, Fragment]]:
        """(range, fragment) of a text that stands after a space and begins at byte ``start``: one for each ``size`` bytes in which
        tokens end, or one for all. A single fragment that is not ok where tokens do not spell the text."""
        words = CUT.split(text) if CROSSED.search(text) or text.startswith(" ") else text.split(" ")
        found = self.all(words)
        if None in found:
            return [(start // size if size else 0, EMPTY._replace(ok=False))]
        a, b = (np.frombuffer(b"".join([x[k] for x in found]), np.int32) for k in (0, 1))
        ends = [start + np.cumsum(self.sizes[k][ids]) for k, ids in ((0, a), (1, b))]
        if size is None:
            return [(0, fragment(a, ends[0], b, ends[1]))]
        out = []
        for r in range(start // size, (int(ends[0][-1]) - 1) // size + 1):
            (a0, a1), (b0, b1) = (np.searchsorted(e, [r * size, (r + 1) * size], "right") for e in ends)
            if a1 > a0 or b1 > b0:
                out.append((r, fragment(a[a0:a1], ends[0][a0:a1], b[b0:b1], ends[1][b0:b1])))
        return out


def linked_pairs(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (first id * width + second id) of groups with m ids of ``a`` and n of ``b``, and how often each is linked."""
    wide = m * n > WIDE
    a_group, starts = np.repeat(np.arange(len(m)), m), np.cumsum(n) - n
    plain = ~wide[a_group]
    times = n[a_group[plain]]
    at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(starts[a_group[plain]], times)
    pairs, count = np.unique(np.repeat(a[plain].astype(np.int64), times) * width + b[at], return_counts=True)
    a_starts = np.cumsum(m) - m
    parts = [(pairs, count)]
    for g in np.flatnonzero(wide):
        ids, k = np.unique(a[a_starts[g] : a_starts[g] + m[g]], return_counts=True)
        others, l = np.unique(b[starts[g] : starts[g] + n[g]], return_counts=True)  # noqa: E741
        parts.append(((ids.astype(np.int64)[:, None] * width + others).ravel(), (k[:, None] * l).ravel()))
    if len(parts) > 1:
        pairs, where = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        count = np.zeros(len(pairs), np.int64)
        np.add.at(count, where, np.concatenate([x for _, x in parts]))
    return pairs, count


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<long>"


def _texts_of_codes() -> list[str]:
    return [f"{i & 0xFFFF}{MARKS[i >> 16]}" for i in range(4 << 16)]


def _finished(found: Fragment, width: int, names: list[str]) -> tuple:
    """A whole text's numbers, digest and pairs; zeros, '' and none where it has no tokens."""
    codes = np.concatenate([group_codes(found.head_a, found.head_b), found.codes])
    if not found.ok or not len(codes):
        return 0, 0, 0, 0, "", NONE, NONE
    kind, ids = codes >> 16, codes & 0xFFFF
    second = kind >= 2
    closes = np.flatnonzero(kind == 3)
    so_far = np.cumsum(second)[closes]
    n = np.diff(so_far, prepend=0)
    m = np.diff(closes + 1 - so_far, prepend=0)
    pairs, times = linked_pairs(ids[~second], m, ids[second], n, width)
    text = "".join(map(names.__getitem__, codes.tolist()))[:-1]
    return int(m.sum()), int(n.sum()), len(closes), int((m * n).sum()), hashlib.sha256(text.encode()).hexdigest(), pairs.astype(np.int32), times


def _batch(ids: list, kind: pa.DataType, id_col: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    names = [x.split()[0] for x in ALIGNED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], [id_col, *names])


class Vocabularies:
    """Both vocabularies as they are sent to tasks: the files' bytes, about 1.3 MB, opened once a worker."""

    open: dict = {}

    def __init__(self, spark: SparkSession, ranks_path: str, model_path: str, pattern: str):
        raw = []
        for path in (ranks_path, model_path):
            with open(path, "rb") as f:
                raw.append(f.read())
        words = Words(*raw, pattern)
        self.first, self.width = len(words.sizes[0]), len(words.sizes[1])
        if max(self.first, self.width) > 1 << 16 or self.first * self.width > 1 << 31:
            raise ValueError("vocabularies of over 65,536 ids, or with over 2^31 pairs of ids")
        self.sent, self.pattern = spark.sparkContext.broadcast(tuple(raw)), pattern

    def words(self) -> Words:
        key = hash((self.sent.value, self.pattern))
        if key not in self.open:
            self.open[key] = (Words(*self.sent.value, self.pattern), _texts_of_codes())
        return self.open[key][0]

    def names(self) -> list[str]:
        self.words()
        return self.open[hash((self.sent.value, self.pattern))][1]


def _short(docs: DataFrame, kind: str, id_col: str, both: Vocabularies) -> DataFrame:
    def work(batches):
        words, names = both.words(), both.names()
        for batch in batches:
            ids, rows, held = [], [], 0
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                ids.append(i.as_py())
                rows.append(_finished(words.fragments(text)[0][1] if text else EMPTY, both.width, names))
                held += len(text or "")
                if held > SLICE:
                    yield _batch(ids, batch.schema.field(0).type, id_col, rows)
                    ids, rows, held = [], [], 0
            yield _batch(ids, batch.schema.field(0).type, id_col, rows)

    return docs.mapInArrow(work, f"`{id_col}` {kind}, {ALIGNED}")


def chunks(text: str, size: int) -> list[tuple[int, str]]:
    """(byte where it begins, text) of pieces of about ``size`` characters; each stands after a space, which is not in it."""
    out, at, start = [], 0, 0
    while at <= len(text):
        cut = CUT.search(text, at + size) if len(text) - at > size else None
        piece = text[at : cut.start()] if cut else text[at:]
        out.append((start, piece))
        if not cut:
            break
        start += 1 + len(piece.encode())
        at = cut.start() + 1
    return out


def _long(docs: DataFrame, kind: str, id_col: str, both: Vocabularies, size: int) -> DataFrame:
    """Texts spread over tasks: chunks, a fragment for each range of bytes, and fragments composed ``FAN`` ranges at a time."""

    def cut(batches):
        for batch in batches:
            for row, i, text in zip(*batch.columns, strict=True):
                found = chunks(text.as_py(), size)
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * n, pa.int64()), pa.array([i.as_py()] * n, batch.schema.field(1).type), pa.array(range(n), pa.int64()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], ["row", id_col, "chunk", "start", "text"])

    def spans(batches):
        words = both.words()
        for batch in batches:
            for row, i, chunk, start, text in zip(*batch.columns, strict=True):
                found = words.fragments(text.as_py(), start.as_py(), size)
                keys = [[row.as_py()] * len(found), [i.as_py()] * len(found), [r for r, _ in found], [chunk.as_py()] * len(found)]
                types = [pa.int64(), batch.schema.field(1).type, pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([*[pa.array(k, t) for k, t in zip(keys, types, strict=True)], *_columns([f for _, f in found])], ["row", id_col, "range", "chunk", *Fragment._fields])

    def whole(table: pa.Table) -> Fragment:
        return reduce(compose, _fragments(table.sort_by([("range", "ascending"), ("chunk", "ascending")])))

    def step(table: pa.Table) -> pa.Table:
        keys = [table[c].slice(0, 1) for c in ("row", id_col, "part", "chunk")]
        return pa.table([*keys, *_columns([whole(table)])], ["row", id_col, "range", "chunk", *Fragment._fields])

    def last(table: pa.Table) -> pa.Table:
        both.words()
        return pa.Table.from_batches([_batch([table[id_col][0].as_py()], table.schema.field(id_col).type, id_col, [_finished(whole(table), both.width, both.names())])])

    keyed = docs.withColumn("row", F.monotonically_increasing_id()).select("row", id_col, "text")
    pieces = materialise(keyed.mapInArrow(cut, f"row long, `{id_col}` {kind}, chunk long, start long, text string"), "chunks")
    schema = f"row long, `{id_col}` {kind}, range long, chunk long, {FIELDS}"
    rows = pieces.repartition("row", "chunk").mapInArrow(spans, schema)
    top = pieces.agg(F.max(F.col("start") + F.octet_length("text"))).first()[0] or 0
    reach = top // size + 1
    while True:
        if reach <= FAN:
            return rows.groupBy("row").applyInArrow(last, f"`{id_col}` {kind}, {ALIGNED}")
        rows = rows.withColumn("part", F.expr(f"range div {FAN}")).groupBy("row", "part").applyInArrow(step, schema)
        reach = -(-reach // FAN)


def _columns(found: list[Fragment]) -> list[pa.Array]:
    return [*[pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in range(5)], pa.array([f.cut for f in found], pa.bool_()), pa.array([f.ok for f in found], pa.bool_())]


def _fragments(table) -> list[Fragment]:
    cols = [table[c] if isinstance(table, pa.Table) else table.column(c) for c in Fragment._fields]
    return [Fragment(*[x.values.to_numpy(zero_copy_only=False).astype(np.int32) for x in row[:5]], row[5].as_py(), row[6].as_py()) for row in zip(*cols, strict=True)]


def aligned_texts(docs: DataFrame, both: Vocabularies, id_col: str = "doc_id", text_col: str = "text", size: int = RANGE) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times), a row per input row.

    Texts up to ``size`` characters are encoded where they are. Longer ones are cut into chunks that several tasks encode, and
    their fragments, one for each ``size`` bytes of the text, are composed in a tree.
    """
    plain = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"))
    kind = dict(docs.dtypes)[id_col]
    long = F.coalesce(F.length("text") > size, F.lit(False))
    return _short(plain.filter(~long), kind, id_col, both).unionByName(_long(plain.filter(long), kind, id_col, both, size))


def pair_weights(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, docs, best): in how many texts a pair is linked, and whether no pair of its first id is in more.

    The most of each first id goes to the pairs' tasks: a row per id of that vocabulary at most.
    """
    linked = materialise(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")), "pairs")
    first = F.expr(f"pair div {width}").alias("first")
    most = linked.groupBy(first).agg(F.max("docs").alias("most"))
    return linked.select("pair", "docs", first).join(F.broadcast(most), "first").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, ranks_path: str, model_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = RANGE, frequent: int = FREQUENT) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row per input row.

    The first vocabulary's tokens of a space and the text, and the second's of the text, are cut into groups where both end.
    Null and empty texts, and those that the tokens of either do not spell, have zeros and ''. Repeated rows give repeated
    rows and count as texts of their own; other columns are not read; an empty table gives none. The ``frequent`` most
    frequent pairs are sent to every task, which bounds what is sent; the other pairs of each text meet their counts in a
    join, where none of them is in many texts.
    """
    spark = docs.sparkSession
    both = Vocabularies(spark, ranks_path, model_path, pattern)
    aligned = materialise(aligned_texts(docs, both, id_col, text_col, size).withColumn("row", F.monotonically_increasing_id()), "aligned")
    weights = materialise(pair_weights(aligned, both.width), "pair-weights")
    top = weights.orderBy(F.desc("docs"), "pair").limit(frequent).toArrow().sort_by("pair")
    sent = spark.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("pair", "docs", "best")))
    numbers = ["row", id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kinds = dict(aligned.dtypes)

    def weigh(batches):
        keys, docs_of, best_of = sent.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            flat, n = pairs.flatten().to_numpy(), times.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(pairs.value_lengths().fill_null(0).to_numpy())]).astype(np.int64)
            at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
            hit = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[ends])
            known = [np.zeros(len(flat), np.int64)] * 2 if not len(keys) else [np.where(hit, n * docs_of[at], 0), np.where(hit, n * best_of[at], 0)]
            offsets = pa.array(np.concatenate([[0], np.cumsum(~hit)])[ends], pa.int32())
            rare = [pa.ListArray.from_arrays(offsets, pa.array(x[~hit], t)) for x, t in ((flat, pa.int32()), (n, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in numbers], pa.array(total(known[0])), pa.array(total(known[1])), *rare], [*numbers, "sum_", "best_", "pairs", "times"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in numbers) + ", sum_ long, best_ long, pairs array<int>, times array<long>"
    weighed = materialise(aligned.select(*numbers, "pairs", "times").mapInArrow(weigh, schema), "weighed")
    rare = weighed.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rest = rare.join(weights, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("docs")).alias("more"), F.sum(F.col("times") * F.col("best").cast("int")).alias("better"))
    n_best = F.col("best_") + F.coalesce("better", F.lit(0))
    count_sum = F.col("sum_") + F.coalesce("more", F.lit(0))
    return weighed.drop("pairs", "times").join(rest, "row", "left").select(id_col, "n_a", "n_b", "n_groups", "n_links", n_best.alias("n_best"), count_sum.alias("count_sum"), "groups_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups and links between the byte-level vocabulary and the one of pieces."""
    import public_tokenizers as P

    return align(read(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model"), P.PATTERN)
