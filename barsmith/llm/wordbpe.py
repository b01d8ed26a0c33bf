"""BPE with word ends through a table of distinct words: each is encoded once, and its ids go back to its places."""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections import defaultdict
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, read

#: Characters of the texts that meet their words in one task, and bytes that a task packs at once.
BLOCK_CHARS, PACKED = 40_000_000, 32_000_000
#: Words encoded by one call.
CALL = 20_000


def vocabulary(path: str) -> dict[int, str]:
    """Id -> piece of a tokenizer's file, added tokens included."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return {i: piece for piece, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}


_open: dict[int, object] = {}


def _tokenizer(raw: str):
    """The tokenizer of a file's text, opened once a worker."""
    if (key := hash(raw)) not in _open:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _open[key] = Tokenizer.from_str(raw)
        _open[key].no_truncation()
        _open[key].no_padding()
    return _open[key]


def _packed(docs: DataFrame, id_col: str, text_col: str, blocks: int) -> DataFrame:
    """(block, ids, sizes, data): texts dealt to blocks by a hash, packed and compressed before they are shuffled."""

    def work(batches):
        held, size = defaultdict(lambda: ([], [])), 0

        def rows():
            press = zstandard.ZstdCompressor(level=3)
            for block, (ids, texts) in held.items():
                sizes = np.array([len(t) for t in texts], "<u4")
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([ids], pa.list_(kind)), pa.array([sizes.tobytes()], pa.binary()), pa.array([press.compress(b"".join(texts))], pa.binary())], ["block", "ids", "sizes", "data"])
            held.clear()

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for i, text, block in zip(*batch.columns, strict=True):
                ids, texts = held[block.as_py()]
                ids.append(i.as_py())
                texts.append(text.as_py())
                size += len(texts[-1])
                if size > PACKED:
                    yield from rows()
                    size = 0
        yield from rows()

    text = F.coalesce(F.col(text_col), F.lit(""))
    block = F.pmod(F.xxhash64(F.col(id_col), text), F.lit(blocks)).cast("int")
    rows = docs.select(F.col(id_col).alias("id"), text.cast("binary").alias("text"), block.alias("block"))
    return rows.mapInArrow(work, f"block int, ids array<{dict(docs.dtypes)[id_col]}>, sizes binary, data binary").repartition(blocks, "block")


def _texts(sizes, data) -> list[bytes]:
    flat, ends = zstandard.ZstdDecompressor().decompress(data.as_py()), np.cumsum(np.frombuffer(sizes.as_py(), "<u4"))
    return [flat[a:b] for a, b in pairwise([0, *ends.tolist()])]


def _dealt(words: set[bytes], parts: int) -> dict[int, list[bytes]]:
    """Words by the part that a hash deals them to, in their order."""
    dealt = defaultdict(list)
    for word in sorted(words):
        dealt[zlib.crc32(word) % parts].append(word)
    return dealt


def _words_of_blocks(packed: DataFrame, parts: int) -> DataFrame:
    """(part, block, words): the distinct words of each block, those of a part in order; white space joins them."""

    def work(batches):
        held: dict[int, set[bytes]] = defaultdict(set)
        for batch in batches:
            for block, _, sizes, data in zip(*batch.columns, strict=True):
                for text in _texts(sizes, data):
                    held[block.as_py()].update(text.split())
        for block, words in held.items():
            for part, found in _dealt(words, parts).items():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([b" ".join(found)], pa.binary())], ["part", "block", "words"])

    return packed.mapInArrow(work, "part int, block int, words binary")


def _encoded_words(words: DataFrame, parts: int, raw) -> DataFrame:
    """(part, block, counts, ids): the numbers of ids of each row's words and, in a row, their ids.

    All blocks' askings for a word come to one task, whose table of distinct words encodes it once.
    """

    def work(batches):
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for part, block, joined in zip(*batch.columns, strict=True):
                asked = joined.as_py().split(b" ")
                fresh = [w for w in asked if w not in known]
                for at in range(0, len(fresh), CALL):
                    some = fresh[at : at + CALL]
                    for word, found in zip(some, _tokenizer(raw.value).encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False), strict=True):
                        known[word] = np.array(found.ids, "<u2").tobytes()
                ids = [known[w] for w in asked]
                counts = np.array([len(x) // 2 for x in ids], "<u4")
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()], pa.int32()), pa.array([block.as_py()], pa.int32()), pa.array([counts.tobytes()], pa.binary()), pa.array([b"".join(ids)], pa.binary())], ["part", "block", "counts", "ids"])

    return words.repartition(parts, "part").mapInArrow(work, "part int, block int, counts binary, ids binary")


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, [ids array,] n_tokens, ids_sha256, decoded_sha256), a row per input row; a null text is empty and has no ids.

    White space of the six ASCII characters ends every token, so texts are split there and words stand for themselves.
    Texts are dealt to blocks of ``block_chars`` characters; a block asks for each of its distinct words once, askings for
    the same word meet in one task, which encodes it once, and the ids come back to the block, whose texts put them in the
    places of their words. The pieces of each distinct word's ids are joined in from the vocabulary, whose size bounds what
    is sent to tasks. A text stays in one row; repeated rows give repeated rows, other columns are not read, an empty table
    gives none. Vocabularies have up to 65,536 ids.
    """
    spark = docs.sparkSession
    names = vocabulary(tokenizer_path)
    if max(names) >= 1 << 16:
        raise ValueError("a vocabulary of over 65,536 ids")
    with open(tokenizer_path, encoding="utf-8") as f:
        raw = spark.sparkContext.broadcast(f.read())
    pieces = spark.sparkContext.broadcast(names)
    blocks = max(1, -(-(docs.agg(F.sum(F.length(text_col))).first()[0] or 0) // block_chars))
    parts = 2 * blocks
    packed = _packed(docs, id_col, text_col, blocks)
    found = _encoded_words(_words_of_blocks(packed, parts), parts, raw)
    fields = [f"`{id_col}` {dict(docs.dtypes)[id_col]}", *(["ids array<int>"] if keep_ids else []), "n_tokens long", "ids_sha256 string", "decoded_sha256 string"]

    def place(text_rows: pa.Table, word_rows: pa.Table) -> pa.Table:
        texts = [t for x in zip(text_rows["sizes"], text_rows["data"], strict=True) for t in _texts(*x)]
        dealt = _dealt({w for text in texts for w in text.split()}, parts)
        table, piece = {}, pieces.value
        for part, counts, ids in zip(*[word_rows[c] for c in ("part", "counts", "ids")], strict=True):
            flat = np.frombuffer(ids.as_py(), "<u2")
            wide, shown, ends = flat.astype("<u4").tobytes(), [piece[i] for i in flat.tolist()], np.cumsum(np.frombuffer(counts.as_py(), "<u4")).tolist()
            for word, (a, b) in zip(dealt[part.as_py()], pairwise([0, *ends]), strict=True):
                table[word] = wide[4 * a : 4 * b], " ".join(shown[a:b]).encode()
        all_ids, n, sha, dec = [], [], [], []
        for text in texts:
            words = list(map(table.__getitem__, text.split()))
            ids = b"".join([x[0] for x in words])
            n.append(len(ids) // 4)
            sha.append(hashlib.sha256(ids).hexdigest())
            dec.append(hashlib.sha256(b" ".join([x[1] for x in words if x[1]])).hexdigest())
            if keep_ids:
                all_ids.append(np.frombuffer(ids, "<i4"))
        ids_of_rows = pa.concat_arrays([x.values for x in text_rows["ids"]])
        cols = {id_col: ids_of_rows} | ({"ids": pa.array(all_ids, pa.list_(pa.int32()))} if keep_ids else {})
        return pa.table(cols | {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array(dec, pa.string())})

    return packed.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(place, ", ".join(fields))


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): each row's pieces, joined in by id and put in order with a space between; null or no ids give ''.

    A row per input row, repeated ones too; an unknown id leaves its place out. The vocabulary is the broadcast side.
    """
    spark = encoded.sparkSession
    table = spark.createDataFrame(list(vocabulary(tokenizer_path).items()), "piece_id int, piece string")
    path = fresh_path(spark, "encoded")
    encoded.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids")).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    flat = rows.select("row", F.posexplode("ids").alias("place", "piece_id")).join(F.broadcast(table), "piece_id")
    texts = flat.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda x: x["piece"]), " ").alias("text"))
    return rows.select("row", F.col("id").alias(id_col)).join(texts, "row", "left").select(id_col, F.coalesce("text", F.lit("")).alias("text"))


def op13_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count and the digests of its ids and of their decoded text."""
    import public_tokenizers

    return encode(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
