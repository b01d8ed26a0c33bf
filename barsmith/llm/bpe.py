"""Byte-level BPE: exact merges in linear time by backtracking over longest matches."""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import read

#: Entries of a worker's caches, and of each of the two generations of chunks (about 130 MB in all); results do not depend on them.
CACHE, GENERATION = 120_000, 200_000
#: Characters that a worker encodes before it hands rows on.
SLICE = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


#: Where a match may cross into a space: after other white space, and at either end of the text.
CROSSED = re.compile(r"\s |^ | $")


#: A pattern that begins so matches a space and ASCII letters as one piece.
WORDS_FIRST = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+|"


class Chunks(dict):
    """Chunk without its leading space -> ids with it, those used of late and of the generation before."""

    def __init__(self, codec: Codec):
        self.codec, self.before = codec, {}

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        found = self.before.get(chunk)
        if found is None:
            found = self.codec.encode_chunk(" " + chunk)
            if len(chunk) >= 64:
                return found
        if len(self) >= GENERATION:
            self.before = dict(self)
            self.clear()
        self[chunk] = found
        return found

    def known(self, chunk: str) -> tuple[int, ...] | None:
        return self.get(chunk) or self.before.get(chunk)


class Codec:
    """Encodes and decodes with one vocabulary whose ranks are its ids.

    ``parts`` holds the two tokens whose merge makes a token, found by merging its bytes with lower ranks only. Tokens
    that merging can never make stay out of the automaton; as in tiktoken they stand only for a whole piece.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.words_first = ranks, regex.compile(pattern), pattern.startswith(WORDS_FIRST)
        self.vocab = {rank: token for token, rank in ranks.items()}
        self.names = {rank: str(rank) for rank in self.vocab}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        self.trie = ahocorasick.Automaton()
        made = set()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            halves = self._halves(token, rank)
            if len(token) > 1 and halves is None:
                continue
            self.parts[rank] = halves or (rank, rank)
            if halves:
                self.merges[halves] = rank
            made.add(token)
            self.trie.add_word(token.decode("latin-1"), (rank, len(token)))
        self.trie.make_automaton()
        #: the longest shorter token that a token starts with, or -1
        self.shorter = {ranks[t]: next((ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in made), -1) for t in made}
        self.length = {rank: len(token) for rank, token in self.vocab.items()}
        self.joins: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.chunks = Chunks(self)

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The last two tokens before merging completes ``token``; None if merging never does."""
        seq = [token[i : i + 1] for i in range(len(token))]
        while len(seq) > 2:
            low, at = min(((self.ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(seq, seq[1:], strict=False))), default=(rank, 0))
            if low >= rank:
                return None
            seq[at : at + 2] = [seq[at] + seq[at + 1]]
        return (self.ranks[seq[0]], self.ranks[seq[1]]) if len(seq) == 2 else None

    def _apart(self, left: int, right: int) -> bool:
        """True if merging leaves the boundary between two adjacent tokens alone.

        Walks the merges of both tokens backwards from the latest; a merge across the boundary wins if it comes before
        the merge that would consume either neighbour.
        """
        bound = 1 << 60
        while True:
            across = self.merges.get((left, right))
            if across is not None and across < bound:
                return False
            for _ in range(2):
                if left > right:
                    inner = self.parts[left][1]
                    if inner != left:
                        bound, left = left, inner
                        break
                    bound = right + 1
                    inner = self.parts[right][0]
                    if inner == right:
                        return True
                    right = inner
                    break
                inner = self.parts[right][0]
                if inner != right:
                    bound, right = right + 1, inner
                    break
                bound = left
                inner = self.parts[left][1]
                if inner == left:
                    return True
                left = inner
                break

    def _compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.joins.get(key)
        if known is None:
            if len(self.joins) > 2 * CACHE:
                self.joins.clear()
            known = self.joins[key] = self._apart(left, right)
        return known

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pattern match; each position is left for a shorter token at most once per token, so time is linear."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        longest = [0] * n
        for end, (rank, size) in self.trie.iter(piece.decode("latin-1")):
            longest[end - size + 1] = rank
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        length, shorter, joins, compatible = self.length, self.shorter, self.joins, self._compatible
        while True:
            end = at + length[token]
            if open_[end] and (not out or joins.get(out[-1] << 32 | token) or compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return tuple(out)
                token = longest[at]
            elif (token := shorter[token]) < 0:
                open_[at] = 0
                token = out.pop()
                at -= length[token]

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        if self.words_first and chunk[0] == " " and chunk.isascii() and chunk[1:].isalpha():
            return self.pieces.get(chunk) or self.encode_piece(chunk.encode())
        found = self.pattern.findall(chunk)
        if found == [chunk]:  # kept as a chunk by the caller
            return self.pieces.get(chunk) or self.encode_piece(chunk.encode("utf-8", "surrogatepass"))
        out: list[int] = []
        for piece in found:
            ids = self.pieces.get(piece) or (piece[0] == " " and self.chunks.known(piece[1:]))
            if not ids:
                if len(self.pieces) > CACHE:
                    self.pieces.clear()
                ids = self.encode_piece(piece.encode("utf-8", "surrogatepass"))
                if len(piece) < 64:
                    self.pieces[piece] = ids
            out += ids
        return tuple(out)

    def encode(self, text: str) -> tuple[list[int], str]:
        """Ids, and the same as decimal text with commas.

        No match crosses from other characters into a space, so the text is cut before its spaces and each chunk is
        encoded once; where white space precedes a space a match may cross it, and such texts are matched whole.
        """
        if not text:
            return [], ""
        if CROSSED.search(text):
            ids = list(self.encode_chunk(text))
        else:
            first, *rest = text.split(" ")
            ids = [*self.encode_chunk(first), *chain.from_iterable(map(self.chunks.__getitem__, rest))]
        return ids, ",".join(map(self.names.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(raw: bytes, pattern: str) -> Codec:
    key = (hash(raw), pattern)
    if key not in _codecs:
        _codecs[key] = Codec({base64.b64decode(t): int(r) for t, r in map(bytes.split, raw.splitlines())}, pattern)
    return _codecs[key]


def _broadcast(spark: SparkSession, ranks_path: str):
    with open(ranks_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def slices(texts: pa.Array, most: int = SLICE) -> list[tuple[int, int]]:
    """Ranges of rows whose texts have about ``most`` bytes together, a longer text by itself; one empty range for no rows."""
    ends, at, out = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), 0, []
    while at < len(ends):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        out.append((at, to))
        at = to
    return out or [(0, 0)]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(id, ids array, n_tokens, ids_sha256, decoded_sha256), a row per input row; a null text is empty and has no ids.

    ``pattern`` must not match across a space from other characters than white space (see Codec.encode).
    Each batch streams through one worker whose caches are bounded; nothing is shuffled. Repeated rows give repeated
    rows; other columns are not read. The vocabulary file (about 1 MB) is broadcast. ``keep_ids=False`` leaves ids out.
    """
    raw = _broadcast(docs.sparkSession, ranks_path)
    kind = dict(docs.dtypes)[id_col]
    fields = [f"{id_col} {kind}", *(["ids array<int>"] if keep_ids else []), "n_tokens long", "ids_sha256 string", "decoded_sha256 string"]

    def work(batches):
        codec = _codec(raw.value, pattern)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids_out, n, sha, dec = [], [], [], []
                for text in batch.column(1).slice(a, b - a):
                    ids, joined = codec.encode(text.as_py() or "")
                    n.append(len(ids))
                    sha.append(hashlib.sha256(joined.encode()).hexdigest())
                    dec.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                    if keep_ids:
                        ids_out.append(np.array(ids, np.int32))
                cols = [batch.column(0).slice(a, b - a)]
                if keep_ids:
                    cols.append(pa.array(ids_out, pa.list_(pa.int32())))
                cols += [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(dec, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in fields])

    return docs.select(id_col, text_col).mapInArrow(work, ", ".join(fields))


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes) of each row's ids; null ids give empty bytes. Decoding is exact: the bytes are those encoded."""
    raw = _broadcast(encoded.sparkSession, ranks_path)

    def work(batches):
        codec = _codec(raw.value, pattern)
        for batch in batches:
            data = [codec.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], [id_col, "bytes"])

    return encoded.select(id_col, ids_col).mapInArrow(work, f"{id_col} {dict(encoded.dtypes)[id_col]}, bytes binary")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count and the digests of its ids and of the decoded bytes."""
    import public_tokenizers

    return encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
