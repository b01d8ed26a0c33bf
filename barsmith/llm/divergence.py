"""Source divergence audit: how each source's words differ from its language's and from those of other sources."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, read

SCALE = 1_000_000_000
#: A language keeps the terms that stand in so many of its documents.
LEAST_DOCS = 3
#: Ranks of terms that are given.
TOP = 200
#: Entries of a task's counting tables before they are handed on (about 100 MB).
HELD = 400_000
#: Terms of a chunk and sources of a block, which bound a task's matrices; rows that one local skyband looks at.
CHUNK, BLOCK, BAND = 4096, 64, 65_536
#: Parts of a group that are merged apart before its ranks are made.
SALTS = 16

#: ASCII letters in lower case, bytes of other characters as they are, all else a space.
FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def count_terms(docs: DataFrame, most: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs) of ``docs(lang, source, text)``: occurrences, and documents that hold the term.

    A task counts in tables that it hands on when they are full, so that a word costs a row per task and not per place.
    """

    def work(batches):
        tables: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def rows():
            for (lang, source), (n, seen) in tables.items():
                size = len(n)
                cols = [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([seen[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"])
            tables.clear()

        for batch in batches:
            for lang, source, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = text.translate(FOLD).split()
                n, seen = tables.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                n.update(words)
                seen.update(set(words))
                held += len(n)
                if held > most:
                    yield from rows()
                    held = 0
        yield from rows()

    counted = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(work, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total), exact: in longs while the product fits, else in decimals; 1 for a total of 0."""
    wide = 1 + F.call_function("div", (n + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)"), total.cast("decimal(19,0)"))
    return F.when(total == 0, F.lit(1).cast("long")).when(n < 9_000_000_000, 1 + F.call_function("div", SCALE * (n + 1), total)).otherwise(wide)


def excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def skyband(totals: list[int], terms: list[str], k: int) -> list[int]:
    """Places of the rows that fewer than ``k`` others dominate; rows come by count down, total up, term up.

    What dominates a row (no lower count, no higher total, an earlier term) stands before it. A Fenwick tree over the
    terms' order holds at each node the ``k`` lowest totals of its span, so a row counts its dominators in a few searches.
    Rows left out need no place: ``k`` of the kept dominate whatever they would.
    """
    size = len(terms)
    rank = [0] * size
    for r, i in enumerate(sorted(range(size), key=terms.__getitem__), 1):
        rank[i] = r
    nodes: list[list[int]] = [[] for _ in range(size + 1)]
    kept = []
    for i, total in enumerate(totals):
        above, at = 0, rank[i] - 1
        while at and above < k:
            above += bisect_right(nodes[at], total)
            at &= at - 1
        if above >= k:
            continue
        kept.append(i)
        at = rank[i]
        while at <= size:
            node = nodes[at]
            if len(node) < k:
                insort(node, total)
            elif total < node[-1]:
                node.pop()
                insort(node, total)
            at += at & -at
    return kept


def skybands(rows: DataFrame, k: int, most: int = BAND) -> DataFrame:
    """Of ``rows(lang, source, term, n, total, value)`` those that fewer than ``k`` rows of the same group dominate within their
    partition, or within each ``most`` rows of it: whatever ranks up to ``k`` in its group stays."""

    def work(batches):
        group, held = None, []

        def band():
            if held:
                table = pa.Table.from_batches(held)
                kept = skyband(table["total"].to_pylist(), table["term"].to_pylist(), k)
                yield from table.take(pa.array(kept, pa.int64())).combine_chunks().to_batches()
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            lang, source = (batch.column(c).dictionary_encode().indices.to_numpy() for c in ("lang", "source"))
            starts = [0, *(np.flatnonzero((np.diff(lang) != 0) | (np.diff(source) != 0)) + 1), batch.num_rows]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                name = (batch.column("lang")[a].as_py(), batch.column("source")[a].as_py())
                if name != group or sum(x.num_rows for x in held) >= most:
                    yield from band()
                group = name
                held.append(batch.slice(int(a), int(b - a)))
        yield from band()

    by = ["lang", "source", F.desc("n"), "total", "term"]
    cols = ["lang", "source", "term", "n", "total", "value"]
    return rows.select(cols).sortWithinPartitions(*by).mapInArrow(work, "lang string, source string, term string, n long, total long, value long")


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def top_terms(kept: DataFrame, groups: DataFrame, k: int = TOP, band: int = BAND) -> DataFrame:
    """The ``k`` terms of each group whose share exceeds the language's the most.

    The value grows with the group's count and falls with the language's, and ties go to the earlier term: a term that ``k``
    others dominate in all three cannot rank. Partitions keep their skybands, these are merged in ``SALTS`` parts a group,
    and only what is left is ranked.
    """
    rows = kept.join(groups.select("lang", "source", "size", "vocabulary", "lang_size"), ["lang", "source"])
    p, q = share(F.col("n"), F.col("size") + F.col("vocabulary")), share(F.col("total"), F.col("lang_size") + F.col("vocabulary"))
    rows = rows.withColumns({"p": p, "q": q}).filter("p > q").withColumn("value", excess(F.col("p"), F.col("q")))
    merged = skybands(rows, k, band).repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(SALTS)))
    ranked = _ranked(skybands(merged, k, band).select("lang", "source", F.col("term").alias("item"), "value"))
    return ranked.filter(F.col("rank") <= k)


def _contrast(table: pa.Table, block: int) -> pa.Table:
    """Of one chunk of terms and two blocks of sources: each pair's value over the chunk's terms, and how many these are."""
    lang, lo, hi = (table[c][0].as_py() for c in ("lang", "lo", "hi"))
    place, p, base = (table[c].to_numpy() for c in ("place", "p", "base"))
    places, at = np.unique(place, return_inverse=True)
    floor = np.empty(len(places), np.int64)
    floor[at] = base
    codes = table["term"].combine_chunks().dictionary_encode()
    codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
    size = len(codes.dictionary)
    real = codes.indices.is_valid().to_numpy(zero_copy_only=False)
    shares = np.tile(floor, (size, 1))
    shares[codes.indices.drop_null().to_numpy(), at[real]] = p[real]
    first, second = np.flatnonzero(places // block == lo), np.flatnonzero(places // block == hi)
    out: list[np.ndarray] = []
    for left, right in [(first, second)] if lo == hi else [(first, second), (second, first)]:
        q = shares[:, right]
        for s in left:
            gap = shares[:, s : s + 1] - q
            value = (gap * gap // q).sum(0)
            out.append(np.stack([np.full(len(right), places[s]), places[right], value])[:, right != s])
    s, o, value = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
    return pa.table({"lang": pa.array([lang] * len(s), pa.string()), "s": s, "o": o, "value": value, "terms": np.full(len(s), size)})


def source_pairs(kept: DataFrame, groups: DataFrame, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """Every ordered pair of a language's sources with its value over all kept terms.

    A blocked product: chunks of terms meet blocks of sources as matrices, and their sums are added. Terms that no source of
    two blocks holds are not sent there; they all have the same value, which is added once a pair.
    """
    blocks = F.expr(f"transform(sequence(0, (sources - 1) div {block}), b -> struct(cast(least(b, place div {block}) as long) as lo, cast(greatest(b, place div {block}) as long) as hi))")
    chunks = F.greatest(F.lit(1), F.ceil(F.col("vocabulary") / chunk)).cast("long")
    cols = ["lang", "place", "p", "base", "term", "chunk", "b.lo", "b.hi"]
    rows = kept.join(groups, ["lang", "source"]).withColumns({"p": share(F.col("n"), F.col("size") + F.col("vocabulary")), "chunk": F.pmod(F.xxhash64("term"), chunks), "b": F.explode(blocks)}).select(cols)
    zero = groups.withColumns({"p": F.col("base"), "term": F.lit(None).cast("string"), "b": F.explode(blocks)}).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))).select(cols)
    sums = rows.unionByName(zero).groupBy("lang", "chunk", "lo", "hi").applyInArrow(lambda table: _contrast(table, block), "lang string, s long, o long, value long, terms long")
    sums = sums.groupBy("lang", "s", "o").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    one = groups.select("lang", F.col("place").alias("s"), "source", F.col("base").alias("p0"), "vocabulary")
    other = groups.select("lang", F.col("place").alias("o"), F.col("source").alias("item"), F.col("base").alias("q0"))
    rest = (F.col("vocabulary") - F.col("terms")) * excess(F.col("p0"), F.col("q0"))
    return _ranked(sums.join(one, ["lang", "s"]).join(other, ["lang", "o"]).select("lang", "source", "item", (F.col("value") + rest).alias("value")))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", top: int = TOP, least_docs: int = LEAST_DOCS, held: int = HELD, band: int = BAND, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): what sets each (lang, source) group apart.

    Part ``term``: the group's terms over their share in the language, ranks up to ``top``. Part ``pair``: the language's
    other sources, all ranks. Nulls in text, language and source are ''; a group without terms has pairs only, and one
    without other sources none. Repeated rows count as often as they stand; other columns are not read; an empty table
    gives none. Only counts reach a shuffle; tables that are read again go to the shared folder.
    """
    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = materialise(count_terms(plain, held), "term-counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    terms = materialise(terms.select("lang", "term", "total"), "kept-terms")
    kept = materialise(counts.select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "kept-counts")
    langs = terms.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("total").alias("lang_size"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = plain.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "vocabulary", "lang_size"])
    w = Window.partitionBy("lang")
    place = (F.row_number().over(w.orderBy("source")) - 1).cast("long")
    groups = groups.withColumns({"place": place, "sources": F.count("*").over(w), "base": share(F.lit(0).cast("long"), F.col("size") + F.col("vocabulary"))})
    groups = materialise(groups, "term-groups")
    both = [source_pairs(kept, groups, chunk, block).withColumn("part", F.lit("pair")), top_terms(kept, groups, top, band).withColumn("part", F.lit("term"))]
    return both[0].unionByName(both[1]).select("lang", "source", "part", "item", "value", "rank")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of ``documents`` against its language and the other sources of it."""
    return audit(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text, row_number() over () as rid from documents),
w as (select lang, source, rid, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
kt as (select lang, term, count(*) as total from w group by lang, term having count(distinct rid) >= 3),
c as (select lang, source, term, count(*) as n from w semi join kt using (lang, term) group by all),
lv as (select lang, count(*) as v, sum(total) as size from kt group by lang),
gs as (select lang, source, sum(n) as size from c group by all),
g as (select a.lang, a.source, coalesce(gs.size, 0)::hugeint as n, coalesce(lv.v, 0)::hugeint as v, coalesce(lv.size, 0)::hugeint as ln from (select distinct lang, source from d) a left join gs using (lang, source) left join lv using (lang)),
p as (select g.lang, g.source, kt.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (g.n + g.v) as p, 1 + (1000000000::hugeint * (kt.total + 1)) // (g.ln + g.v) as q from g join kt using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = kt.term),
pv as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pa as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pv.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source),
te as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // q)::bigint as value from p where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pa union all select * from te))
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 200
"""
