"""Mixing sources to target weights: fixed-length token blocks dealt to output shards by index."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, materialise, read, word_count, words

#: Words in a block, the weights that sources get in turn, and the most sources that one mix takes.
BLOCK, WEIGHTS, MAX_SOURCES = 128, (3, 1, 2), 100_000
#: Slots that one row of the dealing plan expands to at most.
SPREAD = 1 << 16
#: Slots that one task expands to, about.
TASK_SLOTS = 1 << 20


def source_targets(sizes: list[int], weights: list[float], share: float = 1.5, ceiling: float = 2.0) -> list[float]:
    """Words that each source should give: ``share`` of all sizes by weight; what exceeds ``ceiling`` times a size is reshared."""
    caps = [ceiling * s for s in sizes]
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        total = sum(weights[i] for i in free)
        full = {i for i in free if left * weights[i] / total >= caps[i]}
        if not full:
            for i in free:
                target[i] = left * weights[i] / total
            break
        for i in sorted(full):
            target[i] = caps[i]
        left -= sum(caps[i] for i in full)
        free -= full
    return target


def _scramble(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False, rounds: int = 4) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..n-1 (or its inverse), elementwise: a Feistel network walked until it lands below n."""
    x, n, key = (np.asarray(a, np.uint64).copy() for a in (index, n, key))
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n.astype(np.float64), 2)) / 2)).astype(np.uint64)
    half += ((np.uint64(1) << (half + half)) < n).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    todo = np.ones(len(x), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            a, b, h, m, k = x[todo] >> half[todo], x[todo] & low[todo], half[todo], low[todo], key[todo]
            for r in range(rounds - 1, -1, -1) if back else range(rounds):
                turn = k + np.uint64(r) * np.uint64(0xA24BAED4963EE407)
                if back:
                    a, b = b ^ (_scramble(a, turn) & m), a
                else:
                    a, b = b, a ^ (_scramble(b, turn) & m)
            x[todo] = (a << h) | b
            todo &= x >= n
    return x.astype(np.int64)


def _key(seed: int, source: int, turn: int) -> int:
    return (seed * 0x2545F491 + source * 0x9E3779B1 + turn * 0x85EBCA6B + 1) & 0x7FFFFFFFFFFF


def source_slots(sizes: list[int], targets: list[float], block: int, seed: int) -> pd.DataFrame:
    """Per source: its blocks, its slots, and the words trimmed of its last slot.

    A source gives floor(target / size) whole turns of its blocks and a last turn up to its target, whose last slot is
    trimmed to the word.
    """
    rows = []
    for s, (size, target) in enumerate(zip(sizes, targets, strict=True)):
        want, nb = min(round(target), 2 * size), -(-size // block)
        if not want:
            rows.append((s, nb, 0, 0))
            continue
        turns, rest = divmod(want, size)
        short = size - (nb - 1) * block
        at = int(permute([nb - 1], [nb], [_key(seed, s, turns)], back=True)[0])
        given = lambda m: m * block - (block - short) * (at < m)  # noqa: E731, B023
        m = -(-rest // block)
        m += given(m) < rest
        last = short if (at == m - 1 if m else permute([nb - 1], [nb], [_key(seed, s, turns - 1)])[0] == nb - 1) else block
        rows.append((s, nb, turns * nb + m, (last - (given(m) - rest)) if m else 0))
    return pd.DataFrame(rows, columns=["sid", "blocks", "slots", "trim"])


def shard_counts(slots: int, shards: int, seed: int, sid: int) -> np.ndarray:
    """How many of a source's slots each output shard gets: a multinomial draw, so counts vary while the total is exact."""
    return np.random.Generator(np.random.PCG64([seed, sid])).multinomial(slots, np.full(shards, 1 / shards))


def dealing_plan(per_source: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, sid, n, first) of ``per_source(sid, slots)``: the slots that a shard draws of a source and the first one's number.

    A task draws for one source at a time; the draws never reach the driver.
    """

    def work(batches):
        for batch in batches:
            for sid, slots in zip(batch.column("sid").to_pylist(), batch.column("slots").to_pylist(), strict=True):
                n = shard_counts(slots, shards, seed, sid)
                got = np.flatnonzero(n)
                cols = [pa.array(got, pa.int32()), pa.array(np.full(len(got), sid), pa.int32()), pa.array(n[got], pa.int64()), pa.array((np.cumsum(n) - n)[got], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["shard", "sid", "n", "first"])

    return per_source.select("sid", "slots").mapInArrow(work, "shard int, sid int, n long, first long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = 1.5, ceiling: float = 2.0, block: int = BLOCK, seed: int = 7, keep: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, takes): the numbered documents with their source's size and target, and the word spans that the mix takes.

    rows(rid, id, source, size, source_size, target, *keep); takes(rid, shard, slot, turn, lo, hi): words lo..hi-1 of the
    document stand in that slot. A source's documents, in a hash order, form one stream cut into blocks; slots find
    their block through the source's permutation for that turn and join it by index, so a hot source spreads over all
    tasks. The running word positions come from two levels of sums: over about sqrt(documents) groups of a source, then
    inside each. No block is taken over ``ceil(ceiling)`` times. Null texts have size 0 and are never taken, a null
    source counts as one source, sorted last; repeated rows are documents of their own; an empty table gives empty ones.
    Only the list of sources (at most MAX_SOURCES, checked) reaches the driver; shards draw on the executors.
    """
    spark = docs.sparkSession
    order = F.xxhash64(F.col(id_col), F.col(text_col))
    cols = [F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), order.alias("h"), F.monotonically_increasing_id().alias("rid")]
    rows = materialise(docs.select(*cols, *[F.col(c).alias(f"keep_{c}") for c in keep]), "mix-rows")
    totals = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in totals]
    targets = source_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, ceiling)
    per_source = source_slots(sizes, targets, block, seed)
    total = int(per_source["slots"].sum())
    known = [(i, r["source"], r["size"], float(targets[i]), math.isqrt(r["n"]) + 1) for i, r in enumerate(totals)]
    sources = F.broadcast(spark.createDataFrame(known, "sid int, source_ string, source_size long, target double, groups int"))
    rows = rows.join(sources, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    slim = rows.filter("size > 0").select("rid", "sid", "size", "h", F.pmod(F.col("h"), F.col("groups")).alias("grp"))
    inside = Window.partitionBy("sid", "grp").orderBy("h", "rid").rowsBetween(Window.unboundedPreceding, 0)
    ends = slim.withColumn("upto", F.sum("size").over(inside))
    sums = slim.groupBy("sid", "grp").agg(F.sum("size").alias("grp_size"))
    before = Window.partitionBy("sid").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "grp", F.coalesce(F.sum("grp_size").over(before), F.lit(0)).alias("base"))
    spans = ends.join(sums, ["sid", "grp"]).select("rid", "sid", (F.col("base") + F.col("upto") - F.col("size")).alias("start"), (F.col("base") + F.col("upto")).alias("stop"))
    pieces = spans.select("*", F.explode(F.expr(f"sequence(start div {block}, (stop - 1) div {block})")).alias("block"))
    pieces = pieces.select("sid", "block", "rid", "start", F.greatest("start", F.col("block") * block).alias("lo"), F.least("stop", (F.col("block") + 1) * block).alias("hi"))

    facts = spark.createDataFrame(per_source if len(per_source) else pd.DataFrame(columns=per_source.columns), "sid int, blocks long, slots long, trim long")
    dealt = dealing_plan(facts, max(1, math.ceil(total**0.4)), seed)
    facts = F.broadcast(facts)
    # an explicit number of partitions, which adaptive execution leaves alone: the plan is tiny, what it expands to is not
    tasks = max(spark.sparkContext.defaultParallelism, total // TASK_SLOTS + 1)
    dealt = dealt.select("*", F.explode(F.expr(f"sequence(0L, (n - 1) div {SPREAD})")).alias("part")).repartition(tasks, "shard", "sid", "part")
    dealt = dealt.select("shard", "sid", F.explode(F.expr(f"sequence(first + part * {SPREAD}, first + least(n, (part + 1) * {SPREAD}) - 1)")).alias("i"))
    dealt = dealt.join(facts, "sid").withColumn("turn", F.expr("i div blocks"))

    def place(batches):
        for batch in batches:
            i, blocks = batch.column("slot").to_numpy(), batch.column("blocks").to_numpy()
            keys = [_key(seed, s, t) for s, t in zip(batch.column("sid").to_pylist(), batch.column("turn").to_pylist(), strict=True)]
            at = permute(i % np.maximum(blocks, 1), blocks, np.array(keys, np.uint64))
            cols = [batch.column("shard"), batch.column("slot"), batch.column("sid"), batch.column("turn"), pa.array(at), batch.column("take")]
            yield pa.RecordBatch.from_arrays(cols, ["shard", "slot", "sid", "turn", "block", "take"])

    take = F.when((F.col("i") == F.col("slots") - 1) & (F.col("trim") > 0), F.col("trim")).otherwise(F.lit(block)).cast("long")
    # a map and not a function: a filter on the function's result would run it once more, in a second worker of the task
    slots = dealt.select("shard", F.col("i").alias("slot"), "sid", F.col("turn").cast("long").alias("turn"), "blocks", take.alias("take"))
    slots = slots.mapInArrow(place, "shard int, slot long, sid int, turn long, block long, take long")
    upto = F.least("hi", F.col("block") * block + F.col("take"))
    takes = pieces.join(slots, ["sid", "block"]).filter(upto > F.col("lo"))
    takes = takes.select("rid", "shard", "slot", "turn", (F.col("lo") - F.col("start")).alias("lo"), (upto - F.col("start")).alias("hi"))
    return rows.select("rid", "id", "source", "size", "source_size", "target", *[f"keep_{c}" for c in keep]), takes


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """(id, size, source_size, target, taken) of every row: how many of its words the mix takes, repeats counted."""
    rows, takes = mix(docs, **options)
    taken = takes.groupBy("rid").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    return rows.join(taken, "rid", "left").select("id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as documents with the columns of ``docs``: a row per document and turn, its text the words taken in that turn.

    A text taken whole stays as it is; otherwise the spans' words are joined by spaces. n_chars, if present, follows.
    Null and wordless texts are never taken, a null source is one source; repeated rows are documents of their own; an
    empty table gives an empty one.
    """
    rows, takes = mix(docs, id_col, text_col, source_col, keep=tuple(docs.columns))
    parts = takes.groupBy(F.col("rid").alias("rid_"), "turn").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("parts"), F.sum(F.col("hi") - F.col("lo")).alias("got"))
    found = rows.join(parts, F.col("rid") == F.col("rid_"))
    cut = let(words(F.col(f"keep_{text_col}")), lambda w: F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(w, (p["lo"] + 1).cast("int"), (p["hi"] - p["lo"]).cast("int")))), " "))
    found = found.withColumn("keep_" + text_col, F.when(F.col("got") == F.col("size"), F.col(f"keep_{text_col}")).otherwise(cut))
    if "n_chars" in docs.columns:
        found = found.withColumn("keep_n_chars", F.length(f"keep_{text_col}").cast(dict(docs.dtypes)["n_chars"]))
    return found.select(*[F.col(f"keep_{c}").alias(c) for c in docs.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target, and the words that the mix takes of it."""
    return mix_counts(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
