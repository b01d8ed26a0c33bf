"""Quality rules in DataFrame functions: repetition within a document, frequent lines across a host's documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, let, materialise, read, words

#: A line is frequent in a host from this many distinct documents, and over the lesser of this share of them and this count.
MIN_DOCS, MAX_SHARE, MOST_DOCS = 20, 0.05, 1000
#: Least hashes of 3-word windows that must all agree in one of four bands for documents to be near copies.
BAND = 16
#: A document that loses over this share of its line characters is depleted.
MAX_LOST = 0.5


def _windows(w: Column) -> Column:
    """Hashes of the 3-word windows with their places."""
    last = F.size(w) - 3
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))


def _repeated_words(windows: Column) -> Column:
    """Words inside windows, sorted by hash, whose hash comes twice or more: equal hashes are neighbours; overlaps count once."""

    def places(s: Column) -> Column:
        twin = F.filter(s, lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"]))
        return F.sort_array(F.transform(twin, lambda x: x["p"]))

    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
    return F.aggregate(places(windows), start, step, lambda acc: acc["n"])


def _bands(windows: Column) -> Column:
    """Hashes of the BAND least and greatest of the negative and of the other window hashes, as far as there are so many.

    Near copies, with a few words in a hundred changed, mostly agree in one; documents that share a tenth less in none.
    """

    def cut(h: Column) -> Column:
        size, below = F.size(h), F.size(F.filter(h, lambda x: x < 0))
        starts = [(F.lit(1), below), (below - BAND + 1, below), (below + 1, size - below), (size - BAND + 1, size - below)]
        return F.array_compact(F.array(*[F.when(n >= BAND, F.xxhash64(F.lit(j), F.slice(h, F.greatest(at, F.lit(1)), F.lit(BAND)))) for j, (at, n) in enumerate(starts)]))

    return let(F.transform(windows, lambda x: x["h"]), cut)


def _normal(line: Column) -> Column:
    """Lower case, digits as 0, other characters than letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\p{N}", "0"), r"[^\p{L}0]+", " "))


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One pass over the texts, materialised: counts, hashes of the document and its lines, in a row per input row.

    ``content`` is the hash of all its words, equal for copies alone; of ``bands`` near copies mostly share one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), text.alias("body"))

    def counts(w: Column) -> Column:
        content = F.xxhash64(F.lower(F.array_join(w, " ")))
        return let(F.sort_array(_windows(w)), lambda x: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(x).alias("n_repeat_words"), content.alias("content"), _bands(x).alias("bands")))

    worded = F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lines = let(worded, lambda ls: F.struct((F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"), F.transform(ls, lambda x: F.struct(F.xxhash64(_normal(x)).alias("h"), F.length(x).alias("n"))).alias("lines")))
    squeezed = F.regexp_replace("body", SPACES, "")
    return materialise(
        base.select(
            F.monotonically_increasing_id().alias("rid"),
            "id",
            "host",
            F.length(squeezed).cast("long").alias("word_chars"),
            (F.length("body") - F.length(F.regexp_replace("body", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            let(words(F.col("body")), counts).alias("c"),
            lines.alias("l"),
        ).select("rid", "id", "host", "word_chars", "n_symbols", "c.*", "l.*"),
        "lines",
    )


def _distinct_documents(table: DataFrame, min_docs: int) -> DataFrame:
    """(host, doc, lines) of every row: ``doc`` is equal for copies, and for near copies where a host holds ``min_docs`` or more.

    Each document of a large group of near copies takes the most common band that it has, so that the group counts as a
    few documents; documents that only share lines have few whole bands in common, and count as many.
    """
    bands = table.groupBy("host", "content").agg(F.first("bands").alias("bands")).select("host", "content", F.explode("bands").alias("band"))
    common = bands.groupBy("host", "band").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select(F.col("host").alias("host_"), F.col("band").alias("band_"), "n")
    near = bands.join(common, F.col("host").eqNullSafe(F.col("host_")) & (F.col("band") == F.col("band_")))
    near = near.groupBy("host", "content").agg(F.max(F.struct("n", "band"))["band"].alias("near"))
    near = materialise(near, "near-copies").select(F.col("host").alias("host_"), F.col("content").alias("content_"), "near")
    found = table.join(near, F.col("host").eqNullSafe(F.col("host_")) & (F.col("content") == F.col("content_")), "left")
    return found.select("host", F.coalesce("near", "content").alias("doc"), "lines")


def frequent_lines(table: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, most_docs: int = MOST_DOCS) -> DataFrame:
    """(host, h, docs): lines in ``min_docs`` or more of a host's distinct documents, and in over the lesser of
    ``max_share`` of them and ``most_docs``.

    Copies and large groups of near copies count once or a few times, so that no group, however large, makes its own
    lines frequent. Counted in two combined steps, (host, line, document) then (host, line).
    """
    docs = _distinct_documents(table, min_docs)
    hosts = docs.select("host", "doc").distinct().groupBy("host").agg(F.count("*").alias("total"))
    seen = docs.select("host", "doc", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counts = seen.distinct().groupBy("host", "h").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
    counts = counts.join(hosts.withColumnRenamed("host", "host_"), F.col("host").eqNullSafe(F.col("host_")))
    return counts.filter(F.col("docs") > F.least(max_share * F.col("total"), F.lit(most_docs))).select("host", "h", "docs")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_lost: float = MAX_LOST) -> DataFrame:
    """A row per input row: its counts, the characters that frequent lines hold, base_failed and kept.

    base_failed: under 50 words, or repeated words over half of the words. kept: not base_failed and at most ``max_lost``
    of the line characters lie in frequent lines. Null and empty texts have no words and are not kept; a null host is a
    host of its own; repeated rows are judged alike; an empty table gives an empty one; other columns are not read.
    """
    table = line_table(docs, id_col, text_col, host_col)
    return _verdicts(table, frequent_lines(table), max_lost)


def _verdicts(table: DataFrame, frequent: DataFrame, max_lost: float) -> DataFrame:
    often = frequent.select(F.col("host").alias("host_"), F.col("h").alias("h_"))
    each = table.select("rid", "host", F.explode("lines").alias("x")).select("rid", "host", "x.h", "x.n")
    lost = each.join(often, F.col("host").eqNullSafe(F.col("host_")) & (F.col("h") == F.col("h_")))
    lost = lost.groupBy("rid").agg(F.sum("n").alias("lost_chars"), F.collect_set("h").alias("lost_lines"))
    out = table.join(lost, "rid", "left").withColumn("lost_chars", F.coalesce("lost_chars", F.lit(0)).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    chars = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= max_lost * chars))


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The kept documents, without their frequent lines, with the columns of ``docs``; n_chars, if present, follows the text.

    Verdicts come back to the texts by id, host and text hash; rows that agree in these agree in their verdict. Null and
    empty texts go, a null host is a host of its own, repeated rows stay or go alike; an empty table gives an empty one.
    """
    key = docs.select(F.struct(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).alias("key"), F.col(host_col).alias("h0"), F.col(text_col).alias("t0"))
    table = line_table(key, "key", "t0", "h0")
    verdict = _verdicts(table, frequent_lines(table), MAX_LOST).filter("kept")
    verdict = verdict.groupBy(F.col("id").alias("key_"), F.col("host").alias("host_")).agg(F.first("lost_lines").alias("gone_"))
    row, text = lambda c: F.col(f"row.{c}"), F.col("row").getField(text_col)
    keyed = docs.select(F.struct("*").alias("row")).withColumn("hash_", F.xxhash64(F.coalesce(text, F.lit(""))))
    same = row(id_col).eqNullSafe(F.col(f"key_.{id_col}")) & (F.col("hash_") == F.col("key_.col2")) & row(host_col).eqNullSafe(F.col("host_"))
    found = keyed.join(verdict, same)
    cut = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("gone_", F.xxhash64(_normal(x)))), "\n")
    found = found.withColumn("text_", F.when(F.col("gone_").isNull() | (F.size("gone_") == 0), text).otherwise(cut))
    out = {c: row(c) for c in docs.columns} | {text_col: F.col("text_")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length("text_").cast(dict(docs.dtypes)["n_chars"])
    return found.select(*[v.alias(c) for c, v in out.items()])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's word, symbol and repetition counts and the verdict of the rules."""
    found = quality_rules(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")
