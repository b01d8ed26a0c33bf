"""SpotSigs document fingerprints in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import graph
from .common import let, materialise, read

#: Common words of English, German, French and Spanish, which anchor the chains.
ANCHORS = (
    "the of and to a in is that for it with as was on are be by this from or an at not which have has he she they we you but his her their its "
    "der die das und ist von mit den dem ein eine des im zu nicht sich auf für als auch es er sie wir ich oder bei nach um am "
    "le la les de du des et un une que qui est dans pour par sur au aux avec ne pas ce il elle nous vous ou se "
    "el los las y en del que es por con una su al lo como más pero sus"
).split()
#: Content words in a chain, and the spots below which a text's plain word chains are added.
CHAIN, FEW = 2, 4
#: A document's edited text and the next document are found through at most this many id ranges.
RANGES = 1000
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def spots(text: Column) -> Column:
    """Sorted distinct 32-bit hashes of a text's spots: each anchor with the CHAIN content words that follow it.

    An anchor's chain starts at the content word whose rank is the anchor's place less the anchors before it. With fewer
    than FEW spots the chains after every word are added; a text without those is the hash of its words, or of itself.
    """

    def from_words(w: Column) -> Column:
        marked = F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        pair = F.struct(F.filter(marked, lambda m: m["x"].isin(ANCHORS)).alias("a"), F.filter(w, lambda x: ~x.isin(ANCHORS)).alias("c"))

        def chains(p: Column) -> Column:
            found = F.transform(p["a"], lambda m, j: F.when(m["i"] - j + (CHAIN - 1) < F.size(p["c"]), F.hash(m["x"], *[F.get(p["c"], m["i"] - j + k) for k in range(CHAIN)])))
            return F.filter(found, lambda h: h.isNotNull())

        plain = F.transform(w, lambda x, i: F.when(i + CHAIN < F.size(w), F.hash(x, *[F.get(w, i + k) for k in range(1, CHAIN + 1)])))
        whole = F.array(F.hash(F.when(F.size(w) > 0, F.array_join(w, " ")).otherwise(text)))
        plain = let(F.filter(plain, lambda h: h.isNotNull()), lambda c: F.when(F.size(c) > 0, c).otherwise(whole))
        return let(let(pair, chains), lambda s: F.when(F.size(s) >= FEW, s).otherwise(F.concat(s, plain)))

    return F.sort_array(F.array_distinct(let(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)), from_words)))


def fingerprint(spot_set: Column) -> Column:
    """A spot set as text: the hexadecimal hashes in their order."""
    return F.array_join(F.transform(spot_set, lambda h: F.lpad(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members among all, 0 to 1; sets are never empty."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def pruned_jaccard(a: Column, b: Column, least: float) -> Column:
    """Whether two sets' Jaccard likeness reaches ``least``; pairs whose sizes rule it out are not intersected."""
    possible = F.least(F.size(a), F.size(b)) >= least * F.greatest(F.size(a), F.size(b))
    return F.when(possible, jaccard(a, b) >= least).otherwise(F.lit(False))


def _length_range(size: Column, least: float) -> Column:
    """Ranges of set lengths in which the longest is 1 / ``least`` times the shortest: likely partners are in neighbouring ones."""
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(1 / least)))


def _inverted(sets: DataFrame, frequency: DataFrame, least: float) -> DataFrame:
    """``sets(node, s, ...)`` under (range, spot): the set's own length range and the next, and the spots of its prefix.

    Rarest spots come first; two sets that reach ``least`` share a spot among the first n - ceil(least * n) + 1 of each.
    """
    spread = sets.select("node", F.explode("s").alias("spot")).join(frequency, "spot")
    ordered = spread.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "spot"))).alias("order"))
    n = F.size("order")
    prefix = F.slice("order", F.lit(1), (n - F.ceil(least * n) + 1).cast("int"))
    keyed = sets.join(ordered.select("node", F.filter(prefix, lambda x: x["df"] > 1).alias("prefix")), "node")
    own = _length_range(F.size("s"), least)
    return keyed.withColumn("range", F.explode(F.array(own, own + 1))).withColumn("x", F.explode("prefix")).withColumn("spot", F.col("x.spot")).drop("x", "prefix")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """(id, fingerprint, class_id): a row per input row; class_id is the smallest id reachable over spot sets of Jaccard ``least`` or more.

    Equal sets are one node. Sets are partitioned by length and meet under a rare spot of theirs; rows with a null id
    take part and are named by the other ids of their class, if any.
    """
    rows = materialise(docs.select(F.col(id_col).alias("id"), spots(F.coalesce(F.col(text_col), F.lit(""))).alias("s")).withColumn("f", fingerprint(F.col("s"))), "spots")
    spare = F.lit(1 << 62) + F.pmod(F.xxhash64("f"), F.lit(1 << 61))
    nodes = rows.groupBy("f").agg(F.min("id").cast("long").alias("id"), F.first("s").alias("s"))
    nodes = materialise(nodes.select("f", "s", F.coalesce("id", spare).alias("node")), "spot-sets")
    frequency = materialise(nodes.select(F.explode("s").alias("spot")).groupBy("spot").agg(F.count("*").alias("df")), "spot-frequency")
    linked = graph.near_components(nodes.select("node", "s"), "s", lambda df: _inverted(df, frequency, least), ["range", "spot"], lambda a, b: pruned_jaccard(a, b, least))
    labels = nodes.join(linked, "node", "left").select(F.col("f").alias("f_"), F.coalesce("component", "node").alias("label"))
    out = rows.join(labels, F.col("f") == F.col("f_"), "left")
    return out.select("id", F.col("f").alias("fingerprint"), F.when(F.col("label") < (1 << 62), F.col("label")).alias("class_id"))


def next_keys(keys: DataFrame, ranges: int = RANGES) -> DataFrame:
    """(key, prev): for each of ``keys(key)``, distinct longs, the next larger one, or for the largest the smallest.

    That is the document before it in descending order. Keys fall into ranges at approximate quantiles; each range is
    ordered by itself, and only the least key of each range (at most ``ranges``) meets in one task.
    """
    cuts = keys.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    ranged = keys.withColumn("range", F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c < F.col("key"))) if cuts else F.lit(0))
    inside = ranged.withColumn("prev", F.lead("key").over(Window.partitionBy("range").orderBy("key")))
    least = ranged.groupBy("range").agg(F.min("key").alias("least"))
    order = Window.partitionBy(F.lit(1)).orderBy("range")
    after = least.select(F.col("range").alias("range_"), F.coalesce(F.lead("least").over(order), F.first("least").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    return inside.join(F.broadcast(after), F.col("range") == F.col("range_")).select("key", F.coalesce("prev", "after").alias("prev"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint, its edited text's, and the likeness of its own to the edited one and to the next document's.

    The next document is the one of the next smaller id (after the smallest: the largest). The edited text keeps all but
    the last half of the characters, then the first as many of the next document. Null texts are empty; rows without an
    id stand after the smallest id; rows that share an id share their next document, and as a next document the least
    of their texts counts; an empty table gives an empty one. Texts are shuffled twice: by their key, which both sides of the join
    read, and by the key before theirs.
    """
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    links = next_keys(docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key")).distinct())
    # a lag, since the limit that Spark puts below the shuffle for a row number would keep the shuffle from being shared
    one = keyed.withColumn("before_", F.lag("key").over(Window.partitionBy("key").orderBy("t"))).filter("before_ is null")
    follow = one.join(links.withColumnRenamed("key", "key_"), F.col("key") == F.col("key_")).select(F.col("prev").alias("to_"), F.col("id").alias("next_id"), F.col("t").alias("next_t"))
    both = keyed.join(follow, F.col("key") == F.col("to_"))
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    both = both.withColumn("edited", F.concat(F.left("t", n - half), F.left("next_t", half)))
    both = both.select("id", "next_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), spots(F.col("t")).alias("s"), spots(F.col("edited")).alias("e"), spots(F.col("next_t")).alias("x"))
    return both.select("id", "n_chars", "edited_sha256", fingerprint(F.col("s")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"), jaccard(F.col("s"), F.col("e")).alias("near_edited"), jaccard(F.col("s"), F.col("x")).alias("near_next"), "next_id")


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint against its edited text's and the next document's."""
    return edited_fingerprints(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
