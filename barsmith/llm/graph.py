"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none of its own."""
    if edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        return False
    own = edges.select(F.col("u").alias("w"))
    return not edges.join(own, F.col("v") == F.col("w"), "left_semi").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; component is the smallest node it can reach.

    Alternates the large-star and small-star steps until each component is a star around its smallest node. A step takes
    the minimum of each node's neighbours (combined before the shuffle) and joins it back, so no neighbourhood is gathered
    in one task; each round ends in the shared folder. Nodes with self edges only are their own component; an empty list
    gives an empty table.
    """
    given = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    cur = given.filter("u != v")
    ends = cur.select(F.col("u").alias("end")).unionByName(cur.select(F.col("v").alias("end")))
    alone = given.filter("u = v").join(ends, F.col("u") == F.col("end"), "left_anti").select(F.col("u").alias("node"), F.col("v").alias("component"))
    while not _settled(cur):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        cur = materialise(small.distinct(), "small-star")
    roots = cur.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).unionByName(alone)


def near_components(nodes: DataFrame, item: str, buckets: Callable[[DataFrame], DataFrame], bucket: list[str], near: Callable[[Column, Column], Column]) -> DataFrame:
    """(node, component) of the links among ``nodes(node, item)``, rows of distinct items, that ``near(item, item)`` accepts.

    ``buckets`` gives each row its buckets (columns ``bucket``); every linked pair must share one. First each bucket
    links its members to its smallest node, where near enough: a row per member, never pairs. Links inside a component
    found so change nothing, so only buckets that still hold several components are compared, and in them only members
    outside the bucket's largest component against members of other components. No link between components is lost,
    and a bucket of near copies costs rows in proportion to its size.
    """
    table = buckets(nodes)
    hubs = table.groupBy(*bucket).agg(F.min_by(F.struct("node", item), "node").alias("hub"), F.count("*").alias("n")).filter("n > 1").select(*bucket, "hub")
    star = table.join(hubs, bucket).filter((F.col("node") != F.col("hub.node")) & near(F.col(item), F.col(f"hub.{item}")))
    star = materialise(star.select(F.col("node").alias("u"), F.col("hub.node").alias("v")).distinct(), "star-links")
    first = components(star)
    placed = materialise(nodes.join(first, "node", "left").select("node", item, F.coalesce("component", "node").alias("comp")), "placed")
    table = buckets(placed)
    mixed = table.groupBy(*bucket).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select(*bucket)
    members = materialise(table.join(mixed, bucket), "mixed-buckets")
    sizes = members.groupBy(*bucket, "comp").agg(F.count("*").alias("n"))
    major = sizes.groupBy(*bucket).agg(F.max_by("comp", F.struct("n", "comp")).alias("major"))
    rest = members.join(major, bucket).filter("comp != major").select(*bucket, F.col(item).alias("item_u"), F.col("comp").alias("u"))
    cross = rest.join(members, bucket).filter((F.col("u") != F.col("comp")) & near(F.col("item_u"), F.col(item)))
    merged = components(cross.select("u", F.col("comp").alias("v"))).select(F.col("node").alias("comp"), "component")
    return placed.join(merged, "comp", "left").select("node", F.coalesce("component", "comp").alias("component"))
