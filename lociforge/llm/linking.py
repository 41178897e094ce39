"""Exact links and groups from candidate buckets, without emitting all pairs of a bucket.

1. Each record is compared with one leader: the smallest member of most of its buckets. The links found make components.
2. Two records of one bucket still need a comparison only if they lie in different components; a bucket inside one
   component needs none. These cross pairs are joined by (bucket, component), so that a bucket with one large component
   and a few others costs their product, not the square.

For groups this loses nothing: a pair that is skipped is already connected. Every join runs in parts of about ``PART``
records of a key, so that no hot bucket or component is one task's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociforge.operators.components import connected_components
from lociforge.session import Cut

PART = 512


def parts_of(n: str | Column, part: int = PART) -> Column:
    return F.ceil((F.col(n) if isinstance(n, str) else n) / part).cast("int")


def spread(df: DataFrame, *key: str) -> DataFrame:
    """The rows by key in as many tasks as a shuffle has: for work that is heavier than its input is large."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def pairs_within(own: DataFrame, key: list[str], node: str = "node", payload: str | None = None) -> DataFrame:
    """``(key, a, b)``, a before b, of all pairs of a key; with ``payload`` also that of either as ``_ta`` and ``_tb``.

    ``own``: ``(key, node, _p)``, ``_p`` being in how many parts the key's left side goes.
    """
    extra = lambda to: [F.col(payload).alias(to)] if payload else []
    left = own.select(*key, F.col(node).alias("a"), F.pmod(F.xxhash64(node), "_p").alias("_s"), *extra("_ta"))
    right = own.select(*key, F.col(node).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_p").cast("long") - 1)).alias("_s"), *extra("_tb"))
    if payload:
        left, right = spread(left, *key, "_s"), spread(right, *key, "_s")
    return left.join(right, [*key, "_s"]).filter("a < b").drop("_s")


def cross_pairs(placed: DataFrame, cut: Cut) -> DataFrame:
    """``(a, b, n_keys)`` of the records of different components that share a key, with the number of keys they share.

    ``placed``: ``(key, node, comp)``; a table that a cut holds is dropped. Each step is written, so that the shuffles of
    one are gone before the next begins.
    """
    sides = cut.write(placed.groupBy("key", "comp").agg(parts_of(F.count("*")).alias("parts")))
    own = cut.write(placed.join(sides, ["key", "comp"]).select("key", "comp", "node", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("_s")))
    cut.drop(placed)
    per_key = sides.groupBy("key").agg(F.count("*").alias("_c")).select("key", parts_of("_c").alias("_p"))
    meet = pairs_within(sides.join(per_key, "key"), ["key"], "comp", "parts")
    meet = cut.write(meet.select("key", F.col("a").alias("ca"), F.col("_ta").alias("pa"), F.col("b").alias("cb"), F.col("_tb").alias("pb")))
    cut.drop(sides)
    for c, p, n, kept in (("ca", "pa", "na", ["key", "cb", "pb", "na"]), ("cb", "pb", "nb", ["na", "nb"])):
        before, side = meet, own.withColumnRenamed("comp", c).withColumnRenamed("node", n)
        meet = cut.write(meet.withColumn("_s", F.explode(F.sequence(F.lit(0), F.col(p) - 1))).join(side, ["key", c, "_s"]).select(*kept))
        cut.drop(before)
    cut.drop(own)
    pairs = cut.write(meet.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n_keys")))
    cut.drop(meet)
    return pairs


def linked_components(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], cut: Cut, screen: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(node, comp)`` of all records with a link, and the links ``(a, b, sim)`` that were found.

    ``buckets``: ``(key, node)``. ``verify`` gets distinct pairs ``(a, b)``, ``a < b``, and returns those that are
    linked as ``(a, b, sim)``. ``screen`` may leave out pairs ``(a, b, n_keys)`` that share too few keys to be linked; keys
    must not repeat for a node. The links connect every component but aren't all links inside it.
    """
    shared = buckets.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("_last")).filter("lead < _last").select("key", "lead")
    live = cut.write(buckets.join(shared, "key"))
    led = (
        live.filter("node <> lead").groupBy("node", "lead").agg(F.count("*").alias("n"))
        .groupBy("node").agg(F.max_by("lead", F.struct(F.col("n"), -F.col("lead"))).alias("lead"))
    )
    first = cut.write(verify(led.select(F.col("lead").alias("a"), F.col("node").alias("b"))))
    comps = connected_components(first, cut)
    placed = live.select("key", "node").join(comps.withColumnRenamed("comp", "_c"), "node", "left").select("key", "node", F.coalesce("_c", "node").alias("comp"))
    held = placed.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo < _hi").select("key")
    placed = cut.write(placed.join(held, "key", "left_semi"))
    cut.drop(live)
    pairs = cross_pairs(placed, cut)
    screened = cut.write((screen(pairs) if screen else pairs).select("a", "b"))
    cut.drop(pairs)
    second = cut.write(verify(screened))
    cut.drop(screened)
    links = first.unionByName(second)
    # components of components: the first ones are contracted, so only cross links and their stars go round
    stars = comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))
    final = connected_components(second.select("a", "b").unionByName(stars), cut)
    return cut.write(final), links
