"""Connected components of a table of links, and places along closed chains, in rounds of joins."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.storage import dropped, saved


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the least node that links lead to from each linked node, itself included.

    Stars in turns: every node's larger neighbours move to its least one, then its smaller ones do, until no link changes;
    what is left is a star around each root. Each turn is minima by node and joins; no component is gathered, and
    the number of turns grows with the logarithm of a component's size. Nodes may be of any type that has an order.
    """
    now = saved(links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    # what is left of the links shows in their number and the sum of their hashes
    print_ = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = print_(now)
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = saved(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = saved(smaller.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        dropped(now, larger)
        now, mark = after, print_(after)
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def ranked_rings(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, step, place: where each step of a closed chain stands, counted from the chain's least step.

    steps: keys, step, next; one ring for each value of keys. Pointer doubling: every step knows one further on and how far
    that is, and in each round asks it for its own; there are as many rounds as the greatest number of steps has bits.
    """
    first = steps.groupBy(*keys).agg(F.min("step").alias("_first"), F.count("*").alias("_n"))
    cut = steps.join(first, list(keys)).withColumn("next", F.when(F.col("next") != F.col("_first"), F.col("next")))
    now = saved(cut.select(*keys, "step", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("left"), "_n"), "ring")
    for _ in range(max((now.agg(F.max("_n")).first()[0] or 1) - 1, 0).bit_length()):
        ahead = now.select(*keys, F.col("step").alias("next"), F.col("next").alias("_further"), F.col("left").alias("_more"))
        joined = now.join(ahead, [*keys, "next"], "left")
        further = saved(joined.select(*keys, "step", F.col("_further").alias("next"), (F.col("left") + F.coalesce("_more", F.lit(0))).alias("left"), "_n"), "ring")
        dropped(now)
        now = further
    return now.select(*keys, "step", (F.col("_n") - 1 - F.col("left")).alias("place"))
