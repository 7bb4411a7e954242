"""Exact quantiles of groups of any size: no task gathers a group's values."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.storage import dropped, saved

#: Values of a group that one task may gather, and bins in which a larger one is counted.
GATHERED, BINS = 1_000_000, 4096


def summarised(df: DataFrame, by: Sequence[str], x: str, probs: Sequence[float], aggregates: Sequence[Column] = (), gathered: int = GATHERED) -> DataFrame:
    """by, the aggregates, and ``quantiles``: those of the non-null ``x`` of each group, linear between neighbours.

    Groups are counted first. Those of at most ``gathered`` values take one aggregation. For larger ones the ranks asked for are
    closed in by bins: a pass counts each group's values in BINS equal bins, the bin that holds a rank is taken for its
    range, and so on until it holds few values, or equal ones. Counts alone are shuffled; ranges are sent out, of which there
    are a few for every ``gathered`` rows of the table.
    """
    q = F.array(*[F.lit(float(p)) for p in probs])
    counted = (df.groupBy(*by) if by else df.groupBy()).agg(F.count(x).alias("n"))
    at_once = lambda rows: (rows.groupBy(*by) if by else rows.groupBy()).agg(*aggregates, F.percentile(x, q).alias("quantiles"))
    if (counted.agg(F.max("n")).first()[0] or 0) <= gathered:
        return at_once(df)
    if by:
        large = saved(counted.where(F.col("n") > gathered).select(F.struct(*by).alias("_large")), "large")
        own = F.struct(*by)
        of = lambda how: df.withColumn("_own", own).join(F.broadcast(large), F.col("_own").eqNullSafe(F.col("_large")), how).drop("_own")
        small = at_once(of("left_anti"))
        df = of("left_semi")
    values = df.where(F.col(x).isNotNull()).select(F.struct(*by, F.lit(0)).alias("_k"), F.col(x).cast("double").alias("v"))
    ends = values.groupBy("_k").agg(F.count("v").alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = ends.select("_k", F.posexplode(q).alias("i", "p"), "inside", "lo", "hi").withColumn("place", F.col("p") * (F.col("inside") - 1))
    rank = F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank")
    # a row for each group, quantile and neighbour; below: values under the range
    ranges = saved(at.select("_k", "i", (F.col("place") - F.floor("place")).alias("share"), rank, F.lit(0).cast("long").alias("below"), "inside", "lo", "hi"), "ranges")
    while not ranges.where((F.col("inside") > gathered) & (F.col("lo") < F.col("hi"))).isEmpty():
        asked = ranges.select("_k", "rank", "below", F.col("lo").alias("from"), F.col("hi").alias("to")).distinct()
        bin_ = F.when(F.col("from") < F.col("to"), F.least(F.floor((F.col("v") - F.col("from")) / (F.col("to") - F.col("from")) * BINS), F.lit(BINS - 1))).otherwise(0)
        inside = values.join(F.broadcast(asked), "_k").where(F.col("v").between(F.col("from"), F.col("to")))
        counts = inside.groupBy("_k", "rank", "below", bin_.alias("bin")).agg(F.count("*").alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        run = Window.partitionBy("_k", "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("upto", F.col("below") + F.sum("inside").over(run)).where((F.col("upto") - F.col("inside") <= F.col("rank")) & (F.col("rank") < F.col("upto")))
        narrowed = counts.select("_k", "rank", (F.col("upto") - F.col("inside")).alias("below"), "inside", "lo", "hi")
        closer = saved(ranges.select("_k", "i", "share", "rank").join(narrowed, ["_k", "rank"]), "ranges")
        dropped(ranges)
        ranges = closer
    few = ranges.select("_k", "rank", "below", "lo", "hi").distinct()
    held = values.join(F.broadcast(few), "_k").where(F.col("v").between(F.col("lo"), F.col("hi")) & (F.col("lo") < F.col("hi")))
    sorted_ = held.groupBy("_k", "rank", "below").agg(F.array_sort(F.collect_list("v")).alias("vs")).select("_k", "rank", F.col("vs")[(F.col("rank") - F.col("below")).cast("int")].alias("v"))
    found = ranges.join(sorted_, ["_k", "rank"], "left").withColumn("v", F.coalesce("v", "lo"))
    two = found.groupBy("_k", "i", "share").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    points = two.select("_k", F.struct("i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias("v")).alias("p"))
    made = points.groupBy("_k").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["v"]).alias("quantiles"))
    whole = (df.groupBy(*by) if by else df.groupBy()).agg(*aggregates, F.count(F.lit(1)).alias("_rows")).withColumn("_g", F.struct(*by, F.lit(0)))
    out = whole.join(made, whole["_g"].eqNullSafe(made["_k"]), "left").drop("_g", "_k", "_rows")
    return small.unionByName(out) if by else out
