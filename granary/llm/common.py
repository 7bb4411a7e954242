"""Helpers that several operators share: saved tables, global ranks and sums, names, word splitting."""

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions.storage import dropped, exists, new_folder, saved

__all__ = ["WORD", "dropped", "exists", "met", "n_words", "new_folder", "partitions", "process_cache", "ranked", "running_sums", "saved", "sifted", "unused", "words"]

#: A word is a run of anything but the six ASCII white-space characters; ``bytes.split()`` splits alike.
WORD = r"[^\x20\x09-\x0D]+"
_MONO_BITS = 33
#: Keys that :func:`met` sends to all tasks at most, and rows that a key must exceed for it.
HOT_KEYS, HOT_ROWS = 50_000, 1_000
#: Bits that :func:`sifted` has for a key, most bits of all (16 MB, sent to all tasks), and bits in one row of them.
KEY_BITS, MOST_BITS, ROW_BITS = 64, 2**27, 2**12


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, or one made from it, that no column of the frames has, in any case of letters."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def met(rows: DataFrame, facts: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts`` by ``key``; no task gathers the rows of a hot key.

    facts: one row a key, with ``n``, at least the number of its rows, over all keys ``total`` together at most. A key of
    more than HOT_ROWS and total / HOT_KEYS rows is hot; there are under HOT_KEYS such keys, so that their facts are sent to
    all tasks. The other keys meet by a shuffle. With ``how`` "left", rows without facts, also those of a null key, stay.
    Both tables are read twice.
    """
    least = F.lit(max(total // HOT_KEYS, HOT_ROWS))
    hot = facts.where(F.col("n") > least)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.where(F.col("n") <= least), key, how)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def sifted(rows: DataFrame, key: list[Column], keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows whose key may be among ``keys``, rows whose key is not, and the saved bits that tell; no row is shuffled.

    key: columns of ``rows``, of the types of the columns of ``keys`` in turn. Each key sets one bit by its hash. A row of
    another key passes for one of them about once in KEY_BITS times, more often beyond MOST_BITS / KEY_BITS keys: an exact
    join has to follow. ``rows`` is read for either part; the bits can be dropped when both have been.
    """
    n = min(MOST_BITS, max(ROW_BITS, keys.count() * KEY_BITS))

    def place(*cols: Column) -> Column:
        return F.pmod(F.xxhash64(*cols), F.lit(n))

    at = keys.select(place(*(F.col(c) for c in keys.columns)).alias("at"))
    at = at.select(F.floor(F.col("at") / ROW_BITS).alias("row"), (F.col("at") % ROW_BITS).alias("bit"))
    bits = saved(at.repartition("row").groupBy("row").agg(F.substring(F.bitmap_construct_agg("bit"), 1, -(-ROW_BITS // 8)).alias("bits")), "bits")
    bit = place(*key) % ROW_BITS
    byte = F.conv(F.hex(F.substring(bits["bits"], (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    told = (F.floor(place(*key) / ROW_BITS) == bits["row"]) & (F.getbit(byte, (bit % 8).cast("int")) == 1)
    return rows.join(F.broadcast(bits), told, "left_semi"), rows.join(F.broadcast(bits), told, "left_anti"), bits


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """``df`` with ``name``, each row's place from 0 in the global order, nulls last.

    Range partitioning, a sort in each partition, then each partition's offset: only one count for each
    partition reaches the driver.
    """
    spark = df.sparkSession
    cols = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
    at = saved(
        df.repartitionByRange(partitions(spark), *cols).sortWithinPartitions(*cols).withColumn("_mono", F.monotonically_increasing_id()), name
    )
    part = F.shiftright("_mono", _MONO_BITS)
    counts = sorted((r["p"], r["n"]) for r in at.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    base, total = [], 0
    for p, n in counts:
        base.append((p, total))
        total += n
    starts = F.create_map(*[F.lit(int(x)).cast("long") for pair in base for x in pair]) if base else F.create_map().cast("map<bigint,bigint>")
    return at.withColumn(name, F.element_at(starts, part) + F.col("_mono").bitwiseAND(F.lit((1 << _MONO_BITS) - 1))).drop("_mono")


def running_sums(df: DataFrame, by: str, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the same ``by`` up to and with each row, in ``order``.

    A distributed prefix sum: rows are dealt by ranges of by and order, summed in each range, and the ranges' sums
    added up. Rows alike in all of ``order`` stand in any order, so a key however common spreads over ranges. ``df``
    must have no column _at, _range, _mono, _own, _before, _sum or _key.
    """
    spark = df.sparkSession
    # the row's number parts rows that are otherwise alike; it is written down, or the ranges could change
    numbered = saved(df.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    ranges = saved(numbered.repartitionByRange(partitions(spark), by, *order, "_at").withColumn("_range", F.spark_partition_id()), "ranges")
    dropped(numbered)
    inside = Window.partitionBy(by, "_range").orderBy(*order, "_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ranges.groupBy(F.col(by).alias("_key"), F.col("_range").alias("_own")).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy("_key").orderBy("_own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("_before", F.sum("_sum").over(before) - F.col("_sum"))
    out = ranges.withColumn(name, F.sum(value).over(inside))
    out = out.join(sums, out[by].eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_own")))
    return out.withColumn(name, F.col(name) + F.col("_before")).select(*df.columns, name)


def words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def process_cache() -> dict:
    """Lives as long as the Python worker, which serves many tasks in turn."""
    return sys.modules.setdefault("granary_process_cache", types.ModuleType("granary_process_cache")).__dict__
