"""Files: photographs of a folder, sheets of reference measurements."""

from pyspark.sql import DataFrame, SparkSession

#: Endings of photographs, in any case.
ENDINGS = ("jpg", "jpeg", "png", "tif", "tiff", "bmp")


def photographs(spark: SparkSession, path: str) -> DataFrame:
    """path, name, image of every photograph below ``path`` (or the one file); what can't be decoded is left out.

    The key is the whole path, as names may repeat between folders.
    """
    glob = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in ENDINGS) + "}"
    read = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return read.load(path).selectExpr("image.origin as path", "element_at(split(image.origin, '/'), -1) as name", "image")


def listed(photographs_: DataFrame) -> DataFrame:
    """path, name and place of every photograph, numbered from 1 in the order of their names, then paths, over ranges."""
    from pyspark.sql import functions as F

    from granary.functions.storage import saved

    spark = photographs_.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(photographs_.select("path", "name").repartitionByRange(n, "name", "path").sortWithinPartitions("name", "path").withColumn("_at", F.monotonically_increasing_id()), "listed")
    part = F.shiftright("_at", 33)
    counts = dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # a row a partition
    before, starts = 0, {}
    for r in counts:
        starts[r["p"]], before = before, before + r["n"]
    start = F.create_map(*[F.lit(x).cast("long") for pair in starts.items() for x in pair])[part] if starts else F.lit(0)
    return dealt.select("path", "name", (start + F.col("_at") % (1 << 33) + 1).alias("place"))


def reference_template(spark: SparkSession, objects: DataFrame, folder: str, traits: tuple[str, ...] = ("length_mm", "width_mm"), n: int = 20) -> DataFrame:
    """A blank sheet for ``n`` objects written as one CSV file below ``folder``, which :func:`reference_sheet` reads once filled."""
    from granary.operators import stats

    stats.template(objects, traits, n).coalesce(1).write.mode("overwrite").option("header", True).csv(folder)
    return reference_sheet(spark, folder, traits)


def reference_sheet(spark: SparkSession, path: str, traits: tuple[str, ...] = ("length_mm", "width_mm")) -> DataFrame:
    """image, seed_id (if given) and those of the traits that a CSV sheet holds; no trait at all raises.

    A cell that isn't a number is null. Only the header is read to plan.
    """
    found = spark.read.csv(path, header=True)
    have = [t for t in traits if t in found.columns]
    if not have or "image" not in found.columns:
        raise ValueError(f"a sheet needs the column image and one of {', '.join(traits)}")
    ids = ["try_cast(seed_id as bigint) as seed_id"] if "seed_id" in found.columns else []
    return found.selectExpr("image", *ids, *[f"try_cast({t} as double) as {t}" for t in have])
