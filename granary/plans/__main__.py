"""spark-submit entry: object and photograph tables in, a folder of results out."""

import argparse
import sys

from pyspark.sql import SparkSession

from granary.config import Physical
from granary.functions.storage import exists
from granary.plans.run import Settings
from granary.sources import export


def main(arguments: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="granary.plans")
    p.add_argument("seeds", help="Parquet table of measured objects")
    p.add_argument("photographs", help="Parquet table of photographs and their measures")
    p.add_argument("out", help="folder for the results")
    p.add_argument("--lot", default="lot")
    p.add_argument("--px-per-mm", type=float)
    p.add_argument("--density", type=float)
    p.add_argument("--format", choices=("parquet", "csv", "json"), default="parquet")
    a = p.parse_args(arguments)
    spark = SparkSession.builder.appName("granary").getOrCreate()
    missing = [path for path in (a.seeds, a.photographs) if not exists(spark, path)]
    if missing:
        print(f"not found: {', '.join(missing)}", file=sys.stderr)
        return 2
    seeds = spark.read.parquet(a.seeds)
    if seeds.isEmpty():
        print("no objects were measured", file=sys.stderr)
        return 1
    weighed = Physical(density_g_cm3=a.density, density_source="weighed") if a.density else Physical()
    settings = Settings(a.lot, a.px_per_mm, "manual" if a.px_per_mm else "unset", physical=weighed)
    export.written(seeds, spark.read.parquet(a.photographs), settings, a.out, a.format)
    return 0


if __name__ == "__main__":
    sys.exit(main())
