"""Results to files: every table by Spark's writers, settings and a readable summary as small texts."""

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import stats
from granary.plans.run import Run, Settings, measured, results

#: Units by the end of a column's name, and of columns whose name tells none.
ENDS = {"_px": "px", "_px2": "px^2", "_mm": "mm", "_mm2": "mm^2", "_mm3": "mm^3", "_mg": "mg", "_angle": "degrees"}
UNITS = {"confidence": "0-1", "cx": "px", "cy": "px", "mean_L": "CIE-Lab", "lab_a": "CIE-Lab", "lab_b": "CIE-Lab", "spot_coverage": "0-1", "largest_spot": "0-1", "roundness": "0-1", "solidity": "0-1", "convexity": "0-1", "extent": "0-1", "eccentricity": "0-1", "sphericity": "0-1", "saturation": "0-255", "brightness": "0-255", "texture_std": "0-255"}
#: What the columns of the objects' table hold, by where they come from.
MEANINGS = {
    "detector": {"image": "the photograph", "seed_id": "number of the object in its photograph", "cls": "the class it was given", "confidence": "how sure the detector is of the class", "cx": "centre, from the left edge", "cy": "centre, from the top edge", "truncated": "the box touches the frame's edge"},
    "outline": {
        "length_px": "the least rectangle's long side", "width_px": "its short side", "area_px2": "area inside", "perimeter_px": "length of the line", "feret_max_px": "two of its points lie so far apart at most", "eq_diameter_px": "diameter of a circle of that area",
        "roundness": "area over that of a circle with the perimeter", "aspect_ratio": "long side over short side", "solidity": "area over the hull's: a dent makes it small", "convexity": "the hull's perimeter over the line's: a rough edge makes it small", "extent": "area over the rectangle's",
        "eccentricity": "of the ellipse, 0 for a circle", "area_ratio": "area over the ellipse's", "shape_pc1": "score on the first component of shape", "shape_pc2": "score on the second", "shape_pc3": "score on the third", "shape_pc4": "score on the fourth",
        "segment_method": "the threshold that found it", "outline_error": "area_ratio less one", "outline_flag": "that error is too large to trust the outline",
    },
    "coat": {
        "mean_L": "lightness", "lab_a": "from green to red", "lab_b": "from blue to yellow", "chroma": "strength of the colour", "hue_angle": "direction of the colour", "saturation": "strength of the colour in HSV", "brightness": "mean grey level", "texture_std": "spread of grey levels",
        "spot_count": "markings", "spot_coverage": "share under markings", "largest_spot": "share under the largest", "spot_contrast_dE": "colour distance of markings from the rest", "pattern_class": "class by the rules on lightness and markings",
    },
    "scale": {
        "length_mm": "length_px by the scale", "width_mm": "width_px by the scale", "thickness_mm": "a fixed part of the width, not measured", "area_mm2": "area_px2 by the scale", "perimeter_mm": "perimeter_px by the scale", "feret_max_mm": "feret_max_px by the scale", "eq_diameter_mm": "eq_diameter_px by the scale",
        "gmd_mm": "geometric mean of length, width and thickness", "amd_mm": "their arithmetic mean", "sphericity": "gmd_mm over length_mm", "surface_area_mm2": "of a sphere with gmd_mm across", "volume_mm3": "of the ellipsoid with the three as axes", "mass_mg": "volume times density", "units": "of the traits: mm or px",
    },
}


def unit(column: str) -> str:
    return UNITS.get(column) or next((u for end, u in sorted(ENDS.items(), key=lambda x: -len(x[0])) if column.endswith(end)), "")


def dictionary(spark: SparkSession, columns: list[str] | None = None) -> DataFrame:
    """column, units, source, meaning of the objects' columns that are known, or of those given."""
    rows = [(c, unit(c), source, meaning) for source, held in MEANINGS.items() for c, meaning in held.items() if columns is None or c in columns]
    return spark.createDataFrame(rows, "column string, units string, source string, meaning string")


def described(df: DataFrame) -> DataFrame:
    """The dictionary of a table's known columns, with how many of its rows have each."""
    known = dictionary(df.sparkSession, df.columns)
    names = [r["column"] for r in known.select("column").collect()]  # of one table
    counts = df.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "column", "n_rows")
    return known.join(counts, "column")


def cleaned(df: DataFrame) -> DataFrame:
    """Without columns for internal use and without nested ones, which CSV can't hold."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes if not c.startswith(("_contour", "_mask"))])


def text(spark: SparkSession, content: str, folder: str) -> None:
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.mode("overwrite").text(folder)


def written(seeds: DataFrame, photographs: DataFrame, settings: Settings, folder: str, kind: str = "parquet") -> Run:
    """A run as files: tables/<name>, config, summary and report below ``folder``. Each table is written in parallel.

    The measured objects are written first, as Parquet whatever the ``kind``, and every other table is made from
    them; summary and report read the written tables.
    """
    spark = seeds.sparkSession

    def put(df: DataFrame, name: str, form: str) -> DataFrame:
        plain = df if form == "parquet" else cleaned(df)
        to = plain.write.mode("overwrite").format(form)
        (to.option("header", True) if form == "csv" else to).save(f"{folder}/tables/{name}")
        back = spark.read.schema(plain.schema).format(form)
        return (back.option("header", True) if form == "csv" else back).load(f"{folder}/tables/{name}")

    objects = put(measured(seeds, settings), "per_seed", "parquet")
    made = results(objects, photographs, settings)
    tables = {name: objects if name == "per_seed" else put(df, name, kind) for name, df in made.tables.items()}
    if kind != "parquet":
        put(objects, f"per_seed_{kind}", kind)
    put(described(objects), "data_dictionary", kind)
    back = Run(settings, made.units, made.notes, tables)
    text(spark, json.dumps(settings.to_dict() | {"run": header(back)}, indent=2, sort_keys=True), f"{folder}/config")
    text(spark, summary(back), f"{folder}/summary")
    text(spark, report(back), f"{folder}/report")
    return back


def totals(seeds: DataFrame) -> DataFrame:
    return seeds.agg(F.count("*").alias("n_seeds"), F.countDistinct("image").alias("photographs"))


def header(result: Run) -> dict:
    """What a run was of: its lot, units, scale, and the rows that its tables were made from."""
    n = totals(result.tables["per_seed"]).first()
    return {"lot_id": result.settings.lot_id, "units": result.units, "px_per_mm": result.settings.px_per_mm, "scale_source": result.settings.scale_source, "n_seeds": n["n_seeds"], "photographs": n["photographs"], "notes": list(result.notes)}


def summary(result: Run) -> str:
    n = totals(result.tables["per_seed"]).first()
    tables = [f"tables/{name}" for name in result.tables]
    return "\n".join([f"{n['n_seeds']} objects in {n['photographs']} photographs, in {result.units}.", "", *tables, "tables/data_dictionary", "", *result.notes])


def _table(df: DataFrame, rows: int) -> str:
    """At most ``rows`` rows, in the order of the first column: a page shows no more."""
    shown = df.orderBy(df.columns[0]).limit(rows).collect()
    cell = lambda x: html.escape("" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    return f"<table><tr>{head}</tr>{''.join('<tr>' + ''.join(f'<td>{cell(x)}</td>' for x in r) + '</tr>' for r in shown)}</table>"


def _bars(df: DataFrame) -> str:
    """A histogram of 30 bars."""
    counts = [r["n"] for r in df.orderBy("bin").collect()]
    top = max(counts, default=0) or 1
    bars = "".join(f'<rect x="{8 * i}" y="{60 - 60 * n / top:.1f}" width="7" height="{60 * n / top:.1f}"/>' for i, n in enumerate(counts))
    return f'<svg width="240" height="60">{bars}</svg>'


def report(result: Run, rows: int = 60) -> str:
    """One page of HTML with every table but the objects' own, and a histogram of the first trait."""
    trait = "length_mm" if result.units == "mm" else "length_px"
    parts = [f"<h2>{html.escape(name)}</h2>{_table(df, rows)}" for name, df in result.tables.items() if name != "per_seed"]
    notes = "".join(f"<p>{html.escape(n)}</p>" for n in result.notes)
    shape = f"<h2>{trait}</h2>{_bars(stats.histogram(result.tables['per_seed'], trait))}"
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(result.settings.lot_id)}</title>{notes}{shape}{"".join(parts)}'
