"""A whole run over a table of measured objects: every table of results as a lazy frame."""

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.config import MM_TRAITS, PX_TRAITS, QC, Detect, Patterns, Physical, Reliability, Segment, Shape, Validation
from granary.functions.exprs import pattern_class
from granary.operators import physical, qc, reliability, stats


@dataclass(frozen=True)
class Settings:
    lot_id: str = "lot"
    px_per_mm: float | None = None
    scale_source: str = "unset"
    qc: QC = field(default_factory=QC)
    patterns: Patterns = field(default_factory=Patterns)
    physical: Physical = field(default_factory=Physical)
    reliability: Reliability = field(default_factory=Reliability)
    detect: Detect = field(default_factory=Detect)
    segment: Segment = field(default_factory=Segment)
    shape: Shape = field(default_factory=Shape)
    validation: Validation = field(default_factory=Validation)

    @property
    def calibrated(self) -> bool:
        return bool(self.px_per_mm and self.px_per_mm > 0)

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class Run:
    """Nothing is computed before a table is written or shown."""

    settings: Settings
    units: str
    notes: tuple[str, ...]
    tables: dict[str, DataFrame]


def px_per_mm(pixels: float, mm: float) -> float:
    """The scale of a length measured in both; both must be positive."""
    if pixels <= 0 or mm <= 0:
        raise ValueError("a scale needs two positive lengths")
    return pixels / mm


def assumptions(settings: Settings) -> tuple[str, ...]:
    """Sentences on what the physical traits rest on."""
    p = settings.physical
    if not settings.calibrated:
        return ("There is no scale: sizes are in pixels and no physical trait was derived.",)
    scale = f"Scale: {settings.px_per_mm:.2f} pixels a millimetre ({settings.scale_source})."
    thick = f"Thickness is {p.thickness_of_width:g} of the width, not measured; mean diameters, volume and mass rest on it."
    if p.density is None:
        return scale, thick, "There is no density: no mass was derived."
    return scale, thick, f"Density: {p.density:.3f} g/cm3 ({p.density_source})."


def resting_on(seeds: DataFrame, settings: Settings) -> DataFrame:
    """note, n_seeds: each of the :func:`assumptions`, and how many measured objects have a trait that rests on it."""
    rests = ("length_mm", "thickness_mm", "mass_mg") if settings.calibrated else ("length_px",)
    pairs = list(zip(assumptions(settings), rests))
    return seeds.agg(F.array(*[F.struct(F.lit(note).alias("note"), F.count(c).alias("n_seeds")) for note, c in pairs]).alias("a")).select(F.inline("a"))


def passing(seeds: DataFrame, photographs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """setting, value, n_rows: thresholds of a run, and how many objects or photographs lie on their good side."""
    s = settings
    of_seeds = {
        "detect.conf": (s.detect.conf, F.col("confidence") >= s.detect.conf), "reliability.outline_tol": (s.reliability.outline_tol, F.abs("outline_error") <= s.reliability.outline_tol),
        "patterns.black_L_max": (s.patterns.black_L_max, F.col("mean_L") >= s.patterns.black_L_max), "patterns.plain_coverage_max": (s.patterns.plain_coverage_max, F.col("spot_coverage") >= s.patterns.plain_coverage_max),
        "patterns.marbled_largest": (s.patterns.marbled_largest, F.col("largest_spot") <= s.patterns.marbled_largest),
    }
    of_photographs = {"qc.focus_min": (s.qc.focus_min, F.col("focus") >= s.qc.focus_min), "qc.clip_max": (s.qc.clip_max, F.col("clip_frac") <= s.qc.clip_max), "qc.illum_cv_max": (s.qc.illum_cv_max, F.col("illum_cv") <= s.qc.illum_cv_max)}
    counted = lambda df, held: df.agg(F.array(*[F.struct(F.lit(name).alias("setting"), F.lit(str(value)).alias("value"), F.count_if(ok).alias("n_rows")) for name, (value, ok) in held.items()]).alias("a")).select(F.inline("a"))
    return counted(seeds, of_seeds).unionAll(counted(photographs, of_photographs))


def measured(seeds: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The objects with pattern, physical traits and outline check."""
    s = physical.to_physical(seeds.withColumn("pattern_class", pattern_class(settings.patterns)), settings.px_per_mm, settings.physical)
    return reliability.outline(s, settings.reliability)


def results(s: DataFrame, photographs: DataFrame, settings: Settings = Settings()) -> Run:
    """Every table from the :func:`measured` objects; best given a written table, as each result reads it."""
    traits = [t for t in (MM_TRAITS if settings.calibrated else PX_TRAITS) if t in s.columns]
    checks = reliability.detection_checks(s, settings.reliability, settings.detect.edge_margin)
    tables = {
        "per_seed": s, "lot_statistics": stats.lot_summary(s, traits), "per_image": stats.per_group(s, traits[:6]), "composition": stats.composition(s), "crosstab": stats.crosstab_wide(s),
        "quality_control": qc.qc_rules(photographs, s, settings.qc), "detection_checks": checks, "outlines": reliability.outline_summary(s), "outlines_by_method": reliability.outline_by_method(s),
        "position_drift": reliability.drift_reading(reliability.position_drift(s, traits, settings.reliability)), "drift_grid": reliability.drift_grid(s, traits[0], settings.reliability.drift_bins),
        "wide_lot": stats.gwas_wide(s, traits, settings.lot_id, False), "wide_image": stats.gwas_wide(s, traits, settings.lot_id, True),
    }
    if settings.calibrated:
        tables["seed_weight"] = physical.thousand_seed_weight(s)
    return Run(settings, "mm" if settings.calibrated else "px", assumptions(settings), tables)


def run(seeds: DataFrame, photographs: DataFrame, settings: Settings = Settings()) -> Run:
    """seeds: measured objects in pixels with their boxes; photographs: image and its quality measures."""
    return results(measured(seeds, settings), photographs, settings)
