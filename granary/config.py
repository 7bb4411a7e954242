"""Settings; the defaults are part of the results."""

from dataclasses import dataclass

#: Names of traits and labels.
PX_TRAITS = ("length_px", "width_px", "area_px2", "perimeter_px")
MATCHED_TRAITS = ("length_px", "width_px", "area_px2", "roundness", "length_mm", "width_mm")
MM_TRAITS = ("length_mm", "width_mm", "thickness_mm", "area_mm2", "perimeter_mm", "feret_max_mm", "eq_diameter_mm", "gmd_mm", "amd_mm", "sphericity", "surface_area_mm2", "volume_mm3", "mass_mg")
PATTERNS = ("black", "dotted", "marbled", "plain", "spotted")


# The defaults of all settings below.
@dataclass(frozen=True)
class QC:
    focus_min: float = 60.0
    clip_max: float = 0.01
    illum_cv_max: float = 0.12
    seed_min_px: float = 35.0
    seed_good_px: float = 60.0
    min_seeds: int = 5


@dataclass(frozen=True)
class Patterns:
    black_L_max: float = 35.0
    plain_coverage_max: float = 0.02
    dotted_count_min: int = 12
    marbled_largest: float = 0.15
    spot_min_separation: float = 8.0
    spot_min_area_px: int = 3
    shading_share: float = 0.90


@dataclass(frozen=True)
class Colour:
    erode_iter: int = 1
    min_px: int = 10


@dataclass(frozen=True)
class Physical:
    thickness_of_width: float = 0.62
    density_g_cm3: float | None = None
    density_source: str = "unset"
    literature_density: float = 1.30

    @property
    def density(self) -> float | None:
        if self.density_g_cm3:
            return self.density_g_cm3
        return None if self.density_source == "unset" else self.literature_density


@dataclass(frozen=True)
class Reliability:
    dup_iou: float = 0.30
    merged_area_factor: float = 1.8
    outline_tol: float = 0.15
    drift_bins: int = 3
    drift_r2_flag: float = 0.10
    match_max_dist: float = 0.03


@dataclass(frozen=True)
class Detect:
    conf: float = 0.10
    iou: float = 0.50
    max_det: int = 600
    imgsz: int = 640
    tiled: bool = False
    tile_size: int = 1024
    tile_overlap: float = 0.20
    dedup_iou: float = 0.55
    containment: float = 0.80
    edge_margin: int = 2


@dataclass(frozen=True)
class Segment:
    min_fill: float = 0.10
    max_fill: float = 0.95
    max_border_touch: float = 0.35
    close_iter: int = 2
    open_iter: int = 1
    smooth_epsilon: float = 0.004
    smooth_from: int = 12
    least_points: int = 8
    min_area_px: float = 20.0
    fragment_share: float = 0.25
    adaptive_block_frac: float = 0.35
    adaptive_c: float = 4.0


@dataclass(frozen=True)
class Shape:
    harmonics: int = 10
    components: int = 4
    atlas_max: int = 250


@dataclass(frozen=True)
class Validation:
    join_on: str = "seed_id"
    traits: tuple[str, ...] = ("length_mm", "width_mm")
    loa_z: float = 1.96
