"""Measures of a photograph's pixels. Each row is a photograph (image-source struct); one is held at a time.

The helpers state a definition in a few array lines: grey levels, an area mean of the blurred picture, Lab. Values
follow from the definition, without the rounding to bytes that imaging libraries do between steps.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.exprs import let

#: Weights of blue, green and red in grey; D65 white; linear RGB to XYZ.
GREY = np.array([0.114, 0.587, 0.299])
WHITE = np.array([0.950456, 1.0, 1.088754])
XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
METRICS = "image string, width int, height int, megapixels double, focus double, clip_low double, clip_high double, clip_frac double, illum_cv double, illum_range double, colour_cast double, mean_intensity double"
STRIP = 1 << 18


def pixels(row: dict) -> np.ndarray:
    """Height x width x 3 bytes, blue first; one grey channel counts for three, alpha is left out."""
    got = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
    return np.repeat(got, 3, 2) if got.shape[2] == 1 else got[..., :3]


def gauss(sigma: float) -> np.ndarray:
    reach = int(round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / max(sigma, 1e-9)) ** 2)
    return kernel / kernel.sum()


def blurred_means(n: int, cells: int, sigma: float) -> np.ndarray:
    """cells x n weights: equal stretches' means after a Gaussian blur whose border mirrors."""
    edge = np.arange(cells + 1) * n / cells
    at = np.arange(n)
    share = np.clip(np.minimum(edge[1:, None], at + 1) - np.maximum(edge[:-1, None], at), 0, None) * cells / n
    kernel = gauss(sigma)
    reach = len(kernel) // 2
    mirror = np.pad(at, reach, "reflect") if n > 1 else np.zeros(n + 2 * reach, int)
    out = np.zeros((cells, n))
    for i in range(cells):
        np.add.at(out[i], mirror, np.convolve(share[i], kernel))
    return out


def light(grey: np.ndarray, cells: int, divisor: float) -> np.ndarray:
    """A coarse map of the light: the blur takes objects away."""
    h, w = grey.shape
    sigma = max(w, h) / divisor
    return blurred_means(h, cells, sigma) @ grey @ blurred_means(w, cells, sigma).T


def lab_ab(bgr: np.ndarray) -> np.ndarray:
    """a* and b* of rows of pixels."""
    c = bgr[:, ::-1] / 255.0
    linear = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    t = linear @ XYZ.T / WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    return np.stack([500 * (f[:, 0] - f[:, 1]), 200 * (f[:, 1] - f[:, 2])], 1)


def measured(bgr: np.ndarray) -> dict[str, float | int | None]:
    grey = np.rint(bgr @ GREY)
    h, w = grey.shape
    p = np.pad(grey, 1, "reflect") if min(h, w) > 1 else np.pad(grey, 1, "edge")
    laplacian = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * grey
    field = light(grey, 8, 25.0)
    flat = bgr.reshape(-1, 3)
    a, b = sum(lab_ab(flat[i : i + STRIP]).sum(0) for i in range(0, len(flat), STRIP)) / len(flat)
    low, high = float((grey <= 2).mean()), float((grey >= 253).mean())
    return {
        "width": w, "height": h, "megapixels": round(w * h / 1e6, 2), "focus": float(laplacian.var()), "clip_low": low, "clip_high": high, "clip_frac": low + high,
        "illum_cv": float(field.std() / field.mean()) if field.mean() else None, "illum_range": float(np.ptp(field) / 255), "colour_cast": float(np.hypot(a, b)), "mean_intensity": float(grey.mean()),
    }


def _each(images: DataFrame, schema: str, rows) -> DataFrame:
    """``rows(name, pixels)`` of every photograph; those with no pixels give none. Batches are of few photographs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for pdf in batches:
            for name, height, width, channels, data in pdf.itertuples(index=False):
                if data is not None and height > 0 and width > 0:
                    yield pd.DataFrame(rows(name, pixels({"height": height, "width": width, "nChannels": channels, "data": data})), columns=names)

    return images.select("path", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(run, schema)


def photo_metrics(images: DataFrame) -> DataFrame:
    """Size, focus (variance of the Laplacian), clipping, evenness of light and colour cast. images: path, image."""
    return _each(images, METRICS, lambda name, bgr: [{"image": name} | measured(bgr)])


def light_field(images: DataFrame, cells: int = 24) -> DataFrame:
    """image, row, col, level: the light of each cell against the photograph's mean."""

    def rows(name: str, bgr: np.ndarray) -> list[dict]:
        field = light(np.rint(bgr @ GREY), cells, 30.0)
        field = field / max(field.mean(), 1e-6)
        return [{"image": name, "row": i, "col": j, "level": float(field[i, j])} for i in range(cells) for j in range(cells)]

    return _each(images, "image string, row int, col int, level double", rows)


#: Deviation of the blur that is taken from a ruler's profile; lags to look at, as shares of its length, the least
#: of them and how many at least; the least strength of a period.
RULER_BLUR, RULER_LOW, RULER_HIGH, RULER_FIRST, RULER_LAGS, RULER_LEAST = 12, 0.004, 0.25, 3, 2, 0.20


def ruler_scale(images: DataFrame, mm_per_tick: float = 1.0) -> DataFrame:
    """image, px_per_mm, strength of each cropped ruler strip, from the period of its marks; null where it isn't clear."""

    def rows(name: str, bgr: np.ndarray) -> list[dict]:
        grey = bgr @ GREY
        return [{"image": name, "profile": (grey.T if grey.shape[0] > grey.shape[1] else grey).mean(0).tolist()}]

    return profile_scale(_each(images, "image string, profile array<double>", rows), ["image"], mm_per_tick)


def profile_scale(profiles: DataFrame, keys: list[str], mm_per_tick: float = 1.0) -> DataFrame:
    """keys, px_per_mm, strength from ``profile``, an array of brightness along a ruler.

    The profile less its own wide blur is multiplied with itself, moved by each lag; the lag that agrees best is a mark's
    width. Null without contrast, and px_per_mm where the best is weak; ties (to nine places) go to the shorter lag. One
    expression over the array, so a row stays where it lies.
    """
    reach, n = 3 * RULER_BLUR, "size(p)"
    kernel = let("w", f"transform(sequence(-{reach}, {reach}), o -> exp(-0.5D * o * o / {RULER_BLUR * RULER_BLUR}D))", let("t", "aggregate(w, 0D, (s, v) -> s + v)", "transform(w, v -> v / t)"))
    mirrored = f"if({n} = 1, 0, abs(pmod(i + k - {reach} + {n} - 1, 2 * {n} - 2) - {n} + 1))"
    blurred = let("g", kernel, f"transform(p, (v, i) -> v - aggregate(sequence(0, {2 * reach}), 0D, (s, k) -> s + g[k] * p[{mirrored}]))")
    centred = let("b", blurred, let("m", "aggregate(b, 0D, (s, v) -> s + v) / size(b)", "transform(b, v -> v - m)"))
    low = f"greatest({RULER_FIRST}, cast(floor({RULER_LOW}D * {n}) as int))"
    high = f"least(greatest(low + {RULER_LAGS}, cast(floor({RULER_HIGH}D * {n}) as int)), {n}) - 1"
    match = f"transform(sequence(low, {high}), lag -> struct(round(aggregate(sequence(0, {n} - 1 - lag), 0D, (s, i) -> s + z[i] * z[i + lag]) / power, 9) as strength, -lag as lag))"
    best = let("z", centred, let("power", "aggregate(z, 0D, (s, v) -> s + v * v)", let("low", low, f"if(power / {n} < 1e-12D or {high} < low, null, array_max({match}))")))
    found = profiles.select(*keys, F.expr(let("p", "profile", f"if({n} > 0, {best}, null)")).alias("_best"))
    clear = F.col("_best.strength") >= RULER_LEAST
    return found.select(*keys, F.when(clear, -F.col("_best.lag") / F.lit(float(mm_per_tick))).alias("px_per_mm"), F.col("_best.strength").alias("strength"))
