"""Heat-map and image operators on row-major arrays.

An image is one row, and each operator maps a row to rows: no pixel ever crosses a
shuffle. Heat maps stay in JVM array functions, corruptions run as array kernels.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Corruption grid of the robustness study: fixed names, families, units and values.
CORRUPTIONS = (
    ("darker", "lighting", "brightness", "multiplier", (0.9, 0.8, 0.7, 0.6, 0.5)),
    ("brighter", "lighting", "brightness", "multiplier", (1.1, 1.2, 1.3, 1.4, 1.5)),
    ("gaussian_noise", "noise", "gaussian_noise", "fraction_of_uint8_range_std", (0.01, 0.02, 0.035, 0.05, 0.075)),
    ("salt_and_pepper", "noise", "salt_pepper", "affected_pixel_fraction", (0.0025, 0.005, 0.01, 0.02, 0.04)),
    ("gaussian_blur", "blur", "gaussian_blur", "sigma_pixels", (0.5, 1.0, 1.5, 2.0, 3.0)),
    ("motion_blur", "blur", "motion_blur", "kernel_pixels", (3.0, 5.0, 9.0, 13.0, 17.0)),
    ("jpeg", "compression", "jpeg", "quality_percent", (90.0, 70.0, 50.0, 35.0, 20.0)),
)


def condition_grid(spark: SparkSession, corruptions=CORRUPTIONS, clean: bool = True) -> DataFrame:
    """Definitions times severities, plus the clean row with severity 0."""
    rows = [(f"{n}_s{i}", n, fam, kind, unit, i, float(v)) for n, fam, kind, unit, values in corruptions for i, v in enumerate(values, 1)]
    if clean:
        rows = [("clean", "clean", "clean", "clean", "none", 0, 0.0), *rows]
    return spark.createDataFrame(rows, "condition string, corruption string, family string, kind string, unit string, severity int, value double")


def validate_severity_curves(levels: DataFrame) -> DataFrame:
    """Violations per corruption name: (name, rule). Input: name, kind, severity, value."""
    v, kind = F.col("value"), F.col("kind")
    whole = v == F.floor(v)
    stats = levels.groupBy("name").agg(
        F.count("*").alias("n"), F.min("severity").alias("lo"), F.max("severity").alias("hi"), F.count_distinct("severity").alias("nd"), F.min("kind").alias("kind"), F.max("kind").alias("last_kind"),
        F.max(v).alias("top"), F.min(v).alias("bottom"), F.count_if((kind == "motion_blur") & ~(whole & (v >= 3) & (v % 2 == 1))).alias("bad_motion"),
        F.count_if((kind == "jpeg") & ~(whole & (v <= 100))).alias("bad_jpeg"), F.count_if(~(v > 0)).alias("bad_value"),
    )
    # only curves of a legal length are ordered, so a list has at most five values
    curve = F.transform(F.sort_array(F.collect_list(F.struct("severity", "value"))), lambda x: x["value"])
    curves = levels.join(stats.filter("n <= 5").select("name"), "name").groupBy("name").agg(curve.alias("curve"))
    per = stats.join(curves, "name", "left")
    dark, kind_col = F.col("top") < 1, F.col("kind")
    falling = (kind_col == "jpeg") | ((kind_col == "brightness") & dark)
    pairs = F.zip_with(F.slice("curve", 1, F.size("curve") - 1), F.slice("curve", 2, F.size("curve")), lambda a, b: b - a)
    wrong_way = F.when(falling, F.exists(pairs, lambda d: d > 0)).otherwise(F.exists(pairs, lambda d: d < 0))
    rules = {
        "level_count": ~F.col("n").between(3, 5), "severity_not_contiguous": (F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("nd") != F.col("n")),
        "value_not_positive": F.col("bad_value") > 0, "noise_above_one": kind_col.isin("gaussian_noise", "salt_pepper") & (F.col("top") > 1),
        "motion_kernel": F.col("bad_motion") > 0, "jpeg_quality": F.col("bad_jpeg") > 0, "brightness_crosses_one": (kind_col == "brightness") & ~(dark | (F.col("bottom") > 1)),
        "not_mild_to_severe": (F.col("n") > 1) & wrong_way, "mixed_kinds": F.col("kind") != F.col("last_kind"),
    }
    hit = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return per.withColumn("_v", hit).select("name", F.explode("_v").alias("rule"))


def let(value: Column, body) -> Column:
    """Bind ``value`` as a lambda variable: evaluated once per row, not once per use.

    An expression named inside a pixel lambda would run again for every pixel.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _inside(i: Column, w: Column, box: dict[str, Column]) -> Column:
    """Pixel centre inside the half-open box."""
    x, y = (i % w) + F.lit(0.5), F.floor(i / w) + F.lit(0.5)
    return (x >= box["x1"]) & (x < box["x2"]) & (y >= box["y1"]) & (y < box["y2"])


def _indexes(h: Column, w: Column) -> Column:
    return F.sequence(F.lit(0), h * w - 1)


def _box() -> dict[str, Column]:
    return {c: F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")}


def pixel_box_mask(maps: DataFrame) -> DataFrame:
    """Map rows (h, w, box corners) with a boolean row-major ``mask``."""
    return maps.withColumn("mask", F.transform(_indexes(F.col("h"), F.col("w")), lambda i: _inside(i, F.col("w"), _box())))


def heatmap_violations(maps: DataFrame, key: list[str]) -> DataFrame:
    b = _box()
    rules = {
        "wrong_length": F.size("v") != F.col("h") * F.col("w"),
        "nonfinite_or_negative": F.exists("v", lambda x: F.isnan(x) | (x < 0) | (x == F.lit(float("inf")))),
        "box_outside_map": (b["x1"] < 0) | (b["y1"] < 0) | (b["x2"] > F.col("w")) | (b["y2"] > F.col("h")),
        "empty_box": (b["x2"] <= b["x1"]) | (b["y2"] <= b["y1"]),
    }
    return maps.withColumn("_v", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).select(*key, F.explode("_v").alias("rule"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def box_attention(maps: DataFrame, epsilon: float = 1e-12) -> DataFrame:
    """Energy in the box, first peak, hit, area share, lift; zero-energy maps are invalid (NULLs)."""
    w = F.col("w")
    masked = pixel_box_mask(maps).withColumn("total_energy", _total(F.col("v")))
    valid = F.col("total_energy") > epsilon
    peak = F.array_position("v", F.array_max("v")).cast("int") - 1
    inside = _total(F.zip_with("v", "mask", lambda x, m: F.when(m, x).otherwise(F.lit(0.0))))
    area = F.size(F.filter("mask", lambda m: m)) / F.size("mask")
    out = masked.withColumns({"valid": valid, "peak": F.when(valid, peak), "energy_in_box": F.when(valid, inside / F.col("total_energy")), "box_pixel_fraction": area})
    return out.withColumns({
        "peak_x": (F.col("peak") % w).cast("int"), "peak_y": F.floor(F.col("peak") / w).cast("int"),
        "pointing_hit": F.when(F.col("valid"), F.get("mask", F.col("peak"))), "energy_lift_over_area": F.col("energy_in_box") - F.col("box_pixel_fraction"),
    }).drop("mask", "peak", "v")


def cam_from_channels(channels: DataFrame, key: list[str], epsilon: float = 1e-12) -> DataFrame:
    """Class activation map from (key, channel, pixel, activation, gradient) rows.

    A channel weighs its mean gradient; the rectified weighted sum is scaled to its maximum.
    """
    weights = channels.groupBy(*key, "channel").agg(F.avg("gradient").alias("weight"))
    summed = channels.join(weights, [*key, "channel"]).groupBy(*key, "pixel").agg(F.greatest(F.lit(0.0), F.sum(F.col("weight") * F.col("activation"))).alias("cam"))
    top = summed.groupBy(*key).agg(F.max("cam").alias("top"))
    return summed.join(top, key).select(*key, "pixel", F.when(F.col("top") > epsilon, F.col("cam") / F.col("top")).otherwise(0.0).alias("cam"))


def minmax_to_uint8(values: Column, invert: Column | None = None) -> Column:
    """Stretch finite values to 0..255, half to even; NaN and -inf go low, +inf high; flat maps to 0."""
    inf = F.lit(float("inf"))
    finite = F.filter(values, lambda x: ~F.isnan(x) & (F.abs(x) < inf))
    flip = F.lit(False) if invert is None else invert

    def stretch(r: Column) -> Column:
        low, high = r["low"], r["high"]

        def level(x: Column) -> Column:
            filled = F.when(F.isnan(x) | (x == -inf), low).when(x == inf, high).otherwise(x)
            shown = F.when(flip, high + low - filled).otherwise(filled)
            scaled = F.rint((shown - low) * (F.lit(255.0) / (high - low)))
            return F.when(high > low, F.least(F.lit(255.0), F.greatest(F.lit(0.0), scaled))).otherwise(0.0).cast("int")

        return F.transform(values, level)

    limits = let(finite, lambda f: F.struct(F.array_min(f).alias("low"), F.array_max(f).alias("high")))
    return let(limits, stretch)


def _levels(x: np.ndarray) -> np.ndarray:
    """Half to even, clipped to 0..255."""
    return np.clip(np.rint(x), 0, 255).astype(np.int32)


def _uniforms(parts: Iterable[str]) -> np.ndarray:
    """``hashing.uniform`` of colon-joined parts."""
    heads = b"".join(hashlib.md5(p.encode(), usedforsecurity=False).digest()[:4] for p in parts)
    return (np.frombuffer(heads, ">u4") + 0.5) / 4294967296.0


def brightness(v: np.ndarray, multiplier: float) -> np.ndarray:
    return _levels(v * multiplier)


def gaussian_noise(v: np.ndarray, sigma: float, seed_key: str) -> np.ndarray:
    """Box-Muller on two hash uniforms per pixel."""
    u1, u2 = (_uniforms(f"{seed_key}:{i}:{tag}" for i in range(v.size)).reshape(v.shape) for tag in "ab")
    return _levels(v + np.sqrt(-2 * np.log(u1)) * np.cos(2 * math.pi * u2) * (sigma * 255))


def salt_pepper(v: np.ndarray, amount: float, seed_key: str) -> np.ndarray:
    u = _uniforms(f"{seed_key}:{i}:sp" for i in range(v.size)).reshape(v.shape)
    return np.where(u < amount / 2, 255, np.where(u < amount, 0, v)).astype(np.int32)


def reflect(at: np.ndarray, n: int) -> np.ndarray:
    """Mirror indexes at the borders without repeating the edge pixel; any distance."""
    if n == 1:
        return np.zeros_like(at)
    m = at % (2 * (n - 1))
    return np.minimum(m, 2 * (n - 1) - m)


def gaussian_kernel(sigma: float) -> list[float]:
    """Odd length of at least max(3, ceil(6 sigma + 1)), weights summing to one."""
    radius = max(3, math.ceil(6 * sigma + 1)) // 2
    raw = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [x / sum(raw) for x in raw]


def _weighted(v: np.ndarray, taps: Iterable[tuple[float, int, int]]) -> np.ndarray:
    """Sum of taps (weight, dx, dy) around each pixel with reflected borders, added in their order."""
    h, w = v.shape
    total = np.zeros(v.shape)
    for weight, dx, dy in taps:
        moved = v if dy == 0 else v[reflect(np.arange(h) + dy, h)]
        total += weight * (moved if dx == 0 else moved[:, reflect(np.arange(w) + dx, w)])
    return total


def gaussian_blur(v: np.ndarray, sigma: float) -> np.ndarray:
    """Separable: rows, then columns."""
    kernel = gaussian_kernel(sigma)
    r = len(kernel) // 2
    across = _weighted(v, [(a, i - r, 0) for i, a in enumerate(kernel)])
    return _levels(_weighted(across, [(a, 0, i - r) for i, a in enumerate(kernel)]))


def motion_blur(v: np.ndarray, kernel: int, seed_key: str) -> np.ndarray:
    """Mean along a line of ``kernel`` pixels at a seeded angle."""
    angle, r = float(_uniforms([f"{seed_key}:angle"])[0]) * (2 * math.pi), kernel // 2
    return _levels(_weighted(v, [(1.0 / kernel, round(t * math.cos(angle)), round(t * math.sin(angle))) for t in range(-r, r + 1)]))


def corrupt(v: np.ndarray, kind: str, value: float, seed_key: str) -> np.ndarray:
    """One grey image (height x width) under one corruption; jpeg needs a codec."""
    if kind == "brightness":
        return brightness(v, value)
    if kind == "gaussian_noise":
        return gaussian_noise(v, value, seed_key)
    if kind == "salt_pepper":
        return salt_pepper(v, value, seed_key)
    if kind == "gaussian_blur":
        return gaussian_blur(v, value)
    if kind == "motion_blur":
        return motion_blur(v, int(value), seed_key)
    raise ValueError(f"{kind} needs an image codec")


PIXELS_OUT = 1 << 20  # pixels of a batch handed on; a larger image makes a batch of its own


def corruption_fanout(images: DataFrame, seed: int, corruptions=CORRUPTIONS, key: str = "image_id") -> DataFrame:
    """Every image under every codec-free condition, size preserved.

    One scan in Arrow batches, array kernels per image and condition; nothing is shuffled.
    An image without pixels or size gives null pixels; pixels that do not fill h x w raise.
    """
    made = [(f"{name}_s{i}", family, i, kind, float(x)) for name, family, kind, _, values in corruptions if kind != "jpeg" for i, x in enumerate(values, 1)]
    types = {c: images.schema[c].dataType.simpleString() for c in (key, "h", "w")}
    names = [*types, "condition", "family", "severity", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pixels = [], 0

            def packed() -> pa.RecordBatch:
                at = pa.array([r[0] for r in rows], pa.int64())
                lists = [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.string()), (2, pa.string()), (3, pa.int32()), (4, pa.list_(pa.int32())))]
                return pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in types], *lists], names=names)

            for n, (named, h, w, v) in enumerate(zip(*[batch.column(c) for c in (key, "h", "w", "v")], strict=True)):
                whole = h.is_valid and w.is_valid and v.is_valid
                image = v.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(h.as_py(), w.as_py()) if whole else None
                for condition, family, severity, kind, value in made:
                    out = corrupt(image, kind, value, f"{seed}:{named.as_py()}:{condition}").ravel() if whole else None
                    rows.append((n, condition, family, severity, out))
                    pixels += out.size if whole else 0
                    if pixels >= PIXELS_OUT:
                        yield packed()
                        rows, pixels = [], 0
            if rows:
                yield packed()

    schema = ", ".join(f"{c} {t}" for c, t in types.items()) + ", condition string, family string, severity int, v array<int>"
    return images.select(key, "h", "w", "v").mapInArrow(run, schema)
