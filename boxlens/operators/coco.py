"""COCO tables: validation, class maps, joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlens.operators.audit import union_all


def safe_relative_path(name: Column) -> Column:
    """Relative under both POSIX and Windows reading, without dot segments."""
    parts = F.split(F.regexp_replace(name, r"\\", "/"), "/")
    odd = F.exists(parts, lambda p: p.isin("", ".", "..") | p.contains(":"))
    return (F.trim(name) != "") & ~odd


def validate_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """One row (entity, id, rule) per violation."""
    def rows(df: DataFrame, entity: str, rules: dict[str, Column]) -> DataFrame:
        hit = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
        return df.withColumn("_v", hit).select(F.lit(entity).alias("entity"), F.col("id").cast("bigint").alias("id"), F.explode("_v").alias("rule"))

    def repeated(df: DataFrame, entity: str, key: Column, rule: str) -> DataFrame:
        return df.groupBy(key.alias("k")).agg(F.min("id").cast("bigint").alias("id"), F.count("*").alias("n")).filter("n > 1").select(
            F.lit(entity).alias("entity"), "id", F.lit(rule).alias("rule"))

    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    a = annotations.select("id", F.col("image_id"), "category_id", "bbox", "area", "iscrowd",
                           *[F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(("x", "y", "w", "h"))])
    # a repeated image has the smallest of its sizes, whichever of its rows comes first
    sizes = images.groupBy(F.col("id").alias("image_id")).agg(F.min("width").alias("iw"), F.min("height").alias("ih"))
    sized = a.join(sizes, "image_id", "left")
    known = sized.join(categories.select(F.col("id").alias("category_id"), F.lit(True).alias("known_category")).distinct(), "category_id", "left")
    area_off = F.abs(F.col("area") - w * h) > F.greatest(F.lit(1e-6) * F.greatest(F.abs("area"), F.abs(w * h)), F.lit(1e-6))
    boxed = F.size("bbox") == 4
    return union_all([
        rows(categories, "category", {"category_id_below_one": F.col("id") < 1}),
        repeated(categories, "category", F.col("id"), "duplicate_category_id"), repeated(categories, "category", F.col("name"), "duplicate_category_name"),
        rows(images, "image", {"unsafe_file_name": ~safe_relative_path(F.col("file_name")), "nonpositive_size": (F.col("width") < 1) | (F.col("height") < 1)}),
        repeated(images, "image", F.col("id"), "duplicate_image_id"), repeated(images, "image", F.lower("file_name"), "duplicate_file_name"),
        repeated(annotations, "annotation", F.col("id"), "duplicate_annotation_id"),
        rows(known, "annotation", {
            "unknown_image": F.col("iw").isNull(), "unknown_category": F.col("known_category").isNull(), "bbox_not_four_numbers": ~boxed,
            "bbox_origin_or_size": boxed & ((x < 0) | (y < 0) | (w <= 0) | (h <= 0)), "bbox_outside_image": boxed & ((x + w > F.col("iw")) | (y + h > F.col("ih"))),
            "area_mismatch": boxed & area_off, "unsupported_iscrowd": F.col("iscrowd") != 0,
        }),
    ])


def class_id_remap(categories: DataFrame, order: str = "position", start: int = 1) -> DataFrame:
    """Sparse category id to dense label; ``order`` is file position, id or list position.

    The class list is a small dimension.
    """
    w = Window.orderBy(order)
    return categories.select(F.col("id").alias("category_id"), (F.row_number().over(w) + start - 1).alias("dense_label"))


def attach_annotations(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Images with their boxes; images without boxes stay with NULLs."""
    return images.join(annotations, "image_id", "left")


def restrict_to_sample(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """Rows of the sampled images."""
    return rows.join(sample.select("image_id"), "image_id", "left_semi")


def sample_coverage_gaps(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """Sampled images that the rows do not cover."""
    return sample.select("image_id").join(rows.select("image_id"), "image_id", "left_anti")
