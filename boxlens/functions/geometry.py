"""Box arithmetic in continuous pixel coordinates (no +1 convention)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CORNERS = ("x1", "y1", "x2", "y2")


def corners_from_xywh(x: Column, y: Column, w: Column, h: Column) -> dict[str, Column]:
    return {"x1": x, "y1": y, "x2": x + w, "y2": y + h}


def area(w: Column, h: Column) -> Column:
    return w * h


def corner_area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two corner boxes."""
    width = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    height = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    inter = width * height
    return inter / (corner_area(**a) + corner_area(**b) - inter)


def box(prefix: str = "") -> dict[str, Column]:
    return {c: F.col(f"{prefix}{c}").cast("double") for c in CORNERS}


def dice(iou_value: Column) -> Column:
    return 2 * iou_value / (1 + iou_value)


def normalized_center(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Centre and size of an xywh box as fractions of the image size."""
    return {
        "xc": (x + w / F.lit(2.0)) / width,
        "yc": (y + h / F.lit(2.0)) / height,
        "nw": w / width,
        "nh": h / height,
    }


def edges_from_center(xc: Column, yc: Column, w: Column, h: Column) -> dict[str, Column]:
    half = F.lit(2.0)
    return {"left": xc - w / half, "top": yc - h / half, "right": xc + w / half, "bottom": yc + h / half}
