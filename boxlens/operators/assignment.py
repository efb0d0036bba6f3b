"""Ranks and greedy matches of whole images in numpy, inside the task that holds them.

The predictions of a task come image by image, each with the targets of its image; a batch of images is ranked, paired and
matched by array operations. Only pairs that compete for an end are walked, in rounds that take what comes first for both.
What comes out isn't known to be partitioned by image any more: plans that group by image next are better served by
``matching.with_matches``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from boxlens.functions.geometry import CORNERS
from boxlens.functions.grids import IOU_LEVELS

HELD = 1 << 17  # predictions of an unfinished image; beyond, those that the cap leaves out are dropped
PAIRS = 1 << 20  # pairs that are tested together


def _starts(column: pa.Array) -> np.ndarray:
    """Rows whose value differs from that of the row before."""
    here, there = column.slice(1), column.slice(0, max(len(column) - 1, 0))
    differ = pc.fill_null(pc.not_equal(here, there), False).to_numpy(zero_copy_only=False)
    differ = differ | (here.is_valid().to_numpy(zero_copy_only=False) != there.is_valid().to_numpy(zero_copy_only=False))
    return np.flatnonzero(np.concatenate([[len(column) > 0], differ]))


def _ranked(rows: pa.RecordBatch, groups: list[str], cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the rows to keep in the order of image, group and rank; their ranks; the place of each one's image."""
    starts = _starts(rows.column("image_id"))
    image = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
    group = image.copy()
    for c in groups:
        coded = rows.column(c).dictionary_encode(null_encoding="encode")
        group = group * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
    score = rows.column("score").to_numpy(zero_copy_only=False)
    falling = np.where(np.isnan(score), -np.inf, -score)
    order = np.lexsort((rows.column("pidx").to_numpy(zero_copy_only=False), falling, group))
    sorted_group = group[order]
    first = np.flatnonzero(np.diff(sorted_group, prepend=-1))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) + 1
    kept = rank <= cap
    return order[kept], rank[kept], image[order[kept]]


def _iou(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = a, b
    inter = np.maximum(0.0, np.minimum(ax2, bx2) - np.maximum(ax1, bx1)) * np.maximum(0.0, np.minimum(ay2, by2) - np.maximum(ay1, by1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return inter / ((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter)


def _candidates(rows: pa.RecordBatch, kept: np.ndarray, image: np.ndarray, lists: pa.Array, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a kept row and a target of its image and class with at least ``least`` IoU: row, target, IoU."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets, targets = np.cumsum(sizes) - sizes, lists.flatten()
    corners = [targets.field(c).to_numpy(zero_copy_only=False) for c in CORNERS]
    own = [rows.column(c).to_numpy(zero_copy_only=False)[kept] for c in CORNERS]
    labels, wanted = rows.column("label").take(pa.array(kept)), targets.field("label")
    upto, found = np.cumsum(sizes[image]), []
    lo = 0
    while lo < len(kept):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, side="right")))
        each = sizes[image[lo:hi]]
        row = np.repeat(np.arange(lo, hi), each)
        target = offsets[image[row]] + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
        value = _iou([c[row] for c in own], [c[target] for c in corners])
        near = np.flatnonzero(value >= least)
        alike = pc.fill_null(pc.equal(labels.take(pa.array(row[near])), wanted.take(pa.array(target[near]))), False).to_numpy(zero_copy_only=False)
        near = near[alike]
        found.append((row[near], target[near], value[near]))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _greedy(row: np.ndarray, target: np.ndarray, n_rows: int, n_targets: int) -> np.ndarray:
    """Which pairs, given in greedy order, are taken: a round takes every pair that comes first for both its ends."""
    taken, left = np.zeros(len(row), bool), np.arange(len(row))
    while len(left):
        first_r, first_t = np.zeros(n_rows, np.int64), np.zeros(n_targets, np.int64)
        first_r[row[left[::-1]]] = left[::-1]
        first_t[target[left[::-1]]] = left[::-1]
        best = left[(first_r[row[left]] == left) & (first_t[target[left]] == left)]
        taken[best] = True
        used_r, used_t = np.zeros(n_rows, bool), np.zeros(n_targets, bool)
        used_r[row[best]], used_t[target[best]] = True, True
        left = left[~used_r[row[left]] & ~used_t[target[left]]]
    return taken


def _heads(rows: pa.RecordBatch) -> np.ndarray:
    """Per image the row that carries what the image has."""
    return np.flatnonzero(rows.column("_row").to_numpy() == 1)


def _matches(rows: pa.RecordBatch, groups: list[str], cap: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Kept rows, ranks, match bits, and target and IoU of the match at the first level."""
    kept, rank, image = _ranked(rows, groups, cap)
    lists = rows.column("_targets").take(pa.array(_heads(rows)))
    row, target, value = _candidates(rows, kept, image, lists, levels[0])
    tidx = lists.flatten().field("tidx").to_numpy(zero_copy_only=False)
    order = np.lexsort((tidx[target], -value, row))
    row, target, value = row[order], target[order], value[order]
    # a target is another one in every group of its image
    run = np.cumsum(rank == 1)[row]
    _, end = np.unique(run * max(1, len(tidx)) + target, return_inverse=True)
    reach = np.searchsorted(levels, value, side="right")
    bits = (1 << reach) - 1
    rivals = np.flatnonzero((np.bincount(row, minlength=len(kept))[row] > 1) | (np.bincount(end)[end] > 1)) if len(row) else row
    if len(rivals):
        bits[rivals] = 0
        _, r = np.unique(row[rivals], return_inverse=True)
        _, t = np.unique(end[rivals], return_inverse=True)
        for level in range(len(levels)):
            some = np.flatnonzero(reach[rivals] > level)
            hit = some[_greedy(r[some], t[some], r.max() + 1, t.max() + 1)]
            bits[rivals[hit]] |= 1 << level
    mask = np.zeros(len(kept), np.int64)
    np.add.at(mask, row, bits)  # at one level a row has one match
    own = np.full(len(kept), -1)
    at = np.flatnonzero(bits & 1)
    own[row[at]] = at
    none = own < 0
    pick = np.maximum(own, 0)
    if not len(row):
        return kept, rank, mask, pa.nulls(len(kept), pa.int64()), pa.nulls(len(kept), pa.float64())
    return kept, rank, mask, pa.array(tidx[target[pick]], pa.int64(), mask=none), pa.array(value[pick], pa.float64(), mask=none)


def _image_by_image(predictions: DataFrame, targets: DataFrame, groups: list[str], columns: list[str], cap: int, schema: T.StructType, shape,
                    beside: DataFrame | None = None) -> DataFrame:
    """``shape`` of whole images, a batch at a time. Predictions are sorted by image only, and not exchanged if they, the targets
    and ``beside`` (image_id and what its images carry) are partitioned by image; images that ``beside`` lacks are left out.

    The window brings an image's rows together whatever the joins become; its first row carries what the image has.
    """
    each = F.struct(F.col("tidx").cast("bigint").alias("tidx"), "label", *[F.col(c).cast("double").alias(c) for c in CORNERS])
    lists = targets.groupBy("image_id").agg(F.collect_list(each).alias("_targets"))
    lean = predictions.select(*columns, *[F.col(c).cast("double").alias(c) for c in CORNERS])
    lean = lean.withColumn("_row", F.row_number().over(Window.partitionBy("image_id").orderBy("image_id")))
    head = lambda df: [F.when(F.col("_row") == 1, F.col(c)).alias(c) for c in df.columns if c != "image_id"]
    joined = lean.join(lists, "image_id", "left").select(*lean.columns, *head(lists))
    joined = joined if beside is None else joined.join(beside, "image_id").select(*joined.columns, *head(beside))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            last = int(_starts(rows.column("image_id"))[-1])
            if last:
                yield shape(rows.slice(0, last))
            held = rows.slice(last)
            if held.num_rows > HELD:
                held = held.take(pa.array(np.union1d(_ranked(held, groups, cap)[0], _heads(held))))
        if held is not None:
            yield shape(held)

    return joined.sortWithinPartitions("image_id").mapInArrow(work, schema)


def _schema(df: DataFrame, kept: list[str], **more: T.DataType) -> tuple[T.StructType, pa.Schema]:
    schema = T.StructType([*[df.schema[c] for c in kept], *[T.StructField(c, kind) for c, kind in more.items()]])
    return schema, pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])


def match_images(predictions: DataFrame, targets: DataFrame, run: tuple = ("d", "s"), max_detections: int = 100, by: tuple = (),
                 levels: list[float] = IOU_LEVELS) -> DataFrame:
    """The best ``max_detections`` predictions of every image-run (and ``by``) with rank, a match bit per level (ascending), and the
    target and IoU of the match at the first level. ``by`` also separates the matching."""
    kept = [*run, "image_id", "pidx", "label", "score"]
    schema, arrow = _schema(predictions, kept, rank=T.IntegerType(), level_mask=T.IntegerType(), tidx=T.LongType(), iou=T.DoubleType())
    groups, steps = list(dict.fromkeys([*run, *by])), np.array(levels)

    def shape(rows: pa.RecordBatch) -> pa.RecordBatch:
        at, rank, mask, tidx, iou = _matches(rows, groups, max_detections, steps)
        own = [rows.column(c).take(pa.array(at)) for c in kept]
        return pa.RecordBatch.from_arrays([*own, pa.array(rank, pa.int32()), pa.array(mask, pa.int32()), tidx, iou], schema=arrow)

    return _image_by_image(predictions, targets, groups, kept, max_detections, schema, shape)


def image_sums(predictions: DataFrame, targets: DataFrame, run: tuple = ("d", "s"), max_detections: int = 100, iou_threshold: float = 0.5,
               beside: DataFrame | None = None) -> DataFrame:
    """Predictions (``preds``), matches (``tp``) and their summed IoU and Dice per image, run and label that has predictions, with the
    columns of ``beside``."""
    extra = [c for c in beside.columns if c != "image_id"] if beside is not None else []
    whose, groups, steps = [*run, "image_id", "label"], list(run), np.array([iou_threshold])
    source = T.StructType([*[predictions.schema[c] for c in whose], *[beside.schema[c] for c in extra]])
    schema = T.StructType([*source, *[T.StructField(c, T.LongType()) for c in ("preds", "tp")], *[T.StructField(c, T.DoubleType()) for c in ("iou_sum", "dice_sum")]])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def shape(rows: pa.RecordBatch) -> pa.RecordBatch:
        at, rank, mask, _, iou = _matches(rows, groups, max_detections, steps)
        coded = rows.column("label").take(pa.array(at)).dictionary_encode(null_encoding="encode")
        unit = np.cumsum(rank == 1) * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
        _, first, unit = np.unique(unit, return_index=True, return_inverse=True)
        value = np.nan_to_num(iou.to_numpy(zero_copy_only=False))
        sums = [np.bincount(unit, w, len(first)) for w in (None, mask.astype(float), value, 2 * value / (1 + value))]
        own = [rows.column(c).take(pa.array(at[first])) for c in whose]
        head = np.searchsorted(_starts(rows.column("image_id")), at[first], side="right") - 1
        own += [rows.column(c).take(pa.array(_heads(rows)[head])) for c in extra]
        return pa.RecordBatch.from_arrays([*own, *[pa.array(x.astype(np.int64)) for x in sums[:2]], *map(pa.array, sums[2:])], schema=arrow)

    return _image_by_image(predictions, targets, groups, [*whose, "pidx", "score"], max_detections, schema, shape, beside)
