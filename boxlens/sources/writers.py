"""File sinks. Tables that are replaced are kept as versions, so that a reader always sees a whole one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from boxlens.functions.text import ten_decimals
from boxlens.operators.blocks import dense_ids
from boxlens.session import small
from boxlens.sources.versions import write_version

# Fixed value: column order of a split manifest.
MANIFEST_FIELDS = ("split", "image_id", "nih_patient_id", "study_stratum", "is_positive", "source_file", "processed_file", "width", "height", "box_count")


def sink_result_table(df: DataFrame, fields: list[str], path: str, fmt: str = "parquet") -> None:
    """Replace a result table, columns in fixed order; ``readers.scan_result_table`` sees the old or the new one, never a part."""
    def write(folder: str) -> None:
        writer = df.select(*fields).write.mode("error")
        (writer.option("header", True).csv(folder) if fmt == "csv" else writer.parquet(folder))

    write_version(df.sparkSession, path, write)


def sink_text_files(df: DataFrame, key: str, text: str, root: str) -> None:
    """Every text, and a line feed, as the file ``<folder of the task>/<n>/<key>=<value>.txt``; n counts the rows of equal value.

    A folder per task keeps listings short where files are many. Names follow from the rows, so
    a task that runs again writes the same files. ``root`` is shared by all executors and is
    one that Arrow opens (a path, file:, hdfs:, s3: or gs:), else the sink fails.
    """
    pyarrow.fs.FileSystem.from_uri(root)

    def write(rows: Iterator[Row]) -> None:
        files, top = pyarrow.fs.FileSystem.from_uri(root)
        before, n, made = object(), 0, -1
        for value, content in rows:
            n = n + 1 if value == before else 0
            before, folder = value, f"{top.rstrip('/')}/{TaskContext.get().partitionId()}/{n}"
            if n > made:
                files.create_dir(folder)
                made = n
            with files.open_output_stream(f"{folder}/{key}={value}.txt") as out:
                out.write(((content or "") + "\n").encode())

    named = df.select(F.col(key).cast("string").alias("value"), F.col(text).alias("content"))
    named.repartition("value").sortWithinPartitions("value", "content").foreachPartition(write)


def sink_split_manifest(exams: DataFrame, path: str) -> None:
    """One sorted CSV folder per split; a column copy names the folder. All splits are replaced at once."""
    flag = F.col("is_positive").cast("int").alias("is_positive")  # 1 or 0
    rows = exams.select(*[flag if c == "is_positive" else c for c in MANIFEST_FIELDS], F.col("split").alias("split_name"))
    ordered = rows.repartitionByRange("split", "image_id").sortWithinPartitions("split", "image_id")
    write_version(exams.sparkSession, path, lambda folder: ordered.write.mode("error").partitionBy("split_name").option("header", True).csv(folder))


def _ids_in_split(rows: DataFrame, order: list[str], split: list[str]) -> DataFrame:
    """``dense_ids`` that begin at 1 in every split; a split's first global id is its offset."""
    ids = dense_ids(rows, [*split, *order])
    if not split:
        return ids
    first = small(ids.groupBy(*split).agg(F.min("id").alias("_first")))
    return ids.join(first, split).withColumn("id", F.col("id") - F.col("_first") + 1).drop("_first")


def coco_tables(images: DataFrame, boxes: DataFrame, category_id: int = 1, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """COCO images and annotations: ids run from 1 by exam, annotation ids by image and row.

    With a column ``split`` in ``images`` both tables have it too, and ids run from 1 in
    every split. ``keep`` names more columns of the images.
    """
    split = ["split"] if "split" in images.columns else []
    ids = _ids_in_split(images.select(*split, "exam_id", "file_name", "width", "height", *keep), ["exam_id"], split)
    out_images = ids.select(*split, "id", "file_name", "width", "height", *keep)
    linked = boxes.select("exam_id", "row_number", "x", "y", "w", "h").join(ids.select(*split, "exam_id", F.col("id").alias("image_id")), "exam_id")
    numbered = _ids_in_split(linked, ["image_id", "row_number"], split)
    bbox = F.array("x", "y", "w", "h")
    annotations = numbered.select(*split, "id", "image_id", F.lit(category_id).cast("bigint").alias("category_id"), bbox.alias("bbox"), (F.col("w") * F.col("h")).alias("area"), F.lit(0).alias("iscrowd"))
    return out_images, annotations


def sink_coco(images: DataFrame, annotations: DataFrame, path: str, categories: tuple[tuple[int, str], ...] = ((1, "opacity"),)) -> None:
    """JSON lines for the three tables, by split if they have one: splittable, and replaced together."""
    spark = images.sparkSession
    listed = spark.createDataFrame(list(categories), "id bigint, name string")

    def write(folder: str) -> None:
        for name, table in (("images", images), ("annotations", annotations), ("categories", listed)):
            table.write.mode("error").partitionBy(*[c for c in ("split",) if c in table.columns]).json(f"{folder}/{name}")

    write_version(spark, path, write)


def sink_coco_documents(images: DataFrame, annotations: DataFrame, path: str, per_document: int = 1000,
                        categories: tuple[tuple[int, str], ...] = ((1, "opacity"),)) -> None:
    """Whole COCO documents, one file each, of ``per_document`` images in id order with their annotations and all categories.

    A split, if there is one, has documents of its own in a folder ``split=...``. The number
    of documents grows with the images, their size does not. Image ids must be dense.
    """
    split = ["split"] if "split" in images.columns else []
    part = lambda c: F.floor((F.col(c) - 1) / per_document).alias("part")
    pack = lambda df, c, name, fields: df.groupBy(*split, part(c)).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    docs = pack(images, "id", "images", ("id", *[c for c in images.columns if c not in ("id", "split")])).join(
        pack(annotations, "image_id", "annotations", ("id", "image_id", "category_id", "bbox", "area", "iscrowd")), [*split, "part"], "left")
    listed = F.array(*[F.struct(F.lit(i).cast("bigint").alias("id"), F.lit(n).alias("name")) for i, n in categories])
    ready = docs.drop("part").withColumns({"annotations": F.coalesce("annotations", F.array()), "categories": listed})
    write_version(images.sparkSession, path, lambda folder: ready.write.mode("error").option("maxRecordsPerFile", 1).partitionBy(*split).json(folder))


def sink_yolo_labels(images: DataFrame, boxes: DataFrame, key: str, order: str, path: str) -> None:
    """Label lines, each behind its image and a tab, as ``scan_yolo_labels(keyed=True)`` reads them.

    One file per image would be one file per row; instead files hold many images, and an
    image without boxes has a line without a box.
    """
    line = ten_decimals(F.col("class_id"), *[F.col(c) for c in ("xc", "yc", "w", "h")])
    rows = images.select(key).join(boxes.select(key, order, line.alias("line")), key, "left").sortWithinPartitions(key, order)
    rows.select(F.concat_ws("\t", F.col(key).cast("string"), F.coalesce("line", F.lit(""))).alias("value")).write.mode("overwrite").text(path)


def bundle_records(predictions: DataFrame, images: DataFrame, run: list[str]) -> DataFrame:
    """One nested record per run and image, boxes in prediction order."""
    box = F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")])
    entry = F.struct(F.col("pidx"), box.alias("box"), F.col("label"), F.col("score"))
    packed = predictions.groupBy(*run, "image_id").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    part = lambda f: F.transform("e", lambda x: x[f])
    return packed.join(images.select("image_id", "height", "width"), "image_id").select(
        *run, F.col("image_id").cast("string").alias("image_id"), F.array("height", "width").alias("image_size"),
        part("box").alias("boxes_xyxy"), part("label").alias("labels"), part("score").alias("scores"))


def sink_prediction_bundle(records: DataFrame, path: str) -> None:
    write_version(records.sparkSession, path, lambda folder: records.write.mode("error").option("compression", "gzip").json(folder))
