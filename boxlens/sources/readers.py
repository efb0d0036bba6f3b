"""File sources. Every read has a declared shape; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxlens.functions.text import strip
from boxlens.sources.versions import current

BOX = T.ArrayType(T.DoubleType())
COCO_SCHEMA = T.StructType([
    T.StructField("images", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("file_name", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))),
    T.StructField("annotations", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("image_id", T.LongType()), T.StructField("category_id", T.LongType()),
        T.StructField("bbox", BOX), T.StructField("area", T.DoubleType()), T.StructField("iscrowd", T.IntegerType())]))),
    T.StructField("categories", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())]))),
])
BUNDLE_RECORD = T.StructType([
    T.StructField("image_id", T.StringType()), T.StructField("image_size", T.ArrayType(T.IntegerType())), T.StructField("boxes_xyxy", T.ArrayType(BOX)),
    T.StructField("labels", T.ArrayType(T.LongType())), T.StructField("scores", T.ArrayType(T.DoubleType()))])
BUNDLE_SCHEMA = T.StructType([
    T.StructField("detector", T.StringType()), T.StructField("seed", T.IntegerType()), T.StructField("split", T.StringType()),
    T.StructField("predictions", T.ArrayType(BUNDLE_RECORD))])
# Curve columns of a training run: three losses, two scores, three validation losses.
CURVE_FIELDS = ("box_loss", "cls_loss", "dfl_loss", "map_50", "map_50_95", "val_box_loss", "val_cls_loss", "val_dfl_loss")


class MissingColumns(ValueError):
    pass


def require_columns(df: DataFrame, required: list[str]) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")


def csv_by_name(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """CSV as text columns named by the header; every file must have the header of the first."""
    first = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    raw = spark.read.schema(first.schema).option("header", True).option("encoding", "UTF-8").option("enforceSchema", False).csv(path)
    raw = raw.withColumnsRenamed({c: c.lstrip("\ufeff").strip() for c in raw.columns})
    require_columns(raw, required)
    return raw


def cast_or_fail(column: str, kind: str) -> Column:
    """A text column as ``kind``; text that is not one fails the job instead of becoming NULL."""
    value = strip(F.col(column))
    number = value.try_cast(kind)
    bad = number.isNull() & (F.coalesce(value, F.lit("")) != "")
    return F.when(bad, F.raise_error(F.concat(F.lit(f"{column} is no {kind}: "), value)).cast(kind)).otherwise(number)


def scan_csv_required(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """CSV as text, NULL as empty, with ``line`` (the first data row is 2) and ``file``.

    Rows are counted per file block and offset by the blocks before it, so large
    files stay split over tasks.
    """
    raw = csv_by_name(spark, path, required)
    names = raw.columns
    rows = raw.select(*names, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    # one row per file block
    blocks = rows.groupBy("file", "_b").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "_b", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    return rows.join(starts, ["file", "_b"]).select(
        *[F.coalesce(c, F.lit("")).alias(c) for c in names], "file", (F.col("_i") - F.col("_first") + F.col("_skip") + 2).alias("line"))


def scan_split_manifests(spark: SparkSession, path: str) -> DataFrame:
    """All split CSVs, of one header; an empty split falls back to the file stem."""
    raw = csv_by_name(spark, current(spark, path), ["image_id"])
    stem = F.regexp_extract("_metadata.file_path", r"([^/]+?)\.csv(?:/[^/]*)?$", 1)
    given = F.col("split") if "split" in raw.columns else F.lit(None).cast("string")
    return raw.select(*[c for c in raw.columns if c != "split"], F.coalesce(F.when(given != "", given), stem).alias("split"))


def scan_patient_mapping(spark: SparkSession, path: str, parts: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """JSON list documents, one row per element; ``entry`` is its 1-based position in the list.

    Elements that are no objects become NULL fields. A document is one text in one task;
    ``parts`` are partition columns of the folder to keep.
    """
    text = spark.read.option("wholetext", True).text(path)
    entries = text.select(*parts, F.posexplode(F.from_json("value", T.ArrayType(T.StringType()))).alias("pos", "item"))
    field = lambda n: F.get_json_object("item", f"$.{n}").alias(n)
    return entries.select(*parts, (F.col("pos") + 1).cast("bigint").alias("entry"), field("subset_key"), field("original_name"))


def scan_coco(spark: SparkSession, path: str, selected: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of COCO documents; documents in folders ``split=...`` add that column.

    ``selected`` (file_name) restricts images and annotations, see ``restrict_coco``.
    """
    doc = spark.read.schema(COCO_SCHEMA).option("multiLine", True).json(current(spark, path))
    split = [c for c in ("split",) if c in doc.columns]
    part = lambda name: doc.select(*split, F.explode(name).alias("e")).select(*split, "e.*")
    images, annotations, categories = (part(name) for name in ("images", "annotations", "categories"))
    if categories.isEmpty():
        raise ValueError("COCO annotations contain no categories")
    if selected is not None:
        images, annotations = restrict_coco(images, annotations, selected)
    return images, annotations, categories


def restrict_coco(images: DataFrame, annotations: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images of the selected file names, in their order, and the annotations of these; names without an image fail."""
    names = selected.select("file_name").distinct()
    lacking = names.join(images, "file_name", "left_anti").agg(F.count("*").alias("n"), F.min("file_name").alias("first")).first()
    if lacking["n"]:
        raise ValueError(f"{lacking['n']} selected images are not covered by COCO annotations, first {lacking['first']}")
    kept = images.join(names, "file_name", "left_semi")
    keys = [c for c in ("split",) if c in images.columns]
    of_kept = annotations.join(kept.select(*keys, F.col("id").alias("image_id")), [*keys, "image_id"], "left_semi")
    return kept.sort("file_name"), of_kept


def scan_coco_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Images and annotations stored as JSON lines under ``images`` and ``annotations``, by split if they were so written."""
    fields = {f.name: f.dataType.elementType for f in COCO_SCHEMA.fields}
    folder = current(spark, path)
    return (spark.read.schema(fields["images"]).json(f"{folder}/images"), spark.read.schema(fields["annotations"]).json(f"{folder}/annotations"))


def scan_result_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """The newest whole version of a result table."""
    return spark.read.schema(schema).format(fmt).option("header", True).load(current(spark, path))


def xyxy(annotations: DataFrame) -> DataFrame:
    at = lambda i: F.get("bbox", F.lit(i))
    return annotations.select("image_id", "category_id", at(0).alias("x1"), at(1).alias("y1"), (at(0) + at(2)).alias("x2"), (at(1) + at(3)).alias("y2"))


def _boxes(record: DataFrame, keys: list[str]) -> DataFrame:
    zipped = record.select(*keys, "image_id", F.posexplode(F.arrays_zip("boxes_xyxy", "labels", "scores")).alias("pidx", "b"))
    corner = lambda i: F.get("b.boxes_xyxy", F.lit(i))
    return zipped.select(*keys, "image_id", F.col("pidx").cast("bigint").alias("pidx"), F.col("b.labels").alias("label"), F.col("b.scores").alias("score"),
                         *[corner(i).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


def scan_prediction_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Gzip JSON bundles, one document per run, to one row per box."""
    doc = spark.read.schema(BUNDLE_SCHEMA).option("multiLine", True).json(current(spark, path))
    rec = doc.select("detector", "seed", F.explode("predictions").alias("p")).select("detector", "seed", "p.*")
    return _boxes(rec, ["detector", "seed"])


def scan_prediction_records(spark: SparkSession, path: str) -> DataFrame:
    """The splittable layout: one JSON line per run and image."""
    schema = T.StructType([T.StructField("detector", T.StringType()), T.StructField("seed", T.IntegerType()), *BUNDLE_RECORD.fields])
    return _boxes(spark.read.schema(schema).json(current(spark, path)), ["detector", "seed"])


def scan_yolo_labels(spark: SparkSession, path: str, keyed: bool = False) -> DataFrame:
    """``class xc yc w h`` lines with their file, blank lines skipped, NULL where not numeric.

    ``keyed``: lines begin with the image and a tab, and ``file`` is that image.
    """
    text = spark.read.text(path)
    line = F.regexp_replace("value", "^[^\t]*\t", "") if keyed else F.col("value")
    file = F.substring_index("value", "\t", 1) if keyed else F.col("_metadata.file_path")
    rows = text.select(strip(line).alias("line"), file.alias("file")).filter("line <> ''")
    f = F.split("line", r"\s+")
    at = lambda i: F.get(f, F.lit(i))
    return rows.select("file", F.size(f).alias("fields"), at(0).try_cast("int").alias("class_id"), *[at(i).try_cast("double").alias(n) for i, n in enumerate(("xc", "yc", "w", "h"), 1)])


def file_inventory(spark: SparkSession, root: str, suffixes: list[str]) -> DataFrame:
    """Recursive listing: key, path, size and SHA-256 of the bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace(F.col("path"), r"^.*" + root.rstrip("/").split("/")[-1] + "/", "")
    return files.filter(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin([s.lower() for s in suffixes])).select(
        relative.alias("path"), F.lower(F.regexp_replace(relative, r"\.[^./]*$", "")).alias("key"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha"))


def epoch_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Epoch records by column name; a missing column or a value of another type fails."""
    raw = csv_by_name(spark, path, schema.fieldNames())
    return raw.select(*[cast_or_fail(f.name, f.dataType.simpleString()).alias(f.name) for f in schema.fields])


def epoch_log_differences(spark: SparkSession, csv_path: str, jsonl_path: str, schema: T.StructType) -> DataFrame:
    """Records that occur in only one of the two epoch logs."""
    a = epoch_csv(spark, csv_path, schema)
    b = spark.read.schema(schema).json(jsonl_path)
    tag = lambda df, side: df.withColumn("only_in", F.lit(side))
    return tag(a.exceptAll(b), "csv").unionByName(tag(b.exceptAll(a), "jsonl"))


def scan_epoch_logs(spark: SparkSession, csv_path: str, jsonl_path: str, schema: T.StructType) -> DataFrame:
    """Epoch records, read only if both logs hold the same ones."""
    if not epoch_log_differences(spark, csv_path, jsonl_path, schema).isEmpty():
        raise ValueError("CSV and JSONL epoch logs differ")
    return epoch_csv(spark, csv_path, schema)


def scan_training_curve(spark: SparkSession, path: str, fields: tuple[str, ...] = CURVE_FIELDS, strict: bool = True) -> DataFrame:
    """Per-epoch CSV by column name. A field that is not numeric fails; with ``strict`` off it is NULL and named in ``bad_fields``."""
    raw = csv_by_name(spark, path, ["run_id", "epoch", *fields])
    num = {c: strip(F.col(c)).try_cast("double") for c in fields}
    bad = F.array_join(F.array_compact(F.array(*[F.when(v.isNull(), F.lit(c)) for c, v in num.items()])), ";")
    if strict:
        bad = F.when(bad != "", F.raise_error(F.concat(F.lit("curve fields are not numeric: "), bad)).cast("string")).otherwise(bad)
    return raw.select("run_id", cast_or_fail("epoch", "int").alias("epoch"), *[v.alias(c) for c, v in num.items()], bad.alias("bad_fields"))
