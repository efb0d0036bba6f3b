"""Audits of raw annotation tables and of label-file layouts.

Every rule is a filter that lands in one issues table (code, severity, exam_id,
row_number); an exam with any error is invalid.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlens.functions.geometry import edges_from_center
from boxlens.functions.text import parse_finite, strip
from boxlens.session import materialize

COORDS = ("x", "y", "width", "height")
# Patient id inside the original file name (fixed format of the source archive).
PATIENT_PATTERN = r"^(\d{8})_\d{3}\.png$"
WARNINGS = ("duplicate_mapping", "duplicate_box", "duplicate_negative_row", "orphan_class_info", "missing_label", "duplicate_image")


@dataclass(frozen=True)
class AuditRules:
    width: int = 1024
    height: int = 1024
    positive_target: str = "1"
    negative_target: str = "0"
    strata: tuple[str, ...] = ("opacity", "other", "normal")
    positive_stratum: str = "opacity"


@dataclass(frozen=True)
class Audit:
    exams: DataFrame
    boxes: DataFrame
    issues: DataFrame


def severity(code: Column) -> Column:
    return F.when(code.isin(*WARNINGS), "warning").otherwise("error")


def _issues(df: DataFrame, code, exam: Column | None = None, row: Column | None = None) -> DataFrame:
    name = code if isinstance(code, Column) else F.lit(code)
    exam = F.lit(None) if exam is None else exam
    row = F.lit(None) if row is None else row
    return df.select(name.alias("code"), severity(name).alias("severity"), exam.cast("string").alias("exam_id"), row.cast("bigint").alias("row_number"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def extract_patient_id(name: Column, pattern: str = PATIENT_PATTERN) -> Column:
    """Patient id if the whole name matches, else NULL."""
    pid = F.regexp_extract(strip(name), pattern, 1)
    return F.when(pid != "", pid)


def parse_mapping(mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exam_id, patient_id) with the first entry winning, and the mapping issues."""
    exam = strip(F.coalesce("subset_key", F.lit("")))
    entries = mapping.select("entry", exam.alias("exam_id"), extract_patient_id(F.coalesce("original_name", F.lit(""))).alias("patient_id"))
    good = (F.col("exam_id") != "") & F.col("patient_id").isNotNull()
    bad = _issues(entries.filter(~good), "malformed_mapping_entry", F.when(F.col("exam_id") != "", F.col("exam_id")), F.col("entry"))
    first = entries.filter(good).groupBy("exam_id").agg(F.min("entry").alias("first_entry"), F.min_by("patient_id", "entry").alias("patient"))
    later = entries.filter(good).join(first, "exam_id").filter("entry > first_entry")
    code = F.when(F.col("patient_id") != F.col("patient"), "inconsistent_mapping").otherwise("duplicate_mapping")
    return first.select("exam_id", F.col("patient").alias("patient_id")), bad.unionByName(_issues(later, code, F.col("exam_id"), F.col("entry")))


def class_sets(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per exam the smallest and largest class, and malformed rows."""
    rows = classes.select("row_number", strip(F.coalesce("exam_ref", F.lit(""))).alias("exam_id"), strip(F.coalesce("label", F.lit(""))).alias("label"))
    good = (F.col("exam_id") != "") & (F.col("label") != "")
    bad = _issues(rows.filter(~good), "malformed_class_info", F.when(F.col("exam_id") != "", F.col("exam_id")), F.col("row_number"))
    return rows.filter(good).groupBy("exam_id").agg(F.min("label").alias("first_class"), F.max("label").alias("last_class")), bad


def orphan_class_info(class_exams: DataFrame, label_exams: DataFrame) -> DataFrame:
    """Exams with class info but no label row."""
    return class_exams.join(label_exams, "exam_id", "left_anti")


def join_exam_sources(labels: DataFrame, patients: DataFrame, classes: DataFrame, rules: AuditRules = AuditRules()) -> DataFrame:
    """One row per exam: label summary with patient and class, both optional."""
    target = strip(F.coalesce("target", F.lit("")))
    exams = labels.groupBy("exam_id").agg(
        F.min(target).alias("first_target"), F.max(target).alias("last_target"), F.count("*").alias("label_rows"),
        F.max(~target.isin(rules.positive_target, rules.negative_target)).alias("unknown_target"),
    )
    return exams.join(patients, "exam_id", "left").join(classes, "exam_id", "left").withColumn(
        "is_positive", (F.col("first_target") == rules.positive_target) & (F.col("last_target") == rules.positive_target)
    )


def box_code(x: Column, y: Column, w: Column, h: Column, rules: AuditRules) -> Column:
    """First broken box rule: malformed, then nonpositive, then off-image."""
    return (
        F.when(x.isNull() | y.isNull() | w.isNull() | h.isNull(), "malformed_box")
        .when((w <= 0) | (h <= 0), "nonpositive_box")
        .when((x < 0) | (y < 0) | (x + w > rules.width) | (y + h > rules.height), "off_image_box")
    )


def dedupe_keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row of each key by a combinable aggregate, so hot copies merge map-side."""
    others = [c for c in rows.columns if c not in keys and c != order]
    packed = F.min_by(F.struct(*others), order) if others else None
    out = rows.groupBy(*keys).agg(F.min(order).alias(order), *([packed.alias("_f")] if others else []))
    return out.select(*keys, order, *[F.col(f"_f.{c}").alias(c) for c in others])


def audit_annotations(labels: DataFrame, classes: DataFrame, mapping: DataFrame, rules: AuditRules = AuditRules()) -> Audit:
    """Labels (row_number, exam_id, x, y, width, height, target), class info and patient mapping, all text."""
    patients, mapping_issues = parse_mapping(mapping)
    class_info, class_issues = class_sets(classes)
    named = labels.withColumn("exam_id", strip(F.coalesce("exam_id", F.lit(""))))
    rows = named.filter("exam_id <> ''")
    # the exam and row tables feed every rule below: computed once, kept durably
    exams = materialize(join_exam_sources(rows, patients, class_info, rules), "audit-exams")

    values = {c: parse_finite(F.col(c)) for c in COORDS}
    checked = rows.join(exams.select("exam_id", "is_positive"), "exam_id").select(
        "exam_id", "row_number", "is_positive", *[v.alias(f"b_{c}") for c, v in values.items()],
        reduce(lambda a, b: a | b, [strip(F.coalesce(c, F.lit(""))) != "" for c in COORDS]).alias("has_text"),
    )
    code = F.when(F.col("is_positive"), box_code(*[F.col(f"b_{c}") for c in COORDS], rules)).when(F.col("has_text"), "negative_with_box")
    coded = materialize(checked.withColumn("code", code), "audit-rows")
    fit = coded.filter(F.col("is_positive") & F.col("code").isNull())
    keys = ["exam_id", *[f"b_{c}" for c in COORDS]]
    kept = fit.groupBy(*keys).agg(F.min("row_number").alias("first_row"))
    repeats = fit.join(kept, keys).filter("row_number > first_row")
    row_errors = coded.filter("code is not null")
    per_exam = row_errors.groupBy("exam_id").agg(F.count("*").alias("row_errors")).join(
        kept.groupBy("exam_id").agg(F.count("*").alias("box_count")), "exam_id", "full_outer"
    )

    one_class = F.col("first_class") == F.col("last_class")
    positive = F.col("is_positive")
    exam_rules = {
        "missing_patient_mapping": F.col("patient_id").isNull(),
        "unknown_target": F.col("unknown_target"),
        "inconsistent_targets": F.col("first_target") != F.col("last_target"),
        "missing_class_info": F.col("first_class").isNull(),
        "inconsistent_class_info": ~one_class,
        "unknown_study_stratum": one_class & ~F.col("first_class").isin(*rules.strata),
        "target_class_mismatch": one_class & (positive != (F.col("first_class") == rules.positive_stratum)),
        "positive_without_valid_box": positive & (F.col("box_count") == 0),
        "duplicate_negative_row": ~positive & (F.col("label_rows") > 1),
    }
    hits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in exam_rules.items()]))
    full = exams.join(per_exam, "exam_id", "left").fillna(0, ["row_errors", "box_count"]).withColumn("codes", hits)
    errors = F.filter("codes", lambda c: c != "duplicate_negative_row")
    out = full.select(
        "exam_id", F.coalesce("patient_id", F.lit("")).alias("patient_id"), F.when(one_class, F.col("first_class")).otherwise("").alias("study_stratum"),
        "is_positive", "box_count", ((F.size(errors) == 0) & (F.col("row_errors") == 0)).alias("valid"),
    )
    boxes = kept.select("exam_id", *[F.col(f"b_{c}").alias(c) for c in COORDS], F.col("first_row").alias("row_number"))
    flagged = full.select("exam_id", F.explode("codes").alias("code"))
    issues = union_all([
        mapping_issues, class_issues,
        _issues(named.filter("exam_id = ''"), "missing_exam_id", None, F.col("row_number")),
        _issues(flagged, F.col("code"), F.col("exam_id")),
        _issues(row_errors, F.col("code"), F.col("exam_id"), F.col("row_number")),
        _issues(repeats, "duplicate_box", F.col("exam_id"), F.col("row_number")),
        _issues(orphan_class_info(class_info, exams.select("exam_id")), "orphan_class_info", F.col("exam_id")),
    ])
    return Audit(out, boxes, issues)


def audit_input_counts(audit: Audit, labels: DataFrame, classes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Row and exam counts of the three inputs, and exam, box and patient counts of their audit, in one row."""
    valid = audit.exams.filter("valid")
    named = lambda df, c: F.count_distinct(F.when(strip(F.col(c)) != "", strip(F.col(c))))
    mapped = parse_mapping(mapping)[0].agg(F.count("*").alias("mapped_exam_ids"))
    rows = [
        mapping.agg(F.count("*").alias("mapping_entries")), mapped, labels.agg(F.count("*").alias("label_rows"), named(labels, "exam_id").alias("annotation_exam_ids")),
        classes.agg(F.count("*").alias("class_info_rows")), class_sets(classes)[0].agg(F.count("*").alias("class_info_exam_ids")),
        audit.exams.agg(F.count_if("valid").alias("valid_exam_ids"), F.count_if(~F.col("valid")).alias("invalid_exam_ids"),
                        F.sum(F.when(F.col("valid"), F.col("box_count")).otherwise(0)).alias("valid_boxes")),
        valid.groupBy("patient_id").count().agg(
            F.count("*").alias("unique_patients"), F.count_if(F.col("count") > 1).alias("multi_exam_patients"),
            F.coalesce(F.max("count"), F.lit(0)).alias("maximum_exams_per_patient"))]
    return reduce(DataFrame.crossJoin, rows)  # one row each


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code", "severity").agg(F.count("*").alias("n"))


# --- label-file layout -------------------------------------------------------

def file_key(path: Column, folder: Column) -> Column:
    """Case-folded path below ``folder`` without its suffix."""
    return F.lower(F.regexp_replace(F.substring(path, F.length(folder) + 2, F.length(path)), r"\.[^./]*$", ""))


def parse_label_lines(label_files: DataFrame, class_count: int) -> DataFrame:
    """Non-blank lines of each label file with their parsed box and first broken rule."""
    text = F.regexp_replace(F.col("content").cast("string"), "^﻿", "")
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: strip(x)), lambda x: x != "")
    rows = label_files.filter(F.is_valid_utf8(F.col("content").cast("string"))).select("split", "path", F.posexplode(lines).alias("pos", "line"))
    f = F.split("line", r"\s+")
    at = lambda i: F.get(f, F.lit(i))
    # try_cast alone would read '1.5' as an integer, which a class id is not
    class_id = F.when(at(0).rlike(r"^[+-]?\d+$"), at(0).try_cast("int"))
    nums = [at(i).try_cast("double") for i in range(1, 5)]
    parsed = rows.select(
        "split", "path", (F.col("pos") + 1).alias("line_number"), F.size(f).alias("fields"), class_id.alias("class_id"),
        *[n.alias(c) for n, c in zip(nums, ("xc", "yc", "w", "h"))],
    )
    e = edges_from_center(F.col("xc"), F.col("yc"), F.col("w"), F.col("h"))
    numbers = [F.col(c) for c in ("xc", "yc", "w", "h")]
    nonfinite = reduce(lambda a, b: a | b, [F.isnan(c) | (F.abs(c) == F.lit(float("inf"))) for c in numbers])
    outside = (F.col("w") <= 0) | (F.col("h") <= 0) | (F.least(e["left"], e["top"]) < 0) | (F.greatest(e["right"], e["bottom"]) > 1)
    code = (
        F.when(F.col("fields") != 5, "label_field_count")
        .when(F.col("class_id").isNull() | reduce(lambda a, b: a | b, [c.isNull() for c in numbers]), "label_parse")
        .when((F.col("class_id") < 0) | (F.col("class_id") >= class_count), "unknown_class")
        .when(nonfinite, "nonfinite_box").when(outside, "invalid_box")
    )
    coded = parsed.withColumn("code", code)
    keys = ["split", "path", "class_id", "xc", "yc", "w", "h"]
    first = coded.filter("code is null").groupBy(*keys).agg(F.min("line_number").alias("first_line"))
    with_first = coded.join(first, [*keys], "left")
    return with_first.withColumn("code", F.coalesce("code", F.when(F.col("line_number") > F.col("first_line"), F.lit("duplicate_box")))).drop("first_line")


@dataclass(frozen=True)
class LayoutAudit:
    files: DataFrame
    lines: DataFrame
    issues: DataFrame


def audit_yolo_layout(images: DataFrame, labels: DataFrame, splits: list[str], class_count: int) -> LayoutAudit:
    """Images (split, key, path, sha) and label files (split, key, path, content)."""
    lines = parse_label_lines(labels, class_count)
    unreadable = labels.filter(~F.is_valid_utf8(F.col("content").cast("string"))).select("split", "path")
    tag = lambda df, code, path="path": df.select("split", F.col(path).alias("path"), (code if isinstance(code, Column) else F.lit(code)).alias("code"))

    def stems(files: DataFrame) -> tuple[DataFrame, DataFrame]:
        first = files.groupBy("split", "key").agg(F.min("path").alias("first_path"))
        return first, files.join(first, ["split", "key"]).filter("path > first_path")

    image_first, image_repeat = stems(images.select("split", "key", "path"))
    label_first, label_repeat = stems(labels.select("split", "key", "path"))
    used = images.join(image_first, ["split", "key"]).filter("path = first_path").drop("first_path")
    label_keys = label_first.withColumnRenamed("first_path", "label_path")
    per_file = lines.groupBy("split", F.col("path").alias("label_path")).agg(
        F.count_if(F.col("code").isNull()).alias("box_count"), F.count_if(F.col("code").isNotNull()).alias("bad_lines"))
    bad_text = unreadable.select("split", F.col("path").alias("label_path"), F.lit(True).alias("unreadable"))
    files = (
        used.join(label_keys, ["split", "key"], "left").join(per_file, ["split", "label_path"], "left").join(bad_text, ["split", "label_path"], "left")
        .withColumn("label_status", F.when(F.col("label_path").isNull(), "missing").when(F.col("unreadable") | (F.col("bad_lines") > 0), "invalid")
                    .when(F.col("box_count").isNull(), "empty").otherwise("valid"))
        .select("split", "key", "path", "sha", "label_path", "label_status", F.coalesce("box_count", F.lit(0)).alias("box_count"))
    )
    twins = duplicate_images(used)
    expected = images.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    absent = lambda df, code: expected.join(df.select("split").distinct(), "split", "left_anti").select("split", F.lit(None).cast("string").alias("path"), F.lit(code).alias("code"))
    issues = union_all([
        tag(lines.filter("code is not null"), F.col("code")), tag(unreadable, "unreadable_label"),
        tag(image_repeat, "duplicate_stem"), tag(label_repeat, "duplicate_stem"),
        tag(label_keys.join(image_first, ["split", "key"], "left_anti"), "orphan_label", "label_path"),
        tag(files.filter("label_status = 'missing'"), "missing_label"),
        tag(twins, F.col("code"), "first_path"),
        absent(images, "missing_images_directory"), absent(labels, "missing_labels_directory"),
    ])
    return LayoutAudit(files, lines, issues.withColumn("severity", severity(F.col("code"))))


def duplicate_images(images: DataFrame) -> DataFrame:
    """Digests shared by several images; an error when they cross splits."""
    groups = images.groupBy("sha").agg(F.count("*").alias("copies"), F.count_distinct("split").alias("splits"), F.min("split").alias("split"), F.min("path").alias("first_path"))
    return groups.filter("copies > 1").withColumn("code", F.when(F.col("splits") > 1, "cross_split_duplicate").otherwise("duplicate_image"))


def yolo_layout_summary(audit: LayoutAudit, class_count: int) -> DataFrame:
    """Per split: images, boxes by class, label states, groups of equal images by their first split; the overall verdict on every row."""
    passed = audit.issues.agg((F.count_if(F.col("severity") == "error") == 0).alias("passed"))
    files = audit.files.groupBy("split").agg(
        F.count("*").alias("images"), F.sum("box_count").alias("boxes"),
        *[F.count_if(F.col("label_status") == s).alias(f"{s}_labels") for s in ("valid", "invalid", "empty", "missing")])
    boxes = audit.lines.filter("code is null").join(audit.files.select("split", F.col("label_path").alias("path")), ["split", "path"])
    classes = boxes.groupBy("split").agg(*[F.count_if(F.col("class_id") == c).alias(f"class_{c}_boxes") for c in range(class_count)])
    groups = audit.issues.groupBy("split").agg(
        F.count_if(F.col("code") == "duplicate_image").alias("duplicate_groups"), F.count_if(F.col("code") == "cross_split_duplicate").alias("cross_split_groups"))
    counts = [c for c in (*classes.columns, *groups.columns) if c != "split"]
    return files.join(classes, "split", "left").join(groups, "split", "left").fillna(0, counts).crossJoin(F.broadcast(passed))


def manifest_fingerprint(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Order-defined digest of a file table: row digests, bucket digests, one digest.

    Two tree levels bound every ordered list: a bucket's list is itself the
    digest of its sub-buckets, so no group holds more than its share of rows.
    """
    leaf = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    k = F.sha2(F.col(key).cast("string"), 256)
    step = rows.select(leaf.alias("h"), F.substring(k, 1, 2).alias("b1"), F.substring(k, 3, 2).alias("b2"), F.substring(k, 5, 2).alias("b3"))
    merged = lambda: F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h")
    step = step.groupBy("b1", "b2", "b3").agg(merged(), F.count("*").alias("n"))
    step = step.groupBy("b1", "b2").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b3", "h"))), lambda x: x["h"]), ""), 256).alias("h"), F.sum("n").alias("n"))
    step = step.groupBy("b1").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b2", "h"))), lambda x: x["h"]), ""), 256).alias("h"), F.sum("n").alias("n"))
    return step.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b1", "h"))), lambda x: x["h"]), ""), 256).alias("fingerprint"), F.sum("n").alias("rows"))


def availability_summary(expected: DataFrame, sources: DataFrame, outputs: DataFrame, width: int, height: int, enabled: bool = True) -> DataFrame:
    """Expected files against inventory; ``outputs``/``sources`` carry file_key, width, height."""
    src = sources.select("file_key", F.col("width").alias("w"), F.col("height").alias("h"), F.lit(True).alias("has_source"))
    out = outputs.select("file_key", F.lit(True).alias("has_output"))
    j = expected.join(out, "file_key", "left").join(src, "file_key", "left").withColumns({
        "existing": F.col("has_output").isNotNull(), "available": F.col("has_output").isNull() & F.col("has_source").isNotNull(),
    })
    fits = (F.col("w") == width) & (F.col("h") == height)
    s = j.agg(
        F.count("*").alias("selected"), F.count_if("existing").alias("existing"), F.count_if("available").alias("available"),
        F.count_if(~F.col("existing") & ~F.col("available")).alias("missing"), F.count_if(F.col("available") & ~fits & F.lit(enabled)).alias("dimension_errors"),
    )
    converted = F.when(F.lit(enabled), F.col("available") - F.col("dimension_errors")).otherwise(F.lit(0))
    ready = F.col("converted") + F.col("existing")
    return s.withColumn("converted", converted).withColumn(
        "mode", F.when(F.lit(not enabled) | ((F.col("available") == 0) & (ready == 0)), "metadata_only")
        .when((ready == F.col("selected")) & (F.col("dimension_errors") == 0), "converted").otherwise("partial"))


def verify_digests(inventory: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared inputs whose digest or size differs, or that are missing."""
    j = declared.join(inventory.select("path", F.col("sha").alias("actual_sha"), F.col("size").alias("actual_size")), "path", "left")
    problem = F.when(F.col("actual_sha").isNull(), "missing").when(F.col("sha") != F.col("actual_sha"), "digest_mismatch").when(F.col("size") != F.col("actual_size"), "size_mismatch")
    return j.withColumn("problem", problem).filter("problem is not null").select("path", "problem")


def field_rules(rows: DataFrame, key: list[str], integers: list[str], floats: list[str], probabilities: list[str], optional: tuple[str, ...] = (),
                booleans: tuple[str, ...] = (), positive: tuple[str, ...] = ()) -> Column:
    """Array of (field, rule) that a row of a flat result table breaks; see ``strict_table_rows``."""
    fields = dict(rows.dtypes)
    named = {*integers, *floats, *booleans}
    problems = [f"missing field {c}" for c in sorted(named - set(fields))] + [f"unknown field {c}" for c in sorted(set(fields) - named - set(key))]
    problems += [f"{c} must be boolean" for c in booleans if fields.get(c, "boolean") != "boolean"]
    problems += [f"{c} must be a number" for c in (*integers, *floats) if fields.get(c) == "boolean"]
    problems += [f"{c} must be an integer" for c in integers if fields.get(c) in ("float", "double", "string")]
    if problems:
        raise ValueError("; ".join(problems))
    rules = []
    def add(field: str, name: str, cond: Column) -> None:
        rules.append(F.when(cond, F.struct(F.lit(field).alias("field"), F.lit(name).alias("rule"))))
    for c in [*integers, *floats]:
        if c not in optional:
            add(c, "missing", F.col(c).isNull())
        add(c, "negative", F.col(c) < 0)
    for c in booleans:
        add(c, "missing", F.col(c).isNull())
    for c in positive:
        add(c, "not_positive", F.col(c) == 0)
    for c in floats:
        add(c, "nonfinite", F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf"))))
    for c in probabilities:
        add(c, "above_one", (F.col(c) > 1) & ~F.isnan(c))
    return F.array_compact(F.array(*rules))


def strict_table_rows(rows: DataFrame, key: list[str], integers: list[str], floats: list[str], probabilities: list[str], optional: tuple[str, ...] = (),
                      booleans: tuple[str, ...] = (), positive: tuple[str, ...] = ()) -> DataFrame:
    """Field rules of a flat result table, one row per (key, field, rule).

    The table must hold the key and the named fields and no other; numbers must not be of
    type boolean, and boolean fields of no other type.
    """
    broken = field_rules(rows, key, integers, floats, probabilities, optional, booleans, positive)
    return rows.select(*key, F.explode(broken).alias("v")).select(*key, "v.field", "v.rule")


def validate_records(boxes: DataFrame, key: list[str], scored: bool = True) -> DataFrame:
    """Box, label and score rules against the image size; one row per violation."""
    x1, y1, x2, y2 = (F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    rules = {
        "empty_image_id": strip(F.col("image_id").cast("string")) == "",
        "nonpositive_image_size": (F.col("width") <= 0) | (F.col("height") <= 0),
        "nonfinite_box": ~(finite(x1) & finite(y1) & finite(x2) & finite(y2)),
        "empty_box": (x2 <= x1) | (y2 <= y1),
        "outside_image": (x1 < 0) | (y1 < 0) | (x2 > F.col("width")) | (y2 > F.col("height")),
        "invalid_label": F.col("label") < 0,
    }
    if scored:
        rules["invalid_score"] = ~(finite(F.col("score")) & F.col("score").between(0, 1))
    hit = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]))
    return boxes.withColumn("_v", hit).select(*key, F.explode("_v").alias("rule"))


def check_identity_sets(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """Images on one side only, repeated, or with differing size."""
    p = predicted.groupBy("image_id").agg(F.count("*").alias("pn"), F.max("width").alias("pw"), F.max("height").alias("ph"))
    t = expected.groupBy("image_id").agg(F.count("*").alias("tn"), F.max("width").alias("tw"), F.max("height").alias("th"))
    j = p.join(t, "image_id", "full_outer")
    problem = (
        F.when(F.col("pn").isNull(), "no_prediction_record").when(F.col("tn").isNull(), "no_target_record")
        .when((F.col("pn") > 1) | (F.col("tn") > 1), "duplicate_image").when((F.col("pw") != F.col("tw")) | (F.col("ph") != F.col("th")), "size_differs")
    )
    return j.select("image_id", problem.alias("problem")).filter("problem is not null")
