"""Plans that must not exchange or broadcast their rows, and small steps that were wrong."""

import random
import re

from pyspark.sql import functions as F

from boxlens import session
from boxlens.functions.grids import RECALL_POINTS
from boxlens.functions.ratios import decimal_mean
from boxlens.functions.text import scaled_round
from boxlens.operators import ap, assignment, coco, matching, metrics, runlog, stats
from boxlens.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def exchanges(spark, df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_boxes_partitioned_by_image_are_exchanged_once(spark):
    """Ranks, matches, statuses and evidence per image follow from one exchange of the raw boxes."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        p, t, runs = fx.det_predictions(spark, SF), fx.det_targets(spark, SF), fx.runs(spark)
        for df in (matching.coco_match(p, t), matching.greedy_match(p, t), matching.detection_status(p, t, runs),
                   metrics.image_evidence(metrics.operating_evidence(p, t, runs, images=fx.det_images(spark, SF)))):
            found = exchanges(spark, df)
            assert found and all("REPARTITION_BY_COL" in line for line in found), found
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_matches_agree_with_rounds_when_pairs_compete(spark):
    p, t = fx.dense(fx.det_predictions(spark, SF), "pidx", 200), fx.dense(fx.det_targets(spark, SF), "tidx", 200)
    ranked = matching.rank_detections(p, max_detections=60)
    one_pass = matching.with_matches(ranked, t, iou_threshold=0.3, max_detections=60).select("d", "s", "image_id", "pidx", "tidx")
    rounds = matching.with_matches(ranked, t, iou_threshold=0.3, max_detections=None).select("d", "s", "image_id", "pidx", "tidx")
    assert one_pass.count() == ranked.count()
    assert one_pass.exceptAll(rounds).isEmpty() and rounds.exceptAll(one_pass).isEmpty()


def test_halves_round_as_doubles(spark):
    row = spark.range(1).select(scaled_round(F.lit(0.041874999999999996), 5), scaled_round(F.lit(-2.5), 0), scaled_round(F.lit(None).cast("double"), 3)).first()
    assert tuple(row) == (0.04188, -3.0, None)


def epoch_records(spark, *changes):
    base = {"run_id": "a", "is_best": True} | dict.fromkeys(runlog.EPOCH_INTEGERS, 1) | dict.fromkeys(runlog.EPOCH_FLOATS, 0.5)
    schema = f"{runlog.EPOCH_SCHEMA}, arrival bigint"
    rows = [base | change | {"arrival": i} for i, change in enumerate(changes)]
    return spark.createDataFrame([tuple(r[f.split()[0]] for f in schema.split(", ")) for r in rows], schema)


def test_fates_of_epoch_records_come_from_written_records(spark):
    """Rules are evaluated once, not inlined into every branch, and first records are not broadcast."""
    rows = epoch_records(spark, {"epoch": 1}, {"epoch": 1}, {"epoch": 2})
    out = runlog.classify_epoch_records(runlog.ruled_records(rows))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "StructsToJson" not in plan and not re.search(r"BroadcastHashJoin \[run_id#\d+, epoch#", plan)
    assert [r.fate for r in out.orderBy("arrival").collect()] == ["accepted", "ignored", "accepted"]


def test_fields_on_another_scale_may_exceed_one(spark):
    rows = epoch_records(spark, {"val_map_50": 1.1}, {"val_map_50": -1.0}, {"val_f1": 1.1})
    problems = lambda *given: [r.problems for r in runlog.ruled_records(rows, *given).orderBy("arrival").collect()]
    assert problems() == ["val_map_50:above_one", "val_map_50:negative", "val_f1:above_one"]
    assert problems(("val_map_50",)) == ["", "val_map_50:negative", "val_f1:above_one"]


def test_sound_records_stay_sound_at_any_size(spark):
    """Later events must not run into a rule that the SQL doesn't name."""
    from boxlens.plans import runlogs

    rows = spark.createDataFrame([(3_000_001, 5, 77.0), (5_300_000, 5, 77.0)], "event_id bigint, user_id bigint, value double")
    got = runlog.ruled_records(rows.selectExpr(*runlogs.arrival_columns(bounded=True), "event_id as arrival"), runlogs.SCALED).orderBy("arrival").collect()
    assert [r.problems for r in got] == ["", "val_f1:above_one"]


def test_large_tables_are_dealt_to_a_counted_number_of_tasks(spark, monkeypatch):
    """Without a number, small exchanges are merged by bytes and every task sorts the predictions of all runs of its boxes."""
    rows = spark.range(100)
    assert session.key_partitions(rows) is None and session.key_partitions(rows, 1) == 100
    assert session.by_key(rows, "id", 13).rdd.getNumPartitions() == 13
    monkeypatch.setattr(fx, "key_partitions", lambda df: session.key_partitions(df, 100))
    n = fx.image_partitions(spark, SF)
    assert n == -(-fx.table(spark, SF, "lineitem").count() // 100)
    p, t, runs = fx.det_predictions(spark, SF), fx.det_targets(spark, SF), fx.runs(spark)
    evidence = metrics.operating_evidence(p, t, runs, images=fx.det_images(spark, SF), image_partitions=n)
    found = exchanges(spark, metrics.image_evidence(evidence))
    assert found and all(f", {n})" in line and "REPARTITION_BY_NUM" in line for line in found if "image" in line or "orderkey" in line), found


def test_counted_slices_give_the_precision_of_range_blocks(spark):
    """Several runs in a block and a run over several blocks and batches, with and without weights."""
    p, t = fx.dense(fx.det_predictions(spark, SF), "pidx"), fx.dense(fx.det_targets(spark, SF), "tidx")
    dets = session.materialize(matching.coco_match(p, t).withColumn("w", F.col("image_id") % 3), "dets").filter("w > 0")
    keys, batch = ["d", "s"], "spark.sql.execution.arrow.maxRecordsPerBatch"
    totals, before = ap.target_totals(t, fx.runs(spark)), spark.conf.get(batch)
    spark.conf.set(batch, "50")
    try:
        for weight, blocks in ((None, 2), (F.col("w"), 13)):
            counted = ap.counted_detections(dets, keys, weight, num_blocks=blocks)
            assert counted.count() < dets.count() / 2
            got = ap.interpolated_precision(counted, totals, keys)
            want = ap.interpolated_precision(ap.detection_blocks(dets, keys, blocks), totals, keys, weight)
            assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.set(batch, before)


def test_recall_sampling_sorts_no_rows(spark):
    p, t, keys = fx.det_predictions(spark, SF), fx.det_targets(spark, SF), ["d", "s"]
    dets = session.materialize(matching.coco_match(p, t), "dets")
    pr = session.materialize(ap.precision_recall(ap.detection_blocks(dets, keys), ap.target_totals(t, fx.runs(spark)), keys), "pr")
    out = ap.recall_sampling(pr, keys)
    assert out._jdf.queryExecution().executedPlan().toString().count("Window ") <= 2
    rows, want = pr.collect(), set()
    for d, s in {(r.d, r.s) for r in rows}:
        own = [r for r in rows if (r.d, r.s) == (d, s)]
        for i, point in enumerate(RECALL_POINTS):
            if reached := [r for r in own if r.recall >= point]:
                want.add((d, s, i, min(r.cum_tp + r.cum_fp for r in reached), max(r.precision for r in reached)))
    assert {tuple(r) for r in out.collect()} == want


def test_curves_of_slices_agree_with_range_blocks(spark):
    """No detection is put in order a second time, and slices that end inside a run pass on their best."""
    p, t = fx.dense(fx.det_predictions(spark, SF), "pidx"), fx.dense(fx.det_targets(spark, SF), "tidx")
    dets, keys, batch = session.materialize(matching.coco_match(p, t), "dets"), ["d", "s"], "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "50")
    try:
        curve = ap.detection_curve(dets, keys, num_blocks=5)
        assert "Window" not in curve._jdf.queryExecution().executedPlan().toString()
        pr = ap.precision_recall(ap.detection_blocks(dets, keys, 3), ap.target_totals(t, fx.runs(spark)), keys)
        want = ap.precision_envelope(pr, keys).select(curve.columns)
        assert sorted(map(tuple, curve.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.set(batch, before)


def test_means_on_a_half_do_not_depend_on_the_order(spark):
    """Sixteen discounts with a mean of 0.051875, in many orders."""
    values = [0.01, 0.09, 0.1, 0.03, 0.07, 0.0, 0.06, 0.04, 0.1, 0.02, 0.08, 0.05, 0.03, 0.07, 0.06, 0.02]
    orders = [random.Random(k).sample(values, 16) for k in range(40)]
    rows = [(k, v) for k, order in enumerate(orders) for v in order]
    found = spark.createDataFrame(rows, "k int, v double").coalesce(1).groupBy("k").agg(
        scaled_round(decimal_mean(F.col("v")), 5).alias("m"), scaled_round(F.avg("v"), 5).alias("plain")).collect()
    assert {r.m for r in found} == {0.05188} and len({r.plain for r in found}) == 2
    assert spark.createDataFrame([(None,)], "v double").agg(decimal_mean(F.col("v"))).first()[0] is None


def test_repeated_coco_images_have_their_smallest_size_in_any_order(spark):
    bbox = F.array(*[F.lit(v) for v in (1.0, 1.0, 4.0, 4.0)])
    annotations = spark.range(1).select("id", F.lit(1).alias("image_id"), F.lit(1).alias("category_id"), bbox.alias("bbox"), F.lit(16.0).alias("area"), F.lit(0).alias("iscrowd"))
    categories = spark.createDataFrame([(1, "a")], "id int, name string")
    for sizes in ((3, 9), (9, 3)):
        images = spark.createDataFrame([(1, f"{w}.png", w, 9) for w in sizes], "id int, file_name string, width int, height int").coalesce(1)
        rules = {r.rule for r in coco.validate_coco(images, annotations, categories).collect() if r.entity == "annotation"}
        assert rules == {"bbox_outside_image"}, sizes


def test_images_matched_in_numpy_agree_with_arrays(spark, monkeypatch):
    """Any batches, any spread of the rows, caps that cut, competing pairs; images held over several batches."""
    monkeypatch.setattr(assignment, "HELD", 40)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    cols = ["d", "s", "image_id", "pidx", "label", "score", "rank"]
    try:
        for size, cap, by in (("10000", 100, ()), ("37", 60, ()), ("37", 7, ("label",))):
            spark.conf.set(name, size)
            p, t = fx.dense(fx.det_predictions(spark, SF), "pidx", 100), fx.dense(fx.det_targets(spark, SF), "tidx", 100)
            ranked = matching.rank_detections(p, max_detections=cap, by=by).withColumn("own", F.col("label"))
            run = ("d", "s", *["own" for _ in by])
            found = assignment.match_images(p.repartition(5), t.repartition(3), max_detections=cap, by=by)
            for want, more in ((matching.level_matches(ranked, t, run, cap), ["level_mask"]), (matching.with_matches(ranked, t, run, 0.5, cap), ["tidx", "iou"])):
                a, b = want.select(*cols, *more), found.select(*cols, *more)
                assert a.count() == b.count() and a.exceptAll(b).isEmpty(), (size, cap, by, more)
    finally:
        spark.conf.set(name, "10000")


def test_group_evidence_of_images_agrees_with_rows(spark):
    """Groups of a repeated, a missing and a nameless image, and images without predictions or targets."""
    p, t, runs = fx.det_predictions(spark, SF).filter("image_id % 7 > 0 or d = 1"), fx.det_targets(spark, SF), fx.runs(spark)
    g = F.when(F.col("image_id") % 11 > 0, F.col("patient_group")).alias("patient_group")
    images = fx.det_images(spark, SF).filter("image_id % 13 > 0").select("image_id", g)
    groups = images.unionByName(images.filter("image_id % 5 = 0").withColumn("patient_group", F.lit(-1).cast("bigint")))
    keys = ["d", "s", "patient_group"]
    want = stats.group_evidence(metrics.image_evidence(metrics.operating_evidence(p, t, runs)), groups, ["d", "s"])
    got = stats.matched_group_evidence(p, t, runs, groups)
    rounded = [*keys, "target_count", "tp", "fp", "fn", F.round("iou_sum", 9), F.round("dice_sum", 9)]
    a, b = want.select(*rounded), got.select(*rounded)
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()
    sums = lambda df: df.groupBy("d", "s", "label").agg(*[F.round(F.sum(c), 6).alias(c) for c in ("preds", "targets", "tp", "iou_sum", "dice_sum")])
    a, b = sums(metrics.operating_evidence(p, t, runs)), sums(metrics.summed_evidence(p, t, runs))
    assert a.count() == 12 == b.count() and a.exceptAll(b).isEmpty()
