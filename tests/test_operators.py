"""Hand-computed values, brute-force checks and invariants on small fixtures."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxlens.functions.grids import IOU_LEVELS, RECALL_POINTS, points_reached
from boxlens.functions.text import general_6g
from boxlens.operators import ap, blocks, comparison, matching, sampling, stats, sweep

PRED = "d int, s int, image_id bigint, pidx bigint, label bigint, score double, x1 double, y1 double, x2 double, y2 double"
TGT = "image_id bigint, tidx bigint, label bigint, x1 double, y1 double, x2 double, y2 double"


def iou(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def brute_force(preds, tgts, threshold, cap, floor=0.0):
    """Plain greedy matcher over one run; the independent check of both Spark paths."""
    out = set()
    for img in {p[2] for p in preds}:
        mine = sorted((p for p in preds if p[2] == img and p[5] >= floor), key=lambda p: (-p[5], p[3]))[:cap]
        free = sorted((t for t in tgts if t[0] == img), key=lambda t: t[1])
        for p in mine:
            best = max((t for t in free if t[2] == p[4]), key=lambda t: (iou(p[6:], t[3:]), -t[1]), default=None)
            if best is not None and iou(p[6:], best[3:]) >= threshold:
                free.remove(best)
                out.add((img, p[3], best[1]))
    return out


def crowd(seed, images=3, n=25):
    """Crowded images with equal scores and several copies of the same box."""
    r = random.Random(seed)
    boxes = lambda: [float(v) for v in (lambda x, y: (x, y, x + r.choice([30, 40]), y + r.choice([30, 40])))(r.randrange(230, 290, 5), r.randrange(230, 290, 5))]
    preds = [(0, 1, i, k, r.randint(1, 2), r.choice([0.2, 0.5, 0.5, 0.9, r.random()]), *boxes()) for i in range(images) for k in range(n)]
    tgts = [(i, k, r.randint(1, 2), *boxes()) for i in range(images) for k in range(n)]
    return preds, tgts


@pytest.fixture(scope="module")
def crowded(spark):
    preds, tgts = crowd(5)
    return preds, tgts, spark.createDataFrame(preds, PRED), spark.createDataFrame(tgts, TGT)


@pytest.mark.parametrize("cap", [3, 100])
def test_fold_equals_brute_force(crowded, cap):
    preds, tgts, p, t = crowded
    got = {(r.image_id, r.pidx, r.tidx) for r in matching.greedy_match(p, t, iou_threshold=0.3, max_detections=cap).collect()}
    assert got == brute_force(preds, tgts, 0.3, cap)


def test_rounds_equal_brute_force_without_cap(crowded):
    preds, tgts, p, t = crowded
    got = {(r.image_id, r.pidx, r.tidx) for r in matching.greedy_match(p, t, iou_threshold=0.3, max_detections=None).collect()}
    assert got == brute_force(preds, tgts, 0.3, None)


def test_level_masks_equal_ten_matches(crowded):
    preds, tgts, p, t = crowded
    rows = matching.coco_match(p, t, max_detections=20).collect()
    for level, threshold in enumerate(IOU_LEVELS):
        expected = {(a, b) for a, b, _ in brute_force(preds, tgts, threshold, 20, 0.001)}
        assert {(r.image_id, r.pidx) for r in rows if r.level_mask >> level & 1} == expected


def test_prefix_property_of_sweep(spark, crowded):
    preds, tgts, p, t = crowded
    runs = spark.createDataFrame([(0, 1)], "d int, s int")
    grid = [0.1, 0.5, 0.9]
    rows = {r.threshold: r.tp for r in sweep.threshold_sweep(p, t, runs, grid, iou_threshold=0.3, max_detections=10).collect()}
    assert rows == {x: len(brute_force(preds, tgts, 0.3, 10, x)) for x in grid}


def test_iou_one_seventh(spark):
    p = spark.createDataFrame([(0, 1, 1, 0, 1, 0.9, 0.0, 0.0, 2.0, 2.0)], PRED)
    t = spark.createDataFrame([(1, 0, 1, 1.0, 1.0, 3.0, 3.0)], TGT)
    assert matching.pairwise_iou(p, t).first().iou == pytest.approx(1 / 7)


def test_pinned_grids():
    assert IOU_LEVELS == list(np.linspace(0.5, 0.95, 10))
    assert RECALL_POINTS == list(np.linspace(0, 1, 101))


def test_points_reached(spark):
    values = [0.0, 0.35, 0.35000000000000003, 0.57, 0.7977, 0.995, 1.0, *[k / 37 for k in range(38)]]
    df = spark.createDataFrame([(v,) for v in values], "r double")
    got = [r[0] for r in df.select(points_reached(F.col("r"))).collect()]
    assert got == [max(i for i, p in enumerate(RECALL_POINTS) if p <= v) for v in values]


def reference_ap(hits, weights, targets):
    k, n, prec, rec = 0, 0, [], []
    for h, w in zip(hits, weights):
        k, n = k + h * w, n + w
        prec.append(k / n)
        rec.append(k / targets)
    return sum(max((p for p, r in zip(prec, rec) if r >= point), default=0.0) for point in RECALL_POINTS) / 101


def test_average_precision_with_weights_and_ties(spark):
    r = random.Random(3)
    rows = [(0, 1, i // 4, i % 4 + 1, r.choice([0.1, 0.5, 0.5, 0.5, r.random()]), r.randint(0, 1), r.randint(1, 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "d int, s int, image_id bigint, rank int, score double, level_mask int, w int")
    totals = spark.createDataFrame([(0, 1, 400)], "d int, s int, target_count bigint")
    got = ap.average_precision(ap.detection_blocks(df, ["d", "s"], 7), totals, ["d", "s"], F.col("w")).filter("level = 0").first().ap
    ordered = sorted(rows, key=lambda x: (-x[4], x[2], x[3]))
    assert got == pytest.approx(reference_ap([x[5] for x in ordered], [x[6] for x in ordered], 400), abs=1e-12)


def test_ap_edge_cases(spark):
    df = spark.createDataFrame([], "d int, s int, image_id bigint, rank int, score double, level_mask int")
    totals = spark.createDataFrame([(0, 1, 5), (0, 2, 0)], "d int, s int, target_count bigint")
    rows = {r.s: r.ap for r in ap.average_precision(ap.detection_blocks(df, ["d", "s"]), totals, ["d", "s"]).filter("level = 0").collect()}
    assert rows == {1: 0.0, 2: None}


def test_largest_remainder_golden(spark):
    df = spark.createDataFrame([("a", 169), ("b", 331), ("c", 250)], "stratum string, n bigint")
    assert {r.stratum: r.allocated for r in sampling.largest_remainder(df, 300).collect()} == {"a": 68, "b": 132, "c": 100}


def test_exact_counts_golden(spark):
    assert sampling.exact_counts(spark, 5000, {"train": 0.7, "validation": 0.15, "test": 0.15}) == {"train": 3500, "validation": 750, "test": 750}
    assert sampling.exact_counts(spark, 2, {"b": 1 / 3, "a": 1 / 3, "c": 1 / 3}) == {"b": 1, "a": 1, "c": 0}


def test_choose_counts_is_exact():
    import itertools
    import random

    assert sampling.choose_counts({("s", 60000): 2, ("s", 50000): 4}, 200000) == ({("s", 60000): 0, ("s", 50000): 4}, 0)
    assert sampling.choose_counts({("s", 5): 2, ("s", 4): 2, ("s", 2): 1}, 10)[1] == 0
    assert sampling.choose_counts({("s", 4): 3}, 10)[1] == 2
    rng = random.Random(0)
    for _ in range(300):
        cells = {(rng.choice("ab"), rng.randrange(1, 9)): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        total = sum(z * n for (_, z), n in cells.items())
        target = rng.randrange(total + 1)
        take, short = sampling.choose_counts(cells, target)
        sums = {sum(z * k for (_, z), k in zip(cells, pick)) for pick in itertools.product(*(range(n + 1) for n in cells.values()))}
        assert all(0 <= take[c] <= n for c, n in cells.items())
        assert sum(z * k for (_, z), k in take.items()) == target - short == max(x for x in sums if x <= target)
    # a large table: shares stay close to the mix
    cells = {(s, z): 1000 * (1 + i) for i, s in enumerate("abc") for z in range(1, 25)}
    total = sum(z * n for (_, z), n in cells.items())
    take, short = sampling.choose_counts(cells, total // 3)
    share = {s: sum(z * n for (x, z), n in take.items() if x == s) / sum(z * n for (x, z), n in cells.items() if x == s) for s in "abc"}
    assert short == 0 and all(abs(v - 1 / 3) < 0.001 for v in share.values())


def test_group_split_exchanges_groups(spark):
    rows = [(f"g{i}", f"{i}-{j}", "a", True, 1) for i, n in enumerate([5, 5, 4, 4, 2]) for j in range(n)]
    images = spark.createDataFrame(rows, "patient_group string, image_id string, stratum string, is_positive boolean, box_count int")
    out = sampling.group_split(images, ["a"], {"x": 0.5, "y": 0.5}, 3)
    assert {r["split"]: r["n"] for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"x": 10, "y": 10}


def test_split_with_one_huge_group(spark):
    rows = [(i, 0 if i < 300 else i, "a" if i % 2 else "b") for i in range(900)]
    images = spark.createDataFrame(rows, "image_id bigint, patient_group bigint, stratum string")
    out = sampling.group_split(images, ["a", "b"], {"train": 0.6, "validation": 0.2, "test": 0.2}, 1)
    assert {r["split"]: r["n"] for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 540, "validation": 180, "test": 180}
    assert out.select("patient_group", "split").distinct().count() == out.select("patient_group").distinct().count()


def test_holm_hand_computed(spark):
    df = spark.createDataFrame([("m", 0.01), ("m", 0.04), ("m", 0.03), ("m", None)], "family string, p_raw double")
    rows = sorted((r.p_raw, r.p_holm) for r in stats.holm_adjust(df, ["family"]).collect() if r.p_raw is not None)
    assert [round(x[1], 12) for x in rows] == [0.03, 0.06, 0.06]


def test_general_format(spark):
    values = [0.2, 28109.05, 1234567.0, 0.00001234, 0.0, 0.67493]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(general_6g("v")).collect()] == [f"{v:.6g}" for v in values]


def test_dense_ids_and_percentiles(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"), F.lit(1).alias("k"))
    ids = blocks.dense_ids(df, ["v"], num_blocks=5).collect()
    assert all(r.id == r.v + 1 for r in ids)
    skewed = df.withColumn("x", F.when(F.col("v") < 400, 5.0).otherwise(F.col("v").cast("double")))
    got = blocks.exact_percentiles(skewed, ["k"], "x", {"a": 0.5, "b": 0.95}).first()
    values = [r.x for r in skewed.collect()]
    assert got.a == pytest.approx(np.percentile(values, 50)) and got.b == pytest.approx(np.percentile(values, 95))


def test_dominance_needs_every_seed(spark):
    cols = "d int, s int, map_50_95 double, recall double, throughput_fps double, mean_latency_ms double, total_parameters bigint, estimated_gflops double"
    rows = [(0, 1, 0.5, 0.5, 10.0, 50.0, 9, 9.0), (0, 2, 0.6, 0.5, 11.0, 51.0, 9, 9.0), (1, 1, 0.4, 0.6, 9.0, 20.0, 3, 3.0), (1, 2, 0.3, 0.4, 8.0, 20.0, 3, 3.0)]
    got = {r.panel: r.dominant for r in comparison.strict_dominance(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"a": 0, "b": None, "c": None, "d": None}


def slow_patience(metrics, patience, min_delta, min_epochs):
    """From the whole history at every epoch."""
    out = []
    for i in range(len(metrics)):
        seen = metrics[: i + 1]
        moves = [0]
        for j, m in enumerate(seen):
            if m > seen[moves[-1]] + min_delta:
                moves.append(j)
        wait = i - moves[-1]
        out.append((seen.index(max(seen)) == i, moves[-1] == i, wait, i + 1 >= min_epochs and wait >= patience, seen.index(max(seen)) + 1))
    return out


def test_early_stopping_matches_the_history(spark):
    import random

    import numpy as np
    from boxlens.operators.runlog import early_stopping
    from boxlens.streaming.logs import patience_states

    rng = random.Random(8)
    runs = {r: [round(rng.random(), 1 + r % 2) for _ in range(rng.randrange(1, 40))] for r in range(25)}
    rows = [(r, e + 1, m) for r, ms in runs.items() for e, m in enumerate(ms)]
    got = early_stopping(spark.createDataFrame(rows, "run_id bigint, epoch int, metric double"), 3, 0.05, 2).orderBy("run_id", "epoch").collect()
    want = [(r, e + 1, *row) for r, ms in runs.items() for e, row in enumerate(slow_patience(ms, 3, 0.05, 2))]
    assert [(g.run_id, g.epoch, g.is_new_best, g.is_significant, g.epochs_without_improvement, g.should_stop, g.best_epoch) for g in got] == want
    for r, ms in runs.items():
        cut, carry, parts = rng.randrange(len(ms) + 1), None, []
        for lo, hi in ((0, cut), (cut, len(ms))):
            if hi > lo:
                columns, carry = patience_states(np.arange(lo + 1, hi + 1), np.array(ms[lo:hi]), carry, 3, 0.05, 2)
                parts += list(zip(*(c.tolist() for c in columns)))
        assert parts == slow_patience(ms, 3, 0.05, 2)


def test_corruptions_of_large_images_match_pixel_loops(spark):
    """A 512 x 512 image at drawn pixels, a thin one at all; every condition, one null image."""
    import hashlib
    import math
    import random

    import numpy as np
    from boxlens.operators import images

    rng = random.Random(5)
    sizes = {"large": (512, 512), "thin": (1, 9), "none": (2, 2)}
    pixels = {k: [rng.randrange(256) for _ in range(h * w)] for k, (h, w) in sizes.items()}
    rows = [(k, h, w, None if k == "none" else pixels[k]) for k, (h, w) in sizes.items()]
    got = images.corruption_fanout(spark.createDataFrame(rows, "image_id string, h int, w int, v array<int>"), 17).collect()
    assert len(got) == 3 * 30 and all((r.v is None) == (r.image_id == "none") for r in got)
    level = {f"{n}_s{i}": (kind, x) for n, _, kind, _, values in images.CORRUPTIONS for i, x in enumerate(values, 1)}

    def u(*parts):
        return (int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) + 0.5) / 2**32

    def mirror(i, n):
        while n > 1 and not 0 <= i < n:
            i = -i if i < 0 else 2 * (n - 1) - i
        return i if n > 1 else 0

    for r in got:
        if r.v is None:
            continue
        h, w = sizes[r.image_id]
        kind, x = level[r.condition]
        seed, at = f"17:{r.image_id}:{r.condition}", lambda a, b: pixels[r.image_id][mirror(b, h) * w + mirror(a, w)]  # noqa: B023, E731
        kernel = images.gaussian_kernel(x) if kind == "gaussian_blur" else []
        half, angle = len(kernel) // 2, 2 * math.pi * u(seed, "angle")
        for i in range(h * w) if h * w < 100 else rng.sample(range(h * w), 25):
            a, b, v = i % w, i // w, pixels[r.image_id][i]
            want = {
                "brightness": lambda: v * x, "salt_pepper": lambda: 255 if u(seed, i, "sp") < x / 2 else 0 if u(seed, i, "sp") < x else v,
                "gaussian_noise": lambda: v + math.sqrt(-2 * math.log(u(seed, i, "a"))) * math.cos(2 * math.pi * u(seed, i, "b")) * x * 255,
                "gaussian_blur": lambda: sum(p * q * at(a + m - half, b + n - half) for m, p in enumerate(kernel) for n, q in enumerate(kernel)),
                "motion_blur": lambda: sum(at(a + round(t * math.cos(angle)), b + round(t * math.sin(angle))) for t in range(-int(x // 2), int(x // 2) + 1)) / int(x),
            }[kind]()
            assert abs(r.v[i] - np.clip(want, 0, 255)) <= 0.5 + 1e-6, (r.condition, i)


def test_early_stopping_of_long_rising_runs(spark):
    """Runs that rise over many blocks: chains of moves cross blocks, leap over blocks, or take every row."""
    import random

    from boxlens.operators.runlog import early_stopping

    rng = random.Random(9)
    for delta in (0.35, 90.0, -1.0):
        runs = {
            1: [e / 10 for e in range(6000)], 2: [e * 0.5 + rng.random() for e in range(3000)], 3: [1.0], 4: [-float(e) for e in range(50)],
            5: [float(e // 700) for e in range(3000)], 6: [None, None, 0.25, 0.25, 7.0], 7: [None]}
        rows = [(r, e + 1, m) for r, ms in runs.items() for e, m in enumerate(ms)]
        got = early_stopping(spark.createDataFrame(rows, "run_id bigint, epoch int, metric double"), 3, delta, 2)
        got = [(g.run_id, g.epoch, g.is_new_best, g.is_significant, g.epochs_without_improvement) for g in got.orderBy("run_id", "epoch").collect()]
        want = []
        for r, ms in runs.items():
            best = reference = moved = None
            for e, m in enumerate(ms, 1):
                new = m is not None and (best is None or m > best)
                move = new and (reference is None or m > reference + delta)
                best, reference, moved = m if new else best, m if move else reference, e if move else moved
                want.append((r, e, new, move, e - (moved or 0)))
        assert got == want


def write_lines(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_readers_bind_by_name(spark, tmp_path):
    from boxlens.sources import readers

    fields = [*reversed(readers.CURVE_FIELDS), "epoch", "run_id"]
    path = write_lines(tmp_path / "curve.csv", ",".join(fields) + "\n" + ",".join([f"0.{i}" for i in range(8)] + ["3", "r"]) + "\n")
    row = readers.scan_training_curve(spark, path).first()
    assert (row.val_dfl_loss, row.box_loss, row.epoch, row.run_id, row.bad_fields) == (0.0, 0.7, 3, "r", "")
    bad = write_lines(tmp_path / "bad.csv", ",".join(fields) + "\n" + ",".join(["x"] * 8 + ["3", "r"]) + "\n")
    with pytest.raises(Exception, match="not numeric"):
        readers.scan_training_curve(spark, bad).collect()
    with pytest.raises(readers.MissingColumns, match="run_id"):
        readers.scan_training_curve(spark, write_lines(tmp_path / "short.csv", "epoch\n1\n"))
    write_lines(tmp_path / "m" / "a.csv", "image_id,box_count\n1,2\n")
    write_lines(tmp_path / "m" / "b.csv", "box_count,image_id\n7,8\n")
    with pytest.raises(Exception):
        readers.scan_split_manifests(spark, str(tmp_path / "m")).collect()
    both = write_lines(tmp_path / "log.csv", "seconds,epoch\n1.5,2\n")
    with pytest.raises(Exception, match="is no int"):
        readers.epoch_csv(spark, write_lines(tmp_path / "wrong.csv", "seconds,epoch\n1.5,two\n"), readers.T._parse_datatype_string("epoch int, seconds double")).collect()
    assert readers.epoch_csv(spark, both, readers.T._parse_datatype_string("epoch int, seconds double")).first() == (2, 1.5)


def test_label_lines_with_tabs(spark, tmp_path):
    from boxlens.operators import audit
    from boxlens.sources import readers

    text = "\t0 0.5 0.5 0.1 0.1\t\n\t\n1\t0.5 0.5  0.1 0.1\n"
    lines = audit.parse_label_lines(spark.createDataFrame([("train", "a.txt", text.encode())], "split string, path string, content binary"), 2)
    assert [(r.class_id, r.code) for r in lines.orderBy("line_number").collect()] == [(0, None), (1, None)]
    rows = readers.scan_yolo_labels(spark, write_lines(tmp_path / "a.txt", text)).collect()
    assert [(r.class_id, r.fields) for r in rows] == [(0, 5), (1, 5)]


def test_result_table_is_replaced_as_a_whole(spark, tmp_path):
    from boxlens.sources import readers, writers

    path = str(tmp_path / "table")
    tables = []
    for n in (3, 1, 4):
        writers.sink_result_table(spark.range(n), ["id"], path)
        tables.append(readers.scan_result_table(spark, path, "id bigint"))
        assert tables[-1].count() == n
    # who began to read before a replacement still reads the version begun with
    assert tables[1].count() == 1
    failing = spark.range(2).withColumn("x", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        writers.sink_result_table(failing, ["id", "x"], path)
    assert readers.scan_result_table(spark, path, "id bigint").count() == 4
    # two versions and the markers, no rest of the failed one
    assert len(list((tmp_path / "table").iterdir())) == 3


def test_coco_ids_begin_anew_in_every_split_and_a_selection_must_be_covered(spark, tmp_path):
    from boxlens.sources import readers, writers

    images = spark.createDataFrame(
        [("test", "c", "c.png", 1, 1), ("train", "b", "b.png", 1, 1), ("train", "a", "a.png", 1, 1)], "split string, exam_id string, file_name string, width int, height int")
    boxes = spark.createDataFrame([(e, r, 1.0, 1.0, 2.0, 3.0) for e in "abc" for r in (1, 2)], "exam_id string, row_number bigint, x double, y double, w double, h double")
    path = str(tmp_path / "coco")
    writers.sink_coco_documents(*writers.coco_tables(images, boxes), path, per_document=1)
    got = readers.scan_coco(spark, path)
    assert {(r.split, r.file_name, r.id) for r in got[0].collect()} == {("train", "a.png", 1), ("train", "b.png", 2), ("test", "c.png", 1)}
    assert sorted((r.split, r.image_id, r.id) for r in got[1].collect()) == [("test", 1, 1), ("test", 1, 2), ("train", 1, 1), ("train", 1, 2), ("train", 2, 3), ("train", 2, 4)]
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "file_name string")
    some = readers.scan_coco(spark, path, names("c.png", "a.png"))
    assert [r.file_name for r in some[0].collect()] == ["a.png", "c.png"] and some[1].count() == 4
    with pytest.raises(ValueError, match="1 selected images are not covered"):
        readers.scan_coco(spark, path, names("a.png", "z.png"))


def test_epoch_log_stream_equals_batch_and_survives_a_replay(spark, tmp_path):
    from boxlens.operators import runlog
    from boxlens.streaming import logs

    base = {"run_id": "a", "is_best": True} | dict.fromkeys(runlog.EPOCH_INTEGERS, 1) | dict.fromkeys(runlog.EPOCH_FLOATS, 0.5)
    changes = [
        ({"epoch": 2}, "accepted"), ({"epoch": 2}, "ignored"), ({"epoch": 2, "val_f1": 0.6}, "rejected_conflict"), ({"epoch": 1}, "rejected_not_rising"),
        ({"epoch": 4, "val_f1": 1.5}, "rejected_invalid"), ({"epoch": None}, "rejected_invalid"), ({"run_id": None}, "rejected_invalid"), ({"run_id": ""}, "rejected_invalid"),
        ({"epoch": 3, "run_id": "b", "val_recall": None}, "accepted"), ({"epoch": 2}, "ignored"), ({"epoch": 5, "seed": None}, "rejected_invalid"), ({"epoch": 5}, "accepted"),
        ({"epoch": 4}, "rejected_not_rising"), ({"epoch": 3, "run_id": "b", "val_recall": None}, "ignored"), ({"epoch": 4}, "rejected_not_rising")]
    rows = [(base | c) | {"arrival": i} for i, (c, _) in enumerate(changes)]
    schema = f"{runlog.EPOCH_SCHEMA}, arrival bigint"
    names = [f.split()[0] for f in schema.split(", ")]
    records = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    want = [fate for _, fate in changes]
    batch = runlog.classify_epoch_records(runlog.ruled_records(records)).orderBy("arrival").collect()
    assert [r.fate for r in batch] == want
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "log", "checkpoint"))
    for part in range(3):
        records.filter(F.floor(F.col("arrival") / 5) == part).write.json(f"{source}/part{part}")
        # the second drain of a part finds nothing new
        for _ in range(2):
            log = logs.run_to_table(logs.ingest_epochs(logs.epoch_record_stream(spark, source)), table, checkpoint)
    assert sorted(log.collect(), key=lambda r: r.arrival) == batch
    kept = runlog.epoch_fields(log.filter("fate = 'accepted'")).drop("problems", "fate").orderBy("arrival")
    assert [r.asDict() for r in kept.collect()] == [r for r, (_, fate) in zip(rows, changes, strict=True) if fate == "accepted"]


def test_coco_ids_follow_the_exam(spark):
    from boxlens.sources import writers

    images = spark.createDataFrame([("a-b", "a-b.png", 1, 1), ("a", "a.png", 1, 1)], "exam_id string, file_name string, width int, height int")
    boxes = spark.createDataFrame([], "exam_id string, row_number bigint, x double, y double, w double, h double")
    assert {r.file_name: r.id for r in writers.coco_tables(images, boxes)[0].collect()} == {"a.png": 1, "a-b.png": 2}


def test_epoch_record_rules(spark):
    from boxlens.operators import runlog

    base = dict.fromkeys(runlog.EPOCH_INTEGERS, 1) | dict.fromkeys(runlog.EPOCH_FLOATS, 0.5) | {"run_id": "r", "is_best": True}
    kinds = {c: "int" for c in runlog.EPOCH_INTEGERS} | {c: "double" for c in runlog.EPOCH_FLOATS} | {"run_id": "string", "is_best": "boolean"}
    changes = [{}, {"epoch": 0}, {"epoch_seconds": 0.0}, {"val_f1": 1.5}, {"val_f1": None}, {"train_seconds": None}, {"run_id": ""}, {"seed": -1}, {"learning_rate": float("nan")}, {"is_best": None}]
    frame = lambda rows, kinds: spark.createDataFrame([tuple((base | r)[c] for c in kinds) for r in rows], ", ".join(f"{c} {k}" for c, k in kinds.items()))
    found = sorted((r.field, r.rule) for r in runlog.epoch_record_problems(frame(changes, kinds)).collect())
    assert found == sorted([("epoch", "not_positive"), ("epoch_seconds", "not_positive"), ("val_f1", "above_one"), ("train_seconds", "missing"), ("run_id", "missing"),
                            ("seed", "negative"), ("learning_rate", "nonfinite"), ("is_best", "missing")])
    with pytest.raises(ValueError, match="unknown field other"):
        runlog.epoch_record_problems(frame([{}], kinds).withColumn("other", F.lit(1)))
    with pytest.raises(ValueError, match="is_best must be boolean"):
        runlog.epoch_record_problems(frame([{}], kinds).withColumn("is_best", F.lit(1)))
    with pytest.raises(ValueError, match="missing field seed"):
        runlog.epoch_record_problems(frame([{}], kinds).drop("seed"))


def test_draws_in_numpy_equal_the_hash_of_columns(spark):
    from boxlens.functions.hashing import Draws, draw

    tails = ["0", "7", "14999", "150001", None, "", "é", "long " * 12, "x" * 44, "y" * 45]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tails)], "i int, t string").crossJoin(spark.range(112).withColumnRenamed("id", "rep"))
    want = rows.select("i", "rep", draw(F.lit(7), F.lit("swap"), F.col("rep"), F.col("t")).alias("h")).orderBy("i", "rep").collect()
    assert [r.h for r in want] == Draws(7, "swap", count=112)(tails).ravel().tolist()


def test_hybrid_sums_follow_the_swaps(spark):
    """Against a join with the swap rows; group 3 has one detector only."""
    from boxlens.operators import stats

    ev = spark.createDataFrame([(d, s, g, *(10 * g + d + s + i for i in range(6))) for d in (0, 1) for s in (1, 2) for g in (1, 2, 3) if g < 3 or d],
                               "d int, s int, g bigint, " + ", ".join(f"{c} bigint" for c in stats.COUNTS))
    swaps = stats.permutation_swaps(ev, 12, 7, "g")
    role = F.when((F.col("d") == 1) == F.col("swap"), "a").otherwise("b")
    want = ev.join(swaps, "g").groupBy("rep", role.alias("role"), "s").agg(*[F.sum(c).alias(c) for c in stats.COUNTS])
    got = stats.hybrid_sums(ev, 12, 7, 1, ["s"], "g").select(*want.columns)
    # a hybrid that no row of a run falls to has zeros here and no row in the join
    assert got.filter("fn > 0").exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    texts = {r.g: r.swaps for r in stats.swap_texts(ev, 12, 7, "g").collect()}
    assert all(texts[r.g][r.rep] == str(int(r.swap)) for r in swaps.collect())


def test_text_files_are_few_folders_and_one_file_per_row(spark, tmp_path):
    import hashlib

    from boxlens.sources import readers, writers

    rows = [(i, f"text\nof {i}") for i in range(300)] + [(5, "again"), (6, None), (7, "é")]
    root = str(tmp_path / "texts")
    writers.sink_text_files(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", root)
    folders = {p.parent for p in (tmp_path / "texts").rglob("*.txt")}
    assert len(folders) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) + 2
    got = sorted((r.path.split("/")[-1], r.size, r.sha) for r in readers.file_inventory(spark, root, [".txt"]).collect())
    whole = [(i, ((t or "") + "\n").encode()) for i, t in rows]
    assert got == sorted((f"doc_id={i}.txt", len(t), hashlib.sha256(t).hexdigest()) for i, t in whole)


def test_bootstrap_blocks_hold_the_draws_of_the_long_form(spark, monkeypatch):
    """Arrays, texts and sums of blocks against one row per (replicate, drawn group), with blocks and tasks of few groups."""
    monkeypatch.setattr(stats, "GROUP_BLOCK", 7)
    monkeypatch.setattr(stats, "DRAWN", 300)
    monkeypatch.setattr(stats, "TAILS", 16)
    n, reps = 53, 23
    groups = spark.range(3 * n).select((F.col("id") % n).alias("patient_group"))
    long = {(r.patient_group, r.rep): r.w for r in stats.cluster_bootstrap_weights(groups, reps, 7).collect()}
    want = {g: [long.get((g, rep), 0) for rep in range(reps)] for g in range(n)}
    assert {r.patient_group: r.w for r in stats.bootstrap_arrays(groups, reps, 7).collect()} == want
    assert {r.patient_group: r.weights for r in stats.bootstrap_texts(groups, reps, 7).collect()} == {g: ",".join(map(str, w)) for g, w in want.items()}
    rows = [(d, g, g + d, g, 1, d, 0.5 * g, 0.25 * d) for g in range(0, n, 2) for d in (0, 1) if (g, d) != (4, 1)]
    ev = spark.createDataFrame(rows, "d int, patient_group bigint, target_count bigint, tp bigint, fp bigint, fn bigint, iou_sum double, dice_sum double")
    got = {(r.rep, r.d): tuple(r[c] for c in stats.COUNTS) for r in stats.bootstrap_sums(ev, groups, reps, 7, ["d"]).collect()}
    assert got == {(rep, d): tuple(sum(want[x[1]][rep] * x[2 + i] for x in rows if x[0] == d) for i in range(6)) for rep in range(reps) for d in (0, 1)}


def test_bootstrap_texts_of_one_group_and_of_none(spark):
    one = spark.createDataFrame([("a",), ("a",)], "patient_group string")
    assert [tuple(r) for r in stats.bootstrap_texts(one, 4, 7).collect()] == [("a", "1,1,1,1")]
    assert stats.bootstrap_texts(one.limit(0), 4, 7).count() == 0
    many = pa.table({"lo": pa.array([0, 2], pa.int32()), "reps": pa.array([2, 1], pa.int32()),
                     "data": [np.array([[300, 1], [0, 2]], np.int32).tobytes(), np.array([[3, 4]], np.uint8).tobytes()]})
    assert stats._multiplicities(many, 3, 2).tolist() == [[300, 1], [0, 2], [3, 4]]
