"""Average precision, PR curves, sweeps, FROC."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxlens.functions.grids import linspace, threshold_bucket, threshold_grid as make_grid
from boxlens.operators import ap, matching, metrics, sweep
from boxlens.plans import fixtures as fx
from boxlens.plans.catalog import query
from boxlens.plans.detection import evidence_of, round_cols
from boxlens.plans.oracle_parts import METRIC_COLS, RATIOS, ap_ctes, d as dbl, evidence, rounded, sums, with_levels, with_match

RUN = matching.RUN
KEYS = list(RUN)


def detections(spark, sf):
    return matching.coco_match(fx.det_predictions(spark, sf), fx.det_targets(spark, sf))


def totals(spark, sf):
    return ap.target_totals(fx.det_targets(spark, sf), fx.runs(spark))


def blocks(spark, sf):
    return ap.detection_blocks(detections(spark, sf), KEYS)


TOT = "tot as (select d, s, n target_count from runs cross join (select count(*) n from tg))"
LEVELS = with_levels(["pr", "tg", "runs"]) + f", {TOT}"
POOLED = LEVELS + ", " + ap_ctes("d, s", "dl", "tot")
BY_CLASS = with_levels(["pr", "tg", "runs", "classes"], by="label") + """, tot as (select r.d, r.s, c.label, coalesce(n, 0) target_count
    from runs r cross join classes c left join (select label, count(*) n from tg group by label) x on x.label=c.label), """ + ap_ctes("d, s, label", "dl", "tot")


@query("cumulative_tp_fp", LEVELS + """ select d, s, image_id, pidx, (sum(level_mask & 1) over w)::bigint cum_tp, (sum(1 - (level_mask & 1)) over w)::bigint cum_fp
    from dl window w as (partition by d, s order by score desc, image_id, rank rows unbounded preceding)""")
def cumulative_tp_fp(spark, sf):
    return ap.detection_curve(detections(spark, sf), KEYS, envelope=False).select(*KEYS, "image_id", "pidx", "cum_tp", "cum_fp")


PR_ROWS = LEVELS + """, c as (select *, sum(level_mask & 1) over w tp, count(*) over w n from dl
    window w as (partition by d, s order by score desc, image_id, rank rows unbounded preceding)),
    pv as (select c.*, tp::double/n prec, tp::double/target_count rec from c join tot using (d, s)),
    en as (select *, max(prec) over (partition by d, s order by score desc, image_id, rank rows between current row and unbounded following) env from pv)"""


@query("precision_envelope", PR_ROWS + " select d, s, image_id, pidx, round(prec, 9) as precision, round(env, 9) envelope from en")
def precision_envelope(spark, sf):
    out = ap.detection_curve(detections(spark, sf), KEYS).select(*KEYS, "image_id", "pidx", "precision", "envelope")
    return round_cols(out, ["precision", "envelope"])


@query("recall_sampling", PR_ROWS + """, """ + __import__("boxlens.plans.oracle_parts", fromlist=["x"]).RECALL_SQL + """
    select d, s, point::int point, min(n)::bigint "position", round(max(env), 9) envelope from en join rp on rec >= r group by d, s, point""")
def recall_sampling(spark, sf):
    pr = ap.precision_recall(blocks(spark, sf), totals(spark, sf), KEYS)
    return round_cols(ap.recall_sampling(pr, KEYS), ["envelope"])


@query("average_precision", POOLED + " select d, s, level, round(ap, 9) ap from ap")
def average_precision(spark, sf):
    return round_cols(ap.average_precision(ap.counted_detections(detections(spark, sf), KEYS), totals(spark, sf), KEYS), ["ap"])


@query("weighted_average_precision", with_levels(["pr", "tg", "runs", "im"]) + """,
    wt as (select image_id, (o_rank % 3)::int w from (select image_id, patient_group o_rank from im)),
    dw as (select dl.*, w from dl join wt using (image_id) where w > 0),
    tot as (select d, s, n target_count from runs cross join (select sum(w) n from tg join wt using (image_id))), """
       + ap_ctes("d, s", "dw", "tot", "w") + " select d, s, level, round(ap, 9) ap from ap")
def weighted_average_precision(spark, sf):
    weights = fx.det_images(spark, sf).select("image_id", (F.col("patient_group") % 3).cast("int").alias("w"))
    dets = detections(spark, sf).join(weights, "image_id").filter("w > 0")
    tot = fx.det_targets(spark, sf).join(weights, "image_id").agg(F.sum("w").alias("target_count"))
    tot = fx.runs(spark).crossJoin(tot)
    return round_cols(ap.average_precision(ap.counted_detections(dets, KEYS, F.col("w")), tot, KEYS), ["ap"])


COCO_SQL = BY_CLASS + """, pc as (select d, s, label, max(case when level=0 then ap end) map_50, avg(ap) map_50_95 from ap group by d, s, label),
    ca as (select d, s, label, map_50, map_50_95 from pc union all select d, s, null, avg(map_50), avg(map_50_95) from pc group by d, s)"""


@query("coco_ap", COCO_SQL + " select d, s, label, round(map_50, 9) map_50, round(map_50_95, 9) map_50_95 from ca")
def coco_ap(spark, sf):
    out = ap.coco_ap(fx.det_predictions(spark, sf), fx.det_targets(spark, sf), fx.classes(spark), fx.runs(spark))
    return round_cols(out, ["map_50", "map_50_95"])


CURVE_SQL = BY_CLASS + """, fp as (select t.d, t.s, t.label, l.level, p.point, coalesce(prec, 0) prec from (select * from tot where target_count > 0) t cross join lvl l cross join rp p
        left join pt on pt.d=t.d and pt.s=t.s and pt.label=t.label and pt.level=l.level and pt.point=p.point),
    c1 as (select d, s, label, point, max(case when level=0 then prec end) p50, avg(prec) p5095 from fp group by d, s, label, point),
    cv as (select * from c1 union all select d, s, null, point, avg(p50), avg(p5095) from c1 group by d, s, point)"""


def pr_curve(spark, sf):
    return ap.pr_curve_101(fx.det_predictions(spark, sf), fx.det_targets(spark, sf), fx.classes(spark), fx.runs(spark))


@query("pr_curve_101", CURVE_SQL + " select d, s, label, point::int point, round(p50, 9) precision_50, round(p5095, 9) precision_50_95 from cv")
def pr_curve_101(spark, sf):
    return round_cols(pr_curve(spark, sf), ["precision_50", "precision_50_95"])


def sd(c):
    return f"case when count({c}) < 2 then null when min({c})=max({c}) then 0 else stddev_samp({c}) end"


@query("pr_curve_seed_mean", CURVE_SQL + f""" select d, label, point::int point, count(*) n, round(avg(p50), 9) precision_50_mean, round({sd('p50')}, 9) precision_50_sd,
    round(avg(p5095), 9) precision_50_95_mean, round({sd('p5095')}, 9) precision_50_95_sd from cv group by d, label, point""")
def pr_curve_seed_mean(spark, sf):
    out = ap.pr_curve_seed_mean(pr_curve(spark, sf))
    return round_cols(out, [c for c in out.columns if c.startswith("precision")])


@query("compare_pr_curves", CURVE_SQL + """, m as (select d, point, avg(p50) v from cv where label is null group by d, point)
    select count(*) recall_grid_points, count(*) filter (a.v - b.v > 1e-12) a_higher, count(*) filter (abs(a.v - b.v) <= 1e-12) equal,
    count(*) filter (b.v - a.v > 1e-12) b_higher, max(case when a.v > 1e-12 then a.point/100e0 end) a_max_recall, max(case when b.v > 1e-12 then b.point/100e0 end) b_max_recall
    from m a join m b on a.point=b.point and a.d=0 and b.d=1""")
def compare_pr_curves(spark, sf):
    mean = ap.pr_curve_seed_mean(pr_curve(spark, sf)).filter("label is null")
    return sweep.compare_pr_curves(mean, 0, 1, "precision_50_mean")


@query("evaluate_predictions", COCO_SQL.replace("with recursive", "with recursive", 1) + f""",
    seq2 as (select *, row_number() over (partition by d, s, image_id order by rank, iou desc, tidx) o from (
        select p.d, p.s, p.image_id, p.pidx, p.rank, p.label, p.score, t.tidx, {__import__("boxlens.plans.oracle_parts", fromlist=["x"]).IOU_SQL} iou
        from (select * from (select *, row_number() over (partition by d, s, image_id order by score desc, pidx) rank from pr where score >= 0.05e0) where rank <= 100) p
        join tg t on p.image_id=t.image_id and p.label=t.label) where iou >= 0.5e0),
    walk2 as (
        select *, [pidx] up, [tidx] ut, true took from seq2 where o = 1 union all
        select q.*, case when not list_contains(w.up, q.pidx) and not list_contains(w.ut, q.tidx) then list_append(w.up, q.pidx) else w.up end,
            case when not list_contains(w.up, q.pidx) and not list_contains(w.ut, q.tidx) then list_append(w.ut, q.tidx) else w.ut end,
            not list_contains(w.up, q.pidx) and not list_contains(w.ut, q.tidx)
        from walk2 w join seq2 q on q.d=w.d and q.s=w.s and q.image_id=w.image_id and q.o=w.o+1),
    ev as (select d, s, label, 1 preds, 0 targets, 0 tp, 0e0 iou_sum, 0e0 dice_sum from (select * from (select *, row_number() over (partition by d, s, image_id order by score desc, pidx) rank from pr where score >= 0.05e0) where rank <= 100)
        union all select d, s, label, 0, 1, 0, 0, 0 from tg cross join runs union all select d, s, label, 0, 0, 1, iou, 2*iou/(1+iou) from walk2 where took),
    o1 as (select *, {RATIOS} from ({sums('d, s')})), k1 as (select *, {RATIOS} from ({sums('d, s, label')}))
    select o1.d, o1.s, tp, fp, fn, tp+fp prediction_count, tp+fn target_count, {rounded(METRIC_COLS)}, {', '.join(f'macro_{m}' for m in METRIC_COLS)},
        round(map_50, 9) map_50, round(map_50_95, 9) map_50_95
    from o1 join (select d, s, {', '.join(f'round(avg({m}), 9) macro_{m}' for m in METRIC_COLS)} from k1 group by d, s) using (d, s)
    join (select d, s, map_50, map_50_95 from ca where label is null) using (d, s)""")
def evaluate_predictions(spark, sf):
    out = metrics.evaluate_predictions(fx.det_predictions(spark, sf), fx.det_targets(spark, sf), fx.runs(spark), fx.classes(spark))
    return round_cols(out, [*METRIC_COLS, *[f"macro_{m}" for m in METRIC_COLS], "map_50", "map_50_95"])


GRID = "gr as (select i::int t_idx, round(0.01e0 + i*((0.99e0-0.01e0)/98e0), 12) threshold from range(99) x(i))"


@query("threshold_grid", f"""with {fx.sql_views('pr')}, {GRID} select t_idx, threshold, count(score) predictions
    from gr left join pr on score >= threshold and score < threshold + 0.01e0 - 1e-9 group by t_idx, threshold""")
def threshold_grid(spark, sf):
    counts = fx.det_predictions(spark, sf).groupBy(threshold_bucket(F.col("score"), linspace(0.01, 0.99, 99)).alias("t_idx")).agg(F.count("*").alias("predictions"))
    return make_grid(spark).join(counts, "t_idx", "left").fillna(0, ["predictions"])


def sweep_ctes(views=("pr", "tg", "runs"), pred="pr", tgt="tg"):
    return with_match(list(views), pred, tgt, score=0.01) + f""", {GRID},
    c as (select d, s, t_idx, count(*) preds from rk join gr on score>=threshold group by all),
    m as (select d, s, t_idx, count(*) tp, sum(iou) iou_sum, sum(dice) dice_sum from mt join gr on score>=threshold group by all),
    s0 as (select r.d, r.s, t_idx, threshold, coalesce(tp, 0) tp, coalesce(preds, 0)-coalesce(tp, 0) fp, n-coalesce(tp, 0) fn, iou_sum, dice_sum
        from runs r cross join gr left join c using (d, s, t_idx) left join m using (d, s, t_idx) cross join (select count(*) n from {tgt})),
    sw as (select *, {RATIOS} from s0),
    sm as (select d, t_idx, threshold, count(*) seed_count, {', '.join(f'avg({x}) as {x}, {sd(x)} as {x}_std' for x in ('precision', 'recall', 'f1'))} from sw group by d, t_idx, threshold)"""


SWEEP = sweep_ctes()


def the_sweep(spark, sf):
    return sweep.threshold_sweep(fx.det_predictions(spark, sf), fx.det_targets(spark, sf), fx.runs(spark))


@query("threshold_sweep", SWEEP + f" select d, s, t_idx, threshold, tp, fp, fn, tp+fp prediction_count, tp+fn target_count, {rounded(METRIC_COLS)} from sw")
def threshold_sweep(spark, sf):
    return round_cols(the_sweep(spark, sf), METRIC_COLS)


@query("threshold_sweep_seed_mean", SWEEP + f" select d, t_idx, threshold, seed_count, {rounded([m + x for m in ('precision', 'recall', 'f1') for x in ('', '_std')])} from sm")
def threshold_sweep_seed_mean(spark, sf):
    return round_cols(sweep.sweep_seed_mean(the_sweep(spark, sf)), [m + x for m in ("precision", "recall", "f1") for x in ("", "_std")])


GOALS = [("precision", 0.3), ("precision", 0.5), ("recall", 0.2), ("recall", 0.6), ("recall", 0.9)]


@query("select_operating_targets", SWEEP + f""", go as (select * from (values {', '.join(f"('{m}', {dbl(v)})" for m, v in GOALS)}) g(target_metric, target_value)),
    ca as (select go.*, d, threshold, case target_metric when 'precision' then precision else recall end tv, case target_metric when 'precision' then recall else precision end rv,
        case target_metric when 'precision' then recall_std else precision_std end rs from sm cross join go),
    pick as (select *, row_number() over (partition by d, target_metric, target_value order by rv desc, tv desc, threshold desc) o from ca where tv >= target_value),
    sr as (select d, target_metric, target_value, count(distinct case when (case target_metric when 'precision' then precision else recall end) >= target_value then s end) seeds_reaching_target,
        count(distinct s) seed_count from sw cross join go group by all)
    select sr.d, sr.target_metric, sr.target_value, case when p.d is null then 'not_reachable_at_any_swept_threshold' else 'reachable' end status, p.threshold, round(rv, 9) response,
        round(rs, 9) response_std, seeds_reaching_target, seed_count
    from sr left join (select * from pick where o=1) p on p.d=sr.d and p.target_metric=sr.target_metric and p.target_value=sr.target_value""")
def select_operating_targets(spark, sf):
    rows = the_sweep(spark, sf)
    return round_cols(sweep.select_operating_targets(sweep.sweep_seed_mean(rows), rows, GOALS), ["response", "response_std"])


@query("select_validation_threshold", SWEEP + """ select d, t_idx, threshold selected_threshold, round(precision, 9) validation_precision, round(recall, 9) validation_recall, round(f1, 9) validation_f1
    from (select *, row_number() over (partition by d order by f1 desc, threshold desc) o from sm) where o=1""")
def select_validation_threshold(spark, sf):
    out = sweep.select_validation_threshold(sweep.sweep_seed_mean(the_sweep(spark, sf)))
    return round_cols(out, ["validation_precision", "validation_recall", "validation_f1"])


HALF = {"validation": 0, "test": 1}


def half(df, images, rest):
    return df.join(images.filter(F.col("patient_group") % 2 == rest).select("image_id"), "image_id", "left_semi")


def half_sql(rest, tag):
    body = sweep_ctes(("pr", "tg", "runs", "im"), f"pr{tag}", f"tg{tag}")
    views = ", ".join(f"{v}{tag} as (select * from {v} where image_id in (select image_id from im where patient_group % 2 = {rest}))" for v in ("pr", "tg"))
    return body.replace(",\n    rk as", f",\n    {views},\n    rk as", 1)


@query("apply_selected_threshold", f"""with va as ({half_sql(0, 'v')} select d, s, t_idx, threshold, tp, fp, fn, precision, recall, f1 from sw),
    te as ({half_sql(1, 't')} select d, s, t_idx, threshold, tp, fp, fn, precision, recall, f1 from sw),
    ch as (select d, t_idx, threshold from (select *, row_number() over (partition by d order by f1 desc, threshold desc) o
        from (select d, t_idx, threshold, avg(f1) f1 from va group by d, t_idx, threshold)) where o=1)
    select va.d, va.s, ch.threshold selected_threshold, {', '.join(f'round(va.{m}, 9) validation_{m}, round(te.{m}, 9) test_{m}' for m in ('precision', 'recall', 'f1'))},
        {', '.join(f'va.{m} validation_{m}, te.{m} test_{m}' for m in ('tp', 'fp', 'fn'))}, true seeds_match
    from ch join va on va.d=ch.d and va.t_idx=ch.t_idx join te on te.d=va.d and te.s=va.s and te.t_idx=va.t_idx""")
def apply_selected_threshold(spark, sf):
    images = fx.det_images(spark, sf)
    rows = {
        name: sweep.threshold_sweep(half(fx.det_predictions(spark, sf), images, rest), half(fx.det_targets(spark, sf), images, rest), fx.runs(spark))
        for name, rest in HALF.items()
    }
    out = sweep.apply_selected_threshold(rows["validation"], rows["test"])
    return round_cols(out, [f"{a}_{m}" for a in HALF for m in ("precision", "recall", "f1")])


@query("sweep_findings", SWEEP + """, pk as (select d, f1, threshold from (select *, row_number() over (partition by d order by f1 desc, t_idx) o from sm) where o=1)
    select sm.d, max(case when t_idx=4 then sm.threshold end) reference_threshold, round(max(case when t_idx=4 then precision end), 9) reference_precision,
    round(max(case when t_idx=4 then recall end), 9) reference_recall, round(max(case when t_idx=4 then sm.f1 end), 9) reference_f1, round(max(recall), 9) maximum_mean_recall,
    round(max(pk.f1), 9) peak_mean_f1, max(pk.threshold) peak_mean_f1_threshold from sm join pk using (d) group by sm.d""")
def sweep_findings(spark, sf):
    out = sweep.sweep_findings(sweep.sweep_seed_mean(the_sweep(spark, sf)), 4)
    return round_cols(out, [c for c in out.columns if c not in ("d", "reference_threshold", "peak_mean_f1_threshold")])


BUDGETS = [0.125, 0.25, 0.5, 1.0, 2.0]
FROC = SWEEP + """, ni as (select count(*) n from orders),
    fr as (select d, s, t_idx, threshold, recall sensitivity, fp::double/n fp_per_image, tp, fn from sw cross join ni)"""
BUDGET_SQL = ", bu as (select * from (values " + ", ".join(f"({dbl(b)})" for b in BUDGETS) + ") b(budget))"
FROC_PICK = FROC + BUDGET_SQL + """, fo as (select * from (select *, row_number() over (partition by d, s, budget order by sensitivity desc, fp_per_image, threshold desc) o
    from fr join bu on fp_per_image <= budget + 1e-12) where o=1)"""


def froc(spark, sf):
    # the image count is one number; it rides along as a one-row frame
    n = fx.det_images(spark, sf).agg(F.count("*").alias("image_count"))
    return metrics.fp_per_image(the_sweep(spark, sf).crossJoin(F.broadcast(n)), F.col("image_count"))


@query("fp_per_image", FROC + " select d, s, threshold, round(sensitivity, 9) sensitivity, round(fp_per_image, 9) fp_per_image, true counts_ok, true recall_ok from fr")
def fp_per_image(spark, sf):
    out = froc(spark, sf).select(*KEYS, "threshold", "sensitivity", "fp_per_image", "counts_ok", "recall_ok")
    return round_cols(out, ["sensitivity", "fp_per_image"])


@query("froc_budget_candidates", FROC + BUDGET_SQL + " select d, s, budget, threshold, round(fp_per_image, 9) fp_per_image from fr join bu on fp_per_image <= budget + 1e-12")
def froc_budget_candidates(spark, sf):
    out = sweep.froc_budget_candidates(froc(spark, sf), BUDGETS)
    return round_cols(out.select(*KEYS, "budget", "threshold", "fp_per_image"), ["fp_per_image"])


@query("froc_operating_points", FROC_PICK + """ select r.d, r.s, b.budget, round(sensitivity, 9) sensitivity, round(fp_per_image, 9) achieved_fp_per_image, threshold selected_threshold,
    case when fo.d is null then 'no_point_within_budget' else 'selected' end status from runs r cross join bu b left join fo on fo.d=r.d and fo.s=r.s and fo.budget=b.budget""")
def froc_operating_points(spark, sf):
    return round_cols(sweep.froc_operating_points(froc(spark, sf), BUDGETS), ["sensitivity", "achieved_fp_per_image"])


@query("froc_curve", FROC + f""" select d, threshold, count(*) seed_count, round(avg(sensitivity), 9) sensitivity, round({sd('sensitivity')}, 9) sensitivity_std,
    round(avg(fp_per_image), 9) fp_per_image, round({sd('fp_per_image')}, 9) fp_per_image_std from fr group by d, threshold""")
def froc_curve(spark, sf):
    return round_cols(sweep.froc_curve(froc(spark, sf)), ["sensitivity", "sensitivity_std", "fp_per_image", "fp_per_image_std"])


@query("froc_operating_summary", FROC_PICK + f""" select d, budget, count(*) seed_count, round(avg(sensitivity), 9) sensitivity, round({sd('sensitivity')}, 9) sensitivity_std,
    round(avg(fp_per_image), 9) achieved_fp_per_image, round({sd('fp_per_image')}, 9) achieved_fp_per_image_std, round(avg(threshold), 9) selected_threshold_mean,
    min(threshold) selected_threshold_min, max(threshold) selected_threshold_max from fo group by d, budget""")
def froc_operating_summary(spark, sf):
    out = sweep.froc_operating_summary(sweep.froc_operating_points(froc(spark, sf), BUDGETS)).drop("sensitivity_text")
    return round_cols(out, ["sensitivity", "sensitivity_std", "achieved_fp_per_image", "achieved_fp_per_image_std", "selected_threshold_mean"])
