"""Result-table queries: seed means, pivots, cross-checks, dominance, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxlens.functions.ratios import decimal_mean
from boxlens.functions.text import general_6g, mean_std, scaled_round
from boxlens.operators import ap, comparison, metrics, sweep
from boxlens.operators.comparison import METRIC_VECTOR
from boxlens.plans import fixtures as fx
from boxlens.plans.catalog import query
from boxlens.plans.curves import SWEEP, sd, the_sweep
from boxlens.plans.detection import round_cols
from boxlens.plans.oracle_parts import RATIOS, ap_ctes, image_evidence_block, level_block, match_block

SEVEN = list(METRIC_VECTOR)
UNDEFINED = "case when tp > 0 then '' when tp+fp=0 then 'no_detections_at_frozen_score_threshold' else 'no_iou_qualified_true_positive' end"
OPER = f"""with recursive {fx.sql_views('gpr', 'tg', 'runs', 'classes')}, {match_block('g', 'gpr', 'tg')}, {image_evidence_block('g', 'tg', 'runs')},
    go as (select d, s, sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn, sum(iou_sum) iou_sum, sum(dice_sum) dice_sum from ie_g group by d, s),
    op as (select d, s, d || '-' || s run_id, tp, fp, fn, tp+fp prediction_count, tp+fn target_count, precision, recall, f1, mean_iou iou, mean_dice dice, {UNDEFINED} reason from (select *, {RATIOS} from go))"""
RUNS = OPER + f""", {level_block('k', 'gpr', 'tg', 'd, s, label')}, ct as (select d, s, c.label, coalesce(n, 0) target_count from runs cross join classes c left join (select label, count(*) n from tg group by label) x on x.label=c.label),
    {ap_ctes('d, s, label', 'dl_k', 'ct', tag='k')}, rt as (select op.*, m.map_50, m.map_50_95 from op join (select d, s, avg(map_50) map_50, avg(map_50_95) map_50_95 from apsk group by d, s) m using (d, s))"""


def operating_rows(spark, sf):
    ev = metrics.operating_evidence(fx.degenerate_predictions(spark, sf), fx.det_targets(spark, sf), fx.runs(spark))
    rows = metrics.operating_point(ev).withColumnsRenamed({"mean_iou": "iou", "mean_dice": "dice"})
    return rows.withColumns({
        "run_id": F.concat_ws("-", F.col("d").cast("string"), F.col("s").cast("string")),
        "reason": metrics.undefined_reason(F.col("tp"), F.col("prediction_count")),
    })


def run_rows(spark, sf):
    official = ap.coco_ap(fx.degenerate_predictions(spark, sf), fx.det_targets(spark, sf), fx.classes(spark), fx.runs(spark))
    return operating_rows(spark, sf).join(official.filter("label is null").drop("label"), ["d", "s"])


# One compute profile and training summary per run, aggregated from the event log.
PROFILE = """pf as (select user_id % 6 % 2 d, [17, 42, 137][1 + user_id % 6 // 2] s, count(*)*1000/sum(value) throughput_fps, avg(value) mean_latency_ms, sum(event_id)::bigint total_parameters,
    max(value) estimated_gflops, sum(value)/1000 inference_seconds, sum(length(props))::bigint model_bytes, sha256(max(props)) model_sha256, sum(value) training_seconds, min(event_type) first_type
    from events group by all), cp as (select d::int d, s, d || '-' || s run_id, * exclude (d, s) from pf),
    tn as (select run_id, case when d=1 and s=42 then 99 else s end seed, case when d=0 and s=42 then 'running' else 'complete' end status, case when d=1 and s=17 then 'other' else model_sha256 end model_sha256, training_seconds from cp)"""


def compute_rows(spark, sf):
    r = F.col("user_id") % 6
    seeds = F.array(*[F.lit(s) for s in fx.SEEDS])
    out = fx.table(spark, sf, "events").groupBy((r % 2).cast("int").alias("d"), F.element_at(seeds, (F.floor(r / 2) + 1).cast("int")).alias("seed")).agg(
        (F.count("*") * 1000 / F.sum("value")).alias("throughput_fps"), F.avg("value").alias("mean_latency_ms"), F.sum("event_id").alias("total_parameters"),
        F.max("value").alias("estimated_gflops"), (F.sum("value") / 1000).alias("inference_seconds"), F.sum(F.length("props")).alias("model_bytes"),
        F.sha2(F.max("props"), 256).alias("model_sha256"), F.sum("value").alias("training_seconds"),
    )
    return out.withColumn("run_id", F.concat_ws("-", F.col("d").cast("string"), F.col("seed").cast("string")))


def training_rows(spark, sf):
    c = compute_rows(spark, sf)
    at = lambda d, s: (F.col("d") == d) & (F.col("seed") == s)
    return c.select(
        "run_id", F.when(at(1, 42), 99).otherwise(F.col("seed")).alias("seed"), F.when(at(0, 42), "running").otherwise("complete").alias("status"),
        F.when(at(1, 17), "other").otherwise(F.col("model_sha256")).alias("model_sha256"), "training_seconds",
    )


def unpivot_sql(source, keys, cols):
    return f"select {keys}, unnest([{', '.join(repr(c) for c in cols)}]) metric, unnest([{', '.join(c + '::double' for c in cols)}]) v from {source}"


@query("metric_vector", RUNS + f" select d, s, metric, round(v, 9) as value from ({unpivot_sql('rt', 'd, s', SEVEN)})")
def metric_vector(spark, sf):
    return round_cols(comparison.metric_vector(run_rows(spark, sf), ["d", "s"]), ["value"])


WIDE = [*SEVEN, "prediction_count", "throughput_fps", "mean_latency_ms", "total_parameters", "estimated_gflops", "inference_seconds", "training_seconds"]
LONG = RUNS + f""", {PROFILE}, fr as (select rt.*, cp.* exclude (d, s, run_id) from rt join cp using (run_id)), ul as ({unpivot_sql('fr', 'd, s, reason', WIDE)}),
    lo as (select d, metric, count(v) n, count(*) attempted_n, count(*) filter (v is null) undefined_n, coalesce(string_agg(s::varchar, ';' order by s) filter (v is null), '') undefined_seeds,
    coalesce(string_agg(distinct reason, ';') filter (v is null), '') undefined_reason, avg(v) mean, {sd('v')} std from ul group by d, metric)"""


def seed_means(spark, sf):
    wide = run_rows(spark, sf).join(compute_rows(spark, sf).drop("d", "seed"), "run_id")
    return comparison.seed_mean_std(wide, WIDE)


@query("seed_mean_std", LONG + " select d, metric, n, attempted_n, undefined_n, undefined_seeds, undefined_reason, round(mean, 6) mean, round(std, 6) std from lo")
def seed_mean_std(spark, sf):
    return round_cols(seed_means(spark, sf).drop("mean_plus_minus_std"), ["mean", "std"], 6)


@query("publication_pivot", LONG + """ select metric, round(max(mean) filter (d=0), 6) "0_mean", round(max(std) filter (d=0), 6) "0_std", max(n) filter (d=0) "0_n",
    round(max(mean) filter (d=1), 6) "1_mean", round(max(std) filter (d=1), 6) "1_std", max(n) filter (d=1) "1_n" from lo group by metric""")
def publication_pivot(spark, sf):
    out = comparison.publication_pivot(seed_means(spark, sf), [0, 1]).drop("0_text", "1_text")
    return round_cols(out, ["0_mean", "0_std", "1_mean", "1_std"], 6)


@query("seed_contract_violations", RUNS + """, bad as (select *, case when d=0 and s=17 then null else dice end dice2, case when d=0 and s=42 then 'made_up' else reason end reason2 from rt)
    select d, s, 'not_jointly_defined' rule from bad where (iou is null) <> (dice2 is null)
    union all select d, s, 'undefined_with_true_positive' from bad where tp > 0 and (iou is null or dice2 is null)
    union all select d, s, 'defined_without_true_positive' from bad where tp = 0 and (iou is not null or dice2 is not null)
    union all select d, s, 'reason_differs_from_counts' from bad where reason2 <> reason""")
def seed_contract_violations(spark, sf):
    at = lambda d, s: (F.col("d") == d) & (F.col("s") == s)
    rows = run_rows(spark, sf).withColumns({
        "dice": F.when(~at(0, 17), F.col("dice")), "reason": F.when(at(0, 42), "made_up").otherwise(F.col("reason")),
    })
    return comparison.seed_contract_violations(rows)


def g6(v):
    """C-style %.6g from DuckDB's printf."""
    return f"printf('%.6g', {v})"


@query("format_mean_std", f"""select l_partkey, {g6('m')} || ' ± ' || {g6('s')} text, {g6('m*1e5')} || '' big from (
    select l_partkey, round(avg(l_discount), 5) m, round(coalesce(stddev_samp(l_extendedprice), 0), 3) s from lineitem group by l_partkey)""")
def format_mean_std(spark, sf):
    agg = fx.table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        scaled_round(decimal_mean(F.col("l_discount")), 5).alias("m"), scaled_round(F.coalesce(F.stddev_samp("l_extendedprice"), F.lit(0.0)), 3).alias("s"))
    return agg.select("l_partkey", mean_std(F.col("m"), F.col("s")).alias("text"), general_6g(F.col("m") * 1e5).alias("big"))


@query("run_comparison_rows", OPER + f""", {PROFILE} select op.run_id, op.d, op.s, tp, prediction_count, tp > 0 conditional_defined, reason undefined_reason, round((select count(*) from orders)/inference_seconds, 6) evaluation_fps,
    round(model_bytes/1048576e0, 9) checkpoint_size_mib, round(tn.training_seconds, 4) training_seconds,
    array_to_string(list_filter([case when status<>'complete' then 'incomplete_training' end, case when tn.seed<>op.s then 'seed_mismatch' end, case when tn.model_sha256<>cp.model_sha256 then 'model_mismatch' end], lambda x: x is not null), ';') problems
    from op join cp using (run_id) join tn using (run_id)""")
def run_comparison_rows(spark, sf):
    n = fx.det_images(spark, sf).agg(F.count("*").alias("image_count"))
    m = operating_rows(spark, sf).crossJoin(F.broadcast(n))
    out = comparison.run_comparison_rows(m, training_rows(spark, sf), compute_rows(spark, sf), F.col("image_count"))
    return round_cols(round_cols(round_cols(out, ["evaluation_fps"], 6), ["checkpoint_size_mib"]), ["training_seconds"], 4)


@query("check_factorial_grid", """with g as (select n_name detector, o_orderpriority condition, count(*) n from orders join customer on o_custkey=c_custkey join nation on n_nationkey=c_nationkey group by all),
    e as (select r_name detector, condition from region, (select distinct o_orderpriority condition from orders)), full_grid as (select n_name detector, condition from nation, (select distinct o_orderpriority condition from orders))
    select detector, condition, coalesce(n, 0) n, case when e.detector is null then 'unexpected' when g.detector is null then 'missing' else 'duplicate' end problem
    from full_grid e full join g using (detector, condition) where e.detector is null or g.detector is null or n > 1""")
def check_factorial_grid(spark, sf):
    rows = fx.table(spark, sf, "orders").join(fx.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        fx.table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("detector"), F.col("o_orderpriority").alias("condition"))
    dims = [fx.table(spark, sf, "nation").select(F.col("n_name").alias("detector")), fx.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("condition")).distinct()]
    return comparison.check_factorial_grid(rows, dims, ["detector", "condition"])


@query("reconcile_metrics", """with a as (select l_partkey, sum(l_quantity)/count(*) as value from lineitem group by l_partkey), p as (select p_partkey l_partkey, p_size::double as value from part)
    select l_partkey, round(a.value, 9) actual, p.value published from a full join p using (l_partkey) where not coalesce(abs(a.value-p.value) <= 0.5e0, false) and not (a.value is null and p.value is null)""")
def reconcile_metrics(spark, sf):
    actual = fx.table(spark, sf, "lineitem").groupBy("l_partkey").agg((F.sum("l_quantity") / F.count("*")).alias("value"))
    published = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("value"))
    return round_cols(comparison.reconcile(actual, published, ["l_partkey"], tolerance=0.5), ["actual"])


POINTS = RUNS + f""", {PROFILE}, pts as (select rt.d, rt.s, rt.run_id, map_50_95, recall, throughput_fps, mean_latency_ms, total_parameters, estimated_gflops from rt join cp using (run_id)),
    pan as (select d, s, unnest(['a','b','c','d']) panel, unnest(['higher','lower','lower','lower']) x_direction, unnest([throughput_fps, mean_latency_ms, total_parameters::double, estimated_gflops]) x,
    unnest([map_50_95, recall, map_50_95, recall]) y from pts), dr as (select panel, d, s, case when x_direction='higher' then x else -x end x, y from pan)"""


def points(spark, sf):
    rows = run_rows(spark, sf)
    recalls = rows.select("d", "s", "recall")
    return comparison.join_accuracy_compute(rows.select("d", "s", "run_id", "map_50_95"), recalls, compute_rows(spark, sf))


@query("join_accuracy_compute", POINTS + " select d, s, run_id, round(map_50_95, 9) map_50_95, round(recall, 9) recall, round(throughput_fps, 6) throughput_fps, round(mean_latency_ms, 6) mean_latency_ms, total_parameters, estimated_gflops from pts")
def join_accuracy_compute(spark, sf):
    return round_cols(round_cols(points(spark, sf), ["map_50_95", "recall"]), ["throughput_fps", "mean_latency_ms"], 6)


@query("accuracy_compute_violations", OPER + f""", {PROFILE}, ac as (select run_id, d, s from op where not (d=0 and s=137)), co as (select run_id, s seed from cp where not (d=1 and s=17) union all select run_id, 1000 from cp where d=0 and s=17),
    rc as (select d, s from op where not (d=1 and s=42))
    select run_id, 'duplicate_compute_run' problem from co group by run_id having count(*) > 1 union all select run_id, 'no_accuracy_row' from co where run_id not in (select run_id from ac)
    union all select run_id, 'no_compute_row' from ac where run_id not in (select run_id from co) union all select run_id, 'no_selected_recall' from ac where (d, s) not in (select (d, s) from rc)
    union all select ac.run_id, 'seed_mismatch' from ac join co using (run_id) where seed <> s union all select run_id, 'seed_grid_differs' from ac where s in (select s from ac group by s having count(distinct d) < 2)""")
def accuracy_compute_violations(spark, sf):
    at = lambda d, s, c="s": (F.col("d") == d) & (F.col(c) == s)
    ops, comp = operating_rows(spark, sf), compute_rows(spark, sf).select("run_id", "d", "seed")
    extra = comp.filter(at(0, 17, "seed")).withColumn("seed", F.lit(1000))
    return comparison.accuracy_compute_violations(
        ops.filter(~at(0, 137)).select("run_id", "d", "s"), ops.filter(~at(1, 42)).select("d", "s"), comp.filter(~at(1, 17, "seed")).unionByName(extra))


@query("panel_points", POINTS + " select panel, d, s, x_direction, round(x, 6) x, round(y, 9) y from pan")
def panel_points(spark, sf):
    return round_cols(round_cols(comparison.panel_points(points(spark, sf)), ["x"], 6), ["y"])


@query("directed_objective", POINTS + " select panel, d, s, round(x, 6) x, round(y, 9) y from dr")
def directed_objective(spark, sf):
    return round_cols(round_cols(comparison.directed_objective(points(spark, sf)), ["x"], 6), ["y"])


@query("strict_dominance", POINTS + """, sp as (select panel, d, min(x) nx, max(x) mx, min(y) ny, max(y) my from dr group by panel, d)
    select a.panel, max(case when a.nx > b.mx and a.ny > b.my then a.d end)::int dominant from sp a join sp b on a.panel=b.panel and a.d<>b.d group by a.panel""")
def strict_dominance(spark, sf):
    return comparison.strict_dominance(points(spark, sf))


@query("union_detectors", f"with {fx.sql_views('pr')} select image_id, pidx, d, s, score, row_number() over (partition by s, image_id order by score desc, d, pidx)::int position from pr")
def union_detectors(spark, sf):
    """Both detectors' rows of each image in one score order."""
    from pyspark.sql import Window

    p = fx.det_predictions(spark, sf).select("image_id", "pidx", "d", "s", "score")
    both = p.filter("d = 0").unionByName(p.filter("d = 1"))
    order = Window.partitionBy("s", "image_id").orderBy(F.desc("score"), "d", "pidx")
    return both.withColumn("position", F.row_number().over(order))


@query("intersect_groups", f"with {fx.sql_views('im', 'tg')} select patient_group from im where image_id in (select image_id from tg) intersect select patient_group from im where image_id not in (select image_id from tg)")
def intersect_groups(spark, sf):
    """Groups that hold both positive and negative images."""
    images, targets = fx.det_images(spark, sf), fx.det_targets(spark, sf).select("image_id")
    return images.join(targets, "image_id", "left_semi").select("patient_group").intersect(images.join(targets, "image_id", "left_anti").select("patient_group"))


@query("except_ids", "select o_orderkey image_id from orders except select l_orderkey from lineitem")
def except_ids(spark, sf):
    return fx.det_images(spark, sf).select("image_id").subtract(fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image_id")))


@query("distinct_counts", f"with {fx.sql_views('pr', 'im')} select count(distinct patient_group) patients, count(distinct s) seeds, count(distinct image_id) images from pr join im using (image_id)")
def distinct_counts(spark, sf):
    joined = fx.det_predictions(spark, sf).join(fx.det_images(spark, sf), "image_id")
    return joined.agg(F.count_distinct("patient_group").alias("patients"), F.count_distinct("s").alias("seeds"), F.count_distinct("image_id").alias("images"))
