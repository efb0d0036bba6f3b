"""Resampling statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxlens.functions.hashing import stable_seed, stable_seed_le
from boxlens.functions.ratios import finite_or_null
from boxlens.operators import comparison, matching, metrics, resampling, stats
from boxlens.plans import fixtures as fx
from boxlens.plans.catalog import query
from boxlens.plans.detection import round_cols
from boxlens.plans.oracle_parts import RATIOS, image_evidence_block, match_block

SEED = 7
B, P = 2000, 5000  # draws of every statistic
SEEDS = list(fx.SEEDS)
SEVEN = list(comparison.METRIC_VECTOR)


def groups(spark, sf):
    return fx.det_images(spark, sf).select("image_id", "patient_group")


def run_evidence(spark, sf):
    return metrics.image_evidence(metrics.operating_evidence(fx.det_predictions(spark, sf), fx.det_targets(spark, sf), fx.runs(spark)))


def group_sums(spark, sf, of=None, group="patient_group"):
    """Evidence per run and group."""
    return stats.matched_group_evidence(fx.det_predictions(spark, sf), fx.det_targets(spark, sf), fx.runs(spark), of or groups(spark, sf), group=group)


def paired_runs(spark, sf):
    """Evidence per run and group, detection blocks, and the number of groups."""
    numbered, n = resampling.numbered_groups(groups(spark, sf))
    blocks = resampling.pair_blocks(matching.coco_match(fx.det_predictions(spark, sf), fx.det_targets(spark, sf)), numbered)
    return group_sums(spark, sf, numbered, "g"), blocks, n


def hex8(expr):
    return f"('0x' || substr(md5({expr}), 1, 8))::bigint"


def groups_sql(b: int, p: int) -> str:
    return f"""gi as (select patient_group, row_number() over (order by patient_group) - 1 g from (select distinct patient_group from im)),
    gn as (select count(*) n from gi),
    bw as (select rep::int rep, patient_group, count(*) w from (select rep, {hex8(f"'{SEED}:group:' || rep || ':' || j.g")} % n g from range({b}) r(rep), gi j, gn) x join gi using (g) group by all),
    swp as (select patient_group, rep::int rep, {hex8(f"'{SEED}:swap:' || rep || ':' || patient_group")} % 2 = 1 swap from gi, range({p}) r(rep)),
    sw as (select rep::int rep, [17, 42, 137][1 + {hex8(f"'{SEED}:seed:' || rep || ':' || j")} % 3] s, count(*) sw from range({b}) r(rep), range(3) k(j) group by all)"""


VIEWS = f"with recursive {fx.sql_views('pr', 'tg', 'runs', 'im')}"
BASE = f"{VIEWS}, {groups_sql(B, P)}"
GROUP_EVIDENCE = f", {match_block('o', 'pr', 'tg')}, {image_evidence_block('o', 'tg', 'runs')}, ge as (select d, s, patient_group, sum(target_count) target_count, sum(tp) tp, sum(fp) fp, sum(fn) fn, sum(iou_sum) iou_sum, sum(dice_sum) dice_sum from ie_o join im using (image_id) group by all)"
EVID = BASE + GROUP_EVIDENCE
def weighted_sums(keys, source, w):
    return f"select {keys}, " + ", ".join(f"sum({w}*{c}) {c}" for c in stats.COUNTS) + f" from {source} group by {keys}"


ROLE = "case when (d=1) = swap then 'a' else 'b' end"

def rnd(cols, d=9):
    return ", ".join(f"round({c}, {d}) as {c}" for c in cols)


@query("join_patient_cluster", f"with {fx.sql_views('im', 'tg')} select patient_group, count(*) targets, count(distinct image_id) images from tg join im using (image_id) group by patient_group")
def join_patient_cluster(spark, sf):
    joined = stats.join_patient_cluster(fx.det_targets(spark, sf), groups(spark, sf))
    return joined.groupBy("patient_group").agg(F.count("*").alias("targets"), F.count_distinct("image_id").alias("images"))


@query("patient_cluster_violations", """with g as (select distinct l_orderkey image_id, case when l_returnflag='A' then '' else l_returnflag end patient_group from lineitem)
    select o_orderkey image_id, 'missing_group' problem from orders where o_orderkey not in (select image_id from g)
    union all select image_id, 'blank_group' from g where patient_group='' union all select image_id, 'duplicate_mapping' from g group by image_id having count(*) > 1""")
def patient_cluster_violations(spark, sf):
    flag = F.when(F.col("l_returnflag") == "A", "").otherwise(F.col("l_returnflag"))
    mapping = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image_id"), flag.alias("patient_group")).distinct()
    return stats.patient_cluster_violations(fx.det_images(spark, sf), mapping)


@query("stable_rng_seed", f"""select o_orderkey image_id, ('0x' || substr(sha256('17:' || o_orderkey), 1, 8))::bigint seed_be,
    ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::bigint seed_le from (select o_orderkey, sha256('17' || chr(0) || o_orderkey || chr(0) || 'noise_s1') h from orders)""")
def stable_rng_seed(spark, sf):
    return fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("image_id"), stable_seed(17, F.col("o_orderkey")).alias("seed_be"), stable_seed_le(17, F.col("o_orderkey"), F.lit("noise_s1")).alias("seed_le")
    )


@query("cluster_bootstrap_weights", BASE + f" select patient_group, string_agg(coalesce(w, 0)::varchar, ',' order by r.rep) weights from (select patient_group, rep::int rep from gi, range({B}) r(rep)) r left join bw using (rep, patient_group) group by patient_group")
def cluster_bootstrap_weights(spark, sf):
    """All multiplicities of a group in one text, in the order of the replicates."""
    return stats.bootstrap_texts(groups(spark, sf), B, SEED)


@query("seed_bootstrap_weights", BASE + " select rep, s, sw, (select count(*) from pr where pr.s = sw.s) predictions from sw")
def seed_bootstrap_weights(spark, sf):
    sizes = fx.det_predictions(spark, sf).groupBy("s").agg(F.count("*").alias("predictions"))
    return stats.seed_bootstrap_weights(spark, SEEDS, B, SEED).join(sizes, "s").select("rep", "s", "sw", "predictions")


@query("permutation_swaps", BASE + " select patient_group, string_agg(swap::int::varchar, '' order by rep) swaps from swp group by patient_group")
def permutation_swaps(spark, sf):
    """All bits of a group in one text, in the order of the replicates."""
    return stats.swap_texts(groups(spark, sf), P, SEED)


@query("weighted_metrics")
def weighted_metrics(spark, sf):
    ev, blocks, n = paired_runs(spark, sf)
    return round_cols(resampling.weighted_metrics(ev, blocks, resampling.Bootstrap(n, B, SEED), ["d", "s"]).select("rep", "d", "s", *SEVEN), SEVEN)


@query("hybrid_metrics")
def hybrid_metrics(spark, sf):
    ev, blocks, _ = paired_runs(spark, sf)
    return round_cols(resampling.hybrid_metrics(ev, blocks, resampling.Swaps(1, P, SEED), ["s"]).select("rep", "role", "s", *SEVEN), SEVEN)


@query("hybrid_swap", EVID + f" select rep, {ROLE} as role, s, sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn from ge join swp using (patient_group) group by all")
def hybrid_swap(spark, sf):
    ev = group_sums(spark, sf)
    return stats.hybrid_sums(ev, P, SEED, 1, ["s"]).select("rep", "role", "s", "tp", "fp", "fn")


FIVE = ["precision", "recall", "f1", "iou", "dice"]
SEEDAVG = EVID + f""", ws as ({weighted_sums('rep, d, s', 'ge join bw using (patient_group)', 'w')}), mv as (select rep, d, s, precision, recall, f1, mean_iou iou, mean_dice dice from (select *, {RATIOS} from ws)),
    lg as (select * from (select rep, d, s, unnest([{', '.join(f"'{m}'" for m in FIVE)}]) metric, unnest([{', '.join(FIVE)}]) v from mv)),
    sa as (select rep, d, metric, case when count(*) = count(v) then sum(sw*v)/sum(sw) end v from lg join sw using (rep, s) group by rep, d, metric)"""


@query("seed_average_estimate", SEEDAVG + " select rep, d, metric, round(v, 9) as value from sa")
def seed_average_estimate(spark, sf):
    sums = stats.bootstrap_sums(group_sums(spark, sf), groups(spark, sf), B, SEED, ["d", "s"])
    m = stats.count_metrics(sums, ["rep", "d", "s"])
    return round_cols(stats.seed_average(m, stats.seed_bootstrap_weights(spark, SEEDS, B, SEED), ["d"]), ["value"])


RECALLS = EVID + ", rr as (select rep, d, s, sum(w*tp)::double/sum(w*(tp+fn)) recall from ge join bw using (patient_group) group by all)"


def bootstrap_recall(spark, sf):
    sums = stats.bootstrap_sums(group_sums(spark, sf), groups(spark, sf), B, SEED, ["d", "s"])
    return sums.withColumn("recall", F.col("tp").cast("double") / (F.col("tp") + F.col("fn")))


@query("percentile_ci", RECALLS + """ select d, s, round(quantile_cont(recall, 0.025e0), 9) ci_low, round(quantile_cont(recall, 0.975e0), 9) ci_high, count(recall) "valid" from rr group by d, s""")
def percentile_ci(spark, sf):
    return round_cols(stats.percentile_ci(bootstrap_recall(spark, sf), ["d", "s"], "recall"), ["ci_low", "ci_high"])


@query("permutation_p_value", EVID + f""", hb as (select rep, s, {ROLE} as role, sum(tp)::double/sum(tp+fn) recall from ge join swp using (patient_group) group by all),
    nl as (select rep, s, max(case when role='a' then recall end) - max(case when role='b' then recall end) dif from hb group by rep, s),
    ob as (select s, max(case when d=0 then recall end) - max(case when d=1 then recall end) obs from (select d, s, sum(tp)::double/sum(tp+fn) recall from ge group by all) group by s)
    select s, round((1 + count(*) filter (abs(dif) >= abs(obs) - 1e-15))::double/(count(dif)+1), 9) p_value from nl join ob using (s) group by s""")
def permutation_p_value(spark, sf):
    ev = group_sums(spark, sf)
    recall = F.sum("tp").cast("double") / F.sum(F.col("tp") + F.col("fn"))
    swapped = stats.hybrid_sums(ev, P, SEED, 1, ["s"]).groupBy("rep", "s", "role").agg(recall.alias("recall"))
    gap = lambda side, x, y: F.max(F.when(F.col(side) == x, F.col("recall"))) - F.max(F.when(F.col(side) == y, F.col("recall")))
    null = swapped.groupBy("rep", "s").agg(gap("role", "a", "b").alias("null_diff"))
    observed = ev.groupBy("d", "s").agg(recall.alias("recall")).groupBy("s").agg(gap("d", 0, 1).alias("obs"))
    return null.join(observed, "s").groupBy("s").agg(F.round(stats.p_value(F.col("null_diff"), F.col("obs")), 9).alias("p_value"))


C_KEYS = "condition, d, s"
C_EVID = f"{{}} {match_block('c', 'cpr', 'tg', C_KEYS)}, {image_evidence_block('c', 'tg', 'cruns', C_KEYS)}, ge as (select condition, d, s, patient_group, sum(target_count) target_count, sum(tp) tp, sum(fp) fp, sum(fn) fn, sum(iou_sum) iou_sum, sum(dice_sum) dice_sum from ie_c join im using (image_id) group by all)"
C_VIEWS = f"with recursive {fx.sql_views('cpr', 'tg', 'cruns', 'im')}"
CBASE = C_EVID.format(f"{C_VIEWS}, {groups_sql(B, P)},")
C_RUN = ("condition", "d", "s")


def condition_evidence(spark, sf):
    ev = metrics.operating_evidence(fx.condition_predictions(spark, sf), fx.det_targets(spark, sf), fx.condition_runs(spark), C_RUN)
    return metrics.image_evidence(ev, C_RUN)


@query("retention_estimand", CBASE + """, rc as (select rep, condition, d, sum(w*tp)::double/sum(w*(tp+fn)) v from ge join bw using (patient_group) group by all)
    select a.rep, a.condition, a.d, 'recall' metric, 'raw' estimand, round(a.v, 9) as value from rc a union all
    select a.rep, a.condition, a.d, 'recall', 'retention', round(a.v/b.v, 9) from rc a join rc b on a.rep=b.rep and a.d=b.d and b.condition='clean'""")
def retention_estimand(spark, sf):
    ev = stats.matched_group_evidence(fx.condition_predictions(spark, sf), fx.det_targets(spark, sf), fx.condition_runs(spark), groups(spark, sf), C_RUN)
    sums = stats.bootstrap_sums(ev, groups(spark, sf), B, SEED, ["condition", "d"])
    long = sums.select("rep", "condition", "d", (F.col("tp").cast("double") / (F.col("tp") + F.col("fn"))).alias("value"), F.lit("recall").alias("metric"))
    clean = long.filter("condition = 'clean'").drop("condition")
    return round_cols(stats.with_retention(long, clean, ["condition", "d"]), ["value"]).select("rep", "condition", "d", "metric", "estimand", "value")


OUT = ["estimate_a", "estimate_b", "difference", "a_ci_low", "a_ci_high", "b_ci_low", "b_ci_high", "difference_ci_low", "difference_ci_high", "p_raw"]


@query("analyze_pair")
def analyze_pair(spark, sf):
    numbered, n = resampling.numbered_groups(groups(spark, sf))
    blocks = resampling.pair_blocks(matching.coco_match(fx.det_predictions(spark, sf), fx.det_targets(spark, sf)), numbered)
    out = resampling.analyze_pair(run_evidence(spark, sf), blocks, numbered, n, (0, 1), SEEDS, B, P, SEED)
    return round_cols(out, [*OUT, "effect_size"])


HOLM_W = "rows between unbounded preceding and current row"


@query("corruption_statistics")
def corruption_statistics(spark, sf):
    numbered, n = resampling.numbered_groups(groups(spark, sf))
    dets = matching.coco_match(fx.condition_predictions(spark, sf), fx.det_targets(spark, sf), C_RUN)
    blocks = resampling.pair_blocks(dets, numbered, ("condition",))
    out = resampling.analyze_pair(condition_evidence(spark, sf), blocks, numbered, n, (0, 1), [17], B, P, SEED, ("condition",), "clean")
    return round_cols(stats.holm_by_family(out), [*OUT, "effect_size", "p_holm"])


# p-values per (metric, estimand, condition) counted from the orders of each nation.
PVALS = """pv as (select o_orderpriority metric, o_orderstatus estimand, case when n_nationkey=0 then 'clean' else n_name end condition,
    (count(*) filter (o_totalprice > 400000) + 1)::double/(count(*) + 1) p_raw, case when count(*) > 2 then 'complete' else 'not_estimable' end status
    from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey group by all)"""


def p_values(spark, sf):
    nation = F.when(F.col("n_nationkey") == 0, "clean").otherwise(F.col("n_name"))
    joined = fx.table(spark, sf, "orders").join(fx.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        fx.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("o_orderpriority").alias("metric"), F.col("o_orderstatus").alias("estimand"), nation.alias("condition")).agg(
        ((F.count_if(F.col("o_totalprice") > 400000) + 1).cast("double") / (F.count("*") + 1)).alias("p_raw"),
        F.when(F.count("*") > 2, "complete").otherwise("not_estimable").alias("status"))


@query("holm_adjust", f"""with {PVALS}, st as (select *, count(*) over (partition by metric, estimand) sz, row_number() over (partition by metric, estimand order by p_raw, condition) rk from pv)
    select metric, estimand, condition, round(p_raw, 9) p_raw, sz holm_family_size, round(max(least(1, (sz-rk+1)*p_raw)) over (partition by metric, estimand order by p_raw, condition {HOLM_W}), 9) p_holm from st""")
def holm_adjust(spark, sf):
    return round_cols(stats.holm_adjust(p_values(spark, sf).drop("status"), ["metric", "estimand"], tie=["condition"]), ["p_raw", "p_holm"])


FAMILY = f"""{PVALS}, fam as (select *, case when condition<>'clean' and status='complete' then p_raw end pf from pv),
    st as (select *, count(pf) over (partition by metric, estimand) sz, row_number() over (partition by metric, estimand, pf is null order by pf, condition) rk from fam),
    hf as (select *, max(case when pf is not null then least(1, (sz-rk+1)*pf) end) over (partition by metric, estimand, pf is null order by pf, condition {HOLM_W}) ph from st)"""


@query("holm_by_family", f"with {FAMILY} select metric, estimand, condition, status, round(p_raw, 9) p_raw, round(case when condition='clean' then p_raw else ph end, 9) p_holm, case when condition='clean' then 1 else sz end holm_family_size from hf")
def holm_by_family(spark, sf):
    return round_cols(stats.holm_by_family(p_values(spark, sf)), ["p_raw", "p_holm"])


SEVENTH = "(['precision','recall','f1','iou','dice','map_50','map_50_95'])"
CLEAN = f"""cl as (select n_name condition, {SEVENTH}[1 + o_orderkey % 7] metric, (count(*) filter (o_totalprice > 400000) + 1)::double/(count(*) + 1) p_raw, case when count(*) > 60 then 'complete' else 'not_estimable' end status
    from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey group by all)"""


@query("holm_clean_family", f"""with {CLEAN}, ok as (select *, count(*) over (partition by condition) = 7 and count(*) filter (status='complete') over (partition by condition) = 7 whole from cl),
    st as (select *, row_number() over (partition by condition order by p_raw, metric) rk from ok)
    select condition, metric, status, round(p_raw, 9) p_raw, case when whole then 'corrected' else 'not_seven_estimable_endpoints' end family_status, case when whole then 7 else 0 end holm_family_size,
    round(case when whole then max(least(1, (7-rk+1)*p_raw)) over (partition by condition order by p_raw, metric {HOLM_W}) end, 9) p_holm from st""")
def holm_clean_family(spark, sf):
    names = F.array(*[F.lit(m) for m in SEVEN])
    joined = fx.table(spark, sf, "orders").join(fx.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        fx.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = joined.groupBy(F.col("n_name").alias("condition"), F.element_at(names, (1 + F.col("o_orderkey") % 7).cast("int")).alias("metric")).agg(
        ((F.count_if(F.col("o_totalprice") > 400000) + 1).cast("double") / (F.count("*") + 1)).alias("p_raw"),
        F.when(F.count("*") > 60, "complete").otherwise("not_estimable").alias("status"))
    out = stats.holm_clean_family(rows, ["condition"])
    return round_cols(out, ["p_raw", "p_holm"]).withColumn("holm_family_size", F.col("holm_family_size").cast("int"))


@query("nonfinite_to_null", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_discount = 0 then null else round(l_tax/l_discount, 9) end ratio from lineitem""")
def nonfinite_to_null(spark, sf):
    raw = F.when(F.col("l_discount") == 0, F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.col("l_tax") / F.col("l_discount"))
    li = fx.table(spark, sf, "lineitem").withColumn("ratio", finite_or_null(raw))
    return round_cols(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ratio"), ["ratio"])


GEVID = f"with recursive {fx.sql_views('gpr', 'tg', 'runs')}, {match_block('g', 'gpr', 'tg')}, {image_evidence_block('g', 'tg', 'runs')}, go as (select d, s, sum(tp)::bigint tp, sum(tp+fp)::bigint prediction_count, sum(target_count)::bigint target_count, sum(iou_sum) iou_sum, sum(dice_sum) dice_sum from ie_g group by d, s)"


def degenerate_counts(spark, sf):
    ev = metrics.operating_evidence(fx.degenerate_predictions(spark, sf), fx.det_targets(spark, sf), fx.runs(spark))
    return metrics.operating_point(ev)


def declared(spark):
    return spark.createDataFrame([(1, 137, 0)], "d int, s int, prediction_count bigint")


ELIG = GEVID + ", el as (select *, tp=0 undefined, count(*) filter (tp=0) over (partition by s) = 0 pair_complete from go)"


@query("seed_eligibility", ELIG + " select d, s, tp, prediction_count, undefined, pair_complete, case when d=1 and s=137 then undefined and prediction_count=0 else not undefined end matches_declaration from el")
def seed_eligibility(spark, sf):
    return stats.seed_eligibility(degenerate_counts(spark, sf), declared(spark))


def endpoint_rows(rows):
    """Detector means of four metrics; a NULL seed leaves the mean undefined."""
    m = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias("v")) for n, c in (("precision", "precision"), ("recall", "recall"), ("iou", "mean_iou"), ("dice", "mean_dice"))])).alias("m")
    return rows.select("d", "s", m).groupBy("d", "m.metric").agg(F.when(F.count_if(F.col("m.v").isNull()) == 0, F.avg("m.v")).alias("estimate"))


ENDPOINTS = ELIG + """, rt as (select d, s, pair_complete, case when prediction_count=0 then 0 else tp::double/prediction_count end as prec, tp::double/target_count rec, case when tp>0 then iou_sum/tp end iou, case when tp>0 then dice_sum/tp end dice from el),
    lg as (select d, s, pair_complete, unnest(['precision','recall','iou','dice']) metric, unnest([prec, rec, iou, dice]) v from rt),
    mg as (select d, metric, avg(v) estimate from lg where metric in ('precision','recall') or pair_complete group by d, metric),
    ids as (select array_to_string(list_sort(list(distinct s)), ';') all_ids, array_to_string(list_sort(list(distinct s) filter (pair_complete)), ';') ok_ids, array_to_string(list_sort(list(distinct s) filter (not pair_complete)), ';') bad_ids from el)"""
MERGED = ENDPOINTS + """, mr as (select d, metric, round(estimate, 9) estimate, case when metric in ('iou','dice') then ok_ids else all_ids end paired_seed_ids, case when metric in ('iou','dice') then bad_ids else '' end excluded_pair_seed_ids,
    case when metric in ('iou','dice') then 'paired_complete_case_conditional_metric' else 'all_predeclared_attempts' end seed_eligibility_policy from mg cross join ids)"""


def merged(spark, sf):
    counts = degenerate_counts(spark, sf)
    elig = stats.seed_eligibility(counts, declared(spark))
    complete = counts.join(elig.filter("pair_complete").select("d", "s"), ["d", "s"])
    return round_cols(stats.merge_endpoint_rows(endpoint_rows(counts), endpoint_rows(complete), elig), ["estimate"])


@query("merge_endpoint_rows", MERGED + " select * from mr")
def merge_endpoint_rows(spark, sf):
    return merged(spark, sf)


@query("decorate_rows", f"""with {PVALS} select pv.*, round(p_raw, 9) p_holm, 1::bigint holm_family_size, 'robustness' scope, (select count(*) from orders) image_count, (select count(distinct o_custkey) from orders) patient_group_count,
    0.95::double confidence_level, {B} bootstrap_resamples from (select metric, estimand, condition, status, round(p_raw, 9) p_raw from pv) pv""")
def decorate_rows(spark, sf):
    counts = fx.det_images(spark, sf).agg(F.count("*").alias("image_count"), F.count_distinct("patient_group").alias("patient_group_count"))
    rows = round_cols(p_values(spark, sf), ["p_raw"])
    return stats.decorate_rows(rows, "robustness", counts, confidence_level=0.95, bootstrap_resamples=B)


@query("diff_significance", f"""with {FAMILY}, cur as (select metric, estimand, condition, status='complete' and coalesce(case when condition='clean' then p_raw else ph end < 0.5e0, false) sig from hf),
    arc as (select metric, estimand, condition, status='complete' and coalesce(p_raw < 0.5e0, false) sig from pv)
    select metric, estimand, condition, case when a.sig and not c.sig then 'lost' when not a.sig and c.sig then 'gained' when c.sig then 'kept' else 'never' end change from cur c join arc a using (metric, estimand, condition)""")
def diff_significance(spark, sf):
    rows = p_values(spark, sf)
    current = stats.holm_by_family(rows)
    archived = rows.withColumn("p_holm", F.col("p_raw"))
    return comparison.diff_significance(current, archived, ["metric", "estimand", "condition"], 0.5)
