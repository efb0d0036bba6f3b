"""Matching and operating-point queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxlens.functions import geometry
from boxlens.operators import ap, matching, metrics
from boxlens.plans import fixtures as fx
from boxlens.plans.catalog import query
from boxlens.plans.oracle_parts import (IOU_SQL, METRIC_COLS, RATIOS, d, evidence, ranked, rounded, sums, with_levels,
                                        with_match)

RUN = matching.RUN


def round_cols(df, cols, digits=9):
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def evidence_of(spark, sf, images=False):
    return metrics.operating_evidence(
        fx.det_predictions(spark, sf), fx.det_targets(spark, sf), fx.runs(spark), images=fx.det_images(spark, sf) if images else None,
        image_partitions=fx.image_partitions(spark, sf) if images else None,
    )


@query("box_xywh_to_xyxy", f"with {fx.sql_views('b')} select image_id, ln, x1, y1, x1+w x2, y1+h y2 from b")
def box_xywh_to_xyxy(spark, sf):
    b = fx.boxes(spark, sf)
    c = geometry.corners_from_xywh(*[F.col(x) for x in ("x1", "y1", "w", "h")])
    return b.select("image_id", "ln", *[v.alias(k) for k, v in c.items()])


@query("box_area", f"with {fx.sql_views('b')} select label, count(*) boxes, sum(w*h)::bigint area from b group by label")
def box_area(spark, sf):
    b = fx.boxes(spark, sf).withColumn("a", geometry.area(F.col("w"), F.col("h")))
    return b.groupBy("label").agg(F.count("*").alias("boxes"), F.sum("a").alias("area"))


@query("pairwise_iou", f"""with {fx.sql_views('pr', 'tg')} select d, s, p.image_id, pidx, tidx, p.label, round({IOU_SQL}, 9) iou
    from pr p join tg t on p.image_id=t.image_id and p.label=t.label where {IOU_SQL} > 0""")
def pairwise_iou(spark, sf):
    pairs = matching.pairwise_iou(fx.det_predictions(spark, sf), fx.det_targets(spark, sf))
    return pairs.select(*RUN, "image_id", "pidx", "tidx", "label", F.round("iou", 9).alias("iou"))


@query("score_filter", f"with {fx.sql_views('pr')} select d, s, count(*) n from pr where score >= 0.25e0 group by d, s")
def score_filter(spark, sf):
    return matching.score_filter(fx.det_predictions(spark, sf), 0.25).groupBy(*RUN).agg(F.count("*").alias("n"))


@query("rank_detections", f"with {fx.sql_views('dpr')} select d, s, image_id, pidx, rank::int rank from {ranked('dpr', 0.001, 50)}")
def rank_detections(spark, sf):
    dense = fx.dense(fx.det_predictions(spark, sf), "pidx")
    return matching.rank_detections(matching.score_filter(dense, 0.001), RUN, 50).select(*RUN, "image_id", "pidx", "rank")


@query("greedy_match", with_match(["pr", "tg"], score=0.0) + "select d, s, image_id, pidx, tidx, label, score, round(iou, 9) iou from mt")
def greedy_match(spark, sf):
    m = matching.greedy_match(fx.det_predictions(spark, sf), fx.det_targets(spark, sf))
    return round_cols(m.drop("rank"), ["iou"])


@query("greedy_match_dense", with_match(["dpr", "dtg"], "dpr", "dtg", score=0.05, cap=50) + "select d, s, image_id, pidx, tidx, label, score, round(iou, 9) iou from mt")
def greedy_match_dense(spark, sf):
    p, t = fx.dense(fx.det_predictions(spark, sf), "pidx"), fx.dense(fx.det_targets(spark, sf), "tidx")
    return round_cols(matching.greedy_match(p, t, score_threshold=0.05, max_detections=50).drop("rank"), ["iou"])


@query("coco_match", with_levels(["pr", "tg"]) + "select d, s, image_id, pidx, rank::int rank, label, score, level_mask::int level_mask from dl")
def coco_match(spark, sf):
    return matching.coco_match(fx.det_predictions(spark, sf), fx.det_targets(spark, sf))


@query("operating_point", with_match(["pr", "tg", "runs"]) + f""", {evidence()}, a as ({sums('d, s')})
    select d, s, tp, fp, fn, tp+fp prediction_count, tp+fn target_count, {rounded(METRIC_COLS)} from (select *, {RATIOS} from a)""")
def operating_point(spark, sf):
    return round_cols(metrics.operating_point(evidence_of(spark, sf)), METRIC_COLS)


@query("operating_point_per_class", with_match(["pr", "tg", "runs"]) + f""", {evidence()}, a as ({sums('d, s, label')})
    select d, s, label, tp, fp, fn, tp+fp prediction_count, tp+fn target_count, {rounded(METRIC_COLS)} from (select *, {RATIOS} from a)""")
def operating_point_per_class(spark, sf):
    return round_cols(metrics.operating_point_per_class(evidence_of(spark, sf), fx.classes(spark), fx.runs(spark)), METRIC_COLS)


@query("operating_point_per_image", with_match(["pr", "tg", "runs", "im"]) + f""", {evidence(images='im')}, a as ({sums('d, s, image_id')})
    select d, s, image_id, tp, fp, fn, tp+fp prediction_count, tp+fn target_count, {rounded(METRIC_COLS)} from (select *, {RATIOS} from a)""")
def operating_point_per_image(spark, sf):
    return round_cols(metrics.operating_point_per_image(evidence_of(spark, sf, True)), METRIC_COLS)


@query("macro_average", with_match(["pr", "tg", "runs"]) + f""", {evidence()}, a as ({sums('d, s, label')})
    select d, s, {', '.join(f'round(avg({m}), 9) macro_{m}' for m in METRIC_COLS)} from (select *, {RATIOS} from a) group by d, s""")
def macro_average(spark, sf):
    per_class = metrics.operating_point_per_class(evidence_of(spark, sf), fx.classes(spark), fx.runs(spark))
    return round_cols(metrics.macro_average(per_class), [f"macro_{m}" for m in METRIC_COLS])


@query("image_evidence", with_match(["pr", "tg", "runs", "im"]) + f""", {evidence(images='im')}
    select d, s, image_id, sum(targets)::bigint target_count, sum(tp)::bigint tp, sum(preds-tp)::bigint fp, sum(targets-tp)::bigint fn,
    round(sum(iou_sum), 9) iou_sum, round(sum(dice_sum), 9) dice_sum from ev group by d, s, image_id""")
def image_evidence(spark, sf):
    return round_cols(metrics.image_evidence(evidence_of(spark, sf, True)), ["iou_sum", "dice_sum"])


@query("box_dice", with_match(["pr", "tg"]) + "select d, s, image_id, pidx, tidx, round(dice, 9) dice from mt")
def box_dice(spark, sf):
    m = matching.greedy_match(fx.det_predictions(spark, sf), fx.det_targets(spark, sf), score_threshold=0.05)
    return matching.box_dice(m).select(*RUN, "image_id", "pidx", "tidx", F.round("dice", 9).alias("dice"))


@query("detection_status", with_match(["pr", "tg", "runs"]) + """
    select r.d, r.s, t.image_id, 'target' side, t.tidx idx, case when m.pidx is null then 'false_negative' else 'true_positive' end status,
        m.pidx other_idx, m.score, round(m.iou, 9) iou
    from tg t cross join runs r left join mt m on m.d=r.d and m.s=r.s and m.image_id=t.image_id and m.tidx=t.tidx
    union all
    select p.d, p.s, p.image_id, 'prediction', p.pidx, case when m.tidx is null then 'false_positive' else 'true_positive' end,
        m.tidx, p.score, round(m.iou, 9)
    from rk p left join mt m on m.d=p.d and m.s=p.s and m.image_id=p.image_id and m.pidx=p.pidx""")
def detection_status(spark, sf):
    return round_cols(matching.detection_status(fx.det_predictions(spark, sf), fx.det_targets(spark, sf), fx.runs(spark)), ["iou"])


BEST_PROXY_SQL = f"""px as (select r.d, r.s, t.image_id, t.tidx, p.pidx, p.score, case when p.pidx is not null then {IOU_SQL} end iou
        from tg t cross join runs r left join pr p on p.d=r.d and p.s=r.s and p.image_id=t.image_id and p.label=t.label),
    pm as (select *, max(iou) over (partition by d, s, image_id, tidx) mx from px),
    bp as (select * from (select *, row_number() over (partition by d, s, image_id, tidx order by (iou >= mx - 1e-12) desc nulls last, score desc nulls last, pidx) o from pm) where o=1)"""


@query("best_proxy", f"""with {fx.sql_views('pr', 'tg', 'runs')}, {BEST_PROXY_SQL}
    select d, s, image_id, tidx, pidx proxy_pidx, coalesce(score, 0) proxy_score, round(coalesce(iou, 0), 9) proxy_iou from bp""")
def best_proxy(spark, sf):
    out = matching.best_proxy(fx.det_predictions(spark, sf), fx.det_targets(spark, sf), fx.runs(spark)).drop("label")
    return round_cols(out, ["proxy_iou"])


@query("max_score", f"with {fx.sql_views('pr')} select d, s, max(score) max_score from pr group by d, s")
def max_score(spark, sf):
    return metrics.max_score(fx.det_predictions(spark, sf), fx.runs(spark))


@query("undefined_reason", with_match(["pr", "tg", "runs"]) + f""", {evidence()}, a as ({sums('d, s, label')})
    select d, s, label, tp, case when tp > 0 then '' when tp+fp=0 then 'no_detections_at_frozen_score_threshold'
    else 'no_iou_qualified_true_positive' end reason from a""")
def undefined_reason(spark, sf):
    rows = metrics.operating_point_per_class(evidence_of(spark, sf), fx.classes(spark), fx.runs(spark))
    return rows.select(*RUN, "label", "tp", metrics.undefined_reason(F.col("tp"), F.col("prediction_count")).alias("reason"))
