"""Heat-map, image, case-selection and robustness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxlens.operators import ap, cases, images, matching, metrics
from boxlens.plans import fixtures as fx
from boxlens.plans.catalog import query
from boxlens.plans.detection import round_cols
from boxlens.plans.oracle_parts import IOU_SQL, METRIC_COLS, RATIOS, ap_ctes, image_evidence_block, level_block, match_block
from boxlens.plans.statistics import CBASE, C_RUN, hex8

SEED = 17
PX = """px as (select vec_id image_id, i, i%8 x, i//8 y, embedding[i+1]::double e from embeddings, range(64) r(i)),
    mm as (select image_id, min(e) lo, max(e) hi from px group by image_id), gx as (select image_id, i, x, y, floor(255*(e-lo)/(hi-lo))::int v from px join mm using (image_id))"""
HM = """hm as (select vec_id case_id, i, case when vec_id%50=0 then 0 else abs(embedding[i+1]::double) end v, vec_id%4 x1, vec_id//4%4 y1, vec_id%4+2+vec_id%3 x2, vec_id//4%4+1+vec_id%4 y2 from embeddings, range(64) r(i)),
    hk as (select *, i%8+0.5e0 >= x1 and i%8+0.5e0 < x2 and i//8+0.5e0 >= y1 and i//8+0.5e0 < y2 inside from hm)"""


def gray(spark, sf):
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").cast("array<double>").alias("e"))
    limits = F.struct(F.array_min("e").alias("lo"), F.array_max("e").alias("hi"))
    v = images.let(limits, lambda r: F.transform("e", lambda x: F.floor(255 * (x - r["lo"]) / (r["hi"] - r["lo"])).cast("int")))
    return e.select("image_id", F.lit(8).alias("h"), F.lit(8).alias("w"), v.alias("v"))


def heatmaps(spark, sf):
    k = F.col("vec_id")
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(k % 50 == 0, 0.0).otherwise(F.abs(x)))
    x1, y1 = k % 4, F.floor(k / 4) % 4
    return fx.table(spark, sf, "embeddings").select(k.alias("case_id"), F.lit(8).alias("h"), F.lit(8).alias("w"), v.alias("v"), x1.alias("x1"), y1.alias("y1"), (x1 + 2 + k % 3).alias("x2"), (y1 + 1 + k % 4).alias("y2"))


@query("pixel_box_mask", f"with {HM} select case_id, count(*) filter (inside) pixels, sum(case when inside then i else 0 end)::bigint index_sum from hk group by case_id")
def pixel_box_mask(spark, sf):
    m = images.pixel_box_mask(heatmaps(spark, sf)).select("case_id", F.posexplode("mask").alias("i", "m"))
    return m.groupBy("case_id").agg(F.count_if("m").alias("pixels"), F.sum(F.when(F.col("m"), F.col("i")).otherwise(0)).alias("index_sum"))


@query("heatmap_violations", """with h as (select vec_id case_id, case when vec_id%9=1 then -1 else 1 end neg, vec_id%7 x1, vec_id%7 + vec_id%4 x2 from embeddings)
    select case_id, 'nonfinite_or_negative' "rule" from h where neg<0 union all select case_id, 'box_outside_map' from h where x2>8 union all select case_id, 'empty_box' from h where x2<=x1""")
def heatmap_violations(spark, sf):
    k = F.col("case_id")
    rows = heatmaps(spark, sf).withColumns({"v": F.when(k % 9 == 1, F.transform("v", lambda x: -x - 1)).otherwise(F.col("v")), "x1": k % 7, "x2": k % 7 + k % 4, "y1": F.lit(0), "y2": F.lit(8)})
    return images.heatmap_violations(rows, ["case_id"])


@query("box_attention", f"""with {HM}, t as (select case_id, sum(v) tot, count(*) filter (inside)/64e0 area, sum(v) filter (inside) ins from hk group by case_id), pk as (select * from (select *, row_number() over (partition by case_id order by v desc, i) o from hk) where o=1)
    select case_id, round(tot, 9) total_energy, tot > 1e-12 as "valid", round(case when tot>1e-12 then coalesce(ins, 0)/tot end, 9) energy_in_box, area box_pixel_fraction, case when tot>1e-12 then (i%8)::int end peak_x, case when tot>1e-12 then (i//8)::int end peak_y,
    case when tot>1e-12 then inside end pointing_hit, round(case when tot>1e-12 then coalesce(ins, 0)/tot-area end, 9) energy_lift_over_area from t join pk using (case_id)""")
def box_attention(spark, sf):
    out = images.box_attention(heatmaps(spark, sf)).drop("h", "w", "x1", "y1", "x2", "y2")
    return round_cols(out, ["total_energy", "energy_in_box", "energy_lift_over_area"])


@query("cam_from_channels", """with c as (select vec_id//4 case_id, vec_id%4 channel, i pixel, embedding[i+1]::double a, embedding[i+33]::double g from embeddings, range(32) r(i)), w as (select case_id, channel, avg(g) wt from c group by all),
    s as (select case_id, pixel, greatest(0, sum(wt*a)) cam from c join w using (case_id, channel) group by all), m as (select case_id, max(cam) top from s group by case_id) select case_id, pixel::int pixel, round(case when top>1e-12 then cam/top else 0 end, 9) cam from s join m using (case_id)""")
def cam_from_channels(spark, sf):
    e = fx.table(spark, sf, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    half = F.arrays_zip(F.slice("e", 1, 32).alias("a"), F.slice("e", 33, 32).alias("g"))
    rows = e.select(F.floor(F.col("vec_id") / 4).cast("bigint").alias("case_id"), (F.col("vec_id") % 4).alias("channel"), F.posexplode(half).alias("pixel", "z")).select(
        "case_id", "channel", "pixel", F.col("z.a").alias("activation"), F.col("z.g").alias("gradient"))
    return round_cols(images.cam_from_channels(rows, ["case_id"]), ["cam"])


@query("minmax_to_uint8", f"""with {PX}, d as (select *, case when i=5 then null when i=6 then 'inf'::double when i=7 then '-inf'::double else e end z, image_id%2=1 inv from px), r as (select image_id, min(z) lo, max(z) hi from d where i not in (5,6,7) group by image_id),
    f as (select image_id, i, inv, lo, hi, case when i in (5,7) then lo when i=6 then hi else e end q from d join r using (image_id)) select image_id, i::int i, round_even(((case when inv then hi+lo-q else q end)-lo)*(255e0/(hi-lo)), 0)::int v from f""")
def minmax_to_uint8(spark, sf):
    odd = {5: float("nan"), 6: float("inf"), 7: float("-inf")}
    def defect(x, i):
        out = x
        for at, value in odd.items():
            out = F.when(i == at, F.lit(value)).otherwise(out)
        return out
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.transform(F.col("embedding").cast("array<double>"), defect).alias("e"))
    return e.select("image_id", F.posexplode(images.minmax_to_uint8(F.col("e"), F.col("image_id") % 2 == 1)).alias("i", "v"))


GRID_ROWS = ", ".join(f"('{n}_s{i}', '{n}', '{fam}', '{kind}', '{unit}', {i}, {float(v)!r}e0)" for n, fam, kind, unit, vals in images.CORRUPTIONS for i, v in enumerate(vals, 1))
GRID = f"gd as (select * from (values ('clean', 'clean', 'clean', 'clean', 'none', 0, 0e0), {GRID_ROWS}) g(condition, corruption, family, kind, unit, severity, \"value\"))"


@query("condition_grid", f"with {GRID}, st as (select o_orderpriority stratum, count(*) images from orders group by 1) select gd.*, stratum, images from gd cross join st")
def condition_grid(spark, sf):
    """Condition rows with the images each one covers per stratum."""
    counts = fx.det_images(spark, sf).groupBy("stratum").agg(F.count("*").alias("images"))
    return counts.crossJoin(F.broadcast(images.condition_grid(spark)))


CURVES = """lv as (select 'part_' || p_partkey name, case p_partkey%5 when 0 then 'brightness' when 1 then 'gaussian_noise' when 2 then 'motion_blur' when 3 then 'jpeg' else 'gaussian_blur' end kind,
    row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice)::int severity, case p_partkey%5 when 0 then l_discount*10+0.45e0 when 1 then l_tax*20-0.1e0 when 2 then l_quantity when 3 then l_quantity*3 else l_quantity/10 end as value
    from lineitem join part on l_partkey=p_partkey)"""


@query("validate_severity_curves", f"""with {CURVES}, p as (select name, any_value(kind) kind, count(*) n, max(value) top, min(value) bot, count(*) filter (kind='motion_blur' and not (value=floor(value) and value>=3 and value%2=1)) bm, count(*) filter (kind='jpeg' and not (value=floor(value) and value<=100)) bj, count(*) filter (not value>0) bv from lv group by name),
    dd as (select lv.name, value - lag(value) over (partition by lv.name order by severity) df from lv join p on p.name=lv.name and n<=5), ww as (select name, count(*) filter (df>0) ups, count(*) filter (df<0) downs from dd group by name), f as (select p.*, ups, downs, kind='jpeg' or (kind='brightness' and top<1) falling from p left join ww using (name))
    select name, 'level_count' "rule" from f where n not between 3 and 5 union all select name, 'value_not_positive' from f where bv>0 union all select name, 'noise_above_one' from f where kind='gaussian_noise' and top>1 union all select name, 'motion_kernel' from f where bm>0
    union all select name, 'jpeg_quality' from f where bj>0 union all select name, 'brightness_crosses_one' from f where kind='brightness' and not (top<1 or bot>1) union all select name, 'not_mild_to_severe' from f where n>1 and n<=5 and case when falling then ups>0 else downs>0 end""")
def validate_severity_curves(spark, sf):
    from pyspark.sql import Window

    k = F.col("l_partkey") % 5
    li = fx.table(spark, sf, "lineitem").join(fx.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    q = F.col("l_quantity")
    kind = F.when(k == 0, "brightness").when(k == 1, "gaussian_noise").when(k == 2, "motion_blur").when(k == 3, "jpeg").otherwise("gaussian_blur")
    value = F.when(k == 0, F.col("l_discount") * 10 + F.lit(0.45)).when(k == 1, F.col("l_tax") * 20 - F.lit(0.1)).when(k == 2, q).when(k == 3, q * 3).otherwise(q / 10)
    return images.validate_severity_curves(li.select(F.concat(F.lit("part_"), F.col("l_partkey")).alias("name"), kind.alias("kind"), F.row_number().over(w).alias("severity"), value.alias("value")))


KEY = "'17:' || image_id || ':' || condition"
UNI = lambda *p: f"(({hex8(' || '.join(p))}) + 0.5e0)/4294967296e0"
CLIP = lambda x: f"greatest(0, least(255, round_even({x}, 0)))::int"
REF = lambda i: f"least((({i})%14+14)%14, 14-(({i})%14+14)%14)"
POINT = {
    "brightness": CLIP("v*\"value\""),
    "gaussian_noise": CLIP(f"v + sqrt(-2*ln({UNI(KEY, repr(':'), 'i', repr(':a'))}))*cos(2*pi()*{UNI(KEY, repr(':'), 'i', repr(':b'))})*(\"value\"*255)"),
    "salt_pepper": f"case when {UNI(KEY, repr(':'), 'i', repr(':sp'))} < \"value\"/2 then 255 when {UNI(KEY, repr(':'), 'i', repr(':sp'))} < \"value\" then 0 else v end",
}
ALL_SQL = f"""with {PX}, {GRID}, pt as ({' union all '.join(f"select image_id, condition, i, {expr} v from gx cross join gd where kind='{kind}'" for kind, expr in POINT.items())}),
    gk as (select condition, "value" s, unnest(range(-((greatest(3, ceil(6*"value"+1)::int) // 2)), (greatest(3, ceil(6*"value"+1)::int) // 2) + 1)) k from gd where kind='gaussian_blur'),
    kw as (select condition, k, exp(-(k*k)/(2*s*s))/sum(exp(-(k*k)/(2*s*s))) over (partition by condition) wt from gk),
    b1 as (select a.image_id, condition, a.x, a.y, a.i, sum(wt*b.v) v from gx a cross join kw join gx b on b.image_id=a.image_id and b.y=a.y and b.x={REF('a.x+k')} group by all),
    b2 as (select a.image_id, a.condition, a.i, {CLIP('sum(wt*b.v)')} v from b1 a join kw on kw.condition=a.condition join b1 b on b.image_id=a.image_id and b.condition=a.condition and b.x=a.x and b.y={REF('a.y+k')} group by a.image_id, a.condition, a.i),
    mk as (select image_id, condition, "value" n, unnest(range(-("value"::int//2), "value"::int//2+1)) t, {UNI(KEY, repr(':angle'))}*2*pi() th from (select distinct image_id from gx) cross join gd where kind='motion_blur'),
    mo as (select image_id, condition, n, round_even(t*cos(th), 0)::int dx, round_even(t*sin(th), 0)::int dy from mk),
    m1 as (select a.image_id, condition, a.i, {CLIP('sum(b.v*(1e0/n))')} v from gx a join mo on mo.image_id=a.image_id join gx b on b.image_id=a.image_id and b.x={REF('a.x+dx')} and b.y={REF('a.y+dy')} group by a.image_id, condition, a.i),
    al as (select * from pt union all select * from b2 union all select * from m1)"""
CHECK = "sum(v*(i+1))::bigint checksum, sum(v)::bigint brightness, count(*) pixels"


def checksum(df, keys):
    px = df.select(*keys, F.posexplode("v").alias("i", "px"))
    return px.groupBy(*keys).agg(F.sum(F.col("px").cast("bigint") * (F.col("i") + 1)).alias("checksum"), F.sum("px").alias("brightness"), F.count("*").alias("pixels"))


def register_corruption(name: str) -> None:
    rows = [c for c in images.CORRUPTIONS if c[2] == name]

    @query(f"corrupt_{'brightness' if name == 'brightness' else name}", ALL_SQL + f" select image_id, condition, {CHECK} from al join gd using (condition) where kind='{name}' group by all")
    def run(spark, sf):
        return checksum(images.corruption_fanout(gray(spark, sf), SEED, rows), ["image_id", "condition"])


for _kind in ("brightness", "gaussian_noise", "salt_pepper", "gaussian_blur", "motion_blur"):
    register_corruption(_kind)


@query("corruption_fanout", ALL_SQL + f" select image_id, condition, family, severity, {CHECK} from al join gd using (condition) group by all")
def corruption_fanout(spark, sf):
    return checksum(images.corruption_fanout(gray(spark, sf), SEED), ["image_id", "condition", "family", "severity"])


# --- cases on one seed, both detectors ----------------------------------------

RUN1 = ("d",)
SBASE = f"with recursive {fx.sql_views('pr', 'tg')}, r1 as (select unnest([0, 1]) d), p1 as (select d, image_id, pidx, label, score, x1, y1, x2, y2 from pr where s=17), {match_block('s', 'p1', 'tg', 'd')}"
STATUS_SQL = f"""ts as (select r.d, t.image_id, t.tidx, m.pidx, m.score, m.iou, m.pidx is not null tp from tg t cross join r1 r left join mt_s m on m.d=r.d and m.image_id=t.image_id and m.tidx=t.tidx),
    ps as (select p.d, p.image_id, p.score, m.tidx is not null tp from rk_s p left join mt_s m on m.d=p.d and m.image_id=p.image_id and m.pidx=p.pidx)"""


def proxy_sql(label: bool):
    on = " and p.label=t.label" if label else ""
    return f"""px1 as (select r.d, t.image_id, t.tidx, p.pidx, p.score, case when p.pidx is not null then {IOU_SQL} end iou from tg t cross join r1 r left join p1 p on p.d=r.d and p.image_id=t.image_id{on}),
    bp as (select d, image_id, tidx, coalesce(score, 0) pscore, coalesce(iou, 0) piou from (select *, row_number() over (partition by d, image_id, tidx order by (iou >= mx - 1e-12) desc nulls last, score desc nulls last, pidx) o from (select *, max(iou) over (partition by d, image_id, tidx) mx from px1)) where o=1)"""


def runs1(spark):
    return spark.range(2).select(F.col("id").cast("int").alias("d"))


def case_inputs(spark, sf, label=True):
    p, t = fx.det_predictions(spark, sf, (17,)).drop("s"), fx.det_targets(spark, sf)
    return matching.detection_status(p, t, runs1(spark), RUN1), matching.best_proxy(p, t, runs1(spark), RUN1, label), t


GOOD = SBASE + ", " + STATUS_SQL + """, gd1 as (select image_id, tidx, min(iou) sc from ts where tp group by all having count(*)=2),
    g1 as (select * from (select *, row_number() over (partition by image_id order by sc desc, tidx) o from gd1) where o=1 order by sc desc, image_id::varchar, tidx limit 5)"""


@query("top_cases_unique_image", GOOD + " select image_id, tidx, round(sc, 9) selection_score from g1")
def top_cases_unique_image(spark, sf):
    status, _, _ = case_inputs(spark, sf)
    good = cases.both_status(status, "true_positive", (0, 1)).select("image_id", "tidx", F.col("min_iou").alias("selection_score"))
    return round_cols(cases.top_cases_unique_image(good, 5), ["selection_score"])


BAD = """, bd as (select image_id, min(mx) sc from (select image_id, d, max(score) mx from ps where not tp and image_id not in (select image_id from tg) group by all) group by image_id having count(*)=2)"""


@query("top_false_positive_negatives", SBASE + ", " + STATUS_SQL + BAD + " select image_id, sc selection_score from bd")
def top_false_positive_negatives(spark, sf):
    status, _, targets = case_inputs(spark, sf)
    return cases.top_false_positive_negatives(status, targets, (0, 1))


QS = (0.1, 0.5, 0.9)


def failure_sql():
    out = ", " + proxy_sql(True) + """, fl as (select image_id, tidx, avg(piou) sc from ts join bp using (d, image_id, tidx) where (image_id, tidx) in (select (image_id, tidx) from ts where not tp group by image_id, tidx having count(*)=2) group by all),
    fr as (select *, row_number() over (order by sc, image_id::varchar, tidx) pos from fl), nf as (select count(*) n from fl)"""
    used = "select null::bigint image_id where false"
    for k, q in enumerate(QS):
        out += f", q{k} as (select image_id, tidx, sc, {q}::double q from fr cross join nf where image_id not in ({used}) order by abs(pos - 1 - round_even({q!r}e0*(n-1), 0)), pos limit 1)"
        used = " union all ".join(f"select image_id from q{i}" for i in range(k + 1))
    return out + ", qs as (" + " union all ".join(f"select * from q{i}" for i in range(len(QS))) + ")"


@query("quantile_cases", SBASE + ", " + STATUS_SQL + failure_sql() + " select image_id, tidx, round(sc, 9) selection_score, q selection_quantile from qs")
def quantile_cases(spark, sf):
    status, proxies, _ = case_inputs(spark, sf)
    failed = cases.both_status(status, "false_negative", (0, 1)).join(proxies, ["image_id", "tidx"]).groupBy("image_id", "tidx").agg(F.avg("proxy_iou").alias("selection_score"))
    return round_cols(cases.quantile_cases(failed, QS), ["selection_score"])


CASES = GOOD + BAD + failure_sql() + """, b1 as (select image_id, sc from bd order by sc desc, image_id::varchar limit 3), g3 as (select * from g1 limit 3), ca as (select 'good_prediction' category, image_id, tidx, sc, null::double q, row_number() over (order by sc desc, image_id::varchar, tidx) rank from g3
    union all select 'bad_prediction', image_id, null, sc, null, row_number() over (order by sc desc, image_id::varchar) from b1 union all select 'failure_case', image_id, tidx, sc, q, row_number() over (order by q) from qs)"""


def chosen(spark, sf):
    status, proxies, targets = case_inputs(spark, sf)
    return cases.select_qualitative_cases(status, proxies, targets, (0, 1), 3, QS)


@query("select_qualitative_cases", CASES + " select category, image_id, tidx, round(sc, 9) selection_score, q selection_quantile, rank::int rank from ca")
def select_qualitative_cases(spark, sf):
    return round_cols(chosen(spark, sf), ["selection_score"])


@query("case_ranks", """select o_orderpriority category, o_orderkey image_id, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey::varchar)::int rank from orders""")
def case_ranks(spark, sf):
    """Ranks of all orders inside each priority, the dearest first."""
    o = fx.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("category"), F.col("o_orderkey").alias("image_id"), F.lit(None).cast("bigint").alias("tidx"),
                                             F.col("o_totalprice").alias("selection_score"), F.lit(None).cast("double").alias("selection_quantile"))
    return cases.case_ranks(o).select("category", "image_id", "rank")


SAL = SBASE + ", " + STATUS_SQL + ", " + proxy_sql(False) + f""", ne as (select count(*) n from embeddings), hv as (select vec_id, i, case when vec_id%50=0 then 0 else abs(embedding[i+1]::double) end v from embeddings, range(64) r(i)),
    hp as (select vec_id, sum(v) tot, arg_min(i, (-v, i)) pk from hv group by vec_id),
    sl0 as (select t.*, g.x1/128e0 bx1, g.y1/128e0 by1, g.x2/128e0 bx2, g.y2/128e0 by2, (t.image_id*7+t.tidx+t.d)%n vec_id from ts t join tg g using (image_id, tidx) cross join ne),
    si as (select d, image_id, tidx, vec_id, coalesce(sum(v) filter (i%8+0.5e0>=bx1 and i%8+0.5e0<bx2 and i//8+0.5e0>=by1 and i//8+0.5e0<by2), 0) ins, count(*) filter (i%8+0.5e0>=bx1 and i%8+0.5e0<bx2 and i//8+0.5e0>=by1 and i//8+0.5e0<by2)/64e0 area from sl0 join hv using (vec_id) group by all),
    sl as (select s.d, s.image_id, s.tidx, tp, score, iou, pscore, piou, tot > 1e-12 ok, case when tot>1e-12 then ins/tot end en, area, case when tot>1e-12 then ins/tot-area end lift,
        case when tot>1e-12 then pk%8+0.5e0>=bx1 and pk%8+0.5e0<bx2 and pk//8+0.5e0>=by1 and pk//8+0.5e0<by2 end hit from sl0 s join si using (d, image_id, tidx) join hp on hp.vec_id=s.vec_id join bp on bp.d=s.d and bp.image_id=s.image_id and bp.tidx=s.tidx)"""


def saliency(spark, sf):
    status, proxies, targets = case_inputs(spark, sf, False)
    e = fx.table(spark, sf, "embeddings")
    k = F.col("vec_id")
    maps = e.select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(k % 50 == 0, 0.0).otherwise(F.abs(x))).alias("v"), F.lit(8).alias("h"), F.lit(8).alias("w"))
    n = e.agg(F.count("*").alias("n"))
    per = targets.select("image_id", "tidx", *[(F.col(c) / F.lit(128.0)).alias(c) for c in ("x1", "y1", "x2", "y2")]).crossJoin(runs1(spark)).crossJoin(F.broadcast(n))
    joined = per.withColumn("vec_id", (F.col("image_id") * 7 + F.col("tidx") + F.col("d")) % F.col("n")).join(maps, "vec_id")
    attention = images.box_attention(joined).select("d", "image_id", "tidx", "valid", "energy_in_box", "pointing_hit", "box_pixel_fraction", "energy_lift_over_area")
    return cases.saliency_target_rows(status, proxies, attention, targets, 0.05)


@query("saliency_target_rows", SAL + """ select d, image_id, tidx, case when tp then 'true_positive' else 'false_negative' end operating_status, score operating_score, round(iou, 9) operating_iou, case when tp then 'emitted_true_positive' else 'miss_proxy_candidate' end role,
    pscore proxy_score, round(piou, 9) proxy_iou, pscore >= 0.05e0 candidate_above_threshold, ok as "valid", round(en, 9) energy_in_box, hit pointing_hit, area box_pixel_fraction, round(lift, 9) energy_lift_over_area from sl""")
def saliency_target_rows(spark, sf):
    out = saliency(spark, sf).drop("gt_x1", "gt_y1", "gt_x2", "gt_y2")
    return round_cols(out, ["operating_iou", "proxy_iou", "energy_in_box", "energy_lift_over_area"])


LOC = ["mean_energy", "median_energy", "pointing_accuracy", "mean_area", "mean_lift", "image_macro_energy", "image_macro_accuracy"]


@query("localization_summary", SAL + """, x as (select *, unnest(['all', case when tp then 'true_positive' else 'false_negative' end]) g from sl), im1 as (select d, g, image_id, avg(en) filter (ok) e, avg(hit::int) filter (ok) h from x group by all), mc as (select d, g, count(*) n, avg(e) e, avg(h) h from im1 group by all)
    select x.d, x.g group_status, count(*) target_count, count(*) filter (ok) valid_count, count(*) filter (not ok) zero_energy_count, round(avg(en) filter (ok), 9) mean_energy, round(median(en) filter (ok), 9) median_energy, round(avg(hit::int) filter (ok), 9) pointing_accuracy,
    round(avg(area) filter (ok), 9) mean_area, round(avg(lift) filter (ok), 9) mean_lift, max(mc.n) image_count, round(max(mc.e), 9) image_macro_energy, round(max(mc.h), 9) image_macro_accuracy from x join mc on mc.d=x.d and mc.g=x.g group by x.d, x.g""")
def localization_summary(spark, sf):
    return round_cols(cases.localization_summary(saliency(spark, sf)), LOC)


@query("pair_detectors", SAL + " select a.image_id, a.tidx, round(a.en, 9) a_energy, a.hit a_hit, round(b.en, 9) b_energy, b.hit b_hit from sl a join sl b on a.image_id=b.image_id and a.tidx=b.tidx and a.d=0 and b.d=1 and a.ok and b.ok")
def pair_detectors(spark, sf):
    return round_cols(cases.pair_detectors(saliency(spark, sf), 0, 1), ["a_energy", "b_energy"])


@query("localization_paired_summary", SAL + """, pp as (select a.en-b.en df, a.hit ah, b.hit bh from sl a join sl b on a.image_id=b.image_id and a.tidx=b.tidx and a.d=0 and b.d=1 and a.ok and b.ok)
    select count(*) pairs, round(avg(df), 9) mean_difference, round(median(df), 9) median_difference, count(*) filter (round(df, 12)>0) a_higher, count(*) filter (round(df, 12)<0) b_higher, count(*) filter (round(df, 12)=0) equal,
    count(*) filter (ah and bh) both_hit, count(*) filter (ah and not bh) a_only_hit, count(*) filter (not ah and bh) b_only_hit, count(*) filter (not ah and not bh) neither_hit from pp""")
def localization_paired_summary(spark, sf):
    return round_cols(cases.localization_paired_summary(cases.pair_detectors(saliency(spark, sf), 0, 1)), ["mean_difference", "median_difference"])


@query("case_rows", CASES + ", " + SAL.split(STATUS_SQL + ", ")[1].replace("px1 as", "px2 as").replace("from px1)", "from px2)").replace("bp as (", "bp2 as (").replace("join bp on bp.d=s.d and bp.image_id=s.image_id and bp.tidx=s.tidx", "join bp2 bp on bp.d=s.d and bp.image_id=s.image_id and bp.tidx=s.tidx") + """
    select c.category, c.image_id, c.tidx, round(c.sc, 9) selection_score, c.q selection_quantile, c.rank::int rank, r1.d, sl.score operating_score, round(sl.iou, 9) operating_iou, sl.pscore proxy_score, round(sl.piou, 9) proxy_iou, round(en, 9) energy_in_box, hit pointing_hit
    from ca c cross join r1 left join sl on sl.d=r1.d and sl.image_id=c.image_id and sl.tidx=c.tidx""")
def case_rows(spark, sf):
    out = cases.case_rows(chosen(spark, sf), saliency(spark, sf), runs1(spark))
    return round_cols(out, ["selection_score", "operating_iou", "proxy_iou", "energy_in_box"])


# --- robustness tables --------------------------------------------------------

ROB = CBASE + f""", co as (select condition, d, sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn, sum(iou_sum) iou_sum, sum(dice_sum) dice_sum from ie_c group by all), cm as (select * from (select *, {RATIOS} from co))"""
CM = list(METRIC_COLS)
SEVEN_CM = [*CM, "map_50", "map_50_95"]
ROB7 = ROB + f""", {level_block('c', 'cpr', 'tg', 'condition, d, s')}, tt as (select condition, d, s, (select count(*) from tg) target_count from cruns),
    {ap_ctes('condition, d, s', 'dl_c', 'tt', tag='r')}, c7 as (select cm.*, map_50, map_50_95 from cm join apsr using (condition, d))"""


def condition_rows(spark, sf, by=()):
    ev = metrics.summed_evidence(fx.condition_predictions(spark, sf), fx.det_targets(spark, sf), fx.condition_runs(spark), C_RUN)
    return metrics.summarize(ev, ["condition", "d", *by])


def condition_metrics(spark, sf):
    """The seven metrics of every condition and detector."""
    dets = matching.coco_match(fx.condition_predictions(spark, sf), fx.det_targets(spark, sf), C_RUN)
    totals = ap.target_totals(fx.det_targets(spark, sf), fx.condition_runs(spark), C_RUN)
    levels = ap.average_precision(ap.counted_detections(dets, [*C_RUN]), totals, [*C_RUN])
    return condition_rows(spark, sf).join(ap.ap_summary(levels, ["condition", "d"]), ["condition", "d"])


@query("join_clean_baseline", ROB7 + " select a.condition, a.d, " + ", ".join(f"round(a.{m}, 9) as {m}, round(b.{m}, 9) as {m}_clean" for m in SEVEN_CM) + " from c7 a join c7 b on a.d=b.d and b.condition='clean'")
def join_clean_baseline(spark, sf):
    out = cases.join_clean_baseline(condition_metrics(spark, sf), ["d"], SEVEN_CM).select("condition", "d", *SEVEN_CM, *[f"{m}_clean" for m in SEVEN_CM])
    return round_cols(out, [*SEVEN_CM, *[f"{m}_clean" for m in SEVEN_CM]])


@query("retention_degradation", ROB7 + " select a.condition, a.d, " + ", ".join(f"round(a.{m}/nullif(b.{m}, 0), 9) as {m}_relative, round(1-a.{m}/nullif(b.{m}, 0), 9) as {m}_degradation" for m in SEVEN_CM) + " from c7 a join c7 b on a.d=b.d and b.condition='clean'")
def retention_degradation(spark, sf):
    out = cases.retention_degradation(cases.join_clean_baseline(condition_metrics(spark, sf), ["d"], SEVEN_CM), SEVEN_CM)
    cols = [f"{m}_{x}" for m in SEVEN_CM for x in ("relative", "degradation")]
    return round_cols(out.select("condition", "d", *cols), cols)


FAMILY_SQL = "(values " + ", ".join(f"('{c[0]}_s{i}', '{c[1]}', {i})" for c in images.CORRUPTIONS for i in range(1, len(c[4]) + 1)) + ") f(condition, family, severity)"


@query("corruption_family_mean", ROB7 + f""", lg as (select d, condition, unnest([{', '.join(repr(m) for m in SEVEN_CM)}]) metric, unnest([{', '.join(SEVEN_CM)}]) v from c7)
    select a.d, family, severity, a.metric, count(*) corruption_type_count, round(avg(a.v), 9) mean_corrupted,
        round(avg(a.v/nullif(b.v, 0)), 9) mean_relative, round(avg(1-a.v/nullif(b.v, 0)), 9) mean_degradation
    from lg a join lg b on a.d=b.d and a.metric=b.metric and b.condition='clean' join {FAMILY_SQL} on f.condition=a.condition group by all""")
def corruption_family_mean(spark, sf):
    """The seven metrics of every corruption family and severity, over the family's corruptions."""
    rows = cases.retention_degradation(cases.join_clean_baseline(condition_metrics(spark, sf), ["d"], SEVEN_CM), SEVEN_CM)
    grid = images.condition_grid(spark).select("condition", "family", "severity")
    out = cases.corruption_family_mean(rows.join(grid, "condition"), SEVEN_CM)
    return round_cols(out, ["mean_corrupted", "mean_relative", "mean_degradation"])
