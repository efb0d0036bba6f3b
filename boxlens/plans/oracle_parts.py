"""SQL text shared by the oracles: greedy matching, evidence, AP."""

from __future__ import annotations

from boxlens.functions.grids import IOU_LEVELS, RECALL_POINTS
from boxlens.plans.fixtures import sql_views


def d(value: float) -> str:
    """DOUBLE literal."""
    return f"{value!r}e0"


IOU_SQL = """(greatest(0, least(p.x2,t.x2)-greatest(p.x1,t.x1))*greatest(0, least(p.y2,t.y2)-greatest(p.y1,t.y1)))::double
 / ((p.x2-p.x1)*(p.y2-p.y1)+(t.x2-t.x1)*(t.y2-t.y1)
 - greatest(0, least(p.x2,t.x2)-greatest(p.x1,t.x1))*greatest(0, least(p.y2,t.y2)-greatest(p.y1,t.y1)))"""


def ranked(pred: str, score: float, cap: int, by: str = "") -> str:
    by = f", {by}" if by else ""
    return f"""(select * from (select *, row_number() over (partition by d, s, image_id{by} order by score desc, pidx) rank
        from {pred} where score >= {d(score)}) where rank <= {cap})"""


def with_match(views: list[str], pred: str = "pr", tgt: str = "tg", score: float = 0.05, cap: int = 100, iou: float = 0.5) -> str:
    """WITH clause: rk (ranked detections), pairs, mt (matches)."""
    return f"""with recursive {sql_views(*views)},
    rk as {ranked(pred, score, cap)},
    pairs as (select p.d, p.s, p.image_id, p.pidx, p.rank, p.label, p.score, t.tidx, {IOU_SQL} iou
        from rk p join {tgt} t on p.image_id=t.image_id and p.label=t.label),
    seq as (select *, row_number() over (partition by d, s, image_id order by rank, iou desc, tidx) o from pairs where iou >= {d(iou)}),
    walk as (
        select *, [pidx] up, [tidx] ut, true took from seq where o = 1
        union all
        select q.*, case when not list_contains(w.up, q.pidx) and not list_contains(w.ut, q.tidx) then list_append(w.up, q.pidx) else w.up end,
            case when not list_contains(w.up, q.pidx) and not list_contains(w.ut, q.tidx) then list_append(w.ut, q.tidx) else w.ut end,
            not list_contains(w.up, q.pidx) and not list_contains(w.ut, q.tidx)
        from walk w join seq q on q.d=w.d and q.s=w.s and q.image_id=w.image_id and q.o=w.o+1),
    mt as (select d, s, image_id, pidx, tidx, rank, label, score, iou, 2*iou/(1+iou) dice from walk where took)"""


def with_levels(views: list[str], pred: str = "pr", tgt: str = "tg", score: float = 0.001, cap: int = 100, by: str = "") -> str:
    """WITH clause: rk and dl (detections with level_mask)."""
    levels = ", ".join(f"({i},{d(v)})" for i, v in enumerate(IOU_LEVELS))
    part = "d, s, image_id" + (f", {by}" if by else "")
    extra = f" and q.{by}=w.{by}" if by else ""
    return f"""with recursive {sql_views(*views)},
    rk as {ranked(pred, score, cap, by)},
    lv as (select * from (values {levels}) v(level, thr)),
    pairs as (select p.d, p.s, p.image_id, p.pidx, p.rank, p.label, p.score, t.tidx, {IOU_SQL} iou
        from rk p join {tgt} t on p.image_id=t.image_id and p.label=t.label),
    seq as (select *, row_number() over (partition by level, {part} order by rank, iou desc, tidx) o
        from pairs join lv on iou >= thr),
    walk as (
        select *, [pidx] up, [tidx] ut, true took from seq where o = 1
        union all
        select q.*, case when not list_contains(w.up, q.pidx) and not list_contains(w.ut, q.tidx) then list_append(w.up, q.pidx) else w.up end,
            case when not list_contains(w.up, q.pidx) and not list_contains(w.ut, q.tidx) then list_append(w.ut, q.tidx) else w.ut end,
            not list_contains(w.up, q.pidx) and not list_contains(w.ut, q.tidx)
        from walk w join seq q on q.level=w.level and q.d=w.d and q.s=w.s and q.image_id=w.image_id{extra} and q.o=w.o+1),
    msk as (select d, s, image_id, pidx, sum(1 << level)::int level_mask from walk where took group by all),
    dl as (select rk.d, rk.s, rk.image_id, rk.pidx, rk.rank, rk.label, rk.score, coalesce(level_mask, 0) level_mask
        from rk left join msk using (d, s, image_id, pidx))"""


def evidence(tgt: str = "tg", images: str | None = None) -> str:
    """CTE text: ev (long additive rows)."""
    blank = f" union all select d, s, image_id, null, 0, 0, 0, 0e0, 0e0 from {images} cross join runs" if images else ""
    return f"""ev as (select d, s, image_id, label, 1 preds, 0 targets, 0 tp, 0e0 iou_sum, 0e0 dice_sum from rk
        union all select d, s, image_id, label, 0, 1, 0, 0e0, 0e0 from {tgt} cross join runs
        union all select d, s, image_id, label, 0, 0, 1, iou, dice from mt{blank})"""


def sums(keys: str, source: str = "ev") -> str:
    return f"""select {keys}, sum(tp)::bigint tp, sum(preds-tp)::bigint fp, sum(targets-tp)::bigint fn,
        sum(iou_sum) iou_sum, sum(dice_sum) dice_sum from {source} group by {keys}"""


RATIOS = """case when tp+fp=0 and tp+fn=0 then null when tp+fp=0 or tp+fn=0 then 0e0 else tp::double/(tp+fp) end as precision,
    case when tp+fp=0 and tp+fn=0 then null when tp+fp=0 or tp+fn=0 then 0e0 else tp::double/(tp+fn) end as recall,
    case when tp+fp=0 and tp+fn=0 then null when tp=0 then 0e0 else 2*(tp::double/(tp+fp))*(tp::double/(tp+fn))/((tp::double/(tp+fp))+(tp::double/(tp+fn))) end as f1,
    case when tp>0 then iou_sum/tp end mean_iou, case when tp>0 then dice_sum/tp end mean_dice"""

METRIC_COLS = ("precision", "recall", "f1", "mean_iou", "mean_dice")


def rounded(cols, digits: int = 9) -> str:
    return ", ".join(f"round({c}, {digits}) as {c}" for c in cols)


RECALL_SQL = "rp as (select * from (values " + ", ".join(f"({i},{d(v)})" for i, v in enumerate(RECALL_POINTS)) + ") v(point, r))"


def ap_ctes(keys: str, source: str, totals: str, weight: str = "1", order: str = "score desc, image_id, rank", tag: str = "") -> str:
    """CTEs pt (precision at each recall point) and ap (AP per level) by plain definition.

    ``source`` has keys, score, image_id, rank, level_mask; ``totals`` has keys and target_count.
    """
    ks = [k.strip() for k in keys.split(",")]
    on = lambda x, y: " and ".join(f"{x}.{k}={y}.{k}" for k in ks)
    at = lambda x: ", ".join(f"{x}.{k}" for k in ks)
    cols = "score, image_id, rank" + (", d" if "d" in order.replace("desc", "") and "d" not in ks else "")
    by = ", ".join("a." + part.strip() for part in order.split(","))
    return f"""{RECALL_SQL.replace("rp as", f"rp{tag} as", 1)},
    lvl{tag} as (select unnest(range(10))::int as level),
    cum{tag} as (select {keys}, level, sum({weight}) over w n, sum({weight} * ((level_mask >> level) & 1)) over w k, {cols}
        from {source} cross join lvl{tag} window w as (partition by {keys}, level order by {order} rows between unbounded preceding and current row)),
    env{tag} as (select {at('a')}, a.level, a.k::double/b.target_count rec, max(a.k::double/a.n) over (partition by {at('a')}, a.level
        order by {by} rows between current row and unbounded following) prec
        from cum{tag} a join {totals} b on {on('a', 'b')} where b.target_count > 0 and a.n > 0),
    stp{tag} as (select {keys}, level, rec, max(prec) prec from env{tag} group by {keys}, level, rec),
    pt{tag} as (select {keys}, level, point, max(prec) prec from stp{tag} join rp{tag} on rec >= r group by {keys}, level, point),
    ap{tag} as (select {at('b')}, l.level, case when b.target_count > 0 then coalesce(x.v, 0) end ap
        from {totals} b cross join lvl{tag} l left join (select {keys}, level, sum(prec)/101 v from pt{tag} group by {keys}, level) x
        on {on('x', 'b')} and x.level=l.level),
    aps{tag} as (select {keys}, max(case when level=0 then ap end) map_50, avg(ap) map_50_95 from ap{tag} group by {keys})"""


def match_block(tag: str, pred: str, tgt: str, keys: str = "d, s", score: float = 0.05, cap: int = 100, iou: float = 0.5) -> str:
    """Tagged CTEs rk_, seq_, walk_, mt_ for any run keys."""
    ks = [k.strip() for k in keys.split(",")]
    same = " and ".join(f"q.{k}=w.{k}" for k in ks)
    pk = ", ".join(f"p.{k}" for k in ks)
    return f"""rk_{tag} as (select * from (select *, row_number() over (partition by {keys}, image_id order by score desc, pidx) rank from {pred}
        where score >= {d(score)}) where rank <= {cap}),
    seq_{tag} as (select *, row_number() over (partition by {keys}, image_id order by rank, iou desc, tidx) o from (
        select {pk}, p.image_id, p.pidx, p.rank, p.label, p.score, t.tidx, {IOU_SQL} iou from rk_{tag} p join {tgt} t on p.image_id=t.image_id and p.label=t.label) where iou >= {d(iou)}),
    walk_{tag} as (select *, [pidx] up, [tidx] ut, true took from seq_{tag} where o = 1 union all
        select q.*, case when not list_contains(w.up, q.pidx) and not list_contains(w.ut, q.tidx) then list_append(w.up, q.pidx) else w.up end,
            case when not list_contains(w.up, q.pidx) and not list_contains(w.ut, q.tidx) then list_append(w.ut, q.tidx) else w.ut end,
            not list_contains(w.up, q.pidx) and not list_contains(w.ut, q.tidx)
        from walk_{tag} w join seq_{tag} q on {same} and q.image_id=w.image_id and q.o=w.o+1),
    mt_{tag} as (select {keys}, image_id, pidx, tidx, rank, label, score, iou, 2*iou/(1+iou) dice from walk_{tag} where took)"""


def level_block(tag: str, pred: str, tgt: str, keys: str = "d, s", score: float = 0.001, cap: int = 100) -> str:
    """Tagged CTEs ending in dl_ (detections with level_mask) for any run keys."""
    ks = [k.strip() for k in keys.split(",")]
    same = " and ".join(f"q.{k}=w.{k}" for k in ks)
    pk = ", ".join(f"p.{k}" for k in ks)
    levels = ", ".join(f"({i},{d(v)})" for i, v in enumerate(IOU_LEVELS))
    return f"""lrk_{tag} as (select * from (select *, row_number() over (partition by {keys}, image_id order by score desc, pidx) rank from {pred}
        where score >= {d(score)}) where rank <= {cap}),
    llv_{tag} as (select * from (values {levels}) v(level, thr)),
    lsq_{tag} as (select *, row_number() over (partition by level, {keys}, image_id order by rank, iou desc, tidx) o from (
        select {pk}, p.image_id, p.pidx, p.rank, t.tidx, {IOU_SQL} iou from lrk_{tag} p join {tgt} t on p.image_id=t.image_id and p.label=t.label) join llv_{tag} on iou >= thr),
    lwk_{tag} as (select *, [pidx] up, [tidx] ut, true took from lsq_{tag} where o = 1 union all
        select q.*, case when not list_contains(w.up, q.pidx) and not list_contains(w.ut, q.tidx) then list_append(w.up, q.pidx) else w.up end,
            case when not list_contains(w.up, q.pidx) and not list_contains(w.ut, q.tidx) then list_append(w.ut, q.tidx) else w.ut end,
            not list_contains(w.up, q.pidx) and not list_contains(w.ut, q.tidx)
        from lwk_{tag} w join lsq_{tag} q on q.level=w.level and {same} and q.image_id=w.image_id and q.o=w.o+1),
    dl_{tag} as (select r.*, coalesce(level_mask, 0) level_mask from lrk_{tag} r left join
        (select {keys}, image_id, pidx, sum(1 << level)::int level_mask from lwk_{tag} where took group by all) m using ({keys}, image_id, pidx))"""


def image_evidence_block(tag: str, tgt: str, runs: str, keys: str = "d, s") -> str:
    """Tagged CTE ie_: additive evidence per run and image, from rk_ and mt_."""
    return f"""ie_{tag} as (select {keys}, image_id, sum(targets)::bigint target_count, sum(tp)::bigint tp, sum(preds-tp)::bigint fp, sum(targets-tp)::bigint fn,
        sum(iou_sum) iou_sum, sum(dice_sum) dice_sum from (
        select {keys}, image_id, 1 preds, 0 targets, 0 tp, 0e0 iou_sum, 0e0 dice_sum from rk_{tag}
        union all select {keys}, image_id, 0, 1, 0, 0e0, 0e0 from {tgt} cross join {runs}
        union all select {keys}, image_id, 0, 0, 1, iou, dice from mt_{tag}) group by all)"""
