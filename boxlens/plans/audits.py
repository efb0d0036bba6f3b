"""Audit, source, sink, sampling and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxlens.functions import geometry
from boxlens.functions.text import parse_finite
from boxlens.operators import audit, blocks, coco, matching, sampling
from boxlens.plans import fixtures as fx
from boxlens.plans.catalog import query
from boxlens.plans.detection import round_cols
from boxlens.session import scratch_path
from boxlens.sources import readers, writers

V = fx.sql_views
PID = r"regexp_extract(trim(original_name), '^(\d{8})_\d{3}\.png$', 1)"
NUM = lambda c: f"(case when isfinite(try_cast(trim({c}) as double)) then try_cast(trim({c}) as double) end)"
MAPPING_SQL = f"""mpe as (select entry, trim(subset_key) exam_id, nullif({PID}, '') pid from raw_mapping),
    mf as (select exam_id, min(entry) fe, arg_min(pid, entry) pid from mpe where pid is not null and exam_id <> '' group by exam_id),
    mi as (select case when e.pid is null then 'malformed_mapping_entry' when e.pid <> f.pid then 'inconsistent_mapping' else 'duplicate_mapping' end code, e.exam_id, e.entry row_number
        from mpe e left join mf f using (exam_id) where e.pid is null or e.entry > f.fe)"""
AUDIT_SQL = f"""with {V('raw_labels', 'raw_classes', 'raw_mapping')}, {MAPPING_SQL},
    cl as (select exam_ref exam_id, min(label) c1, max(label) c2 from raw_classes where label <> '' group by exam_ref),
    lb as (select *, {NUM('x')} bx, {NUM('y')} by_, {NUM('width')} bw, {NUM('height')} bh from raw_labels where exam_id <> ''),
    eg as (select exam_id, min(target) t1, max(target) t2, count(*) n, bool_or(target not in ('0','1')) unk from lb group by exam_id),
    xs as (select eg.*, mf.pid, c1, c2, t1='1' and t2='1' pos, c1=c2 one from eg left join mf using (exam_id) left join cl using (exam_id)),
    rc as (select lb.*, pos, case when pos then case when bx is null or by_ is null or bw is null or bh is null then 'malformed_box' when bw<=0 or bh<=0 then 'nonpositive_box'
        when bx<0 or by_<0 or bx+bw>1024 or by_+bh>1024 then 'off_image_box' end when trim(x)||trim(y)||trim(width)||trim(height) <> '' then 'negative_with_box' end code from lb join xs using (exam_id)),
    kp as (select *, row_number() over (partition by exam_id, bx, by_, bw, bh order by row_number) o from rc where pos and code is null),
    bc as (select exam_id, count(*) filter (o=1) boxes from kp group by exam_id), re as (select exam_id, count(*) errs from rc where code is not null group by exam_id),
    fu as (select xs.*, coalesce(boxes, 0) boxes, coalesce(errs, 0) errs from xs left join bc using (exam_id) left join re using (exam_id)),
    er as (select 'missing_patient_mapping' code, exam_id from fu where pid is null union all select 'unknown_target', exam_id from fu where unk
        union all select 'inconsistent_targets', exam_id from fu where t1<>t2 union all select 'missing_class_info', exam_id from fu where c1 is null
        union all select 'inconsistent_class_info', exam_id from fu where c1<>c2 union all select 'unknown_study_stratum', exam_id from fu where one and c1 not in ('opacity','other','normal')
        union all select 'target_class_mismatch', exam_id from fu where one and pos <> (c1='opacity') union all select 'positive_without_valid_box', exam_id from fu where pos and boxes=0),
    ex2 as (select fu.*, errs=0 and exam_id not in (select exam_id from er) ok from fu),
    iss as (select code, nullif(exam_id, '') exam_id, row_number from mi union all select 'malformed_class_info', exam_ref, row_number from raw_classes where label=''
        union all select 'missing_exam_id', null, row_number from raw_labels where exam_id='' union all select code, exam_id, null from er
        union all select 'duplicate_negative_row', exam_id, null from fu where not pos and n>1 union all select code, exam_id, row_number from rc where code is not null
        union all select 'duplicate_box', exam_id, row_number from kp where o>1 union all select 'orphan_class_info', exam_id, null from cl where exam_id not in (select exam_id from eg))"""
SEV = f"case when code in ({', '.join(repr(w) for w in audit.WARNINGS)}) then 'warning' else 'error' end"


def the_audit(spark, sf):
    return audit.audit_annotations(*[fx.view(spark, sf, f"raw_{n}") for n in ("labels", "classes", "mapping")])


@query("audit_annotations", AUDIT_SQL + f" select code, {SEV} severity, exam_id, row_number from iss")
def audit_annotations(spark, sf):
    return the_audit(spark, sf).issues


@query("audit_records", AUDIT_SQL + " select exam_id, coalesce(pid, '') patient_id, case when one then c1 else '' end study_stratum, pos is_positive, boxes box_count, ok as \"valid\" from ex2")
def audit_records(spark, sf):
    return the_audit(spark, sf).exams


@query("dedupe_keep_first", AUDIT_SQL + " select exam_id, bx x, by_ y, bw width, bh height, row_number from kp where o=1")
def dedupe_keep_first(spark, sf):
    rows = fx.view(spark, sf, "raw_labels").filter("exam_id <> ''")
    exams = the_audit(spark, sf).exams.filter("is_positive").select("exam_id")
    values = rows.join(exams, "exam_id").select("exam_id", "row_number", *[parse_finite(F.col(c)).alias(c) for c in audit.COORDS])
    fit = values.filter(audit.box_code(*[F.col(c) for c in audit.COORDS], audit.AuditRules()).isNull())
    return audit.dedupe_keep_first(fit, ["exam_id", *audit.COORDS], "row_number")


@query("audit_input_counts", AUDIT_SQL + """, vp as (select pid, count(*) n from ex2 where ok group by pid)
    select (select count(*) from raw_mapping) mapping_entries, (select count(*) from mf) mapped_exam_ids, (select count(*) from raw_labels) label_rows, (select count(*) from raw_classes) class_info_rows,
    (select count(distinct trim(exam_ref)) from raw_classes where trim(exam_ref) <> '' and trim(label) <> '') class_info_exam_ids, (select count(*) from ex2) annotation_exam_ids, (select count(*) from ex2 where ok) valid_exam_ids, (select count(*) from ex2 where not ok) invalid_exam_ids, (select sum(boxes)::bigint from ex2 where ok) valid_boxes,
    (select count(*) from vp) unique_patients, (select count(*) from vp where n>1) multi_exam_patients, (select max(n) from vp) maximum_exams_per_patient""")
def audit_input_counts(spark, sf):
    return audit.audit_input_counts(the_audit(spark, sf), *(fx.view(spark, sf, v) for v in ("raw_labels", "raw_classes", "raw_mapping")))


@query("issue_counts", AUDIT_SQL + f" select code, {SEV} severity, count(*) n from iss group by all")
def issue_counts(spark, sf):
    return audit.issue_counts(the_audit(spark, sf).issues)


@query("join_exam_sources", AUDIT_SQL + " select exam_id, n label_rows, t1 first_target, t2 last_target, unk unknown_target, pid patient_id, c1 first_class, c2 last_class, pos is_positive from xs")
def join_exam_sources(spark, sf):
    patients, _ = audit.parse_mapping(fx.view(spark, sf, "raw_mapping"))
    classes, _ = audit.class_sets(fx.view(spark, sf, "raw_classes"))
    return audit.join_exam_sources(fx.view(spark, sf, "raw_labels").filter("exam_id <> ''"), patients, classes)


@query("orphan_class_info", f"with {V('raw_labels', 'raw_classes')} select distinct exam_ref exam_id from raw_classes where label<>'' and exam_ref not in (select exam_id from raw_labels)")
def orphan_class_info(spark, sf):
    classes, _ = audit.class_sets(fx.view(spark, sf, "raw_classes"))
    return audit.orphan_class_info(classes.select("exam_id"), fx.view(spark, sf, "raw_labels").select("exam_id"))


@query("scan_patient_mapping", f"with {V('raw_mapping')}, {MAPPING_SQL} select exam_id, pid patient_id from mf")
def scan_patient_mapping(spark, sf):
    """List documents of a thousand elements each; the entry number continues over them."""
    path = scratch_path(spark, "mapping")
    rows = fx.view(spark, sf, "raw_mapping").withColumn("part", F.floor((F.col("entry") - 1) / 1000))
    item = F.struct("entry", "subset_key", "original_name")
    listed = F.to_json(F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct(x["subset_key"].alias("subset_key"), x["original_name"].alias("original_name"))))
    rows.groupBy("part").agg(listed.alias("value")).repartition("part").write.partitionBy("part").text(path)
    mapping = readers.scan_patient_mapping(spark, path, ["part"]).withColumn("entry", F.col("entry") + F.col("part") * 1000)
    return audit.parse_mapping(mapping.drop("part"))[0]


@query("extract_patient_id", f"with {V('raw_mapping')} select entry, nullif({PID}, '') patient_id from raw_mapping")
def extract_patient_id(spark, sf):
    return fx.view(spark, sf, "raw_mapping").select("entry", audit.extract_patient_id(F.col("original_name")).alias("patient_id"))


@query("parse_box", f"with {V('raw_labels')} select row_number, {NUM('x')} x, {NUM('y')} y, {NUM('width')} width, {NUM('height')} height from raw_labels")
def parse_box(spark, sf):
    return fx.view(spark, sf, "raw_labels").select("row_number", *[parse_finite(F.col(c)).alias(c) for c in audit.COORDS])


@query("box_normalize", f"with {V('b')} select image_id, ln, (x1+w/2e0)/1024 xc, (y1+h/2e0)/1024 yc, w/1024e0 nw, h/1024e0 nh from b")
def box_normalize(spark, sf):
    n = geometry.normalized_center(*[F.col(c).cast("double") for c in ("x1", "y1", "w", "h")], F.lit(1024.0), F.lit(1024.0))
    out = fx.boxes(spark, sf).select("image_id", "ln", *[v.alias(k) for k, v in n.items()])
    return out.filter(" and ".join(f"{c} > 0 and {c} <= 1" for c in n))


@query("box_denormalize_edges", f"with {V('b')} select image_id, ln, x1/1024e0 \"left\", y1/1024e0 top, (x1+w)/1024e0 \"right\", (y1+h)/1024e0 bottom from b")
def box_denormalize_edges(spark, sf):
    e = geometry.edges_from_center(*[F.col(c) for c in ("xc", "yc", "nw", "nh")])
    out = box_normalize(spark, sf).select("image_id", "ln", *[v.alias(k) for k, v in e.items()])
    return out.filter("`left` >= 0 and top >= 0 and `right` <= 1 and bottom <= 1 and `left` < `right` and top < bottom")


@query("validate_records", f"""with {V('pr')}, z as (select *, case when x1%40=0 then 0 else 1024 end width, case when pidx%4=0 and y1%7=0 then x1-1 else x2 end ex2, case when y1%31=0 then -1 else label end l2, case when x1%29=0 then score+1 else score end s2 from pr),
    r as (select d, s, image_id, pidx, unnest([case when width<=0 then 'nonpositive_image_size' end, case when ex2<=x1 then 'empty_box' end, case when x1<0 or y1<0 or ex2>width or y2>1024 then 'outside_image' end, case when l2<0 then 'invalid_label' end,
    case when s2<0 or s2>1 then 'invalid_score' end]) "rule" from z) select * from r where rule is not null""")
def validate_records(spark, sf):
    p = fx.det_predictions(spark, sf).withColumns({
        "width": F.when(F.col("x1") % 40 == 0, 0).otherwise(1024), "height": F.lit(1024), "x2": F.when((F.col("pidx") % 4 == 0) & (F.col("y1") % 7 == 0), F.col("x1") - 1).otherwise(F.col("x2")),
        "label": F.when(F.col("y1") % 31 == 0, -1).otherwise(F.col("label")), "score": F.when(F.col("x1") % 29 == 0, F.col("score") + 1).otherwise(F.col("score")),
    })
    return audit.validate_records(p, ["d", "s", "image_id", "pidx"])


@query("check_identity_sets", """select image_id, case when pn is null then 'no_prediction_record' when tn is null then 'no_target_record' when pn>1 then 'duplicate_image' else 'size_differs' end problem from
    (select l_orderkey image_id, count(distinct l_linenumber) pn, 512 + 512*(max(l_linenumber)%2) pw from lineitem group by 1) p full join (select o_orderkey image_id, 1 tn, 1024 tw from orders where o_orderstatus<>'P') t using (image_id)
    where pn is null or tn is null or pn>1 or pw<>tw""")
def check_identity_sets(spark, sf):
    li = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image_id"), "l_linenumber").distinct()
    top = li.groupBy("image_id").agg(F.max("l_linenumber").alias("m"))
    predicted = li.join(top, "image_id").select("image_id", (512 + 512 * (F.col("m") % 2)).alias("width"), F.lit(1024).alias("height"))
    expected = fx.table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("image_id"), F.lit(1024).alias("width"), F.lit(1024).alias("height"))
    return audit.check_identity_sets(predicted, expected)


def coco_frames(spark, sf):
    a = fx.view(spark, sf, "coco_ann")
    num = [F.col(c).cast("double") for c in ("x", "y", "w", "h")]
    bbox = F.when(F.col("numbers") == 3, F.array(*num[:3])).otherwise(F.array(*num))
    return fx.view(spark, sf, "coco_images"), a.select("id", "image_id", "category_id", bbox.alias("bbox"), F.col("area").cast("double").alias("area"), "iscrowd"), fx.view(spark, sf, "coco_cat")


@query("validate_coco", f"""with {V('coco_images', 'coco_ann', 'coco_cat')}, ci as (select id, min(width) iw from coco_images group by id),
    an as (select a.*, iw, a.category_id in (select id from coco_cat) kc, numbers=4 four from coco_ann a left join ci on ci.id=a.image_id)
    select 'category' entity, id::bigint id, 'category_id_below_one' "rule" from coco_cat where id<1 union all select 'category', id, 'duplicate_category_id' from coco_cat group by id having count(*)>1
    union all select 'category', min(id), 'duplicate_category_name' from coco_cat group by name having count(*)>1 union all select 'image', id, 'unsafe_file_name' from coco_images where file_name like '../%'
    union all select 'image', id, 'nonpositive_size' from coco_images where width<1 union all select 'image', id, 'duplicate_image_id' from coco_images group by id having count(*)>1
    union all select 'image', min(id), 'duplicate_file_name' from coco_images group by lower(file_name) having count(*)>1 union all select 'annotation', id, 'unknown_image' from an where iw is null
    union all select 'annotation', id, 'unknown_category' from an where not kc union all select 'annotation', id, 'bbox_not_four_numbers' from an where not four
    union all select 'annotation', id, 'bbox_origin_or_size' from an where four and (x<0 or y<0 or w<=0 or h<=0) union all select 'annotation', id, 'bbox_outside_image' from an where four and (x+w>iw or y+h>1024)
    union all select 'annotation', id, 'area_mismatch' from an where four and abs(area-w*h) > greatest(1e-6*greatest(abs(area), abs(w*h)), 1e-6) union all select 'annotation', id, 'unsupported_iscrowd' from an where iscrowd<>0""")
def validate_coco(spark, sf):
    images, annotations, categories = coco_frames(spark, sf)
    return coco.validate_coco(images.withColumn("width", F.col("width")), annotations, categories)


@query("class_id_remap", "with p as (select p_brand name, min(p_partkey) id from part group by p_brand), m as (select id, row_number() over (order by id) dense from p) select dense::int dense_label, count(*) parts from part join p on name=p_brand join m using (id) group by all")
def class_id_remap(spark, sf):
    part = fx.table(spark, sf, "part")
    cats = part.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("id"))
    labelled = part.join(cats, F.col("p_brand") == F.col("name")).join(coco.class_id_remap(cats, "id"), F.col("id") == F.col("category_id"))
    return labelled.groupBy("dense_label").agg(F.count("*").alias("parts"))


@query("attach_annotations", f"with {V('im', 'tg')} select im.image_id, tidx, label, x1, y1, x2, y2 from im left join tg using (image_id)")
def attach_annotations(spark, sf):
    return coco.attach_annotations(fx.det_images(spark, sf).select("image_id"), fx.det_targets(spark, sf))


SAMPLED = f"""with {V('exm')}, sc as (select stratum, count(*) n from exm group by stratum), tt as (select sum(n) t, 1000 k from sc), q as (select stratum, n, k*n::double/t quota from sc cross join tt),
    al as (select *, floor(quota) + case when row_number() over (order by quota-floor(quota) desc, stratum) <= 1000 - (select sum(floor(quota)) from q) then 1 else 0 end allocated from q),
    sp as (select * from (select exm.*, row_number() over (partition by stratum order by sha256('17' || chr(0) || 'sample' || chr(0) || image_id), image_id) o from exm) join al using (stratum) where o <= allocated)"""


@query("largest_remainder", SAMPLED + " select stratum, n, allocated::bigint allocated from al")
def largest_remainder(spark, sf):
    counts = fx.view(spark, sf, "exm").groupBy("stratum").agg(F.count("*").alias("n"))
    return sampling.largest_remainder(counts, 1000)


def the_sample(spark, sf):
    return sampling.stratified_sample(fx.view(spark, sf, "exm"), 1000, 17)


@query("stratified_sample", SAMPLED + " select image_id, stratum, patient_group from sp")
def stratified_sample(spark, sf):
    return the_sample(spark, sf).select("image_id", "stratum", "patient_group")


@query("sample_audit", SAMPLED + """, f as (select stratum, count(*) full_images, count(*) filter (is_positive) full_positives, sum(box_count)::bigint full_boxes, count(distinct patient_group) full_patients from exm group by stratum),
    g as (select stratum, count(*) sample_images, count(*) filter (is_positive) sample_positives, sum(box_count)::bigint sample_boxes, count(distinct patient_group) sample_patients from sp group by stratum) select * from f join g using (stratum)""")
def sample_audit(spark, sf):
    return sampling.sample_audit(fx.view(spark, sf, "exm"), the_sample(spark, sf))


@query("restrict_to_sample", SAMPLED + " select image_id, count(*) targets from b where rf='R' and image_id in (select image_id from sp) group by image_id")
def restrict_to_sample(spark, sf):
    rows = coco.restrict_to_sample(fx.det_targets(spark, sf), the_sample(spark, sf))
    return rows.groupBy("image_id").agg(F.count("*").alias("targets"))


@query("sample_coverage_gaps", SAMPLED + " select image_id from sp where image_id not in (select image_id from b where rf='R')")
def sample_coverage_gaps(spark, sf):
    return coco.sample_coverage_gaps(fx.det_targets(spark, sf), the_sample(spark, sf))


@query("round_robin_sample", f"""with {V('exm')} select image_id, stratum, turn::int turn from (select *, row_number() over (partition by stratum order by sha256('17:' || image_id), image_id) turn from exm) order by turn, stratum limit 48""")
def round_robin_sample(spark, sf):
    return sampling.round_robin_sample(fx.view(spark, sf, "exm"), 48, 17).select("image_id", "stratum", "turn")


@query("eda_summary", f"""with {V('spl')}, rr as (select image_id from (select *, row_number() over (partition by stratum order by sha256('17:' || image_id), image_id) turn from spl) order by turn, stratum limit 48)
    select split, stratum, count(*) n, count(*) filter (image_id in (select image_id from rr)) sampled from spl group by all""")
def eda_summary(spark, sf):
    """Split by stratum counts with the size of the round-robin figure sample."""
    images = fx.view(spark, sf, "spl")
    picked = sampling.round_robin_sample(images, 48, 17).select("image_id", F.lit(1).alias("picked"))
    return images.join(picked, "image_id", "left").groupBy("split", "stratum").agg(F.count("*").alias("n"), F.count("picked").alias("sampled"))


@query("balanced_smoke_sample", f"""with {V('exm')}, r as (select *, row_number() over (partition by is_positive order by file_name) o from exm), k as (select least(10, count(*) filter (is_positive)) p from exm)
    select image_id, is_positive from r cross join k where case when is_positive then o <= p else o <= 20-p end""")
def balanced_smoke_sample(spark, sf):
    return sampling.balanced_smoke_sample(fx.view(spark, sf, "exm"), 20).select("image_id", "is_positive")


STRATA = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
GROUPED = f"""with {V('exm')}, c as (select patient_group, stratum, count(*) n from exm group by all), pg as (select patient_group, sum(n)::bigint size, arg_max(stratum, n*100-list_position([{', '.join(repr(s) for s in STRATA)}], stratum)) dominant,
    string_agg(stratum || '=' || n, ';' order by stratum) strata from c group by patient_group)"""


@query("patient_groups", GROUPED + " select * from pg")
def patient_groups(spark, sf):
    g = sampling.patient_groups(fx.view(spark, sf, "exm"), STRATA)
    text = F.array_join(F.transform(F.sort_array(F.map_entries("stratum_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return g.select("patient_group", "size", "dominant", text.alias("strata"))


@query("stable_hash_order", GROUPED + " select patient_group, sha256('17' || chr(0) || 'subsample' || chr(0) || patient_group) order_key from pg")
def stable_hash_order(spark, sf):
    return sampling.stable_hash_order(fx.det_images(spark, sf).select("patient_group").distinct(), 17, "subsample")


@query("group_subsample", f"""with {V('exm')} select least(5000, count(*))::bigint images, 0::bigint broken_groups from exm""")
def group_subsample(spark, sf):
    """Sampled images and the number of groups that were torn apart; the bound is reachable here."""
    images = fx.view(spark, sf, "exm")
    part = sampling.group_subsample(images, STRATA, 5000, 17)
    sizes = images.groupBy("patient_group").agg(F.count("*").alias("full"))
    kept = part.groupBy("patient_group").agg(F.count("*").alias("n")).join(sizes, "patient_group")
    return kept.agg(F.sum("n").alias("images"), F.count_if(F.col("n") != F.col("full")).alias("broken_groups"))


RATIOS = {"train": 0.7, "validation": 0.15, "test": 0.15}


@query("group_split", f"""with t as (select count(*) n from orders), r as (select * from (values ('train', 0.7e0, 1), ('validation', 0.15e0, 2), ('test', 0.15e0, 3)) r(split, share, o)),
    q as (select split, o, n*share raw, floor(n*share) base from r cross join t), a as (select split, base + case when row_number() over (order by raw-base desc, o) <= (select n from t) - (select sum(base) from q) then 1 else 0 end images from q)
    select split, images::bigint images, 0::bigint shared_groups from a""")
def group_split(spark, sf):
    """Exact split sizes; groups that occur in more than one split (none)."""
    out = sampling.group_split(fx.view(spark, sf, "exm"), STRATA, RATIOS, 17)
    spread = out.groupBy("patient_group").agg(F.count_distinct("split").alias("k"))
    return out.join(spread, "patient_group").groupBy("split").agg(F.count("*").alias("images"), F.count_if(F.col("k") > 1).alias("shared_groups"))


@query("split_summary", f"with {V('spl')} select split, count(*) images, count(distinct patient_group) \"groups\", count(*) filter (is_positive) positives, count(*) filter (not is_positive) negatives, sum(box_count)::bigint boxes from spl group by split")
def split_summary(spark, sf):
    return sampling.split_summary(fx.view(spark, sf, "spl"))


@query("split_group_overlap", f"""with {V('spl')}, m as (select distinct split, patient_group from spl), n as (select distinct split from spl) select a.split, b.split other, (select count(*) from m x join m y using (patient_group) where x.split=a.split and y.split=b.split) shared
    from n a join n b on a.split < b.split""")
def split_group_overlap(spark, sf):
    return sampling.split_group_overlap(fx.view(spark, sf, "spl"))


@query("study_distribution", f"with {V('spl')} select split, " + ", ".join(f"count(*) filter (stratum='{s}') \"{s}\"" for s in STRATA) + " from spl group by split")
def study_distribution(spark, sf):
    return sampling.study_distribution(fx.view(spark, sf, "spl"), STRATA)


@query("dense_ids", f"with {V('exm')} select image_id, row_number() over (order by file_name) id from exm")
def dense_ids(spark, sf):
    return blocks.dense_ids(fx.view(spark, sf, "exm").select("image_id", "file_name"), ["file_name"]).select("image_id", "id")


# --- sources and sinks: tables are written to scratch files and scanned back ----

@query("scan_csv_required", f"""with {V('exm')}, n as (select *, row_number() over (order by file_name) - 1 id from exm)
    select image_id::varchar image_id, stratum, box_count::varchar box_count, (id // 1000)::int part, id % 1000 + 2 line from n""")
def scan_csv_required(spark, sf):
    """Files of a thousand rows each; lines count anew in every file."""
    path = scratch_path(spark, "csv")
    ordered = blocks.dense_ids(fx.view(spark, sf, "exm"), ["file_name"], start=0).withColumn("part", F.floor(F.col("id") / 1000))
    ordered = ordered.repartition("part").sortWithinPartitions("part", "id")
    ordered.select("image_id", "stratum", "box_count", "part").write.partitionBy("part").option("header", True).csv(path)
    rows = readers.scan_csv_required(spark, path, ["image_id", "stratum"])
    return rows.withColumn("part", F.regexp_extract("file", "part=([0-9]+)", 1).cast("int")).drop("file")


@query("scan_split_manifests", f"with {V('spl')} select split, count(*) images, sum(box_count)::bigint boxes from spl group by split")
def scan_split_manifests(spark, sf):
    path = scratch_path(spark, "manifests")
    images = fx.view(spark, sf, "spl")
    for name in ("train", "validation", "test"):
        images.filter(F.col("split") == name).select(F.lit("").alias("split"), "image_id", "box_count").write.option("header", True).csv(f"{path}/{name}.csv")
    out = readers.scan_split_manifests(spark, f"{path}/*.csv")
    return out.groupBy("split").agg(F.count("*").alias("images"), F.sum(F.col("box_count").cast("bigint")).alias("boxes"))


def clean_coco(spark, sf):
    images = fx.view(spark, sf, "spl").select("split", F.col("image_id").alias("exam_id"), "file_name", F.lit(1024).alias("width"), F.lit(1024).alias("height"))
    sides = [F.col(c).cast("double").alias(n) for c, n in (("x1", "x"), ("y1", "y"), ("w", "w"), ("h", "h"))]
    b = fx.boxes(spark, sf).filter("rf = 'R'").select(F.col("image_id").alias("exam_id"), F.col("ln").alias("row_number"), *sides)
    return writers.coco_tables(images, b)


COCO_IDS = f"""with {V('spl', 'b')}, n as (select split, image_id, file_name, is_positive, row_number() over (partition by split order by image_id) id from spl),
    an as (select split, row_number() over (partition by split order by n.id, ln) id, n.id image_id, x1, y1, w, h from b join n using (image_id) where rf='R')"""


@query("sink_coco", COCO_IDS + " select split, id, image_id, 1::bigint category_id, (w*h)::double area, x1::double x1, (x1+w)::double x2 from an")
def sink_coco(spark, sf):
    """Three splits, each with ids from 1."""
    path = scratch_path(spark, "coco")
    writers.sink_coco(*clean_coco(spark, sf), path)
    _, annotations = readers.scan_coco_lines(spark, path)
    x = F.get("bbox", F.lit(0))
    return annotations.select("split", "id", "image_id", "category_id", "area", x.alias("x1"), (x + F.get("bbox", F.lit(2))).alias("x2"))


COCO_SUMS = """, c as (select 1::bigint id, 'opacity' as name)
    select n.split, n.id image_id, file_name, count(an.id) boxes, coalesce(sum(w*h), 0)::double area, any_value(c.name) category
    from n left join an on an.image_id=n.id and an.split=n.split cross join c {} group by n.split, n.id, file_name"""


def coco_sums(images, annotations, categories):
    sums = annotations.groupBy("split", "image_id").agg(F.count("*").alias("boxes"), F.sum("area").alias("area"))
    named = categories.agg(F.max("name").alias("category"))  # one row
    return images.select("split", F.col("id").alias("image_id"), "file_name").join(sums, ["split", "image_id"], "left").fillna(0, ["boxes", "area"]).crossJoin(named)


@query("scan_coco", COCO_IDS + COCO_SUMS.format(""))
def scan_coco(spark, sf):
    """Whole documents of a thousand images each, by split, so their number grows and their size does not."""
    path = scratch_path(spark, "coco-doc")
    writers.sink_coco_documents(*clean_coco(spark, sf), path)
    return coco_sums(*readers.scan_coco(spark, path))


@query("scan_coco_selected", COCO_IDS + COCO_SUMS.format("where n.is_positive"))
def scan_coco_selected(spark, sf):
    """The positive images alone; each must be in a document."""
    path = scratch_path(spark, "coco-doc")
    writers.sink_coco_documents(*clean_coco(spark, sf), path)
    return coco_sums(*readers.scan_coco(spark, path, fx.view(spark, sf, "exm").filter("is_positive")))


BUNDLE = f"with {V('pr')} select d::varchar detector, s seed, image_id::varchar image_id, row_number() over (partition by d, s, image_id order by pidx)-1 pidx, label, score, x1::double x1, y1::double y1, x2::double x2, y2::double y2 from pr"


@query("sink_prediction_bundle", BUNDLE)
def sink_prediction_bundle(spark, sf):
    path = scratch_path(spark, "bundle")
    records = writers.bundle_records(fx.det_predictions(spark, sf), fx.det_images(spark, sf), ["d", "s"])
    writers.sink_prediction_bundle(records.withColumnsRenamed({"d": "detector", "s": "seed"}), path)
    return readers.scan_prediction_records(spark, path)


@query("scan_prediction_bundles", f"with {V('pr')} select d::varchar detector, s seed, count(*) boxes, count(distinct image_id) images, round(sum(score), 6) score from pr group by all")
def scan_prediction_bundles(spark, sf):
    """Gzip documents with header and predictions[]: one file per run and thousand images."""
    path = scratch_path(spark, "bundle-doc")
    records = writers.bundle_records(fx.det_predictions(spark, sf), fx.det_images(spark, sf), ["d", "s"])
    entry = F.struct("image_id", "image_size", "boxes_xyxy", "labels", "scores")
    part = F.floor(F.col("image_id").cast("bigint") / 4000).alias("part")  # a thousand images, as ids are sparse
    docs = records.groupBy(F.col("d").cast("string").alias("detector"), F.col("s").alias("seed"), part).agg(F.collect_list(entry).alias("predictions"))
    docs.drop("part").write.option("compression", "gzip").option("maxRecordsPerFile", 1).json(path)
    boxes = readers.scan_prediction_bundles(spark, path)
    return boxes.groupBy("detector", "seed").agg(F.count("*").alias("boxes"), F.count_distinct("image_id").alias("images"), F.round(F.sum("score"), 6).alias("score"))


def yolo_boxes(spark, sf):
    n = geometry.normalized_center(*[F.col(c).cast("double") for c in ("x1", "y1", "w", "h")], F.lit(1024.0), F.lit(1024.0))
    return fx.boxes(spark, sf).filter("rf = 'R'").select("image_id", "ln", (F.col("label") - 1).alias("class_id"), n["xc"].alias("xc"), n["yc"].alias("yc"), n["nw"].alias("w"), n["nh"].alias("h"))


@query("sink_yolo_labels", f"""with {V('b')} select image_id, (label-1)::int class_id, count(*) boxes, round(sum((x1+w/2e0)/1024)*1024, 3) xc, round(sum(h/1024e0)*1024, 3) h from b where rf='R' group by all""")
def sink_yolo_labels(spark, sf):
    """Label files written and read by the label scan, summed per image and class."""
    path = scratch_path(spark, "yolo")
    writers.sink_yolo_labels(fx.det_images(spark, sf), yolo_boxes(spark, sf), "image_id", "ln", path)
    rows = readers.scan_yolo_labels(spark, path, keyed=True)
    pixels = lambda c: F.round(F.sum(c) * 1024, 3).alias(c)
    return rows.groupBy(F.col("file").cast("bigint").alias("image_id"), "class_id").agg(F.count("*").alias("boxes"), pixels("xc"), pixels("h"))


@query("scan_yolo_labels", f"with {V('b')} select (label-1)::int class_id, count(*) boxes, round(sum(w/1024e0), 6) width from b where rf='R' group by all")
def scan_yolo_labels(spark, sf):
    path = scratch_path(spark, "yolo-lines")
    yolo_boxes(spark, sf).select(writers.ten_decimals(F.col("class_id"), *[F.col(c) for c in ("xc", "yc", "w", "h")]).alias("value")).write.text(path)
    rows = readers.scan_yolo_labels(spark, path).filter("fields = 5")
    return rows.groupBy("class_id").agg(F.count("*").alias("boxes"), F.round(F.sum("w"), 6).alias("width"))


MANIFEST = f"with {V('spl')} select split, image_id::varchar image_id, patient_group::varchar nih_patient_id, stratum study_stratum, is_positive::int::varchar is_positive, box_count::varchar box_count from spl"


@query("sink_split_manifest", MANIFEST)
def sink_split_manifest(spark, sf):
    path = scratch_path(spark, "split-manifest")
    rows = fx.view(spark, sf, "spl").select(
        "split", "image_id", F.col("patient_group").alias("nih_patient_id"), F.col("stratum").alias("study_stratum"), "is_positive",
        F.concat(F.col("image_id"), F.lit(".dcm")).alias("source_file"), F.col("file_name").alias("processed_file"), F.lit(1024).alias("width"), F.lit(1024).alias("height"), "box_count")
    writers.sink_split_manifest(rows, path)
    return readers.scan_split_manifests(spark, path).select("split", "image_id", "nih_patient_id", "study_stratum", "is_positive", "box_count")


@query("sink_result_table", "select o_orderpriority stratum, count(*) n, count(distinct o_custkey) patients from orders group by 1")
def sink_result_table(spark, sf):
    path = scratch_path(spark, "result")
    rows = fx.det_images(spark, sf).groupBy("stratum").agg(F.count_distinct("patient_group").alias("patients"), F.count("*").alias("n"))
    writers.sink_result_table(rows, ["stratum", "n", "patients"], path)
    return readers.scan_result_table(spark, path, "stratum string, n bigint, patients bigint")


DOCS = """f as (select doc_id, case doc_id % 3 when 0 then 'train' when 1 then 'validation' else 'test' end split, 'DOC_' || doc_id || '.txt' path, sha256(text) sha, strlen(text) size from documents)"""


def doc_rows(spark, sf):
    split = F.when(F.col("doc_id") % 3 == 0, "train").when(F.col("doc_id") % 3 == 1, "validation").otherwise("test")
    return fx.table(spark, sf, "documents").select("doc_id", split.alias("split"), F.concat(F.lit("DOC_"), F.col("doc_id"), F.lit(".txt")).alias("path"), F.sha2("text", 256).alias("sha"),
                                                   F.octet_length("text").cast("bigint").alias("size"))


@query("file_inventory", "select 'doc_id=' || doc_id folder, lower('doc_id=' || doc_id) key_folder, strlen(text) + 1 size, sha256(text || chr(10)) sha from documents")
def file_inventory(spark, sf):
    """Every text as a file of its own, listed back with key, size and digest."""
    path = scratch_path(spark, "inventory")
    writers.sink_text_files(fx.table(spark, sf, "documents"), "doc_id", "text", path)
    files = readers.file_inventory(spark, path, [".txt"])
    name = lambda c: F.regexp_extract(c, r"([^/]+?)(\.txt)?$", 1)
    return files.select(name("path").alias("folder"), name("key").alias("key_folder"), F.col("size").cast("bigint").alias("size"), "sha")


@query("verify_digests", f"""with {DOCS}, dc as (select path, case when doc_id%13=0 then sha256(sha) else sha end sha, case when doc_id%17=1 then size+1 else size end size from f union all select 'gone_' || doc_id, sha, size from f where doc_id%19=2)
    select dc.path, case when f.path is null then 'missing' when dc.sha<>f.sha then 'digest_mismatch' else 'size_mismatch' end problem from dc left join f using (path) where f.path is null or dc.sha<>f.sha or dc.size<>f.size""")
def verify_digests(spark, sf):
    inv = doc_rows(spark, sf)
    declared = inv.select(
        "path", F.when(F.col("doc_id") % 13 == 0, F.sha2("sha", 256)).otherwise(F.col("sha")).alias("sha"), F.when(F.col("doc_id") % 17 == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size")
    ).unionByName(inv.filter("doc_id % 19 = 2").select(F.concat(F.lit("gone_"), F.col("doc_id")).alias("path"), "sha", "size"))
    return audit.verify_digests(inv, declared)


@query("duplicate_images", f"with {DOCS} select sha, count(*) copies, count(distinct split) splits, min(path) first_path, case when count(distinct split) > 1 then 'cross_split_duplicate' else 'duplicate_image' end code from f group by sha having count(*) > 1")
def duplicate_images(spark, sf):
    return audit.duplicate_images(doc_rows(spark, sf)).drop("split")


LINES = f"""ly as (select *, string_split(trim(line), ' ') f from ylines), lp as (select k, split, pk, len(f) n, row_number() over (partition by k order by ln) line_number, case when regexp_full_match(f[1], '[0-9]+') then try_cast(f[1] as int) end cid,
    try_cast(f[2] as double) xc, try_cast(f[3] as double) yc, try_cast(f[4] as double) w, try_cast(f[5] as double) h from ly where k % 83 <> 3),
    lc as (select *, case when n<>5 then 'label_field_count' when cid is null or xc is null or yc is null or w is null or h is null then 'label_parse' when cid not in (0, 1) then 'unknown_class'
    when not (isfinite(xc) and isfinite(yc) and isfinite(w) and isfinite(h)) then 'nonfinite_box' when w<=0 or h<=0 or least(xc-w/2, yc-h/2)<0 or greatest(xc+w/2, yc+h/2)>1 then 'invalid_box' end c0 from lp),
    ld as (select *, coalesce(c0, case when row_number() over (partition by k, cid, xc, yc, w, h, c0 order by line_number) > 1 then 'duplicate_box' end) code from lc)"""
LAYOUT = f"""with {V('yimg', 'ylines', 'ex')}, {LINES}, lf as (select distinct k, split, split || '/labels/img_' || k || '.txt' path, 'img_' || k key from ylines
    union all select o_orderkey, s, s || '/labels/img_' || o_orderkey || '.txt', 'img_' || o_orderkey from (select o_orderkey, case o_orderkey % 3 when 0 then 'train' when 1 then 'validation' else 'test' end s from orders where o_orderkey not in (select image_id from b) and o_orderkey % 7 = 3)
    union all select o_orderkey, s, s || '/labels/orphan_' || o_orderkey || '.txt', 'orphan_' || o_orderkey from (select o_orderkey, case o_orderkey % 3 when 0 then 'train' when 1 then 'validation' else 'test' end s from orders where o_orderkey % 89 = 2)),
    u as (select split, k, key, min(path) path from yimg group by split, k, key), um as (select u.*, content from u join yimg using (split, key, path)),
    fl as (select um.*, lf.path label_path, (select count(*) from ld where ld.k=um.k and code is null) good, (select count(*) from ld where ld.k=um.k and code is not null) bad from um left join lf using (split, key)),
    fs as (select *, case when label_path is null then 'missing' when (k % 83 = 3 and k in (select k from ylines)) or bad > 0 then 'invalid' when good = 0 then 'empty' else 'valid' end label_status from fl),
    tw as (select min(split) split, min(path) path, case when count(distinct split) > 1 then 'cross_split_duplicate' else 'duplicate_image' end code from um group by content having count(*) > 1),
    li2 as (select split, split || '/labels/img_' || k || '.txt' path, code from ld where code is not null union all select distinct split, split || '/labels/img_' || k || '.txt', 'unreadable_label' from ylines where k % 83 = 3
    union all select y.split, y.path, 'duplicate_stem' from yimg y join u using (split, key) where y.path > u.path union all select split, path, 'orphan_label' from lf where (split, key) not in (select (split, key) from u)
    union all select split, path, 'missing_label' from fs where label_status='missing' union all select * from tw union all select 'extra', null, 'missing_images_directory' union all select 'extra', null, 'missing_labels_directory')"""


def layout(spark, sf):
    images = fx.view(spark, sf, "yimg").select("split", "key", "path", F.sha2("content", 256).alias("sha"), "k")
    lines = fx.view(spark, sf, "ylines")
    name = lambda stem: F.concat(F.col("split"), F.lit(f"/labels/{stem}_"), F.col("k"), F.lit(".txt"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n\n")
    tail = F.when(F.col("k") % 83 == 3, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    real = lines.groupBy("split", "k").agg(body.alias("text")).select("split", name("img").alias("path"), F.concat(F.lit("img_"), "k").alias("key"), F.concat(F.encode("text", "UTF-8"), tail).alias("content"))
    blank = F.encode(F.lit(" \n"), "UTF-8").alias("content")
    split = F.when(F.col("k") % 3 == 0, "train").when(F.col("k") % 3 == 1, "validation").otherwise("test")
    exams = fx.view(spark, sf, "ex").select("k", split.alias("split"))
    no_lines = exams.join(fx.boxes(spark, sf).select(F.col("image_id").alias("k")), "k", "left_anti").filter("k % 7 = 3")
    empty = no_lines.select("split", name("img").alias("path"), F.concat(F.lit("img_"), "k").alias("key"), blank)
    orphan = exams.filter("k % 89 = 2").select("split", name("orphan").alias("path"), F.concat(F.lit("orphan_"), "k").alias("key"), blank)
    return audit.audit_yolo_layout(images, audit.union_all([real, empty, orphan]), ["train", "validation", "test", "extra"], 2)


@query("audit_yolo_layout", LAYOUT + f" select split, path, code, {SEV} severity from li2")
def audit_yolo_layout(spark, sf):
    return layout(spark, sf).issues.select("split", "path", "code", "severity")


@query("yolo_layout_files", LAYOUT + " select split, key, path, sha256(content) sha, label_path, label_status, case when k % 83 = 3 then 0 else good end box_count from fs")
def yolo_layout_files(spark, sf):
    return layout(spark, sf).files


@query("yolo_layout_summary", LAYOUT + """,
    cb as (select um.split, count(*) filter (cid=0) c0, count(*) filter (cid=1) c1 from um join ld on ld.k=um.k and code is null group by um.split),
    dg as (select split, count(*) filter (code='duplicate_image') same, count(*) filter (code='cross_split_duplicate') crossing from tw group by split)
    select split, count(*) images, sum(case when k % 83 = 3 then 0 else good end)::bigint boxes, count(*) filter (label_status='valid') valid_labels,
    count(*) filter (label_status='invalid') invalid_labels, count(*) filter (label_status='empty') empty_labels, count(*) filter (label_status='missing') missing_labels,
    coalesce(any_value(c0), 0) class_0_boxes, coalesce(any_value(c1), 0) class_1_boxes, coalesce(any_value(same), 0) duplicate_groups,
    coalesce(any_value(crossing), 0) cross_split_groups, false passed from fs left join cb using (split) left join dg using (split) group by split""")
def yolo_layout_summary(spark, sf):
    return audit.yolo_layout_summary(layout(spark, sf), 2)


@query("manifest_fingerprint", f"""with {DOCS}, l as (select sha256(coalesce(path, '') || '|' || coalesce(sha, '') || '|' || size) h, sha256(path) k from f), a as (select substr(k, 1, 2) b1, substr(k, 3, 2) b2, substr(k, 5, 2) b3, sha256(string_agg(h, '' order by h)) h, count(*) n from l group by 1, 2, 3),
    b as (select b1, b2, sha256(string_agg(h, '' order by b3)) h, sum(n) n from a group by 1, 2), c as (select b1, sha256(string_agg(h, '' order by b2)) h, sum(n) n from b group by 1) select sha256(string_agg(h, '' order by b1)) fingerprint, sum(n)::bigint "rows" from c""")
def manifest_fingerprint(spark, sf):
    return audit.manifest_fingerprint(doc_rows(spark, sf), "path", ["path", "sha", "size"])


@query("availability_summary", """with e as (select o_orderkey k from orders), src as (select distinct l_orderkey k from lineitem), sz as (select k, case when k%50=0 then 512 else 1024 end w from src), o as (select o_orderkey k from orders where o_orderstatus='F'),
    j as (select e.k, o.k is not null ex, o.k is null and sz.k is not null av, w from e left join o using (k) left join sz using (k)),
    s as (select count(*) selected, count(*) filter (ex) existing, count(*) filter (av) available, count(*) filter (not ex and not av) missing, count(*) filter (av and w<>1024) dimension_errors from j)
    select *, available-dimension_errors converted, case when available=0 and existing=0 then 'metadata_only' when available-dimension_errors+existing=selected and dimension_errors=0 then 'converted' else 'partial' end mode from s""")
def availability_summary(spark, sf):
    orders = fx.table(spark, sf, "orders")
    key = lambda df, c: df.select(F.col(c).alias("file_key"))
    sources = key(fx.table(spark, sf, "lineitem"), "l_orderkey").distinct().withColumns({"width": F.when(F.col("file_key") % 50 == 0, 512).otherwise(1024), "height": F.lit(1024)})
    return audit.availability_summary(key(orders, "o_orderkey"), sources, key(orders.filter("o_orderstatus = 'F'"), "o_orderkey"), 1024, 1024)


@query("prepare_dataset", AUDIT_SQL + """, ok as (select * from ex2 where ok) select (select count(*) from ok) images, (select sum(boxes)::bigint from ok) boxes, (select count(distinct pid) from ok) "groups", 0::bigint shared_groups,
    (select count(*) from iss) issues""")
def prepare_dataset(spark, sf):
    """Audit, group split and COCO ids in one run; totals over all splits."""
    a = the_audit(spark, sf)
    valid = a.exams.filter("valid").select(F.col("exam_id").alias("image_id"), F.col("patient_id").alias("patient_group"), F.col("study_stratum").alias("stratum"), "is_positive", "box_count")
    parts = sampling.group_split(valid, ["opacity", "other", "normal"], RATIOS, 17)
    overlap = sampling.split_group_overlap(parts).agg(F.sum("shared").alias("shared_groups"))
    totals = sampling.split_summary(parts).agg(F.sum("images").alias("images"), F.sum("boxes").alias("boxes"), F.sum("groups").alias("groups"))
    return totals.crossJoin(overlap).crossJoin(a.issues.agg(F.count("*").alias("issues")))
