"""Detection views derived from the star-schema tables with integer arithmetic.

Boxes come from lineitem keys; rows with return flag R are the annotated targets,
other flags give false positives, and each detector drops the rows its miss rule
names, so both kinds of error occur. The SQL twin below is what the oracle runs.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlens.operators.images import CORRUPTIONS
from boxlens.session import by_key, key_partitions

DETECTORS = (0, 1)
SEEDS = (17, 42, 137)
CLASSES = (1, 2)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def runs(spark: SparkSession) -> DataFrame:
    d = F.explode(F.array(*[F.lit(x) for x in DETECTORS])).alias("d")
    return spark.range(1).select(d).select("d", F.explode(F.array(*[F.lit(x) for x in SEEDS])).alias("s"))


def classes(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(x).cast("bigint") for x in CLASSES])).alias("label"))


def det_images(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("image_id"), F.lit(1024).alias("width"), F.lit(1024).alias("height"),
        F.col("o_custkey").alias("patient_group"), F.col("o_orderpriority").alias("stratum"),
    )


def image_partitions(spark: SparkSession, sf: str) -> int | None:
    """Number of tasks that boxes are dealt to by image."""
    return key_partitions(table(spark, sf, "lineitem"))


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    # partitioned by image once, before runs multiply the rows: every later step is keyed by the image and needs no other exchange
    raw = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    raw = by_key(raw, "l_orderkey", image_partitions(spark, sf))
    li = raw.groupBy(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").cast("bigint").alias("ln")).agg(
        F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"), F.min("l_quantity").cast("bigint").alias("q"),
        F.min("l_returnflag").alias("rf"),
    )
    pk, sk, ln = F.col("pk"), F.col("sk"), F.col("ln")
    return li.select(
        "image_id", "ln", "pk", "sk", "rf", (1 + sk % 2).alias("label"),
        (16 + (pk * 37 + ln * 211) % 880).alias("x1"), (16 + (sk * 91 + ln * 137 + pk * 5) % 880).alias("y1"),
        (40 + F.col("q")).alias("w"), (40 + pk % 60).alias("h"),
    )


def det_targets(spark: SparkSession, sf: str) -> DataFrame:
    return boxes(spark, sf).filter("rf = 'R'").select(
        "image_id", F.col("ln").alias("tidx"), "label", "x1", "y1",
        (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2"),
    )


def det_predictions(spark: SparkSession, sf: str, seeds=SEEDS) -> DataFrame:
    b = boxes(spark, sf).withColumn("d", F.explode(F.array(*[F.lit(x) for x in DETECTORS]))).withColumn(
        "s", F.explode(F.array(*[F.lit(x) for x in seeds]))
    )
    d, s, ln, pk, sk, img = (F.col(c) for c in ("d", "s", "ln", "pk", "sk", "image_id"))
    missed = (img + ln * 3 + s + d) % 5 == 0
    dx = (pk * s + ln * 7 + d * 3) % (13 + 8 * d) - (6 + 4 * d)
    dy = (sk * s + ln * 11 + d * 5) % (13 + 8 * d) - (6 + 4 * d)
    score = ((img * 7919 + ln * 104729 + s * 31 + d * 17) % 1000).cast("double") / F.lit(1000.0)
    x1, y1 = F.col("x1") + dx, F.col("y1") + dy
    return b.filter(~missed).select(
        "d", "s", "image_id", ln.alias("pidx"), "label", score.alias("score"), x1.alias("x1"), y1.alias("y1"),
        (x1 + F.col("w")).alias("x2"), (y1 + F.col("h")).alias("y2"),
    )


def dense(df: DataFrame, index: str, per_image: int = 30) -> DataFrame:
    """Merge ``per_image`` consecutive images into one, so boxes compete; density does not grow with scale."""
    return df.withColumns({
        index: F.col("image_id") * 8 + F.col(index), "image_id": F.floor(F.col("image_id") / per_image).cast("bigint"),
    })


#: (condition, corruption number, severity): the clean images and every corruption at every severity.
CONDITIONS = (("clean", 0, 0), *[(f"{c[0]}_s{sev}", i, sev) for i, c in enumerate(CORRUPTIONS) for sev in range(1, len(c[4]) + 1)])
_CONDITION_SQL = "(values " + ", ".join(f"('{name}', {i}, {sev})" for name, i, sev in CONDITIONS) + ") c(condition, kind, sev)"


def conditions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CONDITIONS), "condition string, kind int, sev int")


def condition_runs(spark: SparkSession) -> DataFrame:
    return conditions(spark).select("condition", F.explode(F.array(*[F.lit(x) for x in DETECTORS])).alias("d"), F.lit(17).alias("s"))


def condition_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """One seed under all conditions: boxes drift with severity and corruption, scores drop with severity."""
    every = F.array(*[F.struct(F.lit(n).alias("condition"), F.lit(i).alias("kind"), F.lit(sev).alias("sev")) for n, i, sev in CONDITIONS])
    p = det_predictions(spark, sf, (17,)).select("*", F.inline(every))
    sev, kind = F.col("sev"), F.col("kind")
    dx, dy = sev * (3 + 2 * F.col("d")) + kind, sev * 2 - kind
    return p.select(
        "condition", "d", "s", "image_id", "pidx", "label", (F.col("score") * (20 - sev) / F.lit(20.0)).alias("score"),
        (F.col("x1") + dx).alias("x1"), (F.col("y1") + dy).alias("y1"), (F.col("x2") + dx).alias("x2"), (F.col("y2") + dy).alias("y2"),
    )


def degenerate_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """All runs, with the scores of (1, 137) so low that its operating point is empty."""
    low = (F.col("d") == 1) & (F.col("s") == 137)
    return det_predictions(spark, sf).withColumn("score", F.when(low, F.col("score") * F.lit(0.04)).otherwise(F.col("score")))


# The same views in SQL. Each entry lists what it needs.
_SQL = {
    "li": ((), """select l_orderkey image_id, cast(l_linenumber as bigint) ln, min(l_partkey) pk, min(l_suppkey) sk,
        cast(min(l_quantity) as bigint) q, min(l_returnflag) rf from lineitem group by 1, 2"""),
    "b": (("li",), """select image_id, ln, pk, sk, rf, 1+sk%2 as label, 16+(pk*37+ln*211)%880 x1,
        16+(sk*91+ln*137+pk*5)%880 y1, 40+q w, 40+pk%60 h from li"""),
    "runs": ((), "select d, s from (values (0),(1)) a(d), (values (17),(42),(137)) b(s)"),
    "classes": ((), "select cast(label as bigint) label from (values (1),(2)) c(label)"),
    "im": ((), """select o_orderkey image_id, 1024 width, 1024 height, o_custkey patient_group, o_orderpriority stratum from orders"""),
    "tg": (("b",), "select image_id, ln tidx, label, x1, y1, x1+w x2, y1+h y2 from b where rf='R'"),
    "p0": (("b", "runs"), """select r.d, r.s, b.*, (pk*r.s+ln*7+r.d*3)%(13+8*r.d)-(6+4*r.d) dx,
        (sk*r.s+ln*11+r.d*5)%(13+8*r.d)-(6+4*r.d) dy,
        cast((image_id*7919+ln*104729+r.s*31+r.d*17)%1000 as double)/1000e0 score
        from b cross join runs r where (image_id+ln*3+r.s+r.d)%5<>0"""),
    "pr": (("p0",), "select d, s, image_id, ln pidx, label, score, x1+dx x1, y1+dy y1, x1+dx+w x2, y1+dy+h y2 from p0"),
    "cruns": ((), f"select condition, d, 17 s from {_CONDITION_SQL}, (values (0),(1)) a(d)"),
    "cpr": (("pr",), f"""select condition, d, s, image_id, pidx, label, score*(20-sev)/20e0 score,
        x1+sev*(3+2*d)+kind x1, y1+sev*2-kind y1, x2+sev*(3+2*d)+kind x2, y2+sev*2-kind y2 from pr, {_CONDITION_SQL} where s=17"""),
    "gpr": (("pr",), "select d, s, image_id, pidx, label, case when d=1 and s=137 then score*0.04e0 else score end score, x1, y1, x2, y2 from pr"),
    # raw annotation text with one injected defect per issue code (by key modulus)
    "ex": (("tg",), """select o_orderkey k, o_custkey c, coalesce(nr, 0) nr from orders left join (select image_id, count(*) nr from tg group by image_id) z on z.image_id = o_orderkey"""),
    "lab0": (("b", "ex"), """select b.image_id k, b.ln, b.pk, b.x1, b.y1, b.w, b.h, case when e.nr > 0 then 1 else 0 end pos from b join ex e on e.k = b.image_id where (e.nr > 0 and b.rf = 'R') or e.nr = 0
        union all select e.k, 15, e.k, 0, 0, 0, 0, 0 from ex e left join (select distinct image_id from b) z on z.image_id = e.k where z.image_id is null"""),
    "lab1": (("lab0",), "select *, k*64+ln row_number from lab0 union all select *, k*64+ln+32 from lab0 where pos = 1 and pk % 67 = 5"),
    "raw_labels": (("lab1",), """select row_number, case when pk % 97 = 0 then '' else concat('e', k) end exam_id,
        case when pos = 1 then case when pk % 79 = 2 then 'abc' when pk % 71 = 4 then '1000' else concat('', x1) end else case when pk % 61 = 6 then '1' else '' end end x,
        case when pos = 1 then concat(' ', y1) else '' end y, case when pos = 1 then case when pk % 73 = 3 then '0' else concat('', w) end else '' end width,
        case when pos = 1 then concat('', h) else '' end height, case when k % 89 = 0 then '7' when pos = 1 and pk % 83 = 1 then '0' else concat('', pos) end target from lab1"""),
    "raw_classes": (("ex",), """select k*4 row_number, concat('e', k) exam_ref, case when k % 41 = 4 then '' when k % 47 = 2 then 'weird' when (nr > 0) <> (k % 43 = 3) then 'opacity' when c % 2 = 1 then 'other' else 'normal' end label
        from ex where k % 59 <> 0 union all select k*4+1, concat('e', k), 'other' from ex where k % 53 = 1 union all select k*4+2, concat('x', k), 'normal' from ex where k % 37 = 5"""),
    "raw_mapping": (("ex",), """select k*4 entry, concat('e', k) subset_key, case when k % 31 = 6 then 'bad.png' else concat(lpad(concat('', c), 8, '0'), '_001.png') end original_name from ex where k % 101 <> 9
        union all select k*4+1, concat('e', k), concat(lpad(concat('', c+1), 8, '0'), '_002.png') from ex where k % 29 = 7
        union all select k*4+2, concat('e', k), concat(lpad(concat('', c), 8, '0'), '_003.png') from ex where k % 23 = 8"""),
    "exm": (("im", "ex"), "select image_id, patient_group, stratum, nr box_count, nr > 0 is_positive, concat('img_', image_id, '.png') file_name from im join ex on k = image_id"),
    "spl": (("exm",), """select exm.*, case when image_id % 50 = 0 then 'test' when patient_group % 10 < 7 then 'train' when patient_group % 10 < 9 then 'validation' else 'test' end split from exm"""),
    "coco_images": (("ex",), """select k id, case when k % 97 = 1 then concat('../img_', k, '.png') when k % 83 = 3 then concat('IMG_', k-1, '.PNG') else concat('img_', k, '.png') end file_name,
        case when k % 89 = 2 then 0 else 1024 end width, 1024 height from ex union all select k, concat('copy_', k, '.png'), 1024, 1024 from ex where k % 79 = 4"""),
    "coco_ann": (("b",), """select image_id*64+ln id, case when pk % 73 = 5 then image_id + 1000000000000 else image_id end image_id, case when pk % 71 = 6 then 99 else label end category_id,
        case when pk % 47 = 11 then 1020 else x1 end x, y1 y, case when pk % 59 = 9 then 0 else w end w, h, case when pk % 53 = 10 then 3 else 4 end numbers,
        w*h + case when pk % 67 = 7 then 1 else 0 end area, case when pk % 61 = 8 then 1 else 0 end iscrowd from b"""),
    "coco_cat": ((), "select r_regionkey id, r_name name, r_regionkey position from region union all select 2, 'AFRICA', 9 from region where r_regionkey = 0"),
    "yimg": ((), """select k, split, concat('img_', k) key, concat(split, '/images/IMG_', k, '.png') path, content from (select o_orderkey k, case o_orderkey % 3 when 0 then 'train' when 1 then 'validation' else 'test' end split,
        concat('', cast(round(o_totalprice * 100) as bigint)) content from orders) z union all
        select o_orderkey, case o_orderkey % 3 when 0 then 'train' when 1 then 'validation' else 'test' end, concat('img_', o_orderkey), concat(case o_orderkey % 3 when 0 then 'train' when 1 then 'validation' else 'test' end, '/images/img_', o_orderkey, '.jpg'), 'copy' from orders where o_orderkey % 97 = 1"""),
    "ylab": (("b",), """select image_id k, ln, case image_id % 3 when 0 then 'train' when 1 then 'validation' else 'test' end split, concat(
        case when pk % 43 = 1 then 'x' when pk % 47 = 2 then '9' else concat('', label - 1) end, ' ', case when pk % 53 = 3 then 'nan' else concat('', cast(2*x1+w as double)/2048) end, ' ', concat('', cast(2*y1+h as double)/2048), ' ',
        case when pk % 59 = 4 then '1.5' else concat('', cast(w as double)/1024) end, ' ', concat('', cast(h as double)/1024), case when pk % 41 = 0 then ' 9' else '' end) line, pk from b where image_id % 11 <> 0"""),
    "ylines": (("ylab",), "select * from ylab union all select k, ln+32, split, line, pk from ylab where pk % 61 = 5"),
    "dtg": (("tg",), "select image_id//30 image_id, image_id*8+tidx tidx, label, x1, y1, x2, y2 from tg"),
    "dpr": (("pr",), "select d, s, image_id//30 image_id, image_id*8+pidx pidx, label, score, x1, y1, x2, y2 from pr"),
}


def sql_views(*names: str) -> str:
    """Comma-joined CTE definitions of the named views and what they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in _SQL[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ",\n".join(f"{n} as ({_SQL[n][1]})" for n in ordered)


# tables each shared SQL view may read
_TABLES = ("region", "orders", "lineitem")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A derived view from the shared SQL text."""
    for t in _TABLES:
        table(spark, sf, t).createOrReplaceTempView(t)
    return spark.sql(f"with {sql_views(name)} select * from {name}")
