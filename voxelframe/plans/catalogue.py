"""The registered queries over the derived relations and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.functions import scalar
from voxelframe.operators import affinity, assignment, grid_graph, instances, metrics, morphology, points, skeleton, splits, tiles, volume, watershed
from voxelframe.operators.sweep import best_thresholds, sweep_thresholds
from voxelframe.plans import fixtures as fx
from voxelframe.plans import report
from voxelframe.sources import pairing
from voxelframe.storage import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
R = 6


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(*names: str):
    return [F.round(F.col(n).cast("double"), R).alias(n) for n in names]


def table(spark, sf):
    """The contingency table, written once: every score reads it several times."""
    return materialise(metrics.contingency(metrics.exclude_unlabelled(fx.label_pair(spark, sf))), "contingency")


# --- label pairs -------------------------------------------------------------------------------------------------

SIZES = f"with {fx.PAIR}, sz as (select gt as label, count(*) as size from lp where gt > 0 group by 1)"


def sizes(spark, sf):
    return instances.sizes(fx.label_pair(spark, sf), "gt")


@query(f"{SIZES} select label, size from sz")
def instance_sizes(spark, sf):
    return sizes(spark, sf)


@query(f"with {fx.TABLE} select gt, pred, n from ct")
def contingency(spark, sf):
    return table(spark, sf)


@query(f"with {fx.TABLE} select gt, pred, n, cast(a as bigint) as gt_area, cast(b as bigint) as pred_area, round(iou, 6) as iou from iou")
def pair_iou(spark, sf):
    return metrics.pair_iou(table(spark, sf)).select("gt", "pred", "n", "gt_area", "pred_area", *r("iou"))


SCORES = ("precision", "recall", "accuracy", "f1", "mean_true_score_best", "mean_true_score_matrix", "mean_matched_score", "panoptic_quality")


def metric_sql(thresholds: str, group: str = "") -> str:
    g, on = (f"{group}, ", f" and iou.{group} = base.{group}") if group else ("", "")
    gb = f" group by {group}" if group else ""
    src = fx.PAIR + f""", ct as (select {g}gt, pred, count(*) as n from sp group by all),
ga as (select {g}gt, sum(n) as a from ct where gt > 0 group by all), pa as (select {g}pred, sum(n) as b from ct where pred > 0 group by all),
iou as (select {"ct." + g if group else ""}ct.gt, ct.pred, n, a, b, cast(n as double) / (a + b - n) as iou from ct
    join ga on ct.gt = ga.gt {f"and ct.{group} = ga.{group}" if group else ""} join pa on ct.pred = pa.pred {f"and ct.{group} = pa.{group}" if group else ""}),
base as (select {g}count(distinct gt) filter (where gt > 0) as n_true, count(distinct pred) filter (where pred > 0) as n_pred from ct{gb}),
best as (select {g}sum(m) as best, sum(t) as total from (select {g}gt, max(iou) as m, sum(iou) as t from iou group by all){gb}),
cut as (select unnest({thresholds}) as thresh),
hit as (select {"base." + g if group else ""}thresh, n_true, n_pred, count(iou.iou) filter (where iou.iou >= thresh) as tp, avg(iou.iou) filter (where iou.iou >= thresh) as mm
    from base cross join cut left join iou on true{on} group by all),
sc as (select hit.*, best, total, n_pred - tp as fp, n_true - tp as fn from hit left join best on true{f" and best.{group} = hit.{group}" if group else ""}),
pr as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as p, coalesce(tp / nullif(tp + fn, 0), 0) as rc from sc),
full_ as (select {g}'iou' as criterion, cast(thresh as double) as thresh, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn,
    p as precision, rc as recall, coalesce(tp / nullif(tp + fp + fn, 0), 0) as accuracy, coalesce(2 * p * rc / nullif(p + rc, 0), 0) as f1,
    cast(n_true as bigint) as n_true, cast(n_pred as bigint) as n_pred, coalesce(best / nullif(n_true, 0), 0) as mean_true_score_best,
    coalesce(total / nullif(n_true * n_pred, 0), 0) as mean_true_score_matrix, coalesce(mm, 0) as mean_matched_score,
    coalesce(tp / nullif(tp + fp / 2 + fn / 2, 0), 0) as panoptic_quality from pr)"""
    return src


ROUNDED = ", ".join(f"round(cast({s} as double), 6) as {s}" for s in SCORES)


@query(f"with {metric_sql('[0.5]')} select criterion, thresh, tp, fp, fn, n_true, n_pred, {ROUNDED} from full_")
def instance_metrics(spark, sf):
    found = metrics.instance_metrics(table(spark, sf), [0.5])
    return found.select("criterion", "thresh", "tp", "fp", "fn", "n_true", "n_pred", *r(*SCORES))


@query(f"with {metric_sql('[0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]')} select thresh, tp, fp, fn, round(cast(f1 as double), 6) as f1 from full_")
def instance_metrics_sweep(spark, sf):
    found = metrics.instance_metrics(table(spark, sf), [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
    return found.select("thresh", "tp", "fp", "fn", *r("f1"))


@query(f"with {fx.TABLE} select gt, pred, round(iou, 6) as iou from iou qualify row_number() over (partition by gt order by iou desc, pred) = 1")
def best_match_per_gt(spark, sf):
    return metrics.best_match(metrics.pair_iou(table(spark, sf))).select("gt", "pred", *r("iou"))


DICE = f"""with {fx.TABLE}, dice as (select l.gt, coalesce(2.0 * n / (a + b), 0) as dice, coalesce(2.0 * n / (a + b), 0) > 0 as matched
from (select distinct gt from ct where gt > 0) l left join (select * from iou where iou > 0.5) m on l.gt = m.gt)"""


def dice(spark, sf):
    t = table(spark, sf)
    return metrics.dice_table(t, metrics.sure_matches(metrics.pair_iou(t)))


@query(f"{DICE} select gt, round(cast(dice as double), 6) as dice, matched from dice")
def dice_per_gt(spark, sf):
    return dice(spark, sf).select("gt", *r("dice"), "matched")


@query(f"""{DICE} select count(*) as n_labels, count(*) filter (where matched) as n_matched, round(cast(avg(dice) as double), 6) as mean, round(cast(stddev_pop(dice) as double), 6) as std,
round(cast(min(dice) as double), 6) as min, round(cast(max(dice) as double), 6) as max, round(cast(median(dice) as double), 6) as median from dice""")
def dice_summary(spark, sf):
    found = dice(spark, sf).agg(F.count("*").alias("n_labels"), F.count_if("matched").alias("n_matched"), *metrics.spread("dice"))
    return found.select("n_labels", "n_matched", *r("mean", "std", "min", "max", "median"))


@query()
def assigned_pairs(spark, sf):
    return assignment.assign(metrics.pair_iou(table(spark, sf))).select("gt", "pred", *r("iou"))


@query()
def dice_assigned(spark, sf):
    t = table(spark, sf)
    iou = metrics.pair_iou(t)
    pairs = assignment.assign(iou).select("gt", "pred")
    return metrics.dice_table(t, iou.join(pairs, ["gt", "pred"])).select("gt", *r("dice"), "matched")


RANK = f"{SIZES}, rk as (select label as old_label, row_number() over (order by label) as new_label, size from sz)"


@query(f"{RANK} select coalesce(new_label, 0) as new_label, count(*) as n from lp left join rk on lp.gt = rk.old_label group by 1")
def apply_label_map(spark, sf):
    pairs = fx.label_pair(spark, sf)
    mapped = instances.apply_map(pairs, instances.relabel_dense(sizes(spark, sf)), "gt")
    return mapped.groupBy("new_label").agg(F.count("*").alias("n"))


@query("""with c as (select count(*) filter (where quality = 1 and toxic = 0) as tp, count(*) filter (where quality <> 1 and toxic = 0) as fp,
    count(*) filter (where quality = 1 and toxic <> 0) as fn from labels), d as (select *, tp / nullif(tp + fp, 0) as p, tp / nullif(tp + fn, 0) as rc from c)
select tp, fp, fn, round(coalesce(p, 0), 6) as precision, round(coalesce(rc, 0), 6) as recall, round(coalesce(2 * p * rc / nullif(p + rc, 0), 0), 6) as f1,
    round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 6) as accuracy from d""")
def binary_metrics(spark, sf):
    rows = fx.read(spark, sf, "labels")
    found = metrics.binary_metrics(rows, F.col("quality") == 1, F.col("toxic") == 0)
    return found.select("tp", "fp", "fn", *r("precision", "recall", "f1", "accuracy"))


@query(f"""with {fx.TABLE}, g as (select gt, sum(n) as a from ct group by 1), p as (select pred, sum(n) as b from ct group by 1),
v as (select -sum(n * log2(n / a)) / sum(n) as s, -sum(n * log2(n / b)) / sum(n) as m from ct join g on ct.gt = g.gt join p on ct.pred = p.pred)
select round(s, 6) as voi_split, round(m, 6) as voi_merge, round(s + m, 6) as voi_sum from v""")
def voi(spark, sf):
    return metrics.voi(table(spark, sf)).select(*r("voi_split", "voi_merge", "voi_sum"))


@query(f"""with {fx.NODE}, ct as (select skel_id as gt, pred_id as pred, count(*) as n from node group by 1, 2), g as (select gt, sum(n) as a from ct group by 1),
p as (select pred, sum(n) as b from ct group by 1),
v as (select -sum(n * log2(n / a)) / sum(n) as s, -sum(n * log2(n / b)) / sum(n) as m from ct join g on ct.gt = g.gt join p on ct.pred = p.pred)
select round(s, 6) as voi_split, round(m, 6) as voi_merge, round(s + m, 6) as voi_sum from v""")
def voi_nodes(spark, sf):
    pairs = fx.node(spark, sf).select(F.col("skel_id").alias("gt"), F.col("pred_id").alias("pred"))
    return metrics.voi(metrics.contingency(pairs)).select(*r("voi_split", "voi_merge", "voi_sum"))


FILES = metric_sql("[0.5]", "l_returnflag")


@query(f"""with {FILES}, f as (select *, precision as p, recall as rc from full_), t as (select count(*) as n_files, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn,
{", ".join(f"{fn}({c}) as {c}_{name}" for c in ("precision", "recall", "f1") for name, fn in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))} from f),
u as (select *, tp / nullif(tp + fp, 0) as mp, tp / nullif(tp + fn, 0) as mr from t)
select n_files, tp, fp, fn, {", ".join(f"round(cast({c}_{n} as double), 6) as {c}_{n}" for c in ("precision", "recall", "f1") for n in ("mean", "std", "min", "max"))},
round(mp, 6) as micro_precision, round(mr, 6) as micro_recall, round(2 * mp * mr / (mp + mr), 6) as micro_f1 from u""")
def metrics_summary(spark, sf):
    pairs = metrics.exclude_unlabelled(fx.label_pair(spark, sf))
    files = metrics.instance_metrics(metrics.contingency(pairs, ["l_returnflag"]), [0.5], ["l_returnflag"])
    found = metrics.micro_macro(files, ["precision", "recall", "f1"])
    names = [f"{c}_{n}" for c in ("precision", "recall", "f1") for n in ("mean", "std", "min", "max")]
    return found.select("n_files", "tp", "fp", "fn", *r(*names, "micro_precision", "micro_recall", "micro_f1"))


@query(f"with {FILES} select l_returnflag, tp, fp, fn, n_true, n_pred, {ROUNDED} from full_")
def metrics_per_file(spark, sf):
    pairs = metrics.exclude_unlabelled(fx.label_pair(spark, sf))
    files = metrics.instance_metrics(metrics.contingency(pairs, ["l_returnflag"]), [0.5], ["l_returnflag"])
    return files.select("l_returnflag", "tp", "fp", "fn", "n_true", "n_pred", *r(*SCORES))


@query(f"{SIZES} select label, size from sz where size >= 400")
def filter_small(spark, sf):
    return instances.filter_small(sizes(spark, sf), 400)


@query(f"{SIZES}, top as (select label, size from sz order by size desc, label limit 22) select row_number() over (order by label) as new_label, label as old_label, size from top")
def keep_largest_k(spark, sf):
    return instances.keep_largest(sizes(spark, sf), 22)


@query(f"{SIZES} select label, size from sz order by size desc, label limit 1")
def largest_instance(spark, sf):
    return instances.largest(sizes(spark, sf))


@query(f"{RANK} select old_label, new_label from rk")
def relabel_dense(spark, sf):
    return instances.relabel_dense(sizes(spark, sf))


@query(f"""{SIZES} select cast(400 as bigint) as min_size, count(*) as n_before, count(*) filter (where size >= 400) as n_after, count(*) filter (where size < 400) as n_removed,
cast(sum(size) as bigint) as voxels_before, cast(coalesce(sum(size) filter (where size >= 400), 0) as bigint) as voxels_after,
cast(coalesce(sum(size) filter (where size < 400), 0) as bigint) as voxels_removed, cast(coalesce(max(label) filter (where size >= 400), 0) as bigint) as max_label_before from sz""")
def filter_remap_stats(spark, sf):
    return instances.filter_remap_stats(fx.label_pair(spark, sf), 400, "gt")


# --- voxels ------------------------------------------------------------------------------------------------------


@query(f"with {fx.VOXEL} select count(*) filter (where val > cast(0.1 as float)) as n_foreground from voxel")
def threshold_mask(spark, sf):
    return volume.threshold_count(fx.voxel(spark, sf), F.lit(0.1).cast("float"))


@query(f"""with {fx.VOXEL}, c as (select count(*) filter (where val > cast(0.9 as float)) as a, count(*) filter (where val > cast(0.45 as float)) as b from voxel)
select case when a = 0 then b else a end as n_foreground, case when a = 0 then cast(0.45 as double) else cast(0.9 as double) end as thr_used from c""")
def adaptive_threshold(spark, sf):
    return volume.adaptive_threshold(fx.voxel(spark, sf), 0.9)


@query(f"""with {fx.CHANNEL}, p as (select 'affinity' as keep, z, y, unnest(range(3)) as ch, unnest(ch[1:3]) as val from cv
union all select 'skeleton', z, y, 0, ch[7] from cv union all select 'list', z, y, unnest([0, 1]), unnest([ch[2], ch[6]]) from cv)
select keep, z, y, cast(ch as bigint) as ch, val from p""")
def channel_select(spark, sf):
    rows, out = fx.channel_voxel(spark, sf), None
    for name, keep in (("affinity", "affinity"), ("skeleton", "skeleton"), ("list", [1, -2, 9])):
        one = rows.select(F.lit(name).alias("keep"), "z", "y", F.posexplode(scalar.channels(F.col("ch"), keep)).alias("ch", "val"))
        out = one if out is None else out.unionByName(one)
    return out.select("keep", "z", "y", F.col("ch").cast("long").alias("ch"), "val")


@query(f"""with {fx.VOXEL}, e as (select cast(min(val) as double) as lo, cast(max(val) as double) as hi from voxel)
select z, y, x, cast(floor(greatest(0.0, least(255.0, case when lo >= 0 and hi <= 1 then cast(val as double) * 255 when lo >= -1 and hi <= 1 then (cast(val as double) + 1) * 127.5
    else (cast(val as double) - lo) / (hi - lo + 1e-8) * 255 end))) as integer) as u8 from voxel, e""")
def channel_to_uint8(spark, sf):
    return volume.to_uint8(fx.voxel(spark, sf))


@query(f"with {fx.VOXEL} select lin, round(1 / (1 + exp(-0.2 * cast(val as double))), 6) as sig, round(tanh(cast(val as double)), 6) as tanh from voxel")
def scaled_sigmoid_tanh(spark, sf):
    rows = fx.voxel(spark, sf)
    return rows.select("lin", scalar.scaled_sigmoid(F.col("val")).alias("sig"), F.tanh(F.col("val").cast("double")).alias("tanh")).select("lin", *r("sig", "tanh"))


def grid_sql(nz: int, ny: int, nx: int) -> str:
    return f"g as (select cast(a as bigint) as z, cast(b as bigint) as y, cast(c as bigint) as x from range({nz}) q(a), range({ny}) s(b), range({nx}) t(c))"


@query(f"with {fx.VOXEL}, {grid_sql(20, 24, 60)} select g.z, g.y, g.x, coalesce(val, cast(-1 as float)) as val from g left join voxel v on g.z = v.z and g.y = v.y and g.x = v.x")
def align_shape(spark, sf):
    return volume.align(fx.voxel(spark, sf), (20, 24, 60), -1.0).withColumn("val", F.col("val").cast("float"))


@query(f"""with {fx.LABEL}, {grid_sql(104, 25, 70)} select g.z, g.y, g.x, coalesce(label, -1) as label from g
left join vl on g.z = vl.z + (104 - {fx.SHAPE}) // 2 and g.y = vl.y + 2 and g.x = vl.x + 3""")
def center_pad(spark, sf):
    return volume.center_pad(fx.voxel_label(spark, sf), fx.shape(spark, sf), (104, 25, 70), -1, "label", crop=True)


@query(f"with {fx.VOXEL}, {grid_sql(8, 8, 8)} select g.z, g.y, g.x, coalesce(val, cast(0 as float)) as val from g left join (select * from voxel where z < 6 and y < 5 and x < 7) v on g.z = v.z and g.y = v.y and g.x = v.x")
def pad_min(spark, sf):
    small = fx.voxel(spark, sf).where("z < 6 and y < 5 and x < 7")
    return volume.pad_min(small, (6, 5, 7), 8).withColumn("val", F.col("val").cast("float"))


@query(f"""with {fx.VOXEL}, {grid_sql(13, 11, 40)} select g.z, g.y, g.x, val from g join voxel v
on v.z = cast(floor(g.z * (({fx.SHAPE} - 1) / 12.0) + 0.5) as bigint) and v.y = cast(floor(g.y * (19 / 10.0) + 0.5) as bigint) and v.x = cast(floor(g.x * (63 / 39.0) + 0.5) as bigint)""")
def resize_nearest(spark, sf):
    return volume.resize_nearest(fx.voxel(spark, sf), fx.shape(spark, sf), (13, 11, 40))


@query(f"with {fx.VOXEL} select x as z, y, z as x, val from voxel")
def transpose_axes(spark, sf):
    return volume.transpose(fx.voxel(spark, sf))


@query(f"with {fx.VOXEL} select {fx.SHAPE} - 1 - z as z, 64 - 1 - x as y, y as x, val from voxel")
def flip_rot(spark, sf):
    return volume.flip_rotate(fx.voxel(spark, sf), fx.shape(spark, sf), ("z",), 1)


@query(f"with {fx.LABEL} select case when val > cast(0 as float) then label else -1 end as label, count(*) as n from vl group by 1")
def mask_apply(spark, sf):
    rows = fx.voxel_label(spark, sf)
    masked = rows.withColumn("label", scalar.masked_label(F.col("label"), scalar.region_mask(F.col("val"))))
    return masked.groupBy("label").agg(F.count("*").alias("n"))


@query(f"with {fx.VOXEL} select round(avg(case when val > 0 then 1.0 else 0.0 end), 6) as coverage from voxel")
def mask_coverage(spark, sf):
    return fx.voxel(spark, sf).agg(F.avg(scalar.region_mask(F.col("val")).cast("double")).alias("coverage")).select(*r("coverage"))


def affinity_sql(d: int) -> str:
    one = [
        f"select '{a}' as axis, label, lead(label, {d}) over (partition by {', '.join(o for o in 'zyx' if o != a)} order by {a}) as o from vl" for a in "zyx"
    ]
    return f"""with {fx.LABEL}, a as ({' union all '.join(one)}), b as (select axis, coalesce(label = o and label <> 0, false) as aff, coalesce(label <> -1 and o <> -1, false) as m from a)
select axis, count(*) filter (where m and aff) as n_true, count(*) filter (where m and not aff) as n_false, count(*) filter (where not m) as n_masked from b group by 1"""


@query(affinity_sql(1))
def affinities_short(spark, sf):
    return affinity.target_counts(affinity.affinities(fx.voxel_label(spark, sf), 1))


@query(affinity_sql(10))
def affinities_long(spark, sf):
    return affinity.target_counts(affinity.affinities(fx.voxel_label(spark, sf), 10))


# --- tiles -------------------------------------------------------------------------------------------------------

OFFSETS = "select cast(o as bigint) as o from range(0, {n} - 7, 8) r(o) union select cast({n} - 8 as bigint)"


def axis_sql(name: str, n: str) -> str:
    base = OFFSETS.format(n=n)
    return f"base_{name} as ({base}), o{name} as (select o from base_{name} union select o + 4 from base_{name} where o + 4 + 8 <= {n})"


TILES = f"{axis_sql('z', fx.SHAPE)}, {axis_sql('y', '20')}, {axis_sql('x', '64')}, tile as (select oz.o as z0, oy.o as y0, ox.o as x0 from oz, oy, ox)"


@query("with o as (select unnest([5, 8, 20, 64, 70]) as big), "
       "r as (select big, cast(unnest(range(0, greatest(big - 7, 1), 8)) as bigint) as start from o union select big, cast(greatest(big - 8, 0) as bigint) from o) select cast(big as bigint) as big, start from r")
def axis_offsets(spark, sf):
    rows = spark.range(1).select(F.explode(F.array(*(F.lit(n).cast("long") for n in (5, 8, 20, 64, 70)))).alias("big"))
    return rows.select("big", F.explode(tiles.starts(F.col("big"), 8)).alias("start"))


@query(f"with {TILES} select z0, y0, x0 from tile")
def tile_grid(spark, sf):
    return tiles.tile_grid(spark, fx.shape(spark, sf), 8)


@query(f"with {grid_sql(8, 8, 8)} select z as i, y as j, x as k, least(z + 1, 8 - z, y + 1, 8 - y, x + 1, 8 - x) as w from g")
def tile_weight(spark, sf):
    rows = volume.grid(spark, (8, 8, 8))
    return rows.select(F.col("z").alias("i"), F.col("y").alias("j"), F.col("x").alias("k"), tiles.weight(F.col("z"), F.col("y"), F.col("x"), small=8).alias("w"))


@query(f"""with {fx.VOXEL}, {TILES}, t as (select z, y, x, cast(least(z - z0 + 1, 8 - z + z0, y - y0 + 1, 8 - y + y0, x - x0 + 1, 8 - x + x0) as double) as w,
    cast(val as double) + 0.001 * (z0 + y0 + x0) as p from voxel join oz z1(z0) on z0 <= z and z < z0 + 8 join oy y1(y0) on y0 <= y and y < y0 + 8 join ox x1(x0) on x0 <= x and x < x0 + 8)
select z, y, x, round(sum(w * p) / sum(w), 6) as val from t group by 1, 2, 3""")
def tile_blend(spark, sf):
    rows = tiles.with_tiles(fx.voxel(spark, sf), fx.shape(spark, sf), 8)
    rows = rows.withColumn("p", F.col("val").cast("double") + 0.001 * (F.col("z0") + F.col("y0") + F.col("x0")))
    return tiles.blend(rows, 8).select("z", "y", "x", *r("val"))


@query(f"with {fx.VOXEL} select z, y, x, round(cast(val as double) * 2, 6) as val from voxel")
def tile_infer(spark, sf):
    found = tiles.infer(fx.voxel(spark, sf), fx.shape(spark, sf), 8, lambda block: block * 2)
    return found.select("z", "y", "x", *r("val"))


# --- components, morphology, distance ------------------------------------------------------------------------------

FG = f"{fx.VOXEL}, fg as (select z, y, x, lin from voxel where val > cast(0.1 as float))"


STEP = "(select unnest([{z}]) as dz, unnest([{y}]) as dy, unnest([{x}]) as dx)"


def component_sql(offsets, lone: bool, last: str) -> str:
    both = [*offsets, *(tuple(-c for c in d) for d in offsets)]
    step = STEP.format(**{a: ", ".join(str(d[i]) for d in both) for i, a in enumerate("zyx")})
    start = "select lin, lin as comp from fg" if lone else "select lin, lin as comp from fg where lin in (select a from e)"
    return f"""with recursive {FG}, e as (select p.lin as a, q.lin as b from fg p cross join {step} s join fg q on q.z = p.z + s.dz and q.y = p.y + s.dy and q.x = p.x + s.dx),
walk as ({start} union select e.b, walk.comp from walk join e on e.a = walk.lin where walk.comp < e.b),
root as (select lin, min(comp) as root from walk group by 1), c as (select lin, dense_rank() over (order by root) as component from root) {last}"""


def foreground(spark, sf):
    return fx.voxel(spark, sf).where(F.col("val") > F.lit(0.1).cast("float")).select("z", "y", "x", "lin")


@query(component_sql(grid_graph.FACES, False, "select lin, component from c"))
def connected_components_6(spark, sf):
    return grid_graph.affinity_components(fx.voxel(spark, sf), 0.1)


HARD = f"""{fx.VOXEL}, hv as (select z, y, x, lin, val > cast(0.1 as float) as az, val < cast(-0.15 as float) as ay, abs(val) > cast(0.2 as float) as ax from voxel)"""


@query(f"""with recursive {HARD}, n as (select lin as a, lin + 1280 as b from hv where az and z < {fx.SHAPE} - 1 union all select lin, lin + 64 from hv where ay and y < 19 union all select lin, lin + 1 from hv where ax and x < 63),
e as (select a, b from n union select b, a from n), v as (select lin from hv where az or ay or ax union select b from n),
walk as (select lin, lin as comp from v union select e.b, walk.comp from walk join e on e.a = walk.lin where walk.comp < e.b),
root as (select lin, min(comp) as root from walk group by 1) select lin, dense_rank() over (order by root) as component from root""")
def hard_affinity_components(spark, sf):
    v = F.col("val")
    rows = fx.voxel(spark, sf).select("z", "y", "x", "lin", (v > F.lit(0.1).cast("float")).alias("az"), (v < F.lit(-0.15).cast("float")).alias("ay"), (F.abs(v) > F.lit(0.2).cast("float")).alias("ax"))
    return grid_graph.hard_affinity_components(rows, shape=fx.shape(spark, sf))


@query(component_sql(grid_graph.FACES, True, "select lin, component from c"))
def mask_components_6(spark, sf):
    return grid_graph.mask_components(foreground(spark, sf))


@query(component_sql(grid_graph.FULL, True, "select lin, component from c").replace("cast(0.1 as float)", "cast(0.2 as float)"))
def connected_components_26(spark, sf):
    rows = fx.voxel(spark, sf).where(F.col("val") > F.lit(0.2).cast("float")).select("z", "y", "x", "lin")
    return grid_graph.mask_components(rows, grid_graph.FULL)


@query(component_sql(grid_graph.FACES, False, "select component, count(*) as size from c group by 1"))
def component_sizes(spark, sf):
    return grid_graph.affinity_components(fx.voxel(spark, sf), 0.1).groupBy("component").agg(F.count("*").alias("size"))


BALL7 = STEP.format(**{a: ", ".join(str(d[i]) for d in morphology.BALL) for i, a in enumerate("zyx")})
INSIDE = f"nz >= 0 and nz < {fx.SHAPE} and ny >= 0 and ny < 20 and nx >= 0 and nx < 64"
FULLBALL = f"7 - (z = 0)::int - (z = {fx.SHAPE} - 1)::int - (y = 0)::int - (y = 19)::int - (x = 0)::int - (x = 63)::int"


def spread_sql(source: str, extra: str = "") -> str:
    return f"select nz as z, ny as y, nx as x{extra} from (select p.z + s.dz as nz, p.y + s.dy as ny, p.x + s.dx as nx{extra} from {source} p cross join {BALL7} s) q where {INSIDE}"


def dilate_sql(source: str) -> str:
    return f"select distinct z, y, x from ({spread_sql(source)})"


def erode_sql(source: str) -> str:
    return f"select z, y, x from (select z, y, x, count(*) as n from ({spread_sql(source)}) group by 1, 2, 3) where n = {FULLBALL}"


@query(f"with {FG} {erode_sql('fg')}")
def erode(spark, sf):
    return morphology.erode(foreground(spark, sf), fx.shape(spark, sf))


@query(f"with {FG} {dilate_sql('fg')}")
def dilate(spark, sf):
    return morphology.dilate(foreground(spark, sf), fx.shape(spark, sf))


@query(f"with {FG}, d0 as ({dilate_sql('fg')}), a as ({erode_sql('d0')}), b as ({dilate_sql('a')}), c as ({dilate_sql('b')}) {erode_sql('c')}")
def open_close(spark, sf):
    shape = fx.shape(spark, sf)
    return morphology.open_close(morphology.dilate(foreground(spark, sf), shape), shape)


@query(f"with {fx.LABEL}, l as (select z, y, x, label from vl where label > 3) select z, y, x, max(label) as label from ({spread_sql('l', ', label')}) group by 1, 2, 3")
def grey_dilate(spark, sf):
    return morphology.grey_dilate(fx.voxel_label(spark, sf).where("label > 3").select("z", "y", "x", "label"), fx.shape(spark, sf))


BOTH6 = STEP.format(**{a: ", ".join(str(d[i]) for d in morphology.BALL[1:]) for i, a in enumerate("zyx")})
EDGE = f"z = 0 or z = {fx.SHAPE} - 1 or y = 0 or y = 19 or x = 0 or x = 63"


@query(f"""with recursive {FG}, m as ({dilate_sql('fg')}), bg as (select v.z, v.y, v.x from voxel v left join m on v.z = m.z and v.y = m.y and v.x = m.x where m.z is null),
outer_ as (select z, y, x from bg where {EDGE} union select bg.z, bg.y, bg.x from outer_ o cross join {BOTH6} s join bg on bg.z = o.z + s.dz and bg.y = o.y + s.dy and bg.x = o.x + s.dx)
select z, y, x from voxel except select z, y, x from outer_""")
def fill_holes(spark, sf):
    shape = fx.shape(spark, sf)
    return morphology.fill_holes(morphology.dilate(foreground(spark, sf), shape), shape, fx.voxel(spark, sf))


def edt_pass(source: str, axis: str) -> str:
    others = [a for a in "zyx" if a != axis]
    return f"select {', '.join('p.' + a for a in 'zyx')}, min(q.d + (p.{axis} - q.{axis}) * (p.{axis} - q.{axis})) as d from {source} p join {source} q on {' and '.join(f'p.{a} = q.{a}' for a in others)} group by 1, 2, 3"


EDT = f"{fx.VOXEL}, d0 as (select z, y, x, case when val > cast(-0.2 as float) then {float(morphology.FAR)} else 0.0 end::double as d from voxel), d1 as ({edt_pass('d0', 'z')}), d2 as ({edt_pass('d1', 'y')}), d3 as ({edt_pass('d2', 'x')})"


@query(f"with {EDT} select (z * 20 + y) * 64 + x as lin, cast(d as double) as dist2 from d3 where d > 0")
def edt(spark, sf):
    rows = fx.voxel(spark, sf)
    found = morphology.distance_squared(rows.where(F.col("val") > F.lit(-0.2).cast("float")), fx.shape(spark, sf), within=rows)
    return found.select(((F.col("z") * 20 + F.col("y")) * 64 + F.col("x")).alias("lin"), "dist2")


def labelled(found: DataFrame) -> DataFrame:
    return found.select(((F.col("z") * 20 + F.col("y")) * 64 + F.col("x")).alias("lin"), "label")


def parts_sql(p: str, source: str, corners: bool) -> str:
    """CTEs named from ``p``: ``{p}s`` (lin, label) has the components of ``source`` in raster order, over faces or with
    ``corners``: runs along x are joined to the runs of the rows around theirs."""
    rows = [(z, y) for z in (-1, 0, 1) for y in (-1, 0, 1) if (z or y) and (corners or not (z and y))]
    step = f"(select unnest([{', '.join(str(z) for z, _ in rows)}]) as dz, unnest([{', '.join(str(y) for _, y in rows)}]) as dy)"
    return f"""{p}l as materialized (select z, y, x, (z * 20 + y) * 64 + x as lin, x - row_number() over (partition by z, y order by x) as g from {source}),
{p}r as materialized (select z, y, g, min(x) as x0, max(x) as x1, min(lin) as lin from {p}l group by 1, 2, 3),
{p}e as materialized (select p.lin as a, q.lin as b from {p}r p cross join {step} s join {p}r q on q.z = p.z + s.dz and q.y = p.y + s.dy where q.x0 <= p.x1 + {int(corners)} and q.x1 >= p.x0 - {int(corners)}),
{p}w(lin, comp) using key (lin) as (select lin, lin from {p}r
    union select e.b, min(w.comp) from {p}w w join {p}e e on e.a = w.lin join recurring.{p}w o on o.lin = e.b where w.comp < o.comp group by e.b),
{p}s as (select l.lin, dense_rank() over (order by comp) as label from {p}w w join {p}r r on r.lin = w.lin join {p}l l on l.z = r.z and l.y = r.y and l.g = r.g)"""


def flood_sql(p: str, mask: str, seeds: str) -> str:
    """CTEs named from ``p``: ``{p}f`` (lin, label) floods ``mask`` by its distance transform from ``seeds`` (lin, label).

    A voxel is the least (cost, cost before, label) of its neighbours, until none changes.
    """
    return f"""{p}d0 as (select v.z, v.y, v.x, case when m.z is null then 0.0 else {float(morphology.FAR)} end::double as d from voxel v left join {mask} m on m.z = v.z and m.y = v.y and m.x = v.x),
{p}d1 as ({edt_pass(p + "d0", "z")}), {p}d2 as ({edt_pass(p + "d1", "y")}), {p}d3 as ({edt_pass(p + "d2", "x")}),
{p}h as materialized (select (z * 20 + y) * 64 + x as lin, z, y, x, -sqrt(d) as h from {p}d3 where d > 0),
{p}n as materialized (select p.lin as a, q.lin as b, q.h from {p}h p cross join {BOTH6} s join {p}h q on q.z = p.z + s.dz and q.y = p.y + s.dy and q.x = p.x + s.dx where q.lin not in (select lin from {seeds})),
{p}f(lin, level, steps, label) using key (lin) as (
    select s.lin, h, cast(0 as bigint), label from {seeds} s join {p}h h on h.lin = s.lin
    union select n.lin, n.best.l, n.best.s, n.best.label from (
        select e.b as lin, min({{'l': greatest(e.h, u.level), 's': case when e.h > u.level then 0 else u.steps + 1 end, 'l0': u.level, 's0': u.steps, 'label': u.label}}) as best
        from (select distinct e.b from {p}f w join {p}n e on e.a = w.lin) c join {p}n e on e.b = c.b join recurring.{p}f u on u.lin = e.a group by e.b) n
    left join recurring.{p}f o on o.lin = n.lin where o.lin is null or o.level <> n.best.l or o.steps <> n.best.s or o.label <> n.best.label)"""


def kept_sql(source: str, least: int) -> str:
    return f"select * from {source} where label in (select label from {source} group by 1 having count(*) >= {least})"


def filled_sql(p: str, source: str) -> str:
    """CTEs named from ``p``: ``{p}o`` is ``source`` with its holes filled, eroded and dilated (outside is not mask)."""
    return f"""{p}b as materialized (select v.z, v.y, v.x from voxel v left join {source} m on v.z = m.z and v.y = m.y and v.x = m.x where m.z is null),
{p}u as (select z, y, x from {p}b where {EDGE} union select b.z, b.y, b.x from {p}u o cross join {BOTH6} s join {p}b b on b.z = o.z + s.dz and b.y = o.y + s.dy and b.x = o.x + s.dx),
{p}i as (select z, y, x from voxel except select z, y, x from {p}u),
{p}r as (select z, y, x from (select z, y, x, count(*) as n from ({spread_sql(p + "i")}) group by 1, 2, 3) where n = 7), {p}o as materialized ({dilate_sql(p + "r")})"""


def over_sql(value: float) -> str:
    return f"select z, y, x from voxel where val > cast({value} as float)"


@query(f"with recursive {fx.VOXEL}, m as ({over_sql(0.05)}), k as ({over_sql(0.25)}), {parts_sql('c', 'k', True)}, {flood_sql('g', 'm', 'cs')} select lin, label from gf")
def seeded_watershed(spark, sf):
    return labelled(watershed.light_decode(fx.voxel(spark, sf), fx.shape(spark, sf), 0.05, 0.25))


@query(f"""with recursive {fx.VOXEL}, k0 as materialized ({over_sql(0.0)}), {filled_sql('k', 'k0')}, w1 as materialized ({dilate_sql('ko')}), w2 as materialized ({dilate_sql('w1')}), w3 as materialized ({dilate_sql('w2')}),
{parts_sql('c', 'ko', False)}, {flood_sql('g', 'w3', 'cs')}, m0 as materialized ({over_sql(-0.1)}), {filled_sql('m', 'm0')},
q as materialized (select lin, label from gf join mo on gf.lin = (mo.z * 20 + mo.y) * 64 + mo.x), {flood_sql('j', 'mo', 'q')}, t as materialized ({kept_sql('jf', 2)}),
u as materialized (select z, y, x from voxel join t on t.lin = voxel.lin), {parts_sql('v', 'u', False)} select lin, label from vs""")
def two_stage_decode(spark, sf):
    return labelled(watershed.two_stage_decode(fx.voxel(spark, sf), fx.shape(spark, sf), -0.1, 0.0, 2))


@query(f"with recursive {fx.VOXEL}, m as ({over_sql(0.0)}), k as ({over_sql(0.25)}), {parts_sql('c', 'k', True)}, {flood_sql('g', 'm', 'cs')} select lin, label from ({kept_sql('gf', 2)})")
def sdt_decode(spark, sf):
    return labelled(watershed.sdt_decode(fx.voxel(spark, sf), fx.shape(spark, sf), 0.25, 2))


@query(f"""with recursive {fx.LABEL}, m as ({over_sql(0.1)}), k0 as (select z, y, x, label from vl where label > 4), k as ({kept_sql('k0', 5)}),
k1 as (select z, y, x, max(label) as label from ({spread_sql('k', ', label')}) group by 1, 2, 3),
k2 as (select (k1.z * 20 + k1.y) * 64 + k1.x as lin, label from k1 join m on k1.z = m.z and k1.y = m.y and k1.x = m.x),
{flood_sql('g', 'm', 'k2')}, t as ({kept_sql('gf', 5)}) select lin, dense_rank() over (order by label) as label from t""")
def refine_instances(spark, sf):
    rows = fx.voxel_label(spark, sf)
    mask = rows.where(F.col("val") > F.lit(0.1).cast("float"))
    return labelled(watershed.refine(mask, rows.where("label > 4").select("z", "y", "x", "label"), fx.shape(spark, sf), 5, 1, 5, rows))


# --- skeletons ---------------------------------------------------------------------------------------------------


def class_sql(size: str) -> str:
    return f"""pr as (select skel_id, pred_id, count(*) as n from node group by 1, 2 having count(*) > {size}),
mg as (select skel_id, pred_id from pr where pred_id in (select pred_id from pr group by 1 having count(*) > 1)),
cl as (select e.skel_id, a.pred_id as segment, edge_length, case when a.pred_id = 0 or b.pred_id = 0 then 'omitted' when a.pred_id <> b.pred_id then 'split'
    when e.skel_id in (select skel_id from mg) and a.pred_id in (select pred_id from mg) then 'merged' else 'correct' end as kind
    from edge e join node a on e.u = a.node_id join node b on e.v = b.node_id)"""


ERL = """rn as (select skel_id, segment, sum(edge_length) as al, coalesce(sum(edge_length) filter (where kind = 'correct'), 0) as ok from cl group by 1, 2),
sk as (select skel_id, sum(al) as l, sum(ok * ok) as s from rn group by 1), er as (select sum(s) / sum(l) as erl, sum(l * l) / sum(l) as max_erl from sk)"""


@query(f"with {fx.NODE}, {class_sql('5')} select kind, count(*) as n, round(sum(edge_length), 6) as length from cl group by 1")
def skeleton_edges(spark, sf):
    nodes = fx.node(spark, sf)
    found = skeleton.classify(fx.edge(nodes), nodes, 5)
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.sum("edge_length").alias("length")).select("kind", "n", *r("length"))


@query(f"with {fx.NODE}, {class_sql('0')}, {ERL} select round(erl, 6) as erl, round(max_erl, 6) as max_erl, round(erl / max_erl, 6) as nerl from er")
def erl(spark, sf):
    nodes = fx.node(spark, sf)
    return skeleton.expected_run_length(skeleton.classify(fx.edge(nodes), nodes, 0)).select(*r("erl", "max_erl", "nerl"))


def nerl_part(k: str, n: float) -> str:
    return f"select {k} as ignored, * from (with {class_sql(str(n))}, {ERL} select round(erl, 6) as erl, round(erl / max_erl, 6) as nerl from er)"


@query(f"with {fx.NODE} {' union all '.join(nerl_part(f'cast({n} as bigint)', n) for n in (5, 20, 100, 1000000000))}")
def nerl_ignore(spark, sf):
    nodes = fx.node(spark, sf)
    found = skeleton.expected_run_length(skeleton.classify_sizes(fx.edge(nodes), nodes, (5, 20, 100, 1_000_000_000)), ["ignored"])
    return found.select(F.col("ignored").cast("long").alias("ignored"), *r("erl", "nerl"))


@query(f"""with {fx.NODE}, {class_sql('0')} select (select count(*) from mg) as n_mergers, (select count(*) from mg where pred_id <> 0) as n_non0_mergers,
(select cast(sum(k - 1) as bigint) from (select count(distinct pred_id) as k from node where pred_id <> 0 group by skel_id)) as n_splits""")
def merge_split_counts(spark, sf):
    return skeleton.merge_split_counts(fx.node(spark, sf)).select("n_mergers", "n_non0_mergers", "n_splits")


@query(f"with {fx.NODE} select skel_id, round(sum(edge_length), 6) as length from edge group by 1")
def skeleton_lengths(spark, sf):
    return skeleton.lengths(fx.edge(fx.node(spark, sf))).select("skel_id", *r("length"))


THRESHOLDS = sweep_thresholds()


def sweep_part(t: float) -> str:
    body = class_sql("0").replace("from node group", "from nt group").replace("join node a", "join nt a").replace("join node b", "join nt b")
    return f"""select * from (with nt as (select * replace (case when nm < {40 * t} then 0 else pred_id end as pred_id) from node), {body}, {ERL},
ctn as (select skel_id as gt, pred_id as pred, count(*) as n from nt group by 1, 2), cg as (select gt, sum(n) as a from ctn group by 1), cp as (select pred, sum(n) as b from ctn group by 1),
vi as (select -sum(n * log2(n / a)) / sum(n) - sum(n * log2(n / b)) / sum(n) as voi from ctn join cg on ctn.gt = cg.gt join cp on ctn.pred = cp.pred)
select {t}::double as thr, erl / max_erl as nerl, voi, (select count(*) from mg where pred_id <> 0) as non0 from er, vi)"""


@query(f"""with {fx.NODE}, sw as ({' union all '.join(sweep_part(t) for t in THRESHOLDS)})
select round(max(nerl), 6) as best_nerl, (select thr from sw order by round(nerl, 9) desc, thr limit 1) as best_thr, round(min(voi), 6) as best_voi,
round(max(nerl) filter (where non0 = 0), 6) as best_nerl_no_merge, (select thr from sw where non0 = 0 order by round(nerl, 9) desc, thr limit 1) as best_thr_no_merge from sw""")
def threshold_sweep_best(spark, sf):
    nodes = fx.node(spark, sf)
    found = best_thresholds(nodes, fx.edge(nodes), lambda t: F.when(F.col("nm") < 40 * t, F.lit(0)).otherwise(F.col("pred_id")).cast("long"), THRESHOLDS)
    return found.select(*r("best_nerl"), "best_thr", *r("best_voi", "best_nerl_no_merge"), "best_thr_no_merge")


@query()
def point_cloud(spark, sf):
    return points.point_cloud(fx.voxel_label(spark, sf), 64, 20, (1.0, 0.5, 0.5))


@query(f"with {fx.NODE} select skel_id, seq as node_id, cast(3 as bigint) as type, nm as x, nm as y, nm as z, cast(1 as double) as radius, case when seq = 1 then -1 else seq - 1 end as parent_id from node")
def swc_chain(spark, sf):
    nodes = fx.node(spark, sf).select("skel_id", "seq", *(F.col("nm").alias(a) for a in ("x", "y", "z")))
    return points.swc_chain(nodes)


# --- files, splits, reports ----------------------------------------------------------------------------------------

FILE_SQL = "pf as (select 'pred_aff_test_RibFrac' || doc_id || '.zarr' as pred from documents), gf as (select 'RibFrac' || doc_id || '-rib-seg.nii.gz' as gt from labels)"
KEY = r"regexp_extract({c}, 'RibFrac(\d+)', 1)"


@query("""with s as (select cast(p_partkey as varchar) as sample_id from part), k as (select sample_id, row_number() over (order by sample_id) - 1 as i, count(*) over () as n from s)
select sample_id, case when i < round_even(n * 0.8, 0) then 'train' when i < round_even(n * 0.8, 0) + round_even(n * 0.1, 0) then 'val' else 'test' end as split from k""")
def split_assign(spark, sf):
    return splits.split_assign(fx.read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("sample_id")))


@query(f"with {FILE_SQL} select pred, gt from pf join gf on {KEY.format(c='pred')} = {KEY.format(c='gt')}")
def pair_files(spark, sf):
    return pairing.by_id(fx.pred_file(spark, sf), fx.gt_file(spark, sf))


@query(f"with {FILE_SQL} select pred from pf where {KEY.format(c='pred')} not in (select {KEY.format(c='gt')} from gf)")
def pair_unmatched(spark, sf):
    return pairing.unmatched(fx.pred_file(spark, sf), fx.gt_file(spark, sf))


@query(f"with {FILE_SQL} select pred, gt from pf left join gf on {KEY.format(c='pred')} = {KEY.format(c='gt')}")
def pair_left(spark, sf):
    return pairing.left_with_truth(fx.pred_file(spark, sf), fx.gt_file(spark, sf))


@query("""with f as (select 'vol_' || doc_id as p from documents), g as (select 'vol_' || doc_id || '_gt' as t from labels)
select p || '.zarr' as pred, min(t || '.zarr') as gt, cast(3 as bigint) as rule from f join g on contains(t, p) or contains(p, t) or contains(p, replace(t, 'gt_', '')) group by 1""")
def pair_priority(spark, sf):
    preds = fx.read(spark, sf, "documents").select(F.concat(F.lit("vol_"), F.col("doc_id").cast("string"), F.lit(".zarr")).alias("pred"))
    gts = fx.read(spark, sf, "labels").select(F.concat(F.lit("vol_"), F.col("doc_id").cast("string"), F.lit("_gt.zarr")).alias("gt"))
    return pairing.with_priority(preds, gts)


@query("""with f as (select 'm' || doc_id || '_pc2.h5' as path from documents where doc_id % 3 = 0 union all select 'm' || doc_id || '_pc9.h5' from documents where doc_id % 2 = 0),
c as (select 'm' || doc_id as sample, k as rule, 'm' || doc_id || '_' || ['pc2.h5', 'pc9.h5', 'pc2.tif', 'pc9.tif'][k + 1] as path from documents, range(4) r(k))
select sample, path, cast(rule as bigint) as rule from c where path in (select path from f) qualify row_number() over (partition by sample order by rule) = 1""")
def first_candidate(spark, sf):
    docs = fx.read(spark, sf, "documents").select("doc_id", F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("sample"))
    files = docs.where("doc_id % 3 = 0").select(F.concat("sample", F.lit("_pc2.h5")).alias("path")).unionByName(docs.where("doc_id % 2 = 0").select(F.concat("sample", F.lit("_pc9.h5")).alias("path")))
    return pairing.first_existing(docs.select("sample"), files, ["{}_pc2.h5", "{}_pc9.h5", "{}_pc2.tif", "{}_pc9.tif"])


@query(f"{DICE} select l_linestatus as case_name, cast(null as bigint) as label_id, round(cast(avg(dice) as double), 6) as dice, count(*) filter (where matched) as matched, count(*) as total_gt_labels, "
       "round(count(*) filter (where matched) / greatest(count(*), 1), 6) as match_rate from dice, (select distinct 'F' as l_linestatus) group by 1 "
       "union all select 'F', gt, round(cast(dice as double), 6), matched::int::bigint, null, null from dice")
def report_rollup(spark, sf):
    return report.case_report(dice(spark, sf), "F").select("case_name", "label_id", *r("dice"), "matched", "total_gt_labels", *r("match_rate"))


@query("""with n as (select unnest(['mito_a', 'rib_b', 'both']) as name), a as (select unnest(['mito_a', 'both']) as name, unnest([8.0, 4.0]::double[]) as resolution),
b as (select unnest(['rib_b', 'both']) as name, unnest([1.0, 2.0]::double[]) as resolution)
select n.name, coalesce(a.resolution, b.resolution) as resolution from n left join a on n.name = a.name left join b on n.name = b.name""")
def resolution_lookup(spark, sf):
    make = lambda rows: spark.createDataFrame(rows, "name string, resolution double")
    names = spark.createDataFrame([("mito_a",), ("rib_b",), ("both",)], "name string")
    return pairing.resolution(names, make([("mito_a", 8.0), ("both", 4.0)]), make([("rib_b", 1.0), ("both", 2.0)]))


@query(f"with {FILE_SQL} select pred from pf where {KEY.format(c='pred')} not in (select {KEY.format(c='gt')} from gf)")
def skip_existing(spark, sf):
    key = lambda df, c: df.select(c, scalar.case_id(F.col(c)).alias("id"))
    return pairing.not_done(key(fx.pred_file(spark, sf), "pred"), key(fx.gt_file(spark, sf), "gt"))
