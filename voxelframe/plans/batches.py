"""Queries over batches of volumes: extraction, matching, tiled predictions, reports and pairing by names."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelframe.operators import batches
from voxelframe.plans import fixtures as fx
from voxelframe.sources import pairing, sinks

from .catalogue import ORACLES, axis_sql, dilate_sql, erode_sql, labelled, parts_sql, query, r

#: Halves of the voxel volume along y as volumes of their own.
HALF = f"{fx.VOXEL}, hv as (select y // 10 as vol_id, z, y % 10 as y, x, lin, val from voxel)"
TRUTH = "tv as (select vol_id, z, y, x, cast(floor(abs(cast(val as double)) * 10) as bigint) as label from hv)"
#: Each true label has two predictions of its own, so the better one of them is the best assignment.
GUESS = "gv as (select vol_id, z, y, x, case when (z + x) % 5 = 0 then 0 when label > 0 then label * 10 + cast((z + y + x) % 3 = 0 as bigint) else 0 end as label from tv)"


def halves(spark, sf):
    return fx.voxel(spark, sf).select(F.expr("y div 10").alias("vol_id"), "z", (F.col("y") % 10).alias("y"), "x", "val")


def half_shape(spark, sf):
    return fx.shape(spark, sf)[0], 10, 64


def truth(spark, sf):
    return halves(spark, sf).withColumn("label", F.floor(F.abs(F.col("val").cast("double")) * 10).cast("long"))


def guess(spark, sf):
    label = F.expr("case when (z + x) % 5 = 0 then 0 when label > 0 then label * 10 + cast((z + y + x) % 3 = 0 as bigint) else 0 end")
    return truth(spark, sf).withColumn("label", label.cast("long"))


DICE = f"""with {HALF}, {TRUTH}, {GUESS}, ct as (select vol_id, tv.label as gt, gv.label as pred, count(*) as n from tv join gv using (vol_id, z, y, x) group by all),
ga as (select vol_id, gt, sum(n) as a from ct where gt > 0 group by all), pa as (select vol_id, pred, sum(n) as b from ct where pred > 0 group by all),
io as (select vol_id, gt, pred, n, a, b, n / (a + b - n) as iou from ct join ga using (vol_id, gt) join pa using (vol_id, pred)),
be as (select * from io qualify row_number() over (partition by vol_id, gt order by iou desc, pred) = 1),
pl as (select vol_id, ga.gt, 2.0 * n / (be.a + b) as dice from ga left join be using (vol_id, gt)),
rows_ as (select vol_id, avg(coalesce(dice, 0)) as dice, count(dice) as matched, count(*) as total_gt_labels from pl group by 1)"""


@query(f"{DICE} select vol_id, round(cast(dice as double), 6) as dice, matched, total_gt_labels, cast(null as varchar) as error, round(matched / greatest(total_gt_labels, 1), 6) as match_rate from rows_")
def batch_dice(spark, sf):
    return batches.dice(truth(spark, sf), guess(spark, sf)).select("vol_id", *r("dice"), "matched", "total_gt_labels", "error", *r("match_rate"))


#: Predictions that several true labels would take: coarser steps, a few voxels a step higher.
RIVAL = "gv as (select vol_id, z, y, x, cast(floor(abs(cast(val as double)) * 7) as bigint) + case when (z + 2 * x + y) % 4 = 0 then 1 else 0 end as label from hv)"


@query(f"""with recursive {DICE.replace(GUESS, RIVAL)[5:]}, gl as (select vol_id, gt, row_number() over (partition by vol_id order by gt) as i from ga),
pr as (select vol_id, pred, 1 << (row_number() over (partition by vol_id order by pred) - 1) as bit from pa),
w as (select vol_id, i, bit, iou, 2.0 * n / (a + b) as dice from io join gl using (vol_id, gt) join pr using (vol_id, pred)),
best(vol_id, i, taken, total, dice, matched) using key (vol_id, i, taken) as (
    select vol_id, cast(0 as bigint), cast(0 as bigint), 0.0::double, 0.0::double, cast(0 as bigint) from gl group by 1
    union select vol_id, i, taken, top.total, top.dice, top.matched from (select vol_id, i, taken, max({{'total': total, 'dice': dice, 'matched': matched}}) as top from (
        select b.vol_id, b.i + 1 as i, taken, total, dice, matched from best b join gl on gl.vol_id = b.vol_id and gl.i = b.i + 1
        union all select b.vol_id, b.i + 1, taken | bit, total + iou, b.dice + w.dice, matched + 1 from best b join w on w.vol_id = b.vol_id and w.i = b.i + 1 where taken & bit = 0) group by all)),
ends as (select vol_id, i, max({{'total': total, 'dice': dice, 'matched': matched}}) as top from best group by all)
select vol_id, round(cast(top.dice / i as double), 6) as dice, top.matched as matched, i as total_gt_labels, cast(null as varchar) as error, round(top.matched / i, 6) as match_rate
from ends qualify row_number() over (partition by vol_id order by i desc) = 1""")
def batch_dice_conflicts(spark, sf):
    """The best assignment where true labels compete for predictions; the oracle tries all choices of labels in turn."""
    label = F.floor(F.abs(F.col("val").cast("double")) * 7) + F.when((F.col("z") + 2 * F.col("x") + F.col("y")) % 4 == 0, 1).otherwise(0)
    found = batches.dice(truth(spark, sf), halves(spark, sf).withColumn("label", label.cast("long")))
    return found.select("vol_id", *r("dice"), "matched", "total_gt_labels", "error", *r("match_rate"))


@query(f"""with recursive {HALF}, fg as (select vol_id, lin, z, y, x from hv where val > cast(0.1 as float)),
e as (select p.lin as a, q.lin as b from fg p join fg q on p.vol_id = q.vol_id and abs(p.z - q.z) + abs(p.y - q.y) + abs(p.x - q.x) = 1 and p.z between q.z - 1 and q.z + 1),
walk as (select lin, lin as comp from fg where lin in (select a from e) union select e.b, walk.comp from walk join e on e.a = walk.lin where walk.comp < e.b),
root as (select lin, min(comp) as root from walk group by 1), sz as (select vol_id, root, count(*) as n from root join fg using (lin) group by all having count(*) >= 3),
top as (select * from sz qualify row_number() over (partition by vol_id order by n desc, root) <= 40)
select vol_id, row_number() over (partition by vol_id order by root) as label, n from top""")
def batch_extract(spark, sf):
    found = batches.extract(halves(spark, sf), half_shape(spark, sf), 0.1, 3, 40)
    return found.groupBy("vol_id", "label").agg(F.count("*").alias("n"))


@query(f"""with {HALF}, {axis_sql('z', fx.SHAPE)}, {axis_sql('y', '10')}, {axis_sql('x', '64')},
t as (select vol_id, z, y, x, z0, y0, x0, cast(val as double) as val from hv join oz z1(z0) on z0 <= z and z < z0 + 8 join oy y1(y0) on y0 <= y and y < y0 + 8 join ox x1(x0) on x0 <= x and x < x0 + 8),
m as (select vol_id, z0, y0, x0, max(val) as top from t group by all),
p as (select vol_id, z, y, x, least(z - z0 + 1, 8 - z + z0, y - y0 + 1, 8 - y + y0, x - x0 + 1, 8 - x + x0) as w, val / top as p from t join m using (vol_id, z0, y0, x0))
select vol_id, z, y, x, round(cast(sum(w * p) / sum(w) as double), 6) as val from p group by all""")
def infer_volumes(spark, sf):
    """The model divides a tile by its largest value: what it gives depends on the tiling."""
    found = batches.infer_volumes(halves(spark, sf), half_shape(spark, sf), 8, lambda block: block / block.max())
    return found.select("vol_id", "z", "y", "x", *r("val"))


LOGIT = {"z": "val * 10", "y": "0 - val * 8 - 0.5", "x": "abs(val) * 6 - 0.9"}
FLAGS = ", ".join(f"1 / (1 + exp(-0.2 * (with_.d{a}))) > 0.51 as a{a}" for a in "zyx")


@query(f"""with recursive {fx.VOXEL}, with_ as (select z, y, x, lin, {', '.join(f"{v.replace('val', 'cast(val as double)')} as d{a}" for a, v in LOGIT.items())} from voxel),
hv as (select z, y, x, lin, {FLAGS} from with_),
n as (select lin as a, lin + 1280 as b from hv where az and z < {fx.SHAPE} - 1 union all select lin, lin + 64 from hv where ay and y < 19 union all select lin, lin + 1 from hv where ax and x < 63),
e as (select a, b from n union select b, a from n), v as (select lin from hv where az or ay or ax union select b from n),
walk as (select lin, lin as comp from v union select e.b, walk.comp from walk join e on e.a = walk.lin where walk.comp < e.b),
root as (select lin, min(comp) as root from walk group by 1) select lin, dense_rank() over (order by root) as component from root""")
def affinity_segmentation(spark, sf):
    rows = fx.voxel(spark, sf).withColumn("val", F.col("val").cast("double"))
    return batches.affinity_segmentation(rows.withColumn("ch", F.array(*(F.expr(v) for v in LOGIT.values()))), 0.51, fx.shape(spark, sf))


@query(f"""with recursive {fx.LABEL}, p0 as (select z, y, x, label from vl where label > 0), p as (select z, y, x from p0 where label in (select label from p0 group by 1 having count(*) >= 40)),
a as materialized ({erode_sql('p')}), b as materialized ({dilate_sql('a')}), c as materialized ({dilate_sql('b')}), d as materialized ({erode_sql('c')}),
{parts_sql('k', 'd', True)} select lin, label from ks""")
def clean_components(spark, sf):
    """Size filter, opening and closing, and the components over corners of what is left."""
    shape = fx.shape(spark, sf)
    return labelled(batches.clean(fx.voxel_label(spark, sf).select("z", "y", "x", "label"), shape, 40, None, True))


@query(f"""select v.*, e.*, m.*, max(n.nerl) filter (where ignored = 5) as nerl_5, max(n.nerl) filter (where ignored = 20) as nerl_20
from ({ORACLES['voi_nodes']}) v, ({ORACLES['erl']}) e, ({ORACLES['merge_split_counts']}) m, ({ORACLES['nerl_ignore']}) n group by all""")
def skeleton_report(spark, sf):
    nodes = fx.node(spark, sf)
    found = batches.skeleton_report(nodes, fx.edge(nodes), (5, 20))
    return found.select(*r("voi_split", "voi_merge", "voi_sum", "erl", "max_erl", "nerl", "nerl_5", "nerl_20"), "n_mergers", "n_non0_mergers", "n_splits")


@query(f"""with {HALF}, {TRUTH}, s as (select vol_id, label, count(*) as n from tv where label > 0 group by all)
select vol_id, count(*) as n_before, count(*) filter (where n >= 50) as n_after, count(*) filter (where n < 50) as n_removed, cast(sum(n) as bigint) as voxels_before,
    cast(coalesce(sum(n) filter (where n >= 50), 0) as bigint) as voxels_after, cast(coalesce(sum(n) filter (where n < 50), 0) as bigint) as voxels_removed from s group by 1""")
def batch_filter_remap(spark, sf):
    return batches.filter_remap(truth(spark, sf), 50)


@query(f"with {HALF} select vol_id, [2.0::double, 0.5::double, 0.5::double] as spacing, [0.0::double, 0.0::double, 0.0::double] as origin, [max(z) + 1, max(y) + 1, max(x) + 1] as shape from hv group by 1")
def volume_meta(spark, sf):
    return sinks.volume_meta(halves(spark, sf), (2.0, 0.5, 0.5))


@query("""with p as (select 'pred_scan' || doc_id || '_b.zarr' as pred, 'pred_scan' || doc_id || '_b' as a, 'scan' || doc_id || '_b' as b from documents),
g as (select 'gt_scan' || doc_id || case when doc_id % 2 = 0 then '_b' else '' end || '.nii.gz' as gt, 'gt_scan' || doc_id || case when doc_id % 2 = 0 then '_b' else '' end as c,
    'scan' || doc_id || case when doc_id % 2 = 0 then '_b' else '' end as d from labels)
select pred, min(gt) as gt, cast(3 as bigint) as rule from p join g on contains(c, a) or contains(c, b) or contains(a, c) or contains(a, d) group by 1""")
def pair_contained(spark, sf):
    """Names that lie within others only without their marks, some within several."""
    number = F.col("doc_id").cast("string")
    preds = fx.read(spark, sf, "documents").select(F.concat(F.lit("pred_scan"), number, F.lit("_b.zarr")).alias("pred"))
    gts = fx.read(spark, sf, "labels").select(F.concat(F.lit("gt_scan"), number, F.when(F.col("doc_id") % 2 == 0, "_b").otherwise(""), F.lit(".nii.gz")).alias("gt"))
    return pairing.with_priority(preds, gts)
