"""Queries over datasets of volumes: voxel joins, masks, patches, seeded draws, augmentations and batch statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelframe.operators import datasets, grid_graph, metrics
from voxelframe.plans import fixtures as fx

from .catalogue import query, r


def u(seed: int, *keys: str) -> str:
    """SQL of ``datasets.uniform``."""
    text = " || ':' || ".join([f"'{seed}'", *(f"cast({k} as varchar)" for k in keys)])
    return f"(cast(('0x' || md5({text})[1:8]) as bigint) / 4294967296.0)"


def coarse(spark, sf):
    """A second segmentation of the voxels, without every 13th place along x."""
    return fx.voxel(spark, sf).where("x % 13 <> 0").withColumn("label", F.floor(F.abs(F.col("val").cast("double")) * 10).cast("long"))


COARSE = "co as (select *, cast(floor(abs(cast(val as double)) * 10) as bigint) as label from voxel where x % 13 <> 0)"


@query(f"with {fx.LABEL}, {COARSE} select vl.label as gt, co.label as pred, count(*) as n from vl join co using (z, y, x) group by 1, 2")
def voxel_pairs(spark, sf):
    return metrics.contingency(datasets.pair_voxels(fx.voxel_label(spark, sf), coarse(spark, sf)))


@query(f"""with {fx.LABEL}, {fx.NODE}, pos as (select skel_id, node_id, seq % 7 as z, (node_id // 64) % 23 as y, node_id % 64 as x from node)
select skel_id, node_id, coalesce(label, 0) as pred_id from pos left join vl using (z, y, x)""")
def node_labels(spark, sf):
    at = fx.node(spark, sf).select("skel_id", "node_id", (F.col("seq") % 7).alias("z"), F.expr("(node_id div 64) % 23").alias("y"), (F.col("node_id") % 64).alias("x"))
    return datasets.node_labels(at, fx.voxel_label(spark, sf)).select("skel_id", "node_id", "pred_id")


@query(f"with {fx.VOXEL}, {COARSE} select label, count(*) as n from co where val > 0 and label > 0 group by 1")
def masked_instances(spark, sf):
    return datasets.masked_instances(fx.voxel(spark, sf), coarse(spark, sf)).groupBy("label").agg(F.count("*").alias("n"))


@query(f"with {fx.VOXEL} select lin, case when x % 3 > 0 then val else cast(0 as float) end as val from voxel")
def multiply_mask(spark, sf):
    return datasets.multiply_mask(fx.voxel(spark, sf), F.col("x") % 3 > 0).select("lin", "val")


@query(f"with {fx.VOXEL} select lin, round(cast(val as double) * 1000 / 255, 6) as val from voxel")
def divide_values(spark, sf):
    return datasets.divide(fx.voxel(spark, sf).withColumn("val", F.col("val").cast("double") * 1000)).select("lin", *r("val"))


@query(f"with {fx.CHANNEL} select i as c, z, y, ch[i + 1] as val from cv, range(7) r(i)")
def channels_first(spark, sf):
    return datasets.channels_first(fx.channel_voxel(spark, sf)).select("c", "z", "y", "val")


@query(f"""with {fx.LABEL}, m as (select 'many' as mask, case when label > 1 then 1 else label end as val from vl where label >= 0
    union all select 'two' as mask, 0 as val from vl)
select mask, cast(val as bigint) as val, count(*) as n from m group by 1, 2""")
def binary_masks(spark, sf):
    many = fx.voxel_label(spark, sf).where("label >= 0").select(F.col("label").alias("val"))
    two = fx.voxel_label(spark, sf).select(F.when(F.col("label") > 2, 2).otherwise(0).cast("long").alias("val"))
    both = datasets.binary_mask(many).withColumn("mask", F.lit("many")).unionByName(datasets.binary_mask(two).withColumn("mask", F.lit("two")))
    return both.groupBy("mask", "val").agg(F.count("*").alias("n"))


def start_sql(axis: str, first: int, last: int) -> str:
    return f"cast({first} + floor({u(5, 'draw', repr(axis))} * {last - first + 1}) as bigint) as {axis}0"


@query(f"with d as (select o_orderkey as draw from orders) select draw, {start_sql('z', 0, 90)}, {start_sql('y', 0, 10)}, {start_sql('x', 0, 54)} from d")
def patch_starts(spark, sf):
    draws = fx.read(spark, sf, "orders").select(F.col("o_orderkey").alias("draw"))
    return datasets.patch_starts(draws, (100, 20, 64), 9, 3, 4, 5)


@query(f"with {fx.VOXEL} select z - 1 as z, y - 2 as y, x - 3 as x, val from voxel where z between 1 and 6 and y between 2 and 9 and x between 3 and 18")
def patch_crop(spark, sf):
    wide = datasets.crop(fx.voxel(spark, sf), (1, 2, 3), (6 + 10, 8 + 10, 16 + 10))
    return datasets.crop(wide, (0, 0, 0), (6, 8, 16)).select("z", "y", "x", "val")


@query(f"""with recursive {fx.LABEL}, p as (select (z * 20 + y) * 64 + x as lin, z, y, x, label from vl where z < 4 and y < 8 and x < 16), f as (select * from p where label > 0),
e as (select a.lin as a, b.lin as b from f a join f b on a.label = b.label and abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1),
w as (select lin as a, lin as root from f union select e.b, w.root from w join e on e.a = w.a),
c as (select a as lin, min(root) as root from w group by 1), k as (select root, row_number() over (order by root) as id from (select distinct root from c))
select p.lin, case when p.label < 0 then -1 else coalesce(k.id, 0) end as label from p left join c on p.lin = c.lin left join k on c.root = k.root""")
def crop_relabel(spark, sf):
    part = datasets.crop(fx.voxel_label(spark, sf), (0, 0, 0), (4, 8, 16))
    found = grid_graph.mask_components(part.where("label > 0").select("z", "y", "x", "lin", "label"), grid_graph.FACES, "label")
    joined = part.select("lin", "label").join(found, "lin", "left")
    return joined.select("lin", F.when(F.col("label") < 0, F.lit(-1)).otherwise(F.coalesce("component", F.lit(0))).cast("long").alias("label"))


@query(f"with d as (select o_orderkey as draw, {u(3, 'o_orderkey')} as u from orders) select draw, cast(case when u < 0.2 then 0 when u < 0.7 then 1 else 2 end as bigint) as dataset from d")
def weighted_choice(spark, sf):
    return datasets.choose_weighted(fx.read(spark, sf, "orders").select(F.col("o_orderkey").alias("draw")), [2.0, 5.0, 3.0], 3)


@query(f"select o_orderkey as draw, {u(4, 'o_orderkey')} < 0.25 as synthetic from orders")
def synthetic_choice(spark, sf):
    return datasets.choose_synthetic(fx.read(spark, sf, "orders").select(F.col("o_orderkey").alias("draw")), 0.25, 4)


MANIFEST = "m as (select source as dataset, lpad(cast(doc_id as varchar), 9, '0') as sample from documents)"


def manifest(spark, sf):
    return fx.read(spark, sf, "documents").select(F.col("source").alias("dataset"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("sample"))


@query(f"with {MANIFEST} select dataset, sample, 'train' as role from m union all (select dataset, sample, 'val' as role from m order by dataset, sample limit 1)")
def data_loaders(spark, sf):
    return datasets.loaders(manifest(spark, sf))


@query(f"with {MANIFEST} select dataset, sample from m order by sample limit 25")
def first_samples(spark, sf):
    return datasets.allowed(manifest(spark, sf), None, 25)


@query(f"with {MANIFEST} select dataset, sample from m where sample in ('000000003', '000000005', '000000008')")
def allowed_samples(spark, sf):
    return datasets.allowed(manifest(spark, sf), ["000000003", "000000005", "000000008"])


@query(f"with {MANIFEST} select distinct sample from m where regexp_matches(sample, '7$') or regexp_matches(sample, '^0000001')")
def matching_files(spark, sf):
    return datasets.matching(manifest(spark, sf), ["7$", "^0000001"], "sample")


@query(f"with {fx.VOXEL} select lin, case when {u(6, 'z')} >= 0.3 then val else cast(0 as float) end as val from voxel")
def drop_slices(spark, sf):
    return datasets.drop_slices(fx.voxel(spark, sf), 0.3, 6).select("lin", "val")


def rolled(axis: str, n: int) -> str:
    step = f"cast(floor({u(7, 'z', repr(axis))} * 11) as bigint) - 5"
    return f"case when {u(7, 'z', repr('moved'))} < 0.5 then ({axis} + {step} + {n}) % {n} else {axis} end as {axis}"


@query(f"with {fx.VOXEL} select z, {rolled('y', 20)}, {rolled('x', 64)}, val from voxel")
def shift_slices(spark, sf):
    return datasets.shift_slices(fx.voxel(spark, sf), (0, 20, 64), 0.5, 5, 7).select("z", "y", "x", "val")


@query(f"""with {fx.VOXEL} select lin, round(cast(val as double) * 1.2 - 0.1 + 0.05 * sqrt(-2 * ln(1 - {u(8, 'z', 'y', 'x', repr('u'))})) * cos(2 * pi() * {u(8, 'z', 'y', 'x', repr('v'))}), 6) as val
from voxel""")
def intensity(spark, sf):
    return datasets.intensity(fx.voxel(spark, sf), 1.2, -0.1, 0.05, 8).select("lin", *r("val"))


#: Cubes of 20 along x, as samples: places beyond the volume are absent.
CUBES = "cu as (select x // 20 as draw, z, y, x % 20 as x, val from voxel where z < 20)"


def cubes(spark, sf):
    rows = fx.voxel(spark, sf).where("z < 20")
    return rows.select(F.expr("x div 20").alias("draw"), "z", "y", (F.col("x") % 20).alias("x"), "val")


def d(name: str, *keys: str) -> str:
    return u(9, "draw", f"'{name}'", *keys)


def oriented_sql() -> str:
    orders = ("zyx", "zxy", "yzx", "yxz", "xzy", "xyz")
    first = ", ".join(f"[{', '.join(o[k] for o in orders)}][1 + cast(floor({d('order')} * 6) as bigint)] as {a}" for k, a in enumerate("zyx"))
    out = f"select draw, {first}, val from cu"
    for a, b in ("xy", "xz", "yz"):
        rest = next(c for c in "zyx" if c not in (a, b))
        t = f"cast(floor({d(f'turn {a}{b}')} * 4) as bigint)"
        one = f"case {t} when 1 then 19 - {b} when 2 then 19 - {a} when 3 then {b} else {a} end as {a}"
        two = f"case {t} when 1 then {a} when 2 then 19 - {b} when 3 then 19 - {a} else {b} end as {b}"
        out = f"select draw, {rest}, {one}, {two}, val from ({out})"
    return f"select draw, {', '.join(f'case when {d(f"mirror {a}")} < 0.5 then 19 - {a} else {a} end as {a}' for a in 'zyx')}, val from ({out})"


@query(f"with {fx.VOXEL}, {CUBES} {oriented_sql()}")
def orient_cubes(spark, sf):
    return datasets.orient(cubes(spark, sf), 20, 9)


SLICE = "[z, y, x][1 + cast(floor({}) as bigint)]"
ROLLED = ", ".join(
    f"case when {d('shift')} < 0.5 and {d('shifted', SLICE.format(d('shift axis') + ' * 3'))} < 0.4 and floor({d('shift axis')} * 3) <> {k} "
    f"then ({a} + cast(floor({d(f'by {a}', SLICE.format(d('shift axis') + ' * 3'))} * 7) as bigint) - 3 + 20) % 20 else {a} end as {a}"
    for k, a in enumerate("zyx")
)


@query(f"""with {fx.VOXEL}, {CUBES}, dr as (select draw, z, y, x, case when {d('drop')} < 0.5 and {d('dropped', SLICE.format(d('drop axis') + ' * 3'))} < 0.3 then 0 else val end as val from cu),
sh as (select draw, {ROLLED}, val from dr),
it as (select *, case when {d('intensity')} < 0.5 then val::double * (0.8 + {d('scale')} * 0.4) - 0.1 + {d('add')} * 0.2 else val::double end as v from sh)
select draw, z, y, x, round(case when {d('noise')} < 0.5 then v + sqrt(-2 * ln(1 - {u(9, 'draw', 'z', 'y', 'x', repr('u'))})) * cos(2 * pi() * {u(9, 'draw', 'z', 'y', 'x', repr('v'))}) * {d('strength')} * 0.3 else v end, 5) as val from it""")
def augment_cubes(spark, sf):
    """Slices dropped and shifted, intensities and noise, each in half of the samples."""
    rows = datasets.shift_drawn(datasets.drop_drawn(cubes(spark, sf), 0.3, 9), 20, 0.4, 3, 9)
    found = datasets.intensity_drawn(rows, 0.2, 0.1, 0.3, 9)
    return found.select("draw", "z", "y", "x", F.round("val", 5).alias("val"))


@query(f"""with {fx.LABEL}, s as (select label, count(*) as n from vl where label > 0 group by 1), k as (select label, n from s where n >= 5 order by n desc, label limit 4),
m as (select label, row_number() over (order by label) as id from k) select coalesce(id, 0) as label, count(*) as n from vl left join m using (label) group by 1""")
def postprocess(spark, sf):
    return datasets.postprocess(fx.voxel_label(spark, sf), 5, 4).groupBy("label").agg(F.count("*").alias("n"))


CASES = "c as (select cast(doc_id as varchar) as name, quality * (doc_id % 100) / 100.0 as dice, case when toxic = 1 then 'failed' end as error from labels)"


def cases(spark, sf):
    return fx.read(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("name"), (F.col("quality") * (F.col("doc_id") % 100) / 100.0).cast("double").alias("dice"), F.when(F.col("toxic") == 1, "failed").alias("error")
    )


def stats_sql(good: str) -> str:
    spread = {"mean": "avg", "std": "stddev_pop", "min": "min", "max": "max", "median": "median"}
    made = ", ".join(f"round(cast({f}(cast(dice as double)) filter (where {good}) as double), 6) as {k}" for k, f in spread.items())
    return f"with {CASES} select count(*) as n_files, count(error) as n_failed, count(*) filter (where {good}) as n_used, {made} from c"


@query(stats_sql("error is null"))
def dice_batch(spark, sf):
    return datasets.batch_stats(cases(spark, sf)).select("n_files", "n_failed", "n_used", *r("mean", "std", "min", "max", "median"))


@query(stats_sql("error is null and dice > 0"))
def dice_batch_nonzero(spark, sf):
    return datasets.batch_stats(cases(spark, sf), False).select("n_files", "n_failed", "n_used", *r("mean", "std", "min", "max", "median"))


@query(f"""with {fx.CHANNEL}, p as (select i as c, cast(ch[i + 1] as double) as val from cv, range(7) r(i))
select c, round(min(val), 6) as min, round(max(val), 6) as max, round(avg(val), 6) as mean, round(stddev_samp(val), 6) as std from p group by 1""")
def channel_stats(spark, sf):
    return datasets.value_stats(datasets.channels_first(fx.channel_voxel(spark, sf)), ["c"]).select("c", *r("min", "max", "mean", "std"))


@query(f"with {fx.VOXEL}, c as (select z, avg(case when val > cast(0.17 as float) then 1.0 else 0.0 end) as v from voxel group by 1) select z, round(v, 6) as coverage, v < 0.1 as low from c")
def coverage_flags(spark, sf):
    return datasets.coverage_flags(fx.voxel(spark, sf), ["z"], F.col("val") > F.lit(0.17).cast("float")).select("z", *r("coverage"), "low")


EPOCHS = "d as (select n_name as dataset, cast(floor(1.5 * (40 + n_nationkey * 3 - 8) * (64 + n_nationkey - 8) * (90 - n_nationkey - 8) / 4096.0) as bigint) as length from nation)"


def epochs(spark, sf):
    k = F.col("n_nationkey")
    sets = fx.read(spark, sf, "nation").select(F.col("n_name").alias("dataset"), (40 + k * 3).alias("nz"), (64 + k).alias("ny"), (90 - k).alias("nx"))
    return datasets.epoch_lengths(sets, 16, 4, 1.5).select("dataset", "length")


@query(f"with {EPOCHS} select dataset, length from d")
def epoch_lengths(spark, sf):
    return epochs(spark, sf)


@query(f"with {EPOCHS} select min(length) as length from d")
def shortest_epoch(spark, sf):
    return epochs(spark, sf).agg(F.min("length").alias("length"))


@query("""with t as (select s_name as config, cast(s_suppkey * 37 % 101 + 1 as double) as elapsed from supplier)
select config, elapsed, round(elapsed / (select min(elapsed) from t), 6) as ratio from t""")
def configs_by_time(spark, sf):
    runs = fx.read(spark, sf, "supplier").select(F.col("s_name").alias("config"), (F.col("s_suppkey") * 37 % 101 + 1).cast("double").alias("elapsed"))
    return datasets.against_fastest(runs).select("config", "elapsed", *r("ratio"))
