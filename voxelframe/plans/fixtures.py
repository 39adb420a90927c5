"""Relations derived from the test tables, in Spark and as SQL for the oracle (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.expr("vec_id div 20").alias("z"), (F.col("vec_id") % 20).alias("y"), F.posexplode("embedding").alias("x", "val"))
    rows = rows.select("z", "y", F.col("x").cast("long").alias("x"), "val")
    return rows.withColumn("lin", (F.col("z") * 20 + F.col("y")) * 64 + F.col("x"))


def shape(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    return read(spark, sf_dir, "embeddings").agg(F.expr("max(vec_id) div 20 + 1")).first()[0], 20, 64


def voxel_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.floor(F.abs(F.col("val").cast("double")) * 20).cast("long")
    return voxel(spark, sf_dir).withColumn("label", F.when((F.col("z") + F.col("y") + F.col("x")) % 11 == 0, F.lit(-1)).otherwise(value).cast("long"))


def channel_voxel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.expr("vec_id div 20").alias("z"), (F.col("vec_id") % 20).alias("y"), F.slice("embedding", 1, 7).alias("ch"))


def label_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = F.expr("case when l_linestatus = 'F' and l_quantity < 10 and l_suppkey % 3 = 0 then -1 when l_discount = 0 then 0 else l_suppkey end")
    pred = F.expr(
        "case when l_tax = 0 then 0 when l_linenumber = 1 and l_suppkey % 4 = 0 then l_suppkey + 100000 "
        "when l_suppkey % 5 = 0 and l_linenumber > 4 then 200000 + l_suppkey % 7 "
        "when l_suppkey % 10 = 3 then 300000 + l_linenumber * 1000 + (l_suppkey div 50) else l_suppkey end"
    )
    return read(spark, sf_dir, "lineitem").select(gt.cast("long").alias("gt"), pred.cast("long").alias("pred"), "l_returnflag")


def node(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts")).cast("long")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("skel_id"), F.col("event_id").alias("node_id"), seq.alias("seq"), F.col("value").alias("nm"), "event_type")
    pred = F.expr(
        "case when event_type = 'error' and nm < 20 then 0 when skel_id % 7 in (0, 1) and seq % 50 < 30 then 500000 + (skel_id div 7) "
        "when skel_id % 7 = 2 and seq < 4 then 500000 + (skel_id div 7) when skel_id % 7 in (3, 4) and seq between 10 and 20 then 600000 + (skel_id div 7) "
        "else skel_id * 100 + (seq div 25) end"
    )
    return rows.withColumn("pred_id", pred.cast("long"))


def edge(nodes: DataFrame) -> DataFrame:
    line = Window.partitionBy("skel_id").orderBy("seq")
    rows = nodes.select("skel_id", F.lag("node_id").over(line).alias("u"), F.col("node_id").alias("v"), F.abs(F.col("nm") - F.lag("nm").over(line)).alias("edge_length"))
    return rows.where("u is not null")


def pred_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("pred_aff_test_RibFrac"), F.col("doc_id").cast("string"), F.lit(".zarr")).alias("pred"))


def gt_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select(F.concat(F.lit("RibFrac"), F.col("doc_id").cast("string"), F.lit("-rib-seg.nii.gz")).alias("gt"))


VOXEL = "voxel as (select vec_id // 20 as z, vec_id % 20 as y, cast(i as bigint) as x, embedding[i + 1] as val, vec_id * 64 + i as lin from embeddings, range(64) r(i))"
LABEL = VOXEL + ", vl as (select *, case when (z + y + x) % 11 = 0 then -1 else cast(floor(abs(cast(val as double)) * 20) as bigint) end as label from voxel)"
SHAPE = "(select max(vec_id) // 20 + 1 from embeddings)"
CHANNEL = "cv as (select vec_id // 20 as z, vec_id % 20 as y, embedding[1:7] as ch from embeddings)"
PAIR = """lp as (
    select case when l_linestatus = 'F' and l_quantity < 10 and l_suppkey % 3 = 0 then -1 when l_discount = 0 then 0 else l_suppkey end as gt,
        case when l_tax = 0 then 0 when l_linenumber = 1 and l_suppkey % 4 = 0 then l_suppkey + 100000
            when l_suppkey % 5 = 0 and l_linenumber > 4 then 200000 + l_suppkey % 7
            when l_suppkey % 10 = 3 then 300000 + l_linenumber * 1000 + (l_suppkey // 50) else l_suppkey end as pred, l_returnflag
    from lineitem
), sp as (select case when gt < 0 then 0 else gt end as gt, case when gt < 0 then 0 else pred end as pred, l_returnflag from lp)"""
TABLE = PAIR + """, ct as (select gt, pred, count(*) as n from sp group by 1, 2),
ga as (select gt, sum(n) as a from ct where gt > 0 group by 1), pa as (select pred, sum(n) as b from ct where pred > 0 group by 1),
iou as (select ct.gt, ct.pred, n, a, b, cast(n as double) / (a + b - n) as iou from ct join ga on ct.gt = ga.gt join pa on ct.pred = pa.pred)"""
NODE = """node0 as (select user_id as skel_id, event_id as node_id, row_number() over (partition by user_id order by ts) as seq, value as nm, event_type from events),
node as (select *, case when event_type = 'error' and nm < 20 then 0 when skel_id % 7 in (0, 1) and seq % 50 < 30 then 500000 + (skel_id // 7)
    when skel_id % 7 = 2 and seq < 4 then 500000 + (skel_id // 7) when skel_id % 7 in (3, 4) and seq between 10 and 20 then 600000 + (skel_id // 7)
    else skel_id * 100 + (seq // 25) end as pred_id from node0),
edge as (select * from (select skel_id, lag(node_id) over w as u, node_id as v, abs(nm - lag(nm) over w) as edge_length from node window w as (partition by skel_id order by seq)) where u is not null)"""
