"""Incremental scoring: label pairs that arrive as files are scored volume by volume, as soon as a volume is whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxelframe.operators import metrics
from voxelframe.storage import materialise

PAIRS = "vol_id string, gt long, pred long, n_voxels long"
PENDING = "vol_id string, gt long, pred long, n long, n_voxels long"


def score_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, thresholds: Sequence[float] = (0.5,), files: int | None = None) -> StreamingQuery:
    """Scores of the volumes (vol_id, gt, pred, n_voxels) whose ``n_voxels`` rows have all arrived, in any number of files
    and batches of at most ``files`` of them.

    The state is a table of counted pairs: those of volumes that are not whole yet, as the batch before left them, are
    added to the batch's own, so a volume is never gathered in one task and only counts are kept. A batch writes its
    scores (``scores/batch=N``) and what is left (``pending/batch=N``) in place of an earlier attempt's, so a restart
    scores nothing twice. Rows of a volume that has been scored start it anew.
    """
    read = spark.readStream.schema(PAIRS)
    rows = (read.option("maxFilesPerTrigger", files) if files else read).parquet(source)

    def score(batch: DataFrame, number: int) -> None:
        counted = metrics.exclude_unlabelled(batch).groupBy("vol_id", "gt", "pred").agg(F.count("*").alias("n"), F.max("n_voxels").alias("n_voxels"))
        if number:
            counted = counted.unionByName(batch.sparkSession.read.schema(PENDING).parquet(f"{sink}/pending/batch={number - 1}"))
        table = materialise(counted.groupBy("vol_id", "gt", "pred").agg(F.sum("n").alias("n"), F.max("n_voxels").alias("n_voxels")), "stream-pairs")
        held = table.groupBy("vol_id").agg((F.sum("n") >= F.max("n_voxels")).alias("whole"))
        whole, rest = (table.join(held.where(c), "vol_id", "left_semi") for c in ("whole", "whole is null or not whole"))
        metrics.instance_metrics(whole.drop("n_voxels"), list(thresholds), ["vol_id"]).write.mode("overwrite").parquet(f"{sink}/scores/batch={number}")
        rest.write.mode("overwrite").parquet(f"{sink}/pending/batch={number}")

    return rows.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
