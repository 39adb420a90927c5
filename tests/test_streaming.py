"""Scores of volumes that arrive over several files and restarts."""

import numpy as np

from voxelframe.operators import metrics
from voxelframe.streaming.scoring import score_stream


def test_volumes_are_scored_once_when_they_are_whole(spark, tmp_path):
    rng = np.random.default_rng(3)
    made = {v: [(v, int(g), int(g if rng.random() < 0.8 else p), n) for g, p in rng.integers(-1, 4, (n, 2))] for v, n in (("a", 90), ("b", 40), ("c", 30))}
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))

    def arrive(rows):
        spark.createDataFrame(rows, "vol_id string, gt long, pred long, n_voxels long").coalesce(1).write.mode("append").parquet(source)

    def run():
        query = score_stream(spark, source, sink, checkpoint, [0.5], files=1)
        query.awaitTermination()
        assert query.exception() is None
        return spark.read.parquet(f"{sink}/scores")

    arrive(made["a"][:30])
    arrive(made["b"] + made["a"][30:50])
    assert {r.vol_id for r in run().collect()} == {"b"}
    arrive(made["a"][50:] + made["c"][:29])
    found = run()
    assert sorted(r.vol_id for r in found.collect()) == ["a", "b"]
    assert sorted(r.vol_id for r in run().collect()) == ["a", "b"]
    both = spark.createDataFrame([r[:3] for v in "ab" for r in made[v]], "vol_id string, gt long, pred long")
    want = metrics.instance_metrics(metrics.contingency(metrics.exclude_unlabelled(both), ["vol_id"]), [0.5], ["vol_id"])
    assert sorted(map(tuple, found.drop("batch").collect())) == sorted(map(tuple, want.collect()))
