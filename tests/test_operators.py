"""Core operators on micro volumes and properties."""

import gzip
import hashlib
import json
import struct
import zlib
from itertools import permutations

import heapq
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.functions.config import DataSettings, DecodeSettings
from voxelframe.operators import affinity, assignment, batches, components, datasets, grid_graph, instances, metrics, morphology, points, skeleton, splits, sweep, tiles, volume, watershed
from voxelframe.sources import pairing, sinks, volumes


def pairs(spark, rows):
    return spark.createDataFrame(rows, "gt long, pred long")


def scores(spark, rows, threshold=0.5):
    return metrics.instance_metrics(metrics.contingency(metrics.exclude_unlabelled(pairs(spark, rows))), [threshold]).first()


def test_instance_metrics_edges(spark):
    half = scores(spark, [(1, 1)] * 2 + [(1, 0)] + [(0, 1)])
    assert (half.tp, half.mean_matched_score) == (1, 0.5)  # inclusive threshold
    double = scores(spark, [(1, 1)] * 2 + [(1, 2)] * 2)
    assert (double.tp, double.fn, double.fp) == (2, -1, 0)
    one_side = scores(spark, [(1, 0), (2, 0)])
    assert (one_side.tp, one_side.fp, one_side.fn, one_side.f1) == (0, 0, 2, 0.0)
    masked = scores(spark, [(-1, 5), (1, 1)])
    assert (masked.n_pred, masked.tp) == (1, 1)
    assert scores(spark, [(0, 0)]).panoptic_quality == 0.0


def test_relabelling_changes_no_score(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, 5, (200, 2))]
    moved = [(a * 7, b * 11) for a, b in rows]
    same = lambda x: metrics.voi(metrics.contingency(pairs(spark, x))).first()
    assert np.allclose(same(rows), same(moved))
    assert scores(spark, rows, 0.1).f1 == scores(spark, moved, 0.1).f1


def most_by_all_choices(weights):
    """The largest sum over all one-to-one choices."""
    rows = sorted(weights)

    def most(k, taken):
        if k == len(rows):
            return 0.0
        return max([most(k + 1, taken), *(w + most(k + 1, taken | {j}) for j, w in weights[rows[k]].items() if j not in taken)])

    return most(0, frozenset())


def test_assignment_is_optimal():
    rng = np.random.default_rng(2)
    for case in range(200):
        n, m = rng.integers(1, 7, 2)
        weights = {i: {int(j): float(rng.integers(1, 9) if case % 2 else rng.random()) for j in range(m) if rng.random() < 0.6} for i in range(n)}
        found = assignment.best_pairs(weights)
        assert len({i for i, _ in found}) == len({j for _, j in found}) == len(found)
        assert np.isclose(sum(weights[i][j] for i, j in found), most_by_all_choices(weights)), (case, weights)


def test_assignment_of_a_long_chain():
    """100,000 labels in one block, each of which overlaps the next one's partner more than its own."""
    n = 100_000
    weights = {i: {i: 0.5, i + 1: 0.6} for i in range(n)}
    weights[n // 2][n // 2] = 0.9
    found = dict(assignment.best_pairs(weights))
    assert len(found) == n and np.isclose(sum(weights[i][j] for i, j in found.items()), 0.6 * n - 0.6 + 0.9)


@pytest.mark.parametrize("small", [0, 1_000_000])
def test_components(spark, monkeypatch, small):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (102, 101), (7, 7), (200, 200)]
    monkeypatch.setattr(components, "SMALL", small)
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in range(100, 104)} == {100} and found[200] == 200 and len(found) == 46
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_instances(spark):
    found = spark.createDataFrame([(5, 3), (2, 9), (8, 3), (4, 1)], "label long, size long")
    assert sorted(map(tuple, instances.keep_largest(found, 2).collect())) == [(1, 2, 9), (2, 5, 3)]
    assert {r.new_label for r in instances.keep_largest(found, 4).collect()} == {2, 4, 5, 8}
    assert {r.old_label: r.new_label for r in instances.relabel_dense(found).collect()} == {2: 1, 4: 2, 5: 3, 8: 4}
    with pytest.raises(ValueError):
        instances.filter_remap_stats(found, 0)


def cube(spark, array, name="label", kind="long"):
    rows = [(*map(int, at), v.item()) for at, v in np.ndenumerate(array)]
    rows = [(z, y, x, v) for z, y, x, v in [(r[0], r[1], r[2], r[3]) for r in rows]]
    return spark.createDataFrame(rows, f"z long, y long, x long, {name} {kind}")


def test_affinities(spark):
    labels = np.array([[[1, 1, -1, 2]]])
    got = {(r.axis, r.x): (r.aff, r.mask) for r in affinity.affinities(cube(spark, labels)).collect()}
    assert got["x", 0] == (True, True) and got["x", 1] == (False, False) and got["x", 3] == (False, False) and got["z", 0] == (False, False)


def test_tiles(spark):
    for n, overlap, want in ((20, False, [0, 8, 12]), (5, False, [0]), (16, False, [0, 8]), (20, True, [0, 4, 8, 12]), (5, True, [0])):
        assert spark.range(1).select(tiles.starts(F.lit(n), 8, overlap)).first()[0] == want
    rows = volume.grid(spark, (9, 8, 10)).withColumn("p", F.lit(3.5))
    out = tiles.blend(tiles.with_tiles(rows, (9, 8, 10), 4), 4)
    assert out.count() == 720 and out.where("abs(val - 3.5) > 1e-9").count() == 0


@pytest.mark.parametrize("small", [1, 3, 4, 8])
def test_tiles_of_a_voxel_by_its_place(spark, small):
    """The tiles that hold a place are those of the starts, and finding them takes no longer along a long axis."""
    for n, overlap in itertools.product((1, 5, 8, 20, 21), (False, True)):
        rows = spark.range(n).select(F.col("id"), tiles._holding(n, F.col("id"), small, overlap).alias("here"), tiles.starts(F.lit(n), small, overlap).alias("all"))
        assert all(sorted(r.here) == [o for o in r.all if o <= r.id < o + small] for r in rows.collect()), (n, overlap)
    plan = tiles.with_tiles(volume.grid(spark, (8, 8, 8)), (10**6, 8, 8), 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan and len(plan) < 20_000


def test_morphology_and_distance(spark):
    rng = np.random.default_rng(3)
    shape = (4, 5, 6)
    mask = rng.random(shape) < 0.7
    rows = cube(spark, mask.astype(int), "v").where("v = 1").select("z", "y", "x")
    got = {(r.z, r.y, r.x): r.dist2 for r in morphology.distance_squared(rows, shape).collect()}
    out = np.argwhere(~mask)
    assert got == {tuple(p): float(((out - p) ** 2).sum(axis=1).min()) for p in map(tuple, np.argwhere(mask).tolist())}
    shell = np.ones((3, 3, 3), int)
    shell[1, 1, 1] = 0
    filled = morphology.fill_holes(cube(spark, np.pad(shell, 1), "v").where("v = 1"), (5, 5, 5))
    assert filled.count() == 27


def test_components_across_tiles(spark, monkeypatch):
    rng = np.random.default_rng(7)
    shape = (5, 7, 9)
    mask = rng.random(shape) < 0.4
    kinds = rng.integers(0, 2, shape)
    rows = [(*map(int, p), int(np.ravel_multi_index(p, shape)), int(kinds[p])) for p in map(tuple, np.argwhere(mask).tolist())]
    table = spark.createDataFrame(rows, "z long, y long, x long, lin long, kind long")

    def brute(offsets, same):
        root = {r[3]: r[3] for r in rows}
        kind = {r[3]: r[4] for r in rows}
        moved = True
        while moved:
            moved = False
            for z, y, x, lin, _ in rows:
                for d in offsets:
                    at = (z + d[0], y + d[1], x + d[2])
                    if all(0 <= c < n for c, n in zip(at, shape)) and mask[at]:
                        other = int(np.ravel_multi_index(at, shape))
                        if (not same or kind[lin] == kind[other]) and root[lin] != root[other]:
                            root[lin] = root[other] = min(root[lin], root[other])
                            moved = True
        return root

    for side in (48, 3):
        monkeypatch.setattr(grid_graph, "TILE", side)
        for offsets, same in ((grid_graph.FACES, None), (grid_graph.FULL, None), (grid_graph.FACES, "kind")):
            assert {r.lin: r.component for r in grid_graph.components_of(table, offsets, same).collect()} == brute(offsets, same)


@pytest.mark.parametrize("side", [48, 1])
def test_hard_affinities(spark, monkeypatch, side):
    monkeypatch.setattr(grid_graph, "TILE", side)
    # A line of five: 0 -> 1, 1 only reached, 2 alone and unset, 3 unset, 4 set at the far border.
    rows = [(0, 0, x, x, False, False, x in (0, 4)) for x in range(5)]
    found = grid_graph.hard_affinity_components(spark.createDataFrame(rows, "z long, y long, x long, lin long, az boolean, ay boolean, ax boolean"))
    assert {r.lin: r.component for r in found.collect()} == {0: 1, 1: 1, 4: 2}


def test_distance_options(spark):
    rng = np.random.default_rng(4)
    shape = (3, 20, 6)
    mask = rng.random(shape) < 0.8
    rows = cube(spark, mask.astype(int), "v").where("v = 1").select("z", "y", "x")
    step = np.array([2.0, 1.0, 0.5])
    wide = np.pad(mask, 1)
    out = np.argwhere(~wide) - 1
    got = {(r.z, r.y, r.x): r.dist2 for r in morphology.distance_squared(rows, shape, tuple(step), True).collect()}
    assert len(got) == mask.sum() and all(np.isclose(d, (((out - p) * step) ** 2).sum(axis=1).min()) for p, d in got.items())


def test_watershed_splits_and_stays_inside(spark):
    line = np.zeros((1, 1, 9), int)
    line[0, 0, :] = 1
    mask = cube(spark, line, "v").select("z", "y", "x")
    heights = mask.withColumn("height", -F.abs(F.col("x") - 4).cast("double"))
    seeds = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 8, 2)], "z long, y long, x long, label long")
    got = {r.x: r.label for r in watershed.watershed(mask, heights, seeds).collect()}
    assert got[0] == got[3] == 1 and got[8] == got[5] == 2 and len(got) == 9


def queue_flood(heights, seeds):
    """A flood by one queue, the lowest voxel first and then the one that came first."""
    label, queue, count = dict(seeds), [], itertools.count()
    for at in sorted(seeds):
        heapq.heappush(queue, (heights[at], next(count), at))
    while queue:
        _, _, at = heapq.heappop(queue)
        for step in watershed.STEPS:
            to = tuple(a + b for a, b in zip(at, step, strict=True))
            if to in heights and to not in label:
                label[to] = label[at]
                heapq.heappush(queue, (heights[to], next(count), to))
    return label


def plain_states(heights, seeds):
    """The least (cost, cost before, label) of every voxel's neighbours, until none changes."""
    state = {at: (heights[at], 0, label) for at, label in seeds.items()}
    while True:
        now = dict(state)
        for at, h in heights.items():
            if at in seeds:
                continue
            near = [state[to] for step in watershed.STEPS if (to := tuple(a + b for a, b in zip(at, step, strict=True))) in state]
            if near:
                best = min((*((h, 0) if h > level else (level, n + 1)), level, n, label) for level, n, label in near)
                now[at] = (best[0], best[1], best[4])
        if now == state:
            return {at: s[2] for at, s in state.items()}
        state = now


@pytest.mark.parametrize("distinct", [True, False])
def test_watershed_by_tiles(spark, distinct):
    rng, shape = np.random.default_rng(4), (4, 9, 11)
    inside = [at for at in itertools.product(*map(range, shape)) if rng.random() < 0.8]
    values = rng.permutation(len(inside)) if distinct else rng.integers(0, 4, len(inside))
    heights = {at: float(v) for at, v in zip(inside, values, strict=True)}
    seeds = {inside[i]: k for k, i in enumerate(rng.choice(len(inside), 9, replace=False).tolist(), 1)}
    want = queue_flood(heights, seeds) if distinct else plain_states(heights, seeds)
    assert want == plain_states(heights, seeds)
    mask = spark.createDataFrame([(*at, h) for at, h in heights.items()], "z long, y long, x long, height double")
    given = [(*at, k) for at, k in seeds.items()] + [(*next(iter(seeds)), 99), (0, 0, 50, 7), (*inside[-1], 0)]
    told = spark.createDataFrame(given, "z long, y long, x long, label long")
    for size in (5, 48):
        assert {(r.z, r.y, r.x): r.label for r in watershed.watershed(mask, mask, told, size).collect()} == want, size
    assert watershed.watershed(mask.limit(0), mask, told).count() == watershed.watershed(mask, mask, told.limit(0)).count() == 0


def test_watershed_along_a_winding_way(spark):
    """One seed at the end of a way that crosses tiles many times, and places left of the origin."""
    way, y = [], 0
    for turn in range(3):
        way += [(-1, y, x) for x in (range(-3, 4) if turn % 2 == 0 else range(3, -4, -1))]
        way.append((-1, y + 1, 3 if turn % 2 == 0 else -3))
        y += 2
    rows = spark.createDataFrame([(*at, float(k % 3)) for k, at in enumerate(way)], "z long, y long, x long, height double")
    seeds = spark.createDataFrame([(*way[0], 4)], "z long, y long, x long, label long")
    found = watershed.watershed(rows, rows, seeds, 5).collect()
    assert {(r.z, r.y, r.x) for r in found} == set(way) and {r.label for r in found} == {4}


def test_skeleton_bounds(spark):
    nodes = spark.createDataFrame([(1, i, 10 if i < 3 else 11) for i in range(6)], "skel_id long, node_id long, pred_id long")
    edges = spark.createDataFrame([(1, i, i + 1, 1.0) for i in range(5)], "skel_id long, u long, v long, edge_length double")
    found = skeleton.expected_run_length(skeleton.classify(edges, nodes)).first()
    assert (found.erl, found.max_erl) == ((4 + 4) / 5, 5.0)


def test_splits_points_and_pairs(spark):
    out = splits.split_assign(spark.createDataFrame([(str(i),) for i in range(15)], "sample_id string"))
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 12, "val": 2, "test": 1}
    empty = cube(spark, np.zeros((1, 2, 2), int))
    cloud = points.point_cloud(empty, 4)
    assert cloud.count() == 4 and cloud.where("label <> 0 or x <> 0").count() == 0
    preds = spark.createDataFrame([("a_RibFrac1.zarr",), ("x_22.zarr",), ("none.zarr",)], "pred string")
    gts = spark.createDataFrame([("RibFrac1-rib.nii.gz",), ("x_22_gt.zarr",)], "gt string")
    assert {r.pred: r.rule for r in pairing.with_priority(preds, gts).collect()} == {"a_RibFrac1.zarr": 1, "x_22.zarr": 3}
    names = [("pred_liver.zarr",), ("case12.zarr",), ("same.zarr",), ("lone.zarr",)]
    gts = spark.createDataFrame([("liver.nii.gz",), ("case123.nii.gz",), ("same.nii.gz",), ("ground_truth_same.nii.gz",)], "gt string")
    found = pairing.with_priority(spark.createDataFrame(names, "pred string"), gts)
    assert {tuple(r) for r in found.collect()} == {("pred_liver.zarr", "liver.nii.gz", 3), ("case12.zarr", "case123.nii.gz", 3), ("same.zarr", "same.nii.gz", 2)}
    assert pairing.with_priority(spark.createDataFrame(names, "pred string"), gts.limit(0)).count() == 0


def test_volume_readers(spark, tmp_path):
    data = np.arange(24, dtype="<i2").reshape(2, 3, 4)
    np.save(tmp_path / "a.npy", data)
    head = bytearray(352)
    struct.pack_into("<i8h", head, 0, 348, *[0] * 8)
    struct.pack_into("<8h", head, 40, 3, 4, 3, 2, 1, 1, 1, 1)
    struct.pack_into("<h", head, 70, 4)
    struct.pack_into("<f", head, 108, 352)
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(bytes(head) + data.tobytes()))
    z = tmp_path / "c.zarr"
    z.mkdir()
    (z / ".zarray").write_text(json.dumps({"shape": [2, 3, 4], "chunks": [2, 2, 4], "dtype": "<i2", "compressor": {"id": "zlib"}, "fill_value": 0, "order": "C", "zarr_format": 2}))
    padded = np.pad(data, ((0, 0), (0, 1), (0, 0)))
    for k in range(2):
        (z / f"0.{k}.0").write_bytes(zlib.compress(padded[:, 2 * k : 2 * k + 2].tobytes()))
    want = {(*at, float(v)) for at, v in np.ndenumerate(data)}
    for name in ("a.npy", "b.nii.gz", "c.zarr"):
        assert {(r.z, r.y, r.x, r.val) for r in volumes.read_volume(spark, f"file://{tmp_path}/{name}").collect()} == want, name
    with pytest.raises(ValueError):
        volumes.read_volume(spark, "x.h5")


def keyed(spark, volume, vol_id, name="label"):
    return cube(spark, volume, name, "double" if volume.dtype == float else "long").withColumn("vol_id", F.lit(vol_id))


def test_batches_score_each_volume_alone(spark):
    rng = np.random.default_rng(5)
    gts = [rng.integers(0, 4, (2, 4, 5)) for _ in range(3)]
    preds = [rng.integers(0, 4, (2, 4, 5)), np.zeros((2, 4, 5), int)]
    gt, pred = (keyed(spark, v[0], "v0").unionByName(keyed(spark, v[1], "v1")) for v in (gts, preds))
    gt = gt.unionByName(keyed(spark, gts[2], "v2"))
    got = {r.vol_id: r for r in batches.dice(gt, pred).collect()}
    n, m = [range(1, 4)] * 2
    score = lambda a, b: 2 * ((gts[0] == a) & (preds[0] == b)).sum() / ((gts[0] == a).sum() + (preds[0] == b).sum())
    iou = lambda a, b: ((gts[0] == a) & (preds[0] == b)).sum() / ((gts[0] == a) | (preds[0] == b)).sum()
    best = max(permutations(m), key=lambda p: sum(iou(a, b) for a, b in zip(n, p, strict=True)))
    assert np.isclose(got["v0"].dice, np.mean([score(a, b) for a, b in zip(n, best, strict=True)]))
    assert [(got[v].dice, got[v].error, got[v].total_gt_labels) for v in ("v1", "v2")] == [(0.0, "no prediction", 3)] * 2
    rows = batches.instance_scores(gt, pred, [0.2])
    alone = metrics.instance_metrics(batches.overlaps(gt, pred).where("vol_id = 'v0'").drop("vol_id"), [0.2]).first()
    assert rows.where("vol_id = 'v0'").first().f1 == alone.f1 and rows.count() == 3
    assert batches.dice(gt.limit(0), pred).count() == 0


def test_batches_extract_across_no_border(spark):
    full = np.ones((2, 1, 3))
    weak = np.array([[[0.4, 0.4, 0.0]], [[0.0, 0.0, 0.0]]])
    rows = keyed(spark, full, "a", "val").unionByName(keyed(spark, weak, "b", "val")).unionByName(keyed(spark, full, "c", "val"))
    found = batches.extract(rows, (2, 1, 3), 0.5)
    assert {(r.vol_id, r.label): r["count"] for r in found.groupBy("vol_id", "label").count().collect()} == {("a", 1): 6, ("b", 1): 2, ("c", 1): 6}
    assert batches.extract(rows, (2, 1, 3), 0.5, 3).where("vol_id = 'b'").count() == 0


def test_clean_chain(spark):
    labels = np.zeros((5, 5, 9), int)
    labels[:, :, :4] = 1
    labels[:, :, 5:] = 2
    labels[2, 2, 4] = 3
    rows = cube(spark, labels, "label")
    assert batches.clean(rows, labels.shape, 2, None).agg(F.count_distinct("label")).first()[0] == 2
    whole = batches.clean(rows, labels.shape, 2, 1, True)
    assert whole.agg(F.count("*"), F.max("label")).first() == (100, 1)


def test_sinks(spark, tmp_path):
    rng = np.random.default_rng(6)
    data = rng.integers(0, 3, (5, 6, 7))
    rows = cube(spark, data, "val")
    path = f"file://{tmp_path}/a.zarr"
    sinks.write_zarr(rows, path, data.shape, kind="<i4", chunks=(2, 4, 4))
    back = {(r.z, r.y, r.x): r.val for r in volumes.read_volume(spark, path).where("val <> 0").collect()}
    assert back == {at: float(v) for at, v in np.ndenumerate(data) if v}
    with pytest.raises(FileExistsError):
        sinks.write_zarr(rows, path, data.shape)
    assert sinks.output_suffix("auto", "x/y.nii.gz") == ".nii.gz" and sinks.output_suffix("zarr", "a.h5") == ".zarr"
    assert sinks.narrowed(rows, "val").schema["val"].dataType.simpleString() == "tinyint"
    images = [keyed(spark, data, f"s{i}", "val").withColumnRenamed("vol_id", "sample_id") for i in range(3)]
    images = images[0].unionByName(images[1]).unionByName(images[2])
    labels = images.withColumnRenamed("val", "label")
    samples = sinks.converted(images, labels, images.where("x > 0").withColumn("val", F.lit(1)))
    sinks.write_dataset(samples, f"file://{tmp_path}/out", "d", 0.34, 0.33)
    read = spark.read.parquet(f"file://{tmp_path}/out/d")
    assert {r.split for r in read.select("split").distinct().collect()} == {"train", "val", "test"} and read.count() == 3 * data.size
    assert read.where("x = 0 and label <> -1").count() == 0
    with pytest.raises(Exception, match="differ in shape"):
        sinks.write_dataset(sinks.converted(images, labels.where("z < 4")), f"file://{tmp_path}/bad", "d")
    best = sinks.write_best(spark.createDataFrame([(0.5, 0.9), (0.4, 0.9), (0.1, 0.2)], "thr double, nerl double"), f"file://{tmp_path}/best", lambda t: rows)
    assert best == 0.4 and spark.read.text(f"file://{tmp_path}/best/best_thr").first()[0] == "0.4"
    points_of = spark.createDataFrame([("m/a.nii", 1, 0.0), ("m/a.nii", 2, 0.0)], "name string, label long, x double")
    files = spark.createDataFrame([("m/a.nii", True), ("m/b.nii", False)], "name string, success boolean")
    sinks.write_clouds(points_of, f"file://{tmp_path}/clouds", files)
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/clouds/neuron_ids.csv").collect() == [("a", "rib_frac")]
    assert sinks.cloud_totals(points_of, files).first() == (2, 2, 1, 1)
    assert [t.count() for t in sinks.empty_skeletons(spark)] == [0, 0]


def test_settings():
    assert DataSettings.load({"name": "a", "unknown": 1}).name == "a"
    with pytest.raises(ValueError):
        DataSettings.load({"small_size": 8})
    with pytest.raises(ValueError):
        DecodeSettings().update(nothing=1)


def test_dataset_draws(spark):
    # Starts are inclusive at both ends; a negative quotient rounds down.
    assert datasets.draw_range(100, 9, 3, 4) == (3 + max(-9 // 4, -3), 100 - 9 - 3 + min(3, 9 // 4))
    with pytest.raises(ValueError):
        datasets.patch_starts(spark.range(1).withColumnRenamed("id", "draw"), (4, 4, 4), 9)
    draws = spark.range(2000).withColumnRenamed("id", "draw")
    found = datasets.choose_weighted(draws, [1, 0, 3], 1).groupBy("dataset").count().collect()
    counts = {r["dataset"]: r["count"] for r in found}
    assert set(counts) == {0, 2} and abs(counts[0] - 500) < 100
    starts = datasets.patch_starts(draws, (20, 12, 9), 9, seed=2)
    assert starts.agg(F.min("z0"), F.max("z0"), F.min("y0"), F.max("y0"), F.max("x0")).first() == (0, 11, 0, 3, 0)
    moments = draws.select(datasets.normal(3, F.col("draw")).alias("n")).agg(F.avg("n"), F.stddev("n")).first()
    assert abs(moments[0]) < 0.1 and abs(moments[1] - 1) < 0.1


def test_voxel_pairs_and_masks(spark):
    a, b = cube(spark, np.array([[[1, 1, 2]]]), "label"), cube(spark, np.array([[[5, 6, 6]]]), "label").where("x < 2")
    assert {tuple(r) for r in datasets.pair_voxels(a, b).collect()} == {(1, 5), (1, 6)}
    nodes = spark.createDataFrame([(1, 0.0, 0.0, 2.9), (2, 0.0, 0.0, 7.0)], "node_id long, z double, y double, x double")
    assert {r.node_id: r.pred_id for r in datasets.node_labels(nodes, a).collect()} == {1: 2, 2: 0}
    three, two = cube(spark, np.array([[[0, 1, 5]]]), "val"), cube(spark, np.array([[[0, 5, 5]]]), "val")
    assert sorted(r.val for r in datasets.binary_mask(three).collect()) == [0, 1, 1]
    assert [r.val for r in datasets.binary_mask(two).collect()] == [0, 0, 0]
    cases = spark.createDataFrame([("a", 0.5, None), ("b", 0.0, None), ("c", None, "no file")], "name string, dice double, error string")
    assert datasets.batch_stats(cases).first()[:4] == (3, 1, 2, 0.25) and datasets.batch_stats(cases, False).first()[:4] == (3, 1, 1, 0.5)


def test_entry_imports_without_optional_modules(tmp_path):
    """A copy of the repository without the corpus modules still gives the other queries."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/voxelframe", tmp_path / "voxelframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'instance_metrics' in q and set(o) <= set(q); assert not any(k[:2] == 'op' and k[2].isdigit() or k == 'pipeline' for k in q)"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


@pytest.mark.parametrize("tile", [3, 64])
def test_affinities_across_tiles_by_one_shuffle(spark, monkeypatch, tile):
    monkeypatch.setattr(affinity, "TILE", tile)
    labels = np.random.default_rng(5).integers(-1, 3, (7, 5, 8))
    found = affinity.all_affinities(cube(spark, labels, "label"), [1, 2])
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r.axis, r.distance, r.z, r.y, r.x): (r.aff, r.mask) for r in found.collect()}
    assert len(got) == 6 * labels.size
    for (axis, d, *at), (aff, mask) in got.items():
        to = list(at)
        to["zyx".index(axis)] += d
        there = all(c < n for c, n in zip(to, labels.shape, strict=True))
        a, b = labels[tuple(at)], labels[tuple(to)] if there else None
        assert aff == (there and a == b != 0) and mask == (there and a != -1 and b != -1), (axis, d, at)


def test_scores_at_many_thresholds_are_those_of_each(spark):
    rng = np.random.default_rng(9)
    nodes = spark.createDataFrame([(i // 20, i, int(rng.integers(0, 6)), float(rng.random())) for i in range(120)], "skel_id long, node_id long, pred_id long, nm double")
    edges = spark.createDataFrame([(i // 20, i, i + 1, float(rng.random())) for i in range(119) if i % 20 != 19], "skel_id long, u long, v long, edge_length double")
    sizes = (0, 2, 5, 1000)
    found = {r.ignored: r for r in skeleton.expected_run_length(skeleton.classify_sizes(edges, nodes, sizes), ["ignored"]).collect()}
    for n in sizes:
        one = skeleton.expected_run_length(skeleton.classify(edges, nodes, n)).first()
        assert np.allclose([found[n].erl, found[n].max_erl, found[n].nerl], [one.erl, one.max_erl, one.nerl])
    cut = lambda t: F.when(F.col("nm") < t, 0).otherwise(F.col("pred_id")).cast("long")
    rows = {r.thr: r for r in sweep.sweep(nodes, edges, cut, [0.1, 0.5, 2.0]).collect()}
    assert set(rows) == {0.1, 0.5, 2.0} and rows[2.0].n_non0_mergers == 0
    for t, r in rows.items():
        one = nodes.withColumn("pred_id", cut(t))
        pairs = one.select(F.col("skel_id").alias("gt"), F.col("pred_id").alias("pred"))
        assert np.isclose(r.nerl, skeleton.expected_run_length(skeleton.classify(edges, one)).first().nerl)
        assert np.isclose(r.voi, metrics.voi(metrics.contingency(pairs)).first().voi_sum)
        assert r.n_non0_mergers == skeleton.merge_split_counts(one).first().n_non0_mergers


def test_sweep_broadcasts_nothing_that_grows(spark):
    """Nodes at many thresholds are far more than their file lets Spark expect."""
    nodes = spark.range(50).select(F.lit(1).alias("skel_id"), F.col("id").alias("node_id"), F.col("id").alias("seq"), F.col("id").cast("double").alias("nm"), F.lit(7).cast("long").alias("pred_id"))
    edges = spark.range(49).select(F.lit(1).alias("skel_id"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(1.0).alias("edge_length"))
    one = nodes.withColumn("thr", F.explode(F.array(F.lit(0.1), F.lit(0.2))))
    plans = [skeleton.classify(edges, one, 0, ["thr"]), metrics.voi(metrics.contingency(one.select("thr", F.col("skel_id").alias("gt"), F.col("pred_id").alias("pred")), ["thr"]), ["thr"])]
    assert all("Broadcast" not in p._jdf.queryExecution().executedPlan().toString() for p in plans)


def ragged(spark):
    """A volume whose last rows are missing: ten slices of 4 x 6 voxels, the last with one row only."""
    rng = np.random.default_rng(11)
    values = rng.random((10, 4, 6))
    held = [p for p in map(tuple, np.argwhere(values >= 0).tolist()) if not (p[0] == 9 and p[1] > 0)]
    rows = spark.createDataFrame([(*p, float(values[p])) for p in held], "z long, y long, x long, val double")
    return values, held, rows


def test_distance_in_a_volume_that_is_not_whole(spark):
    values, held, rows = ragged(spark)
    got = {(r.z, r.y, r.x): r.dist2 for r in morphology.distance_squared(rows.where("val < 0.9"), values.shape, within=rows).collect()}
    out = np.array([p for p in held if values[p] >= 0.9])
    assert got == {p: float(((out - p) ** 2).sum(axis=1).min()) for p in held if values[p] < 0.9}


def test_no_group_holds_the_longest_axis(spark):
    """Lines of the longest axis go by windows; a group in Python is bounded by the shorter two."""
    rows = volume.grid(spark, (60, 4, 3))
    plan = morphology.distance_squared(rows.where("z % 50 <> 3"), (60, 4, 3), within=rows)._jdf.queryExecution().optimizedPlan().toString()
    groups = [line for line in plan.splitlines() if "FlatMapGroupsInPandas" in line]
    assert len(groups) == 2 and "Window" in plan


def test_holes_of_a_volume_that_is_not_whole(spark):
    """Background beside places that do not exist is a hole, and such places are in no result."""
    values, held, rows = ragged(spark)
    solid = rows.where("not (z = 8 and y = 2 and x = 2)")
    mask = solid.select("z", "y", "x").unionByName(spark.createDataFrame([(9, 3, 5)], "z long, y long, x long"))
    found = {tuple(r) for r in morphology.fill_holes(mask, values.shape, rows).collect()}
    assert found == set(held) and (9, 3, 5) not in found


def test_affinities_to_places_without_a_row(spark):
    rows = [(0, 0, 0, 0, True, False, False), (0, 0, 1, 1, False, True, False), (1, 0, 1, 5, False, False, True)]
    table = spark.createDataFrame(rows, "z long, y long, x long, lin long, az boolean, ay boolean, ax boolean")
    found = grid_graph.hard_affinity_components(table, shape=(2, 2, 2)).collect()
    assert {r.lin: r.component for r in found} == {0: 1, 4: 1, 1: 2, 3: 2, 5: 3}


def test_decoding_of_a_volume_that_is_not_whole(spark):
    """A basin beside missing places is as deep as the voxels there are make it, so it is no watershed of its own."""
    rows = volume.grid(spark, (6, 3, 9)).where("not (z = 5 and y > 0)").withColumn("val", F.when(F.expr("z = 0 and x = 4"), -1.0).otherwise(0.5))
    heights = watershed._heights(rows.where("val > 0"), (6, 3, 9), rows)
    deepest = heights.where("z = 4").agg(F.max("height")).first()[0]
    assert np.isclose(deepest, -4.0)
    two = watershed.two_stage_decode(rows.withColumn("val", F.lit(0.5)), (6, 3, 9), 0.0, 0.1)
    assert two.join(rows, ["z", "y", "x"], "left_anti").count() == 0


def test_names_are_paired_by_shuffles(spark):
    """Substrings of names are many times the names, so no side of their join may be broadcast."""
    preds, gts = spark.createDataFrame([("pred_scan1.zarr",), ("vol_2.zarr",)], "pred string"), spark.createDataFrame([("scan1_b.nii.gz",), ("vol_2_gt.zarr",)], "gt string")
    found = pairing.with_priority(preds, gts)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {("pred_scan1.zarr", "scan1_b.nii.gz", 3), ("vol_2.zarr", "vol_2_gt.zarr", 3)}


def test_centre_padding_does_not_crop(spark):
    with pytest.raises(ValueError, match="does not fit"):
        volume.center_pad(cube(spark, np.ones((2, 6, 8), int), "val"), (2, 6, 8), (4, 4, 4))


@pytest.mark.parametrize("n", [7, 8])
def test_centre_padding_crops_if_asked(spark, n):
    values = np.arange(n * 2 * 3).reshape(n, 2, 3)
    found = volume.center_pad(cube(spark, values, "val"), values.shape, (4, 4, 3), -1, "val", crop=True).collect()
    want = np.full((4, 4, 3), -1)
    want[:, 1:3] = values[(n - 4) // 2 :][:4]
    assert {(r.z, r.y, r.x): r.val for r in found} == {tuple(p): want[tuple(p)] for p in np.argwhere(want >= -1).tolist()}


def test_clean_joins_corners(spark):
    """Two crosses that touch along an edge are one instance."""
    labels = np.zeros((5, 9, 9), int)
    for y, x in ((3, 3), (4, 5)):
        for step in morphology.BALL:
            labels[2 + step[0], y + step[1], x + step[2]] = 1 + (x == 5)
    found = batches.clean(cube(spark, labels, "label"), labels.shape, 1, None, True).collect()
    assert {r.label for r in found} == {1}


def test_orient_as_by_arrays(spark):
    n, seed = 3, 4
    cube_ = np.arange(n**3).reshape(n, n, n)
    rows = [(d, *map(int, at), float(v)) for d in range(12) for at, v in np.ndenumerate(cube_)]
    found = datasets.orient(spark.createDataFrame(rows, "draw long, z long, y long, x long, val double"), n, seed).collect()
    u = lambda *keys: int(hashlib.md5(":".join(map(str, (seed, *keys))).encode()).hexdigest()[:8], 16) / 2**32
    orders = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]
    for d in range(12):
        want = cube_.transpose(orders[int(u(d, "order") * 6)])
        for a, b in (("x", "y"), ("x", "z"), ("y", "z")):
            want = np.rot90(want, int(u(d, f"turn {a}{b}") * 4), ("zyx".index(a), "zyx".index(b)))
        for k, a in enumerate("zyx"):
            want = np.flip(want, k) if u(d, f"mirror {a}") < 0.5 else want
        got = np.zeros_like(cube_)
        for r in found:
            if r.draw == d:
                got[r.z, r.y, r.x] = r.val
        assert np.array_equal(got, want), d
