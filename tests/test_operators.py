"""Operators on literal rows with known answers, streams against batches, the plane source."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainfield.functions import arrays
from grainfield.operators import coloc, graph, identity, objects, pixel, planes, qc, tracks
from grainfield.sources import raw_planes
from grainfield.streaming import live


def test_outlier_flags(spark):
    mixed = spark.createDataFrame([(float(x),) for x in [40, 44, 47, 41, 43, 46, 42, 45, 900, 5]], "area double")
    assert [r.area for r in objects.outliers(mixed, "area", []).where("outlier").collect()] == [900.0, 5.0]
    clean = spark.createDataFrame([(float(x),) for x in [40, 44, 47, 41, 43, 46, 42, 45, 48, 39]], "area double")
    assert objects.outliers(clean, "area", []).where("outlier").count() == 0
    few = spark.createDataFrame([(1.0,), (float("nan"),), (99.0,)], "area double")
    assert objects.outliers(few, "area", []).count() == 3 and objects.outliers(few, "area", []).where("outlier").count() == 0


def test_empty_masks_and_tracks(spark):
    some = spark.createDataFrame([("a", 0, 0)], "img string, y int, x int")
    r = coloc.mask_overlap(some, some.limit(0)).first()
    assert (r.m1, r.m2, r.jaccard, r.dice) == (0.0, 0.0, 0.0, 0.0)
    none = spark.createDataFrame([], "track_id long, frame int, y_um double, x_um double, area_um2 double")
    assert tracks.trajectory_metrics(none).count() == 0 and tracks.msd(none, 5).count() == 0
    assert [(r.t, r.at_risk) for r in tracks.kaplan_meier(none, 10).collect()] == [(0, 0)]


def test_brownian_msd(spark):
    rng = np.random.default_rng(1)
    rows = [(k, t, float(y), float(x), 1.0) for k in range(60) for t, (y, x) in enumerate(np.cumsum(rng.normal(0, np.sqrt(2 * 0.5 * 0.1), (120, 2)), axis=0))]
    df = spark.createDataFrame(rows, "track_id long, frame int, y_um double, x_um double, area_um2 double")
    fit = tracks.anomalous_exponent(tracks.msd(df, 12, 20, 0.1), []).first()
    assert fit.alpha == pytest.approx(1, abs=0.1) and fit.d == pytest.approx(0.5, rel=0.15)
    gone = tracks.drift_corrected(df.withColumn("x_um", F.col("x_um") + 3 * F.col("frame")))
    assert gone.groupBy("frame").agg(F.avg("x_um").alias("m")).agg(F.max(F.abs("m"))).first()[0] < 1e-6 + 60


def test_refusals_and_missing_values(spark):
    df = spark.createDataFrame([(1, "x")], "img int, v string")
    with pytest.raises(ValueError):
        pixel.unmix(df, [[1, 1], [1, 1]], ["a", "b"])
    px = spark.createDataFrame([("a", 0, 0, 5.0), ("a", 0, 1, 5.0)], "img string, y int, x int, v double")
    assert {r.v for r in pixel.rescale(px).collect()} == {0.0}
    assert objects.entropy(px, ["img"]).first().entropy == 0
    size = spark.createDataFrame([("1", False), ("1", True), ("4", False), ("none", False)], "s string, c boolean")
    assert [r.pixel_um for r in qc.pixel_size(size, "s", "c").collect()] == [None, 1.0, 2.0, None]


def test_identity(spark):
    df = spark.createDataFrame([(7, 3, None)], "label long, parent long, frame int")
    row = df.select(identity.entity_id(F.lit("d"), "op", "cell", F.col("label"), F.col("frame"), F.col("parent")).alias("e"), identity.migrate(F.lit("d/op/1"), "d", "e").alias("m"), identity.migrate(F.lit("dd/op/1"), "d", "e").alias("n")).first()
    assert (row.e, row.m, row.n) == ("d/op/cell/-/3/7", "e/op/1", "dd/op/1")
    h = df.select(identity.partial_hash(F.lit(b"abc").cast("binary")).alias("h")).first().h
    assert len(h) == 32


def test_lineage(spark):
    edges = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a"), ("a", "d"), ("c", "x")], "child string, parent string")
    found = {(r.node, r.depth) for r in graph.lineage(edges, edges.where("child = 'd'").select("child")).collect()}
    assert found == {("d", 0), ("c", 1), ("b", 2), ("x", 2), ("a", 3)}


def test_labels_agree_with_the_kernel(spark):
    m = np.random.default_rng(5).random((20, 20)) < 0.45
    mask = spark.createDataFrame([("a", int(y), int(x)) for y, x in np.argwhere(m)], "img string, y int, x int")
    want = arrays.label(m)
    assert all(want[r.y, r.x] == r.label for r in graph.label_mask(mask, 20).collect())


def detections(spark):
    rng = np.random.default_rng(2)
    rows = []
    for img in ("a", "b"):
        at = rng.uniform(0, 100, (15, 2))
        for t in range(20):
            at = at + rng.normal(0, 0.3, at.shape)
            rows += [(img, t, k, float(y), float(x), 4.0) for k, (y, x) in enumerate(at) if rng.random() > 0.05]
    return spark.createDataFrame(rows, "img string, frame int, object_id long, y_um double, x_um double, area_um2 double")


def test_linkers_keep_objects_together(spark):
    df = detections(spark)
    for linked in (planes.link_greedy(df, 2.0, 2), planes.link_optimal(df, 2.0, 2)):
        assert linked.count() == df.count()
        per = linked.groupBy("img", "track_id").agg(F.countDistinct("object_id").alias("objects"))
        assert per.where("objects > 1").count() <= 2 and per.count() <= 40


def test_stream_links_like_the_batch(spark, tmp_path):
    df = detections(spark)
    for k, (a, b) in enumerate(((0, 7), (7, 14), (14, 20))):
        df.where(f"frame >= {a} and frame < {b}").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    df.where("frame = 3").limit(2).coalesce(1).write.parquet(str(tmp_path / "in/9"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    live.append(live.linked(stream, 2.0, 1), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    on_time = out.where("track_id >= 0")
    batch = planes.link_greedy(df, 2.0, 1)
    keys = ["img", "frame", "object_id"]
    assert on_time.count() == df.count() and out.where("track_id < 0").count() == 2
    assert on_time.join(batch.withColumnRenamed("track_id", "other"), keys).where("track_id <> other").count() == 0


def test_stream_windows_like_the_batch(spark, tmp_path):
    e = spark.range(500).select((F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(secs=F.col("id") * 60)).alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("a").alias("event_type"), F.col("id").cast("double").alias("value"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    live.append(live.field_summaries(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    done = {(r.start, r.n, r.mean) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(r.start, r.n, r.mean) for r in live.field_summaries(e).collect()}
    assert len(done) >= 7 and done <= batch
    assert live.sessions(e).count() == 3 and live.sliding_means(e).count() > 30


def test_plane_source(spark, tmp_path):
    stack = np.random.default_rng(1).integers(0, 60000, (3, 2, 1, 8, 9)).astype("<u2")
    raw_planes.write_planes(str(tmp_path / "a.gfp"), stack)
    raw_planes.register(spark)
    df = spark.read.format("planes").load(str(tmp_path))
    assert df.count() == 6
    one = raw_planes.pixels(df.where("t = 2 and c = 1")).collect()
    assert len(one) == 72 and all(stack[2, 1, 0, r.y, r.x] == r.v for r in one)


def test_replay_and_goals(spark):
    from grainfield.plans import replay

    y, x = np.indices((32, 32))
    a = 50 + 200.0 * ((np.hypot(y - 9, x - 9) < 5) | (np.hypot(y - 22, x - 21) < 6))
    px = spark.createDataFrame([("a", int(i), int(j), float(a[i, j])) for i in range(32) for j in range(32)], "img string, y int, x int, v double")
    steps = '[{"op": "gaussian", "params": {"sigma": 1.0}}, {"op": "segment"}, {"op": "regions"}, {"op": "flag_sizes", "params": {"k": 3.0}}, {"op": "melt"}]'
    have, results = replay.replay(steps, {"pixels": px})
    assert [r.status for r in results] == ["ok"] * 5 and have["objects"].count() == 2
    direct = objects.region_statistics(planes.segmented(planes.filtered(px, "gaussian", sigma=1.0)), planes.filtered(px, "gaussian", sigma=1.0))
    assert sorted(r.area for r in direct.collect()) == sorted(r.area for r in have["objects"].collect())
    assert {r.measurement for r in have["long"].collect()} >= {"area", "mean", "eccentricity"}
    _, results = replay.replay([{"op": "segment", "params": {"nothing": 1}}, {"op": "regions"}, {"op": "unheard"}], {"pixels": px})
    assert [r.status for r in results] == ["error", "skipped", "error"] and results[0].error is not None
    assert replay.plan_for("objects", {"pixels"}) == ["segment", "regions"]
    with pytest.raises(ValueError):
        replay.plan_for("objects", {"tracks"})
    with pytest.raises(ValueError):
        replay.register("segment", ("pixels",), "labels")(None)
    assert replay.operations(spark).count() == len(replay.REGISTRY)
    for wrong in ({"op": "clip_low", "params": {"depth": 1}}, {"op": "gaussian", "params": {"sigm": 2}}):
        _, results = replay.replay([wrong, {"op": "gaussian", "params": {"sigma": 2}}], {"pixels": px})
        assert [r.status for r in results] == ["error", "skipped"] and isinstance(results[0].error, ValueError)
    labels = spark.createDataFrame([("a", 0, 0, 5), ("a", 0, 1, 5), ("a", 4, 4, 9)], "img string, y int, x int, label int")
    have, results = replay.replay([{"op": "remove_small", "params": {"least": 2}}, {"op": "renumber"}, {"op": "cell_summary"}], {"labels": labels, "cells": labels})
    assert [r.status for r in results] == ["ok"] * 3 and have["cell_summary"].collect()[0].n in (0, 1) and {r.label for r in have["labels"].collect()} == {1}
