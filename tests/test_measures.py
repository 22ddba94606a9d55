"""Kernels and operators without SQL against brute force on small tables."""

import itertools
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainfield.functions import arrays, fits
from grainfield.operators import cells, planes, records, spatial, tracks
from grainfield.storage import shared_dir

POINT = "cell long, id long, y_um double, x_um double"


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    rows = [(c, c * 1000 + k, float(y), float(x)) for c, n in ((1, 40), (2, 3), (3, 2), (4, 1)) for k, (y, x) in enumerate(rng.normal(size=(n, 2)))]
    rows += [(5, 5000 + k, 2.0, float(k // 2)) for k in range(9)]  # on a line, with repeated places
    rows += [(6, 6000 + k, 1.0, 1.0) for k in range(4)] + [(6, 6010, None, 1.0), (6, 6011, math.nan, 1.0), (7, 7000, 0.0, 0.0), (7, 7001, 1e6, 0.0), (7, 7002, 1e6, 0.5)]
    return spark.createDataFrame(rows, POINT), rows


def fine(rows):
    return [r for r in rows if r[2] is not None and not math.isnan(r[2])]


def test_nearest(points):
    table, rows = points
    found = {}
    for r in spatial.k_nearest(table, 3).collect():
        found.setdefault((r.cell, r.id), []).append((r.rank, round(r.d, 9)))
    for c, i, y, x in fine(rows):
        d = sorted(round(math.hypot(y - b, x - a), 9) for k, j, b, a in fine(rows) if k == c and j != i)
        assert sorted(found.get((c, i), [])) == [(k + 1, v) for k, v in enumerate(d[:3])]


def test_persistence(spark):
    rng = np.random.default_rng(5)
    rows = [(k, f, float(y), float(x)) for f in range(3) for k, (y, x) in enumerate(rng.normal(size=(12, 2)) * 2)]
    table = spark.createDataFrame(rows, "track_id long, frame int, y_um double, x_um double")
    near = {}
    for k, f, y, x in rows:
        d = sorted((math.hypot(y - b, x - a), j) for j, g, b, a in rows if g == f and j != k)
        near[k, f] = {j for v, j in d[:5] if v <= 3.0}
    for r in tracks.neighbour_persistence(table).collect():
        now, before = near[r.track_id, r.frame], near[r.track_id, r.frame - 1]
        want = len(now & before) / len(now | before) if now | before else None
        assert r.jaccard == pytest.approx(want) if want is not None else r.jaccard is None


def test_persistence_forms_few_pairs(spark, monkeypatch):
    """All 600 detections of a frame are within the radius, some in one place: only the nearest ones are held, ties to smaller ids."""
    rng = np.random.default_rng(8)
    rows = [(k, f, float(y), float(x)) for f in range(2) for k, (y, x) in enumerate(rng.integers(0, 30, (600, 2)))]
    held = []
    monkeypatch.setattr(spatial, "cut", lambda df, name, cut=spatial.cut: held.append((name, (found := cut(df, name)).count())) or found)
    table = spark.createDataFrame(rows, "track_id long, frame int, y_um double, x_um double")
    found = {r.track_id: r.jaccard for r in tracks.neighbour_persistence(table, 3, 60.0).collect()}
    near = {(k, f): {j for _, j in sorted((math.hypot(y - b, x - a), j) for j, g, b, a in rows if g == f and j != k)[:3]} for k, f, y, x in rows}
    assert found == {k: len(near[k, 1] & near[k, 0]) / len(near[k, 1] | near[k, 0]) for k in range(600)}
    assert 0 < sum(n for name, n in held if name == "nearest") < 60 * len(rows)


def test_inversions_and_tau():
    rng = np.random.default_rng(6)
    for n, top in ((0, 1), (1, 3), (50, 7), (200, 1000)):
        r = rng.integers(0, top, n)
        assert arrays.inversions(r) == sum(r[i] > r[j] for i in range(n) for j in range(i + 1, n))
    a, b = rng.integers(0, 9, 80), rng.integers(0, 9, 80)
    s = [(np.sign(a[i] - a[j]), np.sign(b[i] - b[j])) for i, j in itertools.combinations(range(80), 2)]
    want = sum(x * y for x, y in s) / math.sqrt(sum(abs(x) for x, _ in s) * sum(abs(y) for _, y in s))
    assert arrays.kendall(a, b) == pytest.approx(want) and math.isnan(arrays.kendall(np.ones(5), np.arange(5)))


def test_distance():
    m = np.random.default_rng(7).random((17, 23)) < 0.8
    back = np.argwhere(~m)
    want = [[np.hypot(*(back - (y, x)).T).min() if m[y, x] else 0 for x in range(23)] for y in range(17)]
    assert np.allclose(arrays.distance(m), want)
    big = np.ones((700, 900), bool)
    big[3, 4] = False
    assert arrays.distance(big)[699, 899] == pytest.approx(math.hypot(696, 895))


def test_matched(spark):
    at = lambda rows: spark.createDataFrame([("a", int(y), int(x), k) for k, y, x in rows], "img string, y int, x int, label int")
    r = cells.matched(at([(1, 0, 0), (2, 0, 4), (3, 30, 30)]), at([(7, 0, 2), (8, 0, 6), (9, 90, 90)]), 3.0).first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 1) and r.precision == pytest.approx(2 / 3) and r.f1 == pytest.approx(2 / 3) and r.localization_error == 2.0
    rng = np.random.default_rng(8)
    p, t = ([(k, *rng.integers(0, 12, 2)) for k in range(5)] for _ in range(2))
    n, total = max((sum(ok), -sum(d for d, o in zip(ds, ok, strict=True) if o)) for q in itertools.permutations(range(5)) for ds in [[math.hypot(p[i][1] - t[j][1], p[i][2] - t[j][2]) for i, j in enumerate(q)]] for ok in [[d <= 5.0 for d in ds]])
    r = cells.matched(at(p), at(t), 5.0).first()
    assert r.tp == n and r.localization_error * n == pytest.approx(-total)
    none = cells.matched(at(p), at(t).where("false"), 5.0).first()
    assert (none.tp, none.fp, none.recall, none.f1) == (0, 5, None, None)


def test_merged_in_time(spark):
    rows = [(1, 0, 0.0, 0.0), (1, 1, 0.0, 0.02), (1, 2, 0.0, 0.04), (1, 2, 5.0, 5.0), (1, 9, 0.0, 0.0), (2, 0, 0.0, 0.0)]
    table = spark.createDataFrame(rows, "cell long, frame long, y_um double, x_um double")
    got = sorted((r.cell, r.frame, r.n, round(r.x_um, 6)) for r in planes.merged_in_time(table, ["cell"], 0.05, 1).collect())
    assert got == [(1, 0, 3, 0.02), (1, 2, 1, 5.0), (1, 9, 1, 0.0), (2, 0, 1, 0.0)]
    assert planes.merged_in_time(table.where("false"), ["cell"], 0.05, 1).count() == 0


def test_hulls_and_trees(spark):
    square = [(1, y, x) for y, x in ((0.0, 0.0), (0.0, 2.0), (2.0, 0.0), (2.0, 2.0), (1.0, 1.0), (1.0, 0.0))] + [(2, 0.0, 0.0), (2, 3.0, 4.0), (3, 1.0, 1.0)]
    table = spark.createDataFrame(square, "cell long, y_um double, x_um double")
    hull = {r.cell: r for r in planes.hulls(table, ["cell"]).collect()}
    assert (hull[1].area, hull[1].perimeter, hull[1].corners) == (4.0, 8.0, 4) and hull[2].area is None
    tree = {r.cell: r for r in planes.spanning_trees(table, ["cell"]).collect()}
    assert tree[1].edges == 5 and tree[1].total == pytest.approx(3 + 2 * math.sqrt(2)) and tree[2].total == 5.0
    assert tree[3].edges == 0 and tree[3].total == 0 and tree[3].mean is None


def test_line_profile_brute(spark):
    rng = np.random.default_rng(9)
    a = rng.random((12, 15))
    px = spark.createDataFrame([("a", y, x, float(a[y, x])) for y in range(12) for x in range(15)], "img string, y int, x int, v double")
    got = {r.pos: r.v for r in cells.line_profile(px, (2.0, 1.0, 9.0, 12.0), 3, "max").collect()}
    length = math.hypot(7, 11)
    for k in range(math.ceil(length) + 1):
        values = []
        for j in (-1, 0, 1):
            y, x = 2 + k * 7 / length + j * 11 / length, 1 + k * 11 / length - j * 7 / length
            y0, x0 = math.floor(y), math.floor(x)
            corners = [(y0 + i, x0 + h, (1 - abs(y - y0 - i)) * (1 - abs(x - x0 - h))) for i in (0, 1) for h in (0, 1)]
            values.append(sum(w * a[v, u] for v, u, w in corners if w > 1e-12) if all(0 <= v < 12 and 0 <= u < 15 for v, u, w in corners if w > 1e-12) else None)
        if None not in values:
            assert got[k] == pytest.approx(max(values))
        else:
            assert k not in got


def test_localization_tables(spark):
    base = f"{shared_dir(spark)}/localizations"
    spark.createDataFrame([("1", "100", "250"), ("2", "x", "50")], "frame string, `x [nm]` string, `y [nm]` string").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{base}-nm")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|malformed|cannot be cast"):
        records.localizations(spark, f"{base}-nm").collect()
    spark.createDataFrame([("1", "100", "250")], "frame string, `x [nm]` string, `y [nm]` string").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{base}-ok")
    r = records.localizations(spark, f"{base}-ok").first()
    assert (r.frame, r.x_um, r.y_um) == (1, pytest.approx(0.1), pytest.approx(0.25))
    spark.createDataFrame([("3", "4")], "x string, y string").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{base}-px")
    with pytest.raises(ValueError, match="no pixel size"):
        records.localizations(spark, f"{base}-px")
    r = records.localizations(spark, f"{base}-px", 0.5).first()
    assert (r.frame, r.x_um, r.y_um) == (None, 1.5, 2.0)


def test_metadata_precedence(spark):
    rows = [("a", "pixel_size_um", "file", 1, "0.1"), ("a", "pixel_size_um", "sidecar", 2, "0.2"), ("a", "pixel_size_um", "reader", 3, "0.1"), ("a", "lens", "file", 1, " "), ("a", "lens", "reader", 3, "60x"), ("b", "lens", "file", 1, None)]
    table = spark.createDataFrame(rows, "image string, field string, source string, priority int, value string")
    got = {(r.image, r.field): (r.value, r.source, r.conflicts, r.surfaced) for r in records.merged_metadata(table).collect()}
    assert got == {("a", "pixel_size_um"): ("0.1", "file", "sidecar=0.2", True), ("a", "lens"): ("60x", "reader", "", False)}


def test_long_table_columns(spark):
    wide = spark.createDataFrame([("i", k, float(v), None) for k, v in enumerate([10, 11, 12, 9, 10, 300])], "image string, id long, area double, note string")
    sheet = spark.createDataFrame([("other", "wt")], "image_stem string, genotype string")
    t = records.long_table(wide, "cell", "id", "image", sheet, ["genotype"], {"area": "um2"}, {"operation": "x"}, ("area",), {"image_qc": 0.9})
    assert t.columns == records.long_columns(["genotype"], ["operation"])
    rows = {r.object_id: r for r in t.collect()}
    assert len(rows) == 6 and rows["0"].genotype == "" and rows["5"].qc_flags == "area_outlier" and rows["0"].qc_flags == ""
    assert rows["0"].reliability == "high" and rows["5"].reliability == "low" and rows["5"].reliability_reasons == "object flagged"


def test_sampling(spark):
    table = spark.createDataFrame([("a", k) for k in range(11)] + [("b", k) for k in range(3)], "g string, k int")
    got = records.evenly_sampled(table, ["g"], "k", 5)
    assert sorted(r.k for r in got.where("g = 'a'").collect()) == [0, 3, 5, 8, 10] and got.where("g = 'b'").count() == 3


def test_seams_and_lacunarity(spark):
    a = np.random.default_rng(10).random((10, 12))
    a[:, 6:] += 3
    px = spark.createDataFrame([("a", y, x, float(a[y, x])) for y in range(10) for x in range(12)], "img string, y int, x int, v double")
    got = {r.x: r for r in cells.column_seams(px, ["img"], 4, 5.0).collect()}
    step = [abs(a[:, x] - a[:, x - 1]).mean() if x else None for x in range(12)]
    for x in range(1, 12):
        o = [step[i] for i in range(max(1, x - 4), min(11, x + 4) + 1) if i != x]
        assert got[x].z == pytest.approx((step[x] - np.median(o)) / (np.std(o) + 1e-12))
    assert [x for x, r in got.items() if r.seam] == [6]
    m = a > 2
    mask = px.where(F.col("v") > 2).select("img", "y", "x")
    for r in cells.lacunarity(mask, 10, 12, [2, 3, 4]).collect():
        s = r.box_size
        boxes = np.array([m[y : y + s, x : x + s].sum() for y in range(10 - s + s % 2) for x in range(12 - s + s % 2)], float)
        assert r.lacunarity == pytest.approx((boxes**2).mean() / boxes.mean() ** 2)


def test_fits():
    t = np.arange(60.0)
    f = fits.fit_two_decays(t, 5 * np.exp(-t / 3) + 2 * np.exp(-t / 20) + 1)
    assert (f["a"], f["tau_a"], f["c"], f["tau_c"], f["floor"]) == pytest.approx((5, 3, 2, 20, 1), rel=1e-3) and f["r2"] > 0.9999
    f = fits.fit_relaxation(t, 1 + 0.8 * np.exp(-t / 7))
    assert (f["start"], f["tau"]) == pytest.approx((1.8, 7), rel=1e-4) and fits.fit_relaxation(t, np.ones(60))["tau"] is None
    lag, rng = np.arange(1, 21.0), np.random.default_rng(11)
    noise = 1 + 0.01 * rng.normal(size=20)
    f = fits.fit_confinement(lag, 2.5 * (1 - np.exp(-4 * 0.3 * lag / 2.5)) * noise)
    assert f["confined"] == 1 and f["plateau"] == pytest.approx(2.5, rel=0.05) and f["size"] == pytest.approx(2.5**0.5, rel=0.05)
    f = fits.fit_confinement(lag, 4 * 0.2 * lag**0.9 * noise)
    assert f["confined"] == 0 and f["exponent"] == pytest.approx(0.9, abs=0.1)


def test_sedimentation_is_exact(spark):
    """Slopes and R2 of shares of 64 are the nearest doubles to the exact values, on any order and partitioning of the frames."""
    rng = np.random.default_rng(7)
    held = {f"i{k}": [(t, int(rng.integers(1, 9)), int(c), int(rng.integers(1, 5))) for t, c in enumerate(rng.integers(20, 40, 7))] for k in range(40)}
    rows = [(i, t, n, c / 64, float(r)) for i, frames in held.items() for t, n, c, r in frames]
    table = spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], "img string, t int, n long, area_fraction double, mean_radius double").repartition(5)
    found = {r.img: r for r in cells.sedimentation(table, ["img"]).collect()}
    for i, frames in held.items():
        for at, name, unit in ((1, "n", 1), (2, "area_fraction", 64), (3, "mean_radius", 1)):
            t, y = [f[0] for f in frames], [Fraction(f[at], unit) for f in frames]
            mt, my = Fraction(sum(t), 7), sum(y) / 7
            xx, xy, yy = sum((a - mt) ** 2 for a in t), sum((a - mt) * (b - my) for a, b in zip(t, y, strict=True)), sum((b - my) ** 2 for b in y)
            assert found[i][f"{name}_slope"] == float(xy / xx)
            assert found[i][f"{name}_r2"] == (float(xy**2 / (xx * yy)) if yy else 1.0)
