"""Measurements per cell and per frame, line profiles, seams and other statistics of masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ratio

KEY = ["img", "y", "x"]


def shape(labels: DataFrame, keys: list[str], microns: float = 1.0) -> DataFrame:
    """Centroid, area, axes, eccentricity and box of each label; axes are those of the ellipse with the same second moments,
    pixels being unit squares."""
    m = labels.groupBy(*keys, "label").agg(
        F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.count(F.lit(1)).alias("px"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"),
        (F.var_pop("y") + 1 / 12).alias("vy"), (F.var_pop("x") + 1 / 12).alias("vx"), F.covar_pop("y", "x").alias("c"),
    )
    gap = F.sqrt((F.col("vy") - F.col("vx")) * (F.col("vy") - F.col("vx")) + 4 * F.col("c") * F.col("c"))
    both = F.col("vy") + F.col("vx")
    major, minor = 4 * F.sqrt((both + gap) / 2), 4 * F.sqrt(F.greatest(F.lit(0.0), (both - gap) / 2))
    round_ = F.sqrt(F.greatest(F.lit(0.0), 1 - minor * minor / (major * major)))
    return m.select(
        *keys, "label", (F.col("cy") * microns).alias("y_um"), (F.col("cx") * microns).alias("x_um"), (F.col("px") * microns * microns).alias("area_um2"),
        (major * microns).alias("major_um"), (minor * microns).alias("minor_um"), round_.alias("eccentricity"), "y0", "x0", "y1", "x1",
    )


def cell_enrichment(dense: DataFrame, cells: DataFrame, px: DataFrame, shell: int = 5, background: float = 0.0) -> DataFrame:
    """Per cell: dense and dilute means, their ratio, and the median ratio of its objects to the dilute shell around them
    inside the cell. A shell has all pixels within `shell` steps to a side neighbour of the object."""
    v = px.select(*KEY, F.greatest(F.lit(0.0), F.col("v") - background).alias("v"))
    cell = cells.select(*KEY, F.col("label").alias("cell"))
    inside = v.join(cell, KEY).join(dense.select(*KEY, "label"), KEY, "left")
    whole = inside.groupBy("img", "cell").agg(F.avg(F.when(F.col("label").isNotNull(), F.col("v"))).alias("dense_mean"), F.avg(F.when(F.col("label").isNull(), F.col("v"))).alias("dilute_mean"), F.countDistinct("label").alias("n"))
    steps = [(dy, dx) for dy in range(-shell, shell + 1) for dx in range(-shell, shell + 1) if abs(dy) + abs(dx) <= shell]
    offsets = F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in steps)))
    around = dense.select("img", "label", "y", "x", offsets.alias("o")).select("img", "label", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).distinct()
    dilute = inside.where("label is null").select(*KEY, "cell", "v")
    rings = around.join(dilute, KEY).groupBy("img", "cell", "label").agg(F.avg("v").alias("ring"))
    objects = dense.join(v, KEY).groupBy("img", "label").agg(F.avg("v").alias("mean"))
    held = inside.where("label is not null").select("img", "cell", "label").distinct().join(rings, ["img", "cell", "label"]).join(objects, ["img", "label"])
    per = held.groupBy("img", "cell").agg(F.median(F.when(F.col("ring") > 0, F.col("mean") / F.col("ring"))).alias("median_enrichment"))
    return whole.join(per, ["img", "cell"], "left").select("img", "cell", "n", F.when(F.col("dilute_mean") > 0, F.col("dense_mean") / F.col("dilute_mean")).alias("enrichment"), "median_enrichment", "dense_mean", "dilute_mean")


def cell_summary(objects: DataFrame, cells: DataFrame, microns: float = 1.0) -> DataFrame:
    """Per cell: its area, number and total area of objects, coverage, and the radius of their mean area; zeros without objects."""
    area = cells.groupBy("img", F.col("label").alias("cell")).agg((F.count(F.lit(1)) * microns * microns).alias("cell_um2"))
    on = objects.join(cells.select(*KEY, F.col("label").alias("cell")), KEY).groupBy("img", "cell", "label").agg((F.count(F.lit(1)) * microns * microns).alias("a"))
    s = on.groupBy("img", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("total"), F.avg("a").alias("mean"))
    out = area.join(s, ["img", "cell"], "left").na.fill(0, ["n", "total", "mean"])
    return out.select("img", "cell", "cell_um2", "n", F.col("total").alias("objects_um2"), (F.col("total") / F.col("cell_um2")).alias("coverage"), F.sqrt(F.col("mean") / F.pi()).alias("mean_radius_um"))


def cell_fractals(objects: DataFrame, cells: DataFrame, side: int, least: int = 16) -> DataFrame:
    """Box dimension of all objects of a cell, and mean and deviation of its objects' own (from `least` pixels on, boxes laid
    from an object's corner, full boxes only, two sizes at least)."""
    on = objects.join(cells.select(*KEY, F.col("label").alias("cell")), KEY)
    sizes = [2**k for k in range(1, max(1, side.bit_length() - 1))]
    box = lambda y, x: (F.floor(y / F.col("s")).alias("by"), F.floor(x / F.col("s")).alias("bx"))
    slope = lambda n: F.regr_slope(F.log(n), F.log(1 / F.col("s")))
    whole = on.withColumn("s", F.explode(F.array(*map(F.lit, sizes)))).select("img", "cell", "s", *box(F.col("y"), F.col("x"))).distinct()
    whole = whole.groupBy("img", "cell", "s").agg(F.count(F.lit(1)).alias("boxes")).groupBy("img", "cell").agg(slope("boxes").alias("cell_dimension"))
    own = on.groupBy("img", "cell", "label").agg(F.count(F.lit(1)).alias("px"), F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") - F.min("y") + 1).alias("h"), (F.max("x") - F.min("x") + 1).alias("w")).where(F.col("px") >= least)
    fit = (F.col("dy") < F.floor(F.col("h") / F.col("s")) * F.col("s")) & (F.col("dx") < F.floor(F.col("w") / F.col("s")) * F.col("s"))
    # sizes go up to half the short side's power of two
    fit = fit & (F.col("s") <= F.pow(2.0, F.floor(F.log2(F.least("h", "w"))) - 1))
    parts = on.join(own, ["img", "cell", "label"]).withColumns({"s": F.explode(F.array(*map(F.lit, sizes))), "dy": F.col("y") - F.col("y0"), "dx": F.col("x") - F.col("x0")})
    boxes = parts.where(fit).select("img", "cell", "label", "s", *box(F.col("dy"), F.col("dx"))).distinct().groupBy("img", "cell", "label", "s").agg(F.count(F.lit(1)).alias("boxes"))
    each = boxes.groupBy("img", "cell", "label").agg(slope("boxes").alias("d"))
    stats = own.join(each, ["img", "cell", "label"], "left").groupBy("img", "cell").agg(F.avg("d").alias("mean_dimension"), F.stddev_pop("d").alias("std_dimension"), F.avg("px").alias("mean_area"), F.count(F.lit(1)).alias("n"))
    total = on.groupBy("img", "cell").agg(F.count(F.lit(1)).alias("total_area"))
    return total.join(whole, ["img", "cell"], "left").join(stats, ["img", "cell"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def lacunarity(mask: DataFrame, height: int, width: int, sizes: list[int]) -> DataFrame:
    """E[m^2] / E[m]^2 of the mass m of a gliding box of each size. A mask pixel adds to one window sum along x, then y: rows
    and columns in turn, so a box costs its side, not its area. Even boxes leave the last place out."""
    m = mask.select(*KEY).distinct().withColumn("s", F.explode(F.array(*(F.lit(s) for s in sizes if s < height and s < width))))
    last = lambda n: F.lit(n) - F.col("s") - F.when(F.col("s") % 2 == 0, 1).otherwise(0)  # noqa: E731  the last start
    starts = lambda c, n: F.explode(F.sequence(F.greatest(F.lit(0), F.col(c) - F.col("s") + 1), F.least(F.col(c), last(n))))
    inside = lambda df, c, n: df.where(F.greatest(F.lit(0), F.col(c) - F.col("s") + 1) <= F.least(F.col(c), last(n)))
    rows = inside(m, "x", width).select("img", "s", "y", starts("x", width).alias("x")).groupBy("img", "s", "y", "x").agg(F.count(F.lit(1)).alias("m"))
    boxes = inside(rows, "y", height).select("img", "s", starts("y", height).alias("y"), "x", "m").groupBy("img", "s", "y", "x").agg(F.sum("m").cast("double").alias("m"))
    places = (last(height) + 1) * (last(width) + 1)
    return boxes.groupBy("img", "s").agg(F.sum(F.col("m") * F.col("m")).alias("two"), F.sum("m").alias("one")).select("img", F.col("s").alias("box_size"), (places * F.col("two") / (F.col("one") * F.col("one"))).alias("lacunarity"))


def _samples(y0: float, x0: float, y1: float, x1: float, width: int) -> list[tuple[int, int, int, int, float]]:
    """(place along the line, place across, y, x, weight): bilinear samples one pixel apart."""
    length = ((y1 - y0) ** 2 + (x1 - x0) ** 2) ** 0.5
    uy, ux = (y1 - y0) / length, (x1 - x0) / length
    out = []
    for k in range(int(-(-length // 1)) + 1):
        for j in range(width):
            across = j - (width - 1) / 2
            y, x = y0 + k * uy + across * ux, x0 + k * ux - across * uy
            for cy in (int(y // 1), int(y // 1) + 1):
                for cx in (int(x // 1), int(x // 1) + 1):
                    w = (1 - abs(y - cy)) * (1 - abs(x - cx))
                    if w > 1e-12:
                        out.append((k, j, cy, cx, w))
    return out


def line_profile(px: DataFrame, line: tuple[float, float, float, float], width: int = 1, how: str = "mean", keys: list[str] = ("img",), value: str = "v") -> DataFrame:
    """Values along a line (y0, x0, y1, x1), sampled bilinearly one pixel apart, across its width by mean, max or sum. Places
    of which a pixel is missing are left out; more keys, as a frame, make a kymograph. The samples are as many as the line
    has pixels, so they are broadcast."""
    reduce = {"mean": F.avg, "max": F.max, "sum": F.sum}[how]
    samples = px.sparkSession.createDataFrame(_samples(*line, width), "pos int, j int, y int, x int, w double")
    need = samples.groupBy("pos").agg(F.count(F.lit(1)).alias("need"))
    at = px.select(*keys, "y", "x", F.col(value).alias("v")).join(F.broadcast(samples), ["y", "x"])
    one = at.groupBy(*keys, "pos", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"), F.count("v").alias("have"))
    return one.groupBy(*keys, "pos").agg(reduce("v").alias("v"), F.sum("have").alias("have")).join(F.broadcast(need), "pos").where("have = need").select(*keys, "pos", "v")


def kymograph_correlation(px: DataFrame, line: tuple[float, float, float, float], a: str, b: str, width: int = 1) -> DataFrame:
    """Two channels' profiles along a line in each frame, and their Pearson correlation over it."""
    both = line_profile(px, line, width, keys=["img", "t"], value=a).withColumnRenamed("v", "a").join(line_profile(px, line, width, keys=["img", "t"], value=b).withColumnRenamed("v", "b"), ["img", "t", "pos"])
    return both.groupBy("img", "t").agg(F.corr("a", "b").alias("pearson"), F.count(F.lit(1)).alias("n"))


def column_seams(px: DataFrame, keys: list[str], window: int = 16, threshold: float = 5.0) -> DataFrame:
    """How far the mean step from each column to the next stands out from the steps around it, as a z-score (0 with fewer
    than three neighbours), and whether that is a seam. Steps are one row for each column, so the window is narrow."""
    before = px.select(*keys, "y", (F.col("x") + 1).alias("x"), F.col("v").alias("u"))
    steps = px.join(before, [*keys, "y", "x"]).groupBy(*keys, "x").agg(F.avg(F.abs(F.col("v") - F.col("u"))).alias("step"))
    around = W.partitionBy(*keys).orderBy("x").rangeBetween(-window, window)
    others = F.filter(F.collect_list(F.struct("x", "step")).over(around), lambda s: s["x"] != F.col("x"))
    s = steps.select(*keys, "x", "step", F.transform(others, lambda s: s["step"]).alias("o")).withColumn("n", F.size("o"))
    ordered = s.withColumn("o", F.sort_array("o"))
    mid = (F.get("o", F.floor((F.col("n") - 1) / 2).cast("int")) + F.get("o", F.floor(F.col("n") / 2).cast("int"))) / 2
    mean = F.aggregate("o", F.lit(0.0), lambda a, v: a + v) / F.col("n")
    ordered = ordered.withColumns({"mid": mid, "mean": mean})
    sd = F.sqrt(F.aggregate("o", F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean"))) / F.col("n"))
    z = F.when(F.col("n") >= 3, (F.col("step") - F.col("mid")) / (sd + 1e-12)).otherwise(0.0)
    return ordered.select(*keys, "x", z.alias("z"), (z >= threshold).alias("seam"))


def persistent_seams(seams: DataFrame, share: float = 0.6) -> DataFrame:
    """Columns that are seams in at least a share of an image's frames; seams has a frame `t`."""
    return seams.groupBy("img", "x").agg(F.avg(F.col("seam").cast("double")).alias("share")).withColumn("persistent", F.col("share") >= share)


def outside_statistics(px: DataFrame, cells: DataFrame, least: int) -> DataFrame:
    """Level (median) and noise (1.4826 MAD) of the pixels outside all cells, or, where these are too few, of the darkest quarter."""
    on = px.select(*KEY, "v").join(cells.select(*KEY).distinct().withColumn("in", F.lit(1)), KEY, "left")
    s = on.groupBy("img").agg(F.sum(F.when(F.col("in").isNull(), 1).otherwise(0)).alias("free"), F.percentile("v", F.lit(0.25)).alias("p25"))
    bg = on.join(s, "img").where(F.when(F.col("free") >= least, F.col("in").isNull()).otherwise(F.col("v") <= F.col("p25")))
    mid = bg.groupBy("img").agg(F.median("v").alias("level"))
    return bg.join(mid, "img").groupBy("img").agg(F.first("level").alias("level"), (1.4826 * F.median(F.abs(F.col("v") - F.col("level")))).alias("m"), F.stddev_pop("v").alias("s")).select("img", "level", F.when(F.col("m") > 0, F.col("m")).otherwise(F.greatest("s", F.lit(1e-6))).alias("noise"))


def stitched(base: DataFrame, crop: DataFrame, how: str) -> DataFrame:
    """A crop's values written back by `or`, `add` or `replace`; pixels of the crop alone are taken as they are."""
    j = base.select(*KEY, "v").join(crop.select(*KEY, F.col("v").alias("c")), KEY, "full")
    v = {"or": F.greatest(F.coalesce("v", F.lit(0.0)), F.coalesce("c", F.lit(0.0))), "add": F.coalesce("v", F.lit(0.0)) + F.coalesce("c", F.lit(0.0)), "replace": F.coalesce("c", "v")}[how]
    return j.select(*KEY, v.alias("v"))


def renumbered(labels: DataFrame, offset: int = 0) -> DataFrame:
    """Labels of each image counted from 1 (plus an offset) in their order. Distinct labels are counted, not pixels."""
    n = F.row_number().over(W.partitionBy("img").orderBy("label")) + offset
    names = labels.select("img", "label").distinct().withColumn("new", n.cast("int"))
    return labels.join(names, ["img", "label"]).select(*KEY, F.col("new").alias("label"))


def bands(px: DataFrame, edges: list[float]) -> DataFrame:
    """Pixels by bands of brightness between percentiles, the brightest band first; equal edges collapse, the last is closed."""
    cuts = px.groupBy("img").agg(F.array_distinct(F.sort_array(F.percentile("v", F.array(*map(F.lit, edges))))).alias("e"))
    j = px.select(*KEY, "v").join(cuts, "img").where((F.col("v") >= F.get("e", F.lit(0))) & (F.col("v") <= F.element_at("e", -1)))
    over = F.size(F.filter("e", lambda e: e <= F.col("v")))
    return j.select(*KEY, (F.size("e") - F.least(over, F.size("e") - 1)).alias("band"))


def to_region(points: DataFrame, kind: str, *at: float) -> DataFrame:
    """Distance of each point to a point (y, x) or a segment (y0, x0, y1, x1)."""
    y, x = F.col("y_um"), F.col("x_um")
    if kind == "point":
        return points.withColumn("distance", F.sqrt((y - at[0]) * (y - at[0]) + (x - at[1]) * (x - at[1])))
    y0, x0, y1, x1 = at
    square = (y1 - y0) ** 2 + (x1 - x0) ** 2
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((y - y0) * (y1 - y0) + (x - x0) * (x1 - x0)) / square))
    dy, dx = y - (y0 + t * (y1 - y0)), x - (x0 + t * (x1 - x0))
    return points.withColumn("distance", F.sqrt(dy * dy + dx * dx))


def background_region(px: DataFrame, region: DataFrame, dense: DataFrame, limit: float = 0.8) -> DataFrame:
    """Whether a region taken for background is as bright as the dilute phase: its mean is at least `limit` of the mean of
    all that is neither dense nor in the region."""
    on = px.select(*KEY, "v").join(region.select(*KEY).distinct().withColumn("r", F.lit(1)), KEY, "left").join(dense.select(*KEY).distinct().withColumn("d", F.lit(1)), KEY, "left")
    s = on.groupBy("img").agg(F.avg(F.when(F.col("r") == 1, F.col("v"))).alias("region"), F.avg(F.when(F.col("r").isNull() & F.col("d").isNull(), F.col("v"))).alias("dilute"))
    return s.withColumn("suspect", F.coalesce((F.col("dilute") > 0) & (F.col("region") >= limit * F.col("dilute")), F.lit(False)))


def size_confound(df: DataFrame, keys: list[str], group: str, radius: str, psf: float, contrast: float = 1.0) -> DataFrame:
    """For each pair of groups (a before b) the difference in brightness that their mean radii alone explain, and its level:
    ok under 2 %, mild under 5 %, else warning."""
    g = df.groupBy(*keys, group).agg(F.avg(radius).alias("r")).withColumn("bias", -F.tanh(0.75 * psf / F.col("r")) * contrast)
    a, b = (g.select(*keys, F.col(group).alias(f"group_{s}"), F.col("r").alias(f"r_{s}"), F.col("bias").alias(f"bias_{s}")) for s in "ab")
    pairs = (a.join(b, keys) if keys else a.crossJoin(b)).where("group_a < group_b")  # groups are conditions, a few
    apparent = F.when(F.abs(1 + F.col("bias_a")) > 1e-9, (1 + F.col("bias_b")) / (1 + F.col("bias_a")) - 1)
    level = F.when(apparent.isNull(), "unknown").when(F.abs(apparent) < 0.02, "ok").when(F.abs(apparent) < 0.05, "mild").otherwise("warning")
    return pairs.select(*keys, "group_a", "group_b", "r_a", "r_b", apparent.alias("apparent"), level.alias("level"))


def frame_coefficients(px: DataFrame) -> DataFrame:
    """Two channels frame by frame: Pearson, overlap, and both Manders shares over the other channel's mean; px has img, t, v1, v2."""
    m = px.groupBy("img", "t").agg(F.avg("v1").alias("m1"), F.avg("v2").alias("m2"))
    on = px.join(m, ["img", "t"])
    first, second = F.sum(F.when(F.col("v2") > F.col("m2"), F.col("v1"))), F.sum(F.when(F.col("v1") > F.col("m1"), F.col("v2")))
    return on.groupBy("img", "t").agg(
        F.corr("v1", "v2").alias("pearson"), (F.sum(F.col("v1") * F.col("v2")) / F.sqrt(F.sum(F.col("v1") * F.col("v1")) * F.sum(F.col("v2") * F.col("v2")))).alias("overlap"),
        ratio(first, F.sum("v1")).alias("m1"), ratio(second, F.sum("v2")).alias("m2"),
    )


def frame_object_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per frame: objects of a and b, objects of a that touch one of b, and their share; labels have img, t, y, x, label."""
    key = ["img", "t", "y", "x"]
    hit = a.join(b.select(*key).distinct(), key).select("img", "t", "label").distinct().withColumn("hit", F.lit(1))
    of_a = a.select("img", "t", "label").distinct().join(hit, ["img", "t", "label"], "left").groupBy("img", "t").agg(F.count(F.lit(1)).alias("n_a"), F.count("hit").alias("n_touching"))
    of_b = b.groupBy("img", "t").agg(F.countDistinct("label").alias("n_b"))
    return of_a.join(of_b, ["img", "t"], "full").select("img", "t", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"), F.coalesce("n_touching", F.lit(0)).alias("n_touching"), (F.col("n_touching") / F.col("n_a")).alias("share"))


def trend_preservation(frames: DataFrame, keys: list[str], raw: str, new: str) -> DataFrame:
    """Of raw and processed values frame by frame: Pearson, rank correlation (ordinal, ties by frame), and the share of steps
    in the same direction. Windows run over the frames of one image."""
    order = W.partitionBy(*keys).orderBy("t")
    ranked = frames.withColumns({f"r_{c}": F.row_number().over(W.partitionBy(*keys).orderBy(c, "t")) for c in (raw, new)})
    same = F.signum(F.col(raw) - F.lag(raw).over(order)) == F.signum(F.col(new) - F.lag(new).over(order))
    s = ranked.withColumn("same", same.cast("double")).groupBy(*keys)
    return s.agg(F.coalesce(F.corr(f"r_{raw}", f"r_{new}"), F.lit(0.0)).alias("spearman"), F.coalesce(F.corr(raw, new), F.lit(0.0)).alias("pearson"), F.coalesce(F.avg("same"), F.lit(1.0)).alias("steps"))


def bleach_corrected(px: DataFrame, factors: DataFrame) -> DataFrame:
    """Values times their frame's factor, held to [0, 1]; frames without a factor stay."""
    v = F.when(F.col("factor").isNull(), F.col("v")).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("v") * F.col("factor"))))
    return px.join(factors.select("img", "t", "factor"), ["img", "t"], "left").select("img", "t", "y", "x", v.alias("v"))


def prebleach_normalized(series: DataFrame, frames: int) -> DataFrame:
    """Values over the mean of the first frames."""
    s = series.where(F.col("t") <= frames).groupBy("series_id").agg(F.avg("v").alias("pre"))
    return series.join(s, "series_id").select("series_id", "t", ratio(F.col("v"), F.col("pre")).alias("v"))


def linear_fit(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares line of y on x: slope, intercept and 1 - RSS / TSS; null for fewer than two rows or no spread."""
    slope, cut = F.regr_slope(y, x), F.regr_intercept(y, x)
    return df.groupBy(*keys).agg(slope.alias("slope"), cut.alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"))


def _lines(rows: DataFrame, x: str, ys: list[str]) -> DataFrame:
    """rows with slope and R2 of each y on x over the sorted structs of __f: null without spread of x, R2 1 without spread of y.

    Deviations are n times a value less the sum, in the order of __f: the same on any partitioning, and exact where the values
    are whole or shares of a power of two, so that no slope of zero gets a sign and no half is rounded either way."""
    total = {f"__t_{c}": F.expr(f"aggregate(__f, 0D, (a, r) -> a + r.{c})") for c in [x, *ys]}
    apart = {f"__d_{c}": F.expr(f"transform(__f, r -> size(__f) * r.{c} - __t_{c})") for c in [x, *ys]}
    product = lambda a, b: F.expr(f"aggregate(zip_with(__d_{a}, __d_{b}, (p, q) -> p * q), 0D, (s, v) -> s + v)")
    sums = {"__xx": product(x, x)} | {f"__xy_{y}": product(x, y) for y in ys} | {f"__yy_{y}": product(y, y) for y in ys}
    found = {}
    for y in ys:
        xx, xy, yy = F.col("__xx"), F.col(f"__xy_{y}"), F.col(f"__yy_{y}")
        found[f"{y}_slope"] = F.when(xx != 0, xy / xx)
        found[f"{y}_r2"] = F.when(xx != 0, F.when(yy == 0, 1.0).otherwise(xy * xy / (xx * yy)))
    return rows.withColumns(total).withColumns(apart).withColumns(sums).withColumns(found).drop(*total, *apart, *sums)


def sedimentation(frames: DataFrame, keys: list[str]) -> DataFrame:
    """From frames (t, n, mean_radius, area_fraction) whether droplets settle (area fraction rises, R2 over 0.3; corroborated
    if their number rises too) or coarsen (radii rise, R2 over 0.3; corroborated if their number falls); 4 frames at least."""
    names = ["area_fraction", "n", "mean_radius"]
    fine = frames.where(" and ".join(f"{c} is not null" for c in ["t", *names]))
    s = _lines(fine.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), F.sort_array(F.collect_list(F.struct(*(F.col(c).cast("double").alias(c) for c in ["t", *names])))).alias("__f")), "t", names).drop("__f")
    rises = lambda c: F.coalesce((F.col(f"{c}_slope") > 0) & (F.col(f"{c}_r2") > 0.3), F.lit(False))
    settles, coarsens = rises("area_fraction"), rises("mean_radius")
    process = F.when(F.col("frames") < 4, "insufficient_data").when(settles & coarsens, "both").when(settles, "sedimentation").when(coarsens, "coarsening").otherwise("stable")
    return s.withColumns({"process": process, "settling_corroborated": settles & F.coalesce(F.col("n_slope") > 0, F.lit(False)), "coarsening_corroborated": coarsens & F.coalesce(F.col("n_slope") < 0, F.lit(False))})


def pinhole_crosstalk(labels: DataFrame, px: DataFrame, ring: int = 4, gap: int = 1, far: int = 15) -> DataFrame:
    """Median background in a ring around the brighter half of the objects over that far from all objects, less 1: light that
    leaks. Distances are steps to side neighbours. Null where there is no ring or nothing far away."""
    v = px.select(*KEY, "v")
    means = labels.join(v, KEY).groupBy("img", "label").agg(F.avg("v").alias("m"))
    bright = means.join(means.groupBy("img").agg(F.median("m").alias("mid")), "img").where(F.col("m") >= F.col("mid")).select("img", "label")
    steps = lambda n: F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in range(-n, n + 1) for b in range(-n, n + 1) if abs(a) + abs(b) <= n)))
    grown = lambda df, n: df.select(*KEY, steps(n).alias("o")).select("img", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).distinct()
    on = v.join(grown(labels.join(bright, ["img", "label"]), ring).withColumn("near", F.lit(1)), KEY, "left").join(grown(labels, gap).withColumn("touch", F.lit(1)), KEY, "left").join(grown(labels, far).withColumn("wide", F.lit(1)), KEY, "left")
    s = on.groupBy("img").agg(F.median(F.when(F.col("near").isNotNull() & F.col("touch").isNull(), F.col("v"))).alias("local"), F.median(F.when(F.col("wide").isNull(), F.col("v"))).alias("distant"))
    up = (F.col("local") - F.col("distant")) / F.greatest(F.abs("distant"), F.lit(1e-6))
    return s.select("img", "local", "distant", up.alias("elevation"), F.when(up < 0.1, "good").when(up < 0.3, "warn").when(up.isNotNull(), "bad").otherwise("na").alias("status"))


def plausible_size(value: Column, least: float = 1e-3, most: float = 100.0) -> Column:
    """Whether a pixel size in microns is a number within bounds; null and what is no number are not."""
    number = F.expr(f"try_cast({value} as double)") if isinstance(value, str) else value.cast("double")
    return F.coalesce(~F.isnan(number) & (number >= least) & (number <= most), F.lit(False))


def local_partition(labels: DataFrame, px: DataFrame, gap: int = 2, width: int = 6, dark: float | None = None, top: float | None = None) -> DataFrame:
    """Each droplet's mean over that of the dilute ring around it, beyond a gap: K with the camera's floor taken off both where
    it is known, else a contrast only. Droplets with a saturated pixel are marked, rings take in no droplet."""
    v = px.select(*KEY, "v")
    steps = [(a, b) for a in range(-gap - width, gap + width + 1) for b in range(-gap - width, gap + width + 1) if abs(a) + abs(b) <= gap + width]
    offsets = F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(abs(a) + abs(b)).alias("d")) for a, b in steps)))
    reach = labels.select("img", "label", "y", "x", offsets.alias("o")).groupBy("img", "label", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).agg(F.min("o.d").alias("d"))
    ring = reach.where(F.col("d") > gap).join(labels.select(*KEY), KEY, "left_anti").join(v, KEY).groupBy("img", "label").agg(F.avg("v").alias("dilute"), F.count(F.lit(1)).alias("ring_px"))
    hot = F.max((F.col("v") >= top).cast("int")) if top is not None else F.lit(0)
    dense = labels.join(v, KEY).groupBy("img", "label").agg(F.avg("v").alias("dense"), hot.alias("saturated"))
    floor = dark or 0.0
    k = F.when(F.col("dilute") > floor, (F.col("dense") - floor) / (F.col("dilute") - floor))
    out = dense.join(ring, ["img", "label"], "left")
    return out.select("img", "label", "dense", "dilute", F.coalesce("ring_px", F.lit(0)).alias("ring_px"), (F.col("saturated") == 1).alias("saturated"), (k if dark is not None else F.lit(None).cast("double")).alias("k"), ratio(F.col("dense"), F.col("dilute")).alias("contrast"))


def bead_classes(beads: DataFrame, keys: list[str], brightness: str, factor: float = 1.6) -> DataFrame:
    """Unit brightness (median of the lower half), units of each bead, and whether it is an aggregate."""
    mid = beads.groupBy(*keys).agg(F.median(brightness).alias("mid"))
    unit = beads.join(mid, keys).where(F.col(brightness) <= F.col("mid")).groupBy(*keys).agg(F.median(brightness).alias("unit"))
    units = ratio(F.col(brightness), F.col("unit"))
    return beads.join(unit, keys).withColumns({"units": units, "bead_class": F.when(units >= factor, "aggregate").otherwise("single")})


def matched(predicted: DataFrame, true: DataFrame, tolerance: float) -> DataFrame:
    """Precision, recall, F1 and mean distance of objects matched one to one by centroid within a tolerance, image by image.

    Candidates come from a join on a grid of tolerance-sized squares; the assignment of least total distance is found for
    each image's candidates alone, whose number is bounded by its objects'."""
    from .planes import assigned

    keys = ["img"]
    centroid = lambda df, s: df.groupBy(*keys, "label").agg(F.avg("y").alias(f"{s}y"), F.avg("x").alias(f"{s}x")).withColumnRenamed("label", f"{s}_label")
    p, t = centroid(predicted, "p"), centroid(true, "t")
    side = max(tolerance, 1e-9)
    square = lambda c: F.floor(F.col(c) / side)
    spread = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    wide = p.withColumn("o", spread).withColumns({"gy": square("py") + F.col("o.a"), "gx": square("px") + F.col("o.b")}).drop("o")
    apart = F.sqrt((F.col("py") - F.col("ty")) * (F.col("py") - F.col("ty")) + (F.col("px") - F.col("tx")) * (F.col("px") - F.col("tx")))
    near = wide.join(t.withColumns({"gy": square("ty"), "gx": square("tx")}), [*keys, "gy", "gx"]).withColumn("distance", apart).where(F.col("distance") <= tolerance)
    pairs = assigned(near.select(*keys, "p_label", "t_label", "distance"), keys, tolerance)
    tp = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("tp"), F.avg("distance").alias("localization_error"))
    n = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("np")).join(t.groupBy(*keys).agg(F.count(F.lit(1)).alias("nt")), keys, "full").join(tp, keys, "left").na.fill(0, ["np", "nt", "tp"])
    precision, recall = ratio(F.col("tp"), F.col("np")), ratio(F.col("tp"), F.col("nt"))
    return n.select(*keys, precision.alias("precision"), recall.alias("recall"), F.when((F.col("tp") > 0), 2 * F.col("tp") / (F.col("np") + F.col("nt"))).alias("f1"), "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("nt") - F.col("tp")).alias("fn"), "localization_error")


def image_bands_share(banded: DataFrame) -> DataFrame:
    """Pixels in each band."""
    return banded.groupBy("img", "band").agg(F.count(F.lit(1)).alias("pixels"))


def gaussian(x: Column, amplitude: float, center: float, sigma: float, offset: float = 0.0) -> Column:
    return F.lit(amplitude) * F.exp(-(x - center) * (x - center) / (2 * sigma * sigma)) + offset


def gaussian_2d(y: Column, x: Column, amplitude: float, cy: float, cx: float, sy: float, sx: float, offset: float = 0.0) -> Column:
    return F.lit(amplitude) * F.exp(-((y - cy) * (y - cy) / (2 * sy * sy) + (x - cx) * (x - cx) / (2 * sx * sx))) + offset


def fusion_relaxation(t: Column, a: float, tau: float, b: float, d: float) -> Column:
    return a * F.exp(-t / tau) + b * t + d


def worm_like_chain(force: Column, contour_um: float = 16.49, persistence_nm: float = 50.0, stretch_pn: float = 1500.0, kt: float = 4.11) -> Column:
    """Extension of an extensible worm-like chain at a force; contour, persistence, stretch and kT are fixed defaults of DNA."""
    f = F.greatest(force, F.lit(1e-6))
    return contour_um * (1 - 0.5 * F.sqrt(kt / (f * persistence_nm)) + f / stretch_pn)


def _chain(force: Column, kuhn_nm: float, stretch_pn: float, kt: float) -> Column:
    f = F.greatest(force, F.lit(1e-6))
    u = f * kuhn_nm / kt
    return (1 / F.tanh(u) - 1 / u) * (1 + f / stretch_pn)


def freely_jointed_chain(force: Column, contour_um: float, kuhn_nm: float = 1.5, stretch_pn: float = 800.0, kt: float = 4.11) -> Column:
    return contour_um * _chain(force, kuhn_nm, stretch_pn, kt)


def chain_contour(force: Column, extension: Column, kuhn_nm: float = 1.5, stretch_pn: float = 800.0, kt: float = 4.11) -> Column:
    """Contour length of a freely-jointed chain of known force and extension; null where the model has none."""
    c = _chain(force, kuhn_nm, stretch_pn, kt)
    return F.when(c > 0, extension / c)


def viscosity_interval(d: Column, low: Column, high: Column, radius_um: float, celsius: float = 24.0) -> dict[str, Column]:
    """Stokes-Einstein viscosity (Pa s) and its bounds from those of the diffusion coefficient (um2 / s): a low one gives the
    upper bound, which is missing (unbounded) if that is not positive; `wide` marks a ratio over 1.5 or none."""
    kt = 1.380649e-23 * (celsius + 273.15)
    eta = lambda c: F.when(c > 0, kt / (6 * F.pi() * radius_um * 1e-6 * c * 1e-12))
    upper, lower = eta(low), eta(high)
    return {"viscosity": eta(d), "lower": lower, "upper": upper, "unbounded": upper.isNull(), "wide": F.coalesce(upper / lower > 1.5, F.lit(True))}
