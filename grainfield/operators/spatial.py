"""Point patterns and image structure: neighbours, Ripley, pair correlation, Moran, grid entropy, densities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import cut
from .common import ratio, with_group
from .graph import near_pairs

KEY = ["img", "y", "x"]


def _nearest(points: DataFrame, k: int, most: float = float("inf"), start: float = 1.0) -> DataFrame:
    """(cell, id, other, d): at least the k nearest others of each point, or all where a cell has fewer; those farther than
    `most` may be left out. The first look reaches `start` of a square's side.

    Points look into a grid whose squares hold about k points of their cell, then those with too few others within a square's
    side look again at twice the distance, until none is left: no pairs beyond that are formed. Each round is written."""
    finite = (F.abs("y_um") < float("inf")) & (F.abs("x_um") < float("inf"))  # neither null nor nan
    own = points.select("cell", "id", "y_um", "x_um").where(finite & F.col("cell").isNotNull() & F.col("id").isNotNull())
    size = own.groupBy("cell").agg(F.countDistinct("id").alias("n"), ((F.max("y_um") - F.min("y_um")) * (F.max("x_um") - F.min("x_um"))).alias("area"), F.greatest(F.max("y_um") - F.min("y_um"), F.max("x_um") - F.min("x_um")).alias("span"))
    # a cell on a line has no area: its span is shared out instead; points all in one place are at once near each other
    unit = F.greatest(F.sqrt((k + 1) * F.col("area") / F.col("n")), (k + 1) * F.col("span") / F.col("n"))
    side = cut(own.join(size.where("n > 1").withColumn("unit", F.when(unit > 0, unit).otherwise(1.0)).drop("area", "span"), "cell"), "nearest-points")
    todo, found, reach = side, None, start
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    while True:
        square = lambda c: F.floor(F.col(c) / (F.col("unit") * reach))  # noqa: E731, B023
        look = todo.withColumns({"gy": square("y_um"), "gx": square("x_um")}).withColumn("s", steps)
        look = look.select("cell", "id", "n", "unit", F.col("y_um").alias("y"), F.col("x_um").alias("x"), (F.col("gy") + F.col("s.i")).alias("gy"), (F.col("gx") + F.col("s.j")).alias("gx"))
        at = side.select("cell", F.col("id").alias("other"), "y_um", "x_um", square("y_um").alias("gy"), square("x_um").alias("gx"))
        dy, dx = F.col("y") - F.col("y_um"), F.col("x") - F.col("x_um")
        d = F.sqrt(dy * dy + dx * dx)
        near = look.join(at, ["cell", "gy", "gx"]).where("id <> other").select("cell", "id", "other", d.alias("d"), (F.col("unit") * reach).alias("reach")).where("d <= reach")
        near = cut(near.select("cell", "id", "other", "d").where(F.col("d") <= most), "nearest")
        done = near.groupBy("cell", "id").agg(F.countDistinct("other").alias("have"))
        held = todo.join(done, ["cell", "id"], "left").withColumn("have", F.coalesce("have", F.lit(0)))
        short = (F.col("have") < F.least(F.lit(k), F.col("n") - 1)) & (F.col("unit") * reach < most)
        left = cut(held.where(short).drop("have"), "nearest-left")
        settled = near.join(left, ["cell", "id"], "left_anti")
        found = settled if found is None else found.unionByName(settled)
        if left.isEmpty():
            return found
        todo, reach = left, reach * 2


def nearest_neighbours(points: DataFrame) -> DataFrame:
    """Mean, median, population deviation and coefficient of variation of nearest-neighbour distances of each cell."""
    nn = _nearest(points, 1).groupBy("cell", "id").agg(F.min("d").alias("d"))
    return nn.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.median("d").alias("median"), F.stddev_pop("d").alias("std"), ratio(F.stddev_pop("d"), F.avg("d")).alias("cv"))


def k_nearest(points: DataFrame, k: int = 3) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("cell", "id").orderBy("d", "other"))
    return _nearest(points, k).withColumn("rank", rank).where(F.col("rank") <= k).select("cell", "id", "rank", "other", "d")


def ripley_l(points: DataFrame, areas: DataFrame, radii: list[float]) -> DataFrame:
    """K, L and L - r on a grid of radii, weighted 1 + r / R with R the radius of a disk of the area; 3 points at least.
    Pairs come from a grid of the largest radius, so far points never meet."""
    n = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").join(areas, "cell")
    grid = n.withColumn("r", F.explode(F.array(*(F.lit(float(r)) for r in radii))))
    near = near_pairs(points, max(radii)).join(grid.select("cell", "r"), "cell").where(F.col("d") <= F.col("r")).groupBy("cell", "r").agg((2 * F.count(F.lit(1))).alias("pairs"))
    weight = 1 + F.col("r") / F.sqrt(F.col("area") / F.pi())
    k = F.col("area") * F.coalesce("pairs", F.lit(0)) * weight / (F.col("n") * (F.col("n") - 1))
    out = grid.join(near, ["cell", "r"], "left").withColumn("k", k).withColumn("l", F.sqrt(F.col("k") / F.pi()))
    return out.select("cell", "r", "k", "l", (F.col("l") - F.col("r")).alias("l_minus_r"))


def pair_correlation(points: DataFrame, areas: DataFrame, width: float, rings: int) -> DataFrame:
    """g(r): pairs in each ring over those expected at the mean density."""
    n = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(areas, "cell")
    near = near_pairs(points, width * rings).where(F.col("d") < width * rings).groupBy("cell", F.floor(F.col("d") / width).cast("int").alias("ring")).agg((2 * F.count(F.lit(1))).alias("pairs"))
    grid = n.withColumn("ring", F.explode(F.sequence(F.lit(0), F.lit(rings - 1))))
    size = F.pi() * width * width * (2 * F.col("ring") + 1)
    g = F.coalesce("pairs", F.lit(0)) * F.col("area") / (F.col("n") * (F.col("n") - 1) * size)
    return grid.join(near, ["cell", "ring"], "left").select("cell", "ring", F.when(F.col("n") > 1, g).alias("g"))


def grid_entropy(points: DataFrame, bins: int = 10) -> DataFrame:
    """Entropy (bits) of counts on a bins x bins grid over each cell's box, and its share of log2(bins^2)."""
    on = with_group(points, ["cell"], y0=F.min("y_um"), y1=F.max("y_um"), x0=F.min("x_um"), x1=F.max("x_um"))
    cell = lambda c: F.least(F.lit(bins - 1), F.coalesce(F.floor(ratio((F.col(f"{c}_um") - F.col(f"{c}0")) * bins, F.col(f"{c}1") - F.col(f"{c}0"))), F.lit(0)))
    h = on.groupBy("cell", cell("y").alias("by"), cell("x").alias("bx")).agg(F.count(F.lit(1)).alias("c"))
    e = F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")
    import math

    return h.groupBy("cell").agg(e.alias("entropy"), (e / math.log2(bins * bins)).alias("normalized"))


def kernel_density(points: DataFrame) -> DataFrame:
    """Gaussian kernel density at each point with Scott's bandwidth n^(-1/6) and the cell's covariance."""
    s = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.var_samp("y_um").alias("vy"), F.var_samp("x_um").alias("vx"), F.covar_samp("y_um", "x_um").alias("c")).where("n > 2")
    f = F.pow("n", F.lit(-1 / 3))
    s = s.select("cell", "n", (F.col("vy") * f).alias("vy"), (F.col("vx") * f).alias("vx"), (F.col("c") * f).alias("c"))
    a, b = points.alias("a"), points.alias("b")
    p = a.join(b, F.col("a.cell") == F.col("b.cell")).select(F.col("a.cell").alias("cell"), F.col("a.id").alias("id"), (F.col("a.y_um") - F.col("b.y_um")).alias("dy"), (F.col("a.x_um") - F.col("b.x_um")).alias("dx"))
    det = F.col("vy") * F.col("vx") - F.col("c") * F.col("c")
    m = (F.col("vx") * F.col("dy") * F.col("dy") - 2 * F.col("c") * F.col("dy") * F.col("dx") + F.col("vy") * F.col("dx") * F.col("dx")) / det
    return p.join(s, "cell").where(det > 0).groupBy("cell", "id").agg((F.sum(F.exp(-m / 2)) / F.first(2 * F.pi() * F.sqrt(det) * F.col("n"))).alias("density"))


def radial_profile(px: DataFrame, cy: float, cx: float, bins: int, most: float) -> DataFrame:
    """Mean, population deviation and count of each ring [e, e + 1) around a centre; empty rings stay."""
    w = most / bins
    r = F.hypot(F.col("y") - cy, F.col("x") - cx)
    h = px.withColumn("r", r).where(F.col("r") < most).groupBy("img", F.floor(F.col("r") / w).cast("int").alias("ring")).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count(F.lit(1)).alias("n"))
    grid = px.select("img").distinct().withColumn("ring", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(h, ["img", "ring"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def interface_width(profile: DataFrame) -> DataFrame:
    """First rings whose mean is at most 80, 50 and 20 % of the profile's range, and their span."""
    s = with_group(profile.where("mean is not null"), ["img"], lo=F.min("mean"), hi=F.max("mean"))
    u = s.withColumn("u", ratio(F.col("mean") - F.col("lo"), F.col("hi") - F.col("lo")))
    at = lambda p: F.min(F.when(F.col("u") <= p, F.col("ring")))
    return u.groupBy("img").agg(at(0.8).alias("r80"), at(0.5).alias("r50"), at(0.2).alias("r20")).withColumn("width", F.col("r20") - F.col("r80"))


def morans_i(px: DataFrame, value: str = "v") -> DataFrame:
    """Moran's I with rook contiguity: each pair counted once and doubled."""
    on = with_group(px, ["img"], m=F.avg(value)).select(*KEY, (F.col(value) - F.col("m")).alias("d"))
    pairs = None
    for dy, dx in ((0, 1), (1, 0)):
        other = on.select("img", (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col("d").alias("e"))
        p = on.join(other, KEY).groupBy("img").agg(F.sum(F.col("d") * F.col("e")).alias("num"), F.count(F.lit(1)).alias("w"))
        pairs = p if pairs is None else pairs.unionByName(p)
    s = pairs.groupBy("img").agg(F.sum("num").alias("num"), F.sum("w").alias("w"))
    own = on.groupBy("img").agg(F.sum(F.col("d") * F.col("d")).alias("den"), F.count(F.lit(1)).alias("n"))
    return s.join(own, "img").select("img", ratio(F.col("n") * 2 * F.col("num"), 2 * F.col("w") * F.col("den")).alias("morans_i"))


def radial_localization(points: DataFrame, bins: int = 10) -> DataFrame:
    """Share of points in half-open bins of normalised distance from the cell's centroid; 1 itself is in no bin."""
    on = with_group(points, ["cell"], cy=F.avg("y_um"), cx=F.avg("x_um")).withColumn("r", F.hypot(F.col("y_um") - F.col("cy"), F.col("x_um") - F.col("cx")))
    on = with_group(on, ["cell"], top=F.max("r"), n=F.count(F.lit(1)))
    b = F.floor(ratio(F.col("r") * bins, F.col("top"))).cast("int")
    return on.groupBy("cell", b.alias("bin")).agg((F.count(F.lit(1)) / F.first("n")).alias("share")).where(F.col("bin") < bins)


def shift_correlation(px: DataFrame, a: str, b: str, most: int) -> DataFrame:
    """r between a and b shifted along rows; pixels beyond the edge are no pairs."""
    other = px.select("img", "y", F.col("x").alias("x2"), F.col(b).alias("w"))
    s = px.select("img", "y", "x", F.col(a).alias("u"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("shift")).withColumn("x2", F.col("x") + F.col("shift"))
    return s.join(other, ["img", "y", "x2"]).groupBy("img", "shift").agg(F.corr("u", "w").alias("r"))


def linking_conditions(detections: DataFrame, sigma: float) -> DataFrame:
    """Motion over the median of the frames' median nearest-neighbour spacing: how safely frames can be linked."""
    p = _nearest(detections.select(F.col("frame").alias("cell"), F.col("track_id").alias("id"), "y_um", "x_um"), 1)
    per = p.groupBy("cell", "id").agg(F.min("d").alias("d")).groupBy("cell").agg(F.median("d").alias("m"))
    r = per.agg(F.median("m").alias("spacing")).withColumn("r", ratio(F.lit(sigma), F.col("spacing")))
    return r.withColumn("level", F.when(F.col("r") < 0.3, "ok").when(F.col("r") < 0.6, "ambiguous").otherwise("unsafe"))


def local_variance_ratio(px: DataFrame) -> DataFrame:
    """Mean population variance of 3 x 3 neighbourhoods over the image's variance; edges use the neighbours that exist."""
    from .pixel import footprint, neighbourhood

    local = neighbourhood(px, footprint("square", 1), F.var_pop("v").alias("s")).groupBy("img").agg(F.avg("s").alias("local"))
    return local.join(px.groupBy("img").agg(F.var_pop("v").alias("all")), "img").select("img", ratio(F.col("local"), F.col("all")).alias("ratio"))


def headroom(scores: DataFrame) -> DataFrame:
    """1 - Moran's I: how far from saturation."""
    h = 1 - F.col("morans_i")
    return scores.select("img", h.alias("headroom"), F.when(h < 0.02, "saturated").when(h < 0.15, "close").otherwise("usable").alias("state"))
