"""Per-pixel maps, references, projections, normalisation and noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ratio, with_group

KEY = ["img", "y", "x"]


def rescale(px: DataFrame, low: float = 0.0, high: float = 1.0, value: str = "v") -> DataFrame:
    """Linear rescaling of each image from its range to [low, high]; a constant image gives low."""
    out = with_group(px, ["img"], lo=F.min(value), hi=F.max(value))
    return out.withColumn(value, F.coalesce(ratio((F.col(value) - F.col("lo")) * (high - low), F.col("hi") - F.col("lo")), F.lit(0.0)) + low).drop("lo", "hi")


def invert(px: DataFrame, top: float = 1.0, value: str = "v") -> DataFrame:
    """top - v: top is the type's maximum for unsigned pixels and 1 for fractions."""
    return px.withColumn(value, F.lit(top) - F.col(value))


def clip_low(px: DataFrame, value: str = "v") -> DataFrame:
    return px.withColumn(value, F.greatest(F.col(value), F.lit(0.0)))


def convert_depth(px: DataFrame, top: int, value: str = "v") -> DataFrame:
    """Fractions to unsigned integers up to top, rounded and held in range."""
    return px.withColumn(value, F.least(F.lit(top), F.greatest(F.lit(0), F.round(F.col(value) * top))).cast("int"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two images on their common pixels."""
    return a.join(b.withColumnRenamed("v", "w"), KEY).select(*KEY, (F.col("v") * F.col("w")).alias("v"))


def crop_to_mask(px: DataFrame, mask: DataFrame, pad: int = 0) -> DataFrame:
    """Pixels within the bounding box of each image's mask."""
    box = bounding_boxes(mask.withColumn("label", F.lit(1)), pad).drop("label")
    return px.join(box, "img").where(F.col("y").between(F.col("y0"), F.col("y1")) & F.col("x").between(F.col("x0"), F.col("x1"))).select(*px.columns)


def bounding_boxes(labels: DataFrame, pad: int = 0, height: int | None = None, width: int | None = None) -> DataFrame:
    """Padded bounding box of each label, clamped to the image."""
    top = F.max("y") + pad if height is None else F.least(F.max("y") + pad, F.lit(height - 1))
    right = F.max("x") + pad if width is None else F.least(F.max("x") + pad, F.lit(width - 1))
    return labels.groupBy("img", "label").agg(F.greatest(F.min("y") - pad, F.lit(0)).alias("y0"), top.alias("y1"), F.greatest(F.min("x") - pad, F.lit(0)).alias("x0"), right.alias("x1"))


def threshold(px: DataFrame, at: Column, value: str = "v") -> DataFrame:
    return px.withColumn("mask", (F.col(value) >= at).cast("int"))


def flat_field(px: DataFrame, flat: DataFrame, dark: float = 0.0) -> DataFrame:
    """(v - dark) / (flat - dark) x mean(flat - dark), on (y, x); null where the reference is dark."""
    gain = flat.groupBy("y", "x").agg((F.avg("v") - dark).alias("g"))
    mean = gain.agg(F.avg("g").alias("m"))
    return px.join(gain, ["y", "x"]).crossJoin(F.broadcast(mean)).withColumn("v", ratio((F.col("v") - dark) * F.col("m"), F.col("g"))).select(*px.columns)


def subtract_background(px: DataFrame, background: DataFrame) -> DataFrame:
    return px.join(background.select(*KEY, F.col("v").alias("b")), KEY).withColumn("v", F.greatest(F.col("v") - F.col("b"), F.lit(0.0))).drop("b")


def optical_density(px: DataFrame, reference: Column, value: str = "v") -> DataFrame:
    """-log10(I / I0) with I floored at 0.001 I0 + 1e-9, held in [0, 3]."""
    floor = reference * 0.001 + 1e-9
    od = -F.log10(F.greatest(F.col(value), floor) / reference)
    return px.withColumn("od", F.least(F.lit(3.0), F.greatest(F.lit(0.0), od)))


def ratio_image(px: DataFrame, num: str, den: str, background_num: float, background_den: float, floor: float) -> DataFrame:
    d = F.col(den) - background_den
    return px.withColumn("ratio", F.when(d > floor, (F.col(num) - background_num) / d))


def unmix(px: DataFrame, matrix: list[list[float]], channels: list[str], limit: float = 1e6) -> DataFrame:
    """Abundances a of M a = c for each pixel: the small matrix is inverted once; ill-conditioned ones are refused."""
    import numpy as np

    m = np.array(matrix, float)
    if np.linalg.cond(m) > limit:
        raise ValueError("the mixing matrix is ill-conditioned")
    inverse = np.linalg.inv(m)
    return px.withColumns({f"a{i + 1}": sum((F.col(c) * float(w) for c, w in zip(channels, row, strict=True)), F.lit(0.0)) for i, row in enumerate(inverse)})


def negative_fraction(px: DataFrame, value: str) -> DataFrame:
    """Share of values below -1e-9 x the largest magnitude, for each image."""
    return with_group(px, ["img"], top=F.max(F.abs(value))).groupBy("img").agg(F.avg((F.col(value) < -1e-9 * F.col("top")).cast("double")).alias("negative"))


def mixing_matrix(controls: DataFrame, channels: list[str], background: float = 0.0) -> DataFrame:
    """Channel means of each control over the mean of its own channel; control k's own channel is channels[k]."""
    means = controls.groupBy("control").agg(*(F.avg(c).alias(c) for c in channels))
    own = F.element_at(F.array(*(F.col(c) - background for c in channels)), F.col("control") + 1)
    return means.select("control", *(ratio(F.col(c) - background, own).alias(c) for c in channels))


def normalize_within_mask(px: DataFrame, mask: DataFrame) -> DataFrame:
    """Min-max of each image over its mask; other pixels go."""
    return rescale(px.join(mask.select(*KEY), KEY, "left_semi"))


def image_noise(px: DataFrame, value: str = "v") -> DataFrame:
    """1.4826 x median |difference of vertical neighbours| / sqrt 2, for each image."""
    below = px.select("img", "x", (F.col("y") - 1).alias("y"), F.col(value).alias("below"))
    return px.join(below, KEY).groupBy("img").agg((F.median(F.abs(F.col("below") - F.col(value))) * 1.4826 / F.sqrt(F.lit(2.0))).alias("noise"))


def object_noise(px: DataFrame, value: str = "v") -> DataFrame:
    """1.4826 x MAD of row and column neighbour differences / sqrt 2."""
    parts = None
    for dy, dx in ((0, 1), (1, 0)):
        shifted = px.select("img", (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col(value).alias("w"))
        part = px.join(shifted, KEY).select("img", (F.col("w") - F.col(value)).alias("d"))
        parts = part if parts is None else parts.unionByName(part)
    from .common import mad

    return mad(parts, ["img"], "d").select("img", (F.col("mad") * 1.4826 / F.sqrt(F.lit(2.0))).alias("sigma"))


def iqr_filtered(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows within 1.5 interquartile ranges of the quartiles (linear percentiles)."""
    out = with_group(df, keys, q=F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))))
    lo, hi = F.col("q")[0], F.col("q")[1]
    return out.where(F.col(value).between(lo - 1.5 * (hi - lo), hi + 1.5 * (hi - lo))).select(*df.columns)


def merge_layers(layers: list[DataFrame], how: str, top: float) -> DataFrame:
    """Additive, mean, max or min of equal-shaped layers, held in [0, top]."""
    all_ = layers[0]
    for x in layers[1:]:
        all_ = all_.unionByName(x)
    agg = {"additive": F.sum, "mean": F.avg, "max": F.max, "min": F.min}[how]("v")
    return all_.groupBy(*KEY).agg(F.least(F.lit(top), F.greatest(F.lit(0.0), agg)).alias("v"))


def mask_logic(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """AND, OR or XOR of two masks as sets of pixels."""
    if how == "and":
        return a.select(*KEY).intersect(b.select(*KEY))
    if how == "or":
        return a.select(*KEY).union(b.select(*KEY)).distinct()
    if how == "xor":
        return a.select(*KEY).exceptAll(b.select(*KEY)).union(b.select(*KEY).exceptAll(a.select(*KEY)))
    raise ValueError(how)


def log_stretch(px: DataFrame) -> DataFrame:
    """log1p, then min-max."""
    return rescale(px.withColumn("v", F.log1p("v")))


def extend_to_edges(px: DataFrame, n: int, height: int, width: int) -> DataFrame:
    """Rows and columns at distance n from the border copied outward."""
    grid = px.select("img").distinct().select("img", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("ty")).select("img", "ty", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("tx"))
    hold = lambda c, size: F.least(F.lit(size - 1 - n), F.greatest(F.lit(n), F.col(c))).cast("int")
    return grid.withColumns({"y": hold("ty", height), "x": hold("tx", width)}).join(px, KEY).select("img", F.col("ty").alias("y"), F.col("tx").alias("x"), "v")


def neighbourhood(px: DataFrame, offsets: list[tuple[int, int]], aggregate, value: str = "v") -> DataFrame:
    """Aggregate of the pixels at the offsets that exist around each pixel: offsets are exploded once and summed map-side,
    so a pixel meets its neighbours in one shuffle."""
    moved = px.select("img", "y", "x", value, F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets))).alias("o"))
    around = moved.groupBy("img", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).agg(aggregate)
    return px.select(*KEY).join(around, KEY)


def footprint(kind: str, r: int) -> list[tuple[int, int]]:
    span = range(-r, r + 1)
    keep = {"disk": lambda y, x: y * y + x * x <= r * r, "square": lambda y, x: True, "diamond": lambda y, x: abs(y) + abs(x) <= r, "cross": lambda y, x: y == 0 or x == 0}[kind]
    return [(y, x) for y in span for x in span if keep(y, x)]


def erode(mask: DataFrame, kind: str = "disk", r: int = 1) -> DataFrame:
    """Mask pixels whose whole footprint is in the mask; outside the image counts as background."""
    shape = footprint(kind, r)
    return neighbourhood(mask.withColumn("v", F.lit(1)), shape, F.count(F.lit(1)).alias("n")).where(F.col("n") == len(shape)).select(*KEY)


def dilate(mask: DataFrame, kind: str = "disk", r: int = 1, height: int | None = None, width: int | None = None) -> DataFrame:
    shape = F.explode(F.array(*(F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for y, x in footprint(kind, r))))
    out = mask.select("img", "y", "x", shape.alias("o")).select("img", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).where("y >= 0 and x >= 0")
    if height is not None:
        out = out.where((F.col("y") < height) & (F.col("x") < width))
    return out.distinct()


def detrend_frames(stack: DataFrame, window: int) -> DataFrame:
    """Boxcar trend of the frame-mean trace (ends truncated); every frame is multiplied by overall mean / trend."""
    trace = stack.groupBy("img", "t").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("img").orderBy("t").rowsBetween(-(window // 2), window - 1 - window // 2)  # as many rows as frames
    trend = trace.withColumn("trend", F.avg(F.col("s") / F.col("n")).over(w)).withColumn("overall", F.avg(F.col("s") / F.col("n")).over(W.partitionBy("img")))
    return stack.join(trend.select("img", "t", ratio(F.col("overall"), F.col("trend")).alias("f")), ["img", "t"]).withColumn("v", F.col("v") * F.col("f")).drop("f")


def number_and_brightness(stack: DataFrame, gain: float = 1.0, offset: float = 0.0, read_variance: float = 0.0) -> DataFrame:
    """Temporal mean and sample variance of each pixel: brightness (var - read) / (gain (mean - offset)), number gain mean /
    brightness; zero where mean or variance do not exceed 1e-6."""
    stats = stack.groupBy(*KEY).agg((F.avg("v") - offset).alias("mean"), F.coalesce(F.var_samp("v") - read_variance, F.lit(0.0)).alias("var"))
    fine = (F.col("mean") > 1e-6) & (F.col("var") > 1e-6)
    eps = F.col("var") / (gain * F.col("mean"))
    return stats.select(*KEY, "mean", "var", F.when(fine, eps).otherwise(0.0).alias("brightness"), F.when(fine, gain * F.col("mean") / eps).otherwise(0.0).alias("number"))


def stream_stats(stack: DataFrame, keys: list[str], bins: int = 512, percentiles=(1, 99)) -> DataFrame:
    """Minimum, maximum, mean, population deviation, and percentiles from a histogram of `bins` bins: upper edge of the first
    bin that reaches the share."""
    basic = stack.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    binned = stack.join(basic, keys).groupBy(*keys, F.least(F.lit(bins - 1), F.coalesce(F.floor(ratio(F.col("v") - F.col("lo"), width)), F.lit(0))).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy(*keys).orderBy("bin")  # at most `bins` rows a group
    upto = binned.withColumn("upto", F.sum("c").over(w)).join(basic, keys)
    parts = [F.min(F.when(F.col("upto") >= F.col("n") * p / 100, F.col("lo") + (F.col("bin") + 1) * width)).alias(f"p{p}") for p in percentiles]
    return basic.join(upto.groupBy(*keys).agg(*parts), keys)


def projection(stack: DataFrame, how: str = "max") -> DataFrame:
    agg = {"max": F.max, "mean": F.avg, "sum": F.sum, "min": F.min}[how]("v")
    return stack.groupBy(*KEY).agg(agg.alias("v"))
