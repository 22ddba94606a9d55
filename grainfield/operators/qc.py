"""Acquisition checks, calibration and physical plausibility: one row of figures and a verdict for each image or series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ratio
from .pixel import image_noise


def verdict(value: Column, good: float, warn: float, low_is_good: bool = True) -> Column:
    if low_is_good:
        return F.when(value <= good, "good").when(value <= warn, "warn").otherwise("bad")
    return F.when(value >= good, "good").when(value >= warn, "warn").otherwise("bad")


def saturation(px: DataFrame, top: float) -> DataFrame:
    s = px.groupBy("img").agg(F.avg((F.col("v") >= top).cast("double")).alias("at_top"), F.avg((F.col("v") == 0).cast("double")).alias("at_zero"))
    return s.withColumn("verdict", F.when(F.col("at_top") < 0.001, "good").when(F.col("at_top") < 0.01, "warn").otherwise("bad"))


def signal_to_noise(px: DataFrame) -> DataFrame:
    spread = px.groupBy("img").agg((F.percentile("v", F.lit(0.95)) - F.percentile("v", F.lit(0.05))).alias("spread"))
    s = spread.join(image_noise(px), "img").select("img", ratio(F.col("spread"), F.col("noise")).alias("snr"))
    return s.withColumn("verdict", verdict(F.col("snr"), 10, 4, low_is_good=False))


def brenner(px: DataFrame, keys: list[str] = ("img",)) -> DataFrame:
    """Mean squared difference two pixels along a row."""
    ahead = px.select(*keys, "y", (F.col("x") - 2).alias("x"), F.col("v").alias("w"))
    d = F.col("w") - F.col("v")
    return px.join(ahead, [*keys, "y", "x"]).groupBy(*keys).agg(F.avg(d * d).alias("focus"))


def focus_series(stack: DataFrame, share: float = 0.5) -> DataFrame:
    """Focus of each frame over the median of its frames, flagged below a share of the highest."""
    f = brenner(stack, ["img", "t"])
    s = f.groupBy("img").agg(F.median("focus").alias("m"), F.max("focus").alias("top"))
    return f.join(s, "img").select("img", "t", ratio(F.col("focus"), F.col("m")).alias("relative"), (F.col("focus") < share * F.col("top")).alias("blurred"))


def best_slice(stack: DataFrame) -> DataFrame:
    """The frame with the highest focus; of equal ones the first."""
    return brenner(stack, ["img", "t"]).groupBy("img").agg(F.max_by("t", F.struct("focus", -F.col("t"))).alias("t"))


def bleaching(stack: DataFrame) -> DataFrame:
    """Log-linear decay of the frames' medians: tau, and last over first; 4 frames at least."""
    m = stack.groupBy("img", "t").agg(F.median("v").alias("m"))
    s = m.groupBy("img").agg(F.count(F.lit(1)).alias("frames"), F.regr_slope(F.log("m"), F.col("t")).alias("slope"), ratio(F.max_by("m", "t"), F.min_by("m", "t")).alias("remaining")).where("frames >= 4")
    tau = F.when((F.col("slope") < 0) & (-1 / F.col("slope") <= 10 * F.col("frames")), -1 / F.col("slope"))
    return s.select("img", "frames", tau.alias("tau"), "remaining").withColumn("verdict", verdict(F.col("remaining"), 0.85, 0.5, low_is_good=False))


def nyquist(df: DataFrame, pixel: str, wavelength: str, aperture: str) -> DataFrame:
    r = ratio(F.col(pixel), F.col(wavelength) / (4 * F.col(aperture)))
    return df.withColumn("ratio", r).withColumn("verdict", F.when(F.col("ratio") < 0.4, "oversampled").when(F.col("ratio") <= 1.05, "good").when(F.col("ratio") <= 2, "warn").otherwise("bad"))


def time_sampling(df: DataFrame, interval: str, timescale: str) -> DataFrame:
    r = ratio(F.col(interval), F.col(timescale) / 2)
    return df.withColumn("ratio", r).withColumn("verdict", verdict(F.col("ratio"), 1.0, 2.0))


def calibration(df: DataFrame, keys: list[str], intensity: str, concentration: str) -> DataFrame:
    """Least squares of concentration on intensity: slope, intercept, R2, residual deviation (n - 2), range; 3 pairs at least."""
    c, i = F.col(concentration), F.col(intensity)
    s = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(c, i).alias("slope"), F.regr_intercept(c, i).alias("intercept"), F.regr_r2(c, i).alias("r2"), F.regr_syy(c, i).alias("syy"), F.min(i).alias("lo"), F.max(i).alias("hi")).where("n >= 3")
    return s.select(*keys, "n", "slope", "intercept", "r2", F.sqrt(F.greatest(F.lit(0.0), F.col("syy") * (1 - F.col("r2"))) / (F.col("n") - 2)).alias("residual_std"), "lo", "hi")


def concentrations(df: DataFrame, model: DataFrame, keys: list[str], intensity: str) -> DataFrame:
    """Calibrated concentrations; outside the calibrated range they are marked extrapolated."""
    return df.join(model, keys).withColumn("concentration", F.col("slope") * F.col(intensity) + F.col("intercept")).withColumn("status", F.when(F.col(intensity).between(F.col("lo"), F.col("hi")), "calibrated").otherwise("extrapolated"))


def transfer_energy(df: DataFrame, dense: str, dilute: str, kelvin: float = 298.15) -> DataFrame:
    """-RT ln(dense / dilute) in kcal/mol; null for concentrations that are not positive."""
    r = 0.00198720425864083  # fixed value: gas constant, kcal/(K mol)
    fine = (F.col(dense) > 0) & (F.col(dilute) > 0)
    return df.withColumn("delta_g", F.when(fine, -r * kelvin * F.log(F.col(dense) / F.col(dilute))))


def meaningful(value: Column, zero_is_impossible: bool = False) -> Column:
    """Neither null, blank, a placeholder, nor not finite."""
    text = F.lower(F.trim(value.cast("string")))
    # fixed values: texts that stand for nothing
    placeholders = ["", "none", "null", "nan", "n/a", "na", "unknown", "inf", "-inf", "infinity", "-infinity"]
    out = value.isNotNull() & ~text.isin(*placeholders)
    return out & ~text.rlike("^-?0+(\\.0*)?$") if zero_is_impossible else out


def pixel_size(df: DataFrame, stored: str, confirmed: str) -> DataFrame:
    """Root of the stored square microns; null if missing, not positive, or exactly 1 (a placeholder) unless confirmed."""
    v = F.expr(f"try_cast({stored} as double)")
    return df.withColumn("pixel_um", F.when((v > 0) & ((F.abs(v - 1) >= 1e-9) | F.col(confirmed)), F.sqrt(v)))


def worst(*signals: str) -> Column:
    """ok < warn < block."""
    rank = F.greatest(*(F.when(F.col(s) == "block", 2).when(F.col(s) == "warn", 1).otherwise(0) for s in signals))
    return F.element_at(F.array(F.lit("ok"), F.lit("warn"), F.lit("block")), rank + 1)


def grade(score: Column, lacking: Column) -> Column:
    """Grade of a product of factors; what lacks a core factor is no better than moderate, and no score at all is unreliable."""
    # fixed values: the least scores of the grades
    known = F.when(score >= 0.85, F.when(lacking, "moderate").otherwise("high")).when(score >= 0.6, "moderate").when(score >= 0.3, "low")
    return F.coalesce(known, F.lit("unreliable"))


def reliability(df: DataFrame, factors: list[str], core: list[str], hard: str) -> DataFrame:
    """Product of the available factors, null if there is none; a missing core factor caps the grade at moderate, a hard
    failure makes it unreliable."""
    score, lacking = F.lit(1.0), F.lit(False)
    for f in factors:
        score = score * F.coalesce(F.col(f), F.lit(1.0))
    for f in core:
        lacking = lacking | F.col(f).isNull()
    any_ = F.coalesce(*(F.col(f) for f in factors)).isNotNull()
    out = df.withColumn("score", F.when(F.col(hard), 0.0).when(any_, score))
    out = out.withColumn("grade", F.when(F.col(hard), "unreliable").otherwise(grade(F.col("score"), lacking)))
    return out.withColumn("missing", F.concat_ws(",", *(F.when(F.col(f).isNull(), F.lit(f)) for f in factors)))


def edge_width(px: DataFrame) -> DataFrame:
    """(p99.5 - p0.5) of intensity over p99.9 of the central-difference gradient, over sqrt(2 pi)."""
    at = lambda dy, dx, name: px.select("img", (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col("v").alias(name))
    on = px
    for dy, dx, name in ((1, 0, "s"), (-1, 0, "n"), (0, 1, "e"), (0, -1, "w")):
        on = on.join(at(dy, dx, name), ["img", "y", "x"])
    g = on.groupBy("img").agg(F.percentile(F.hypot((F.col("s") - F.col("n")) / 2, (F.col("e") - F.col("w")) / 2), F.lit(0.999)).alias("g"))
    spread = px.groupBy("img").agg((F.percentile("v", F.lit(0.995)) - F.percentile("v", F.lit(0.005))).alias("d"))
    return spread.join(g, "img").select("img", ratio(F.col("d"), F.col("g") * F.sqrt(2 * F.pi())).alias("edge_width_px"))


def vignetting(px: DataFrame, height: int, width: int, bins: int = 24) -> DataFrame:
    """Outer over inner mean of radial bins of the background."""
    r = F.hypot(F.col("y") - (height - 1) / 2, F.col("x") - (width - 1) / 2) / F.hypot(F.lit((height - 1) / 2), F.lit((width - 1) / 2))
    b = px.groupBy("img", F.least(F.lit(bins - 1), F.floor(r * bins)).cast("int").alias("bin")).agg(F.avg("v").alias("m"))
    s = b.groupBy("img").agg(F.max_by("m", "bin").alias("edge"), F.min_by("m", "bin").alias("centre"))
    return s.select("img", ratio(F.col("edge"), F.col("centre")).alias("ratio")).withColumn("verdict", verdict(F.col("ratio"), 0.9, 0.7, low_is_good=False))


def frame_adequacy(stack: DataFrame) -> DataFrame:
    """Frames of each image and how well a temporal variance can be had from them; relative error sqrt(2 / (T - 1))."""
    s = stack.groupBy("img").agg(F.countDistinct("t").alias("frames"))
    level = F.when(F.col("frames") < 4, "none").when(F.col("frames") < 16, "unreliable").when(F.col("frames") < 64, "usable").when(F.col("frames") < 256, "recommended").otherwise("well sampled")
    return s.select("img", "frames", F.when(F.col("frames") > 1, F.sqrt(2 / (F.col("frames") - 1))).alias("relative_error"), level.alias("level"))
