"""Colocalisation: pixel coefficients, mask overlap, object pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays
from .common import ratio, with_group

KEY = ["img", "y", "x"]


def pixel_coefficients(px: DataFrame, a: str = "v1", b: str = "v2", roi: str = "img") -> DataFrame:
    """Pearson r, overlap, k1, k2 and the intensity correlation quotient of each region, rounded to 4 digits."""
    x, y = F.col(a), F.col(b)
    centred = with_group(px, [roi], ma=F.avg(a), mb=F.avg(b))
    same = ((x - F.col("ma")) * (y - F.col("mb")) > 0).cast("double")
    return centred.groupBy(roi).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.corr(a, b), 4).alias("pearson"),
        F.round(ratio(F.sum(x * y), F.sqrt(F.sum(x * x) * F.sum(y * y))), 4).alias("overlap"),
        F.round(ratio(F.sum(x * y), F.sum(x * x)), 4).alias("k1"),
        F.round(ratio(F.sum(x * y), F.sum(y * y)), 4).alias("k2"),
        F.round(F.avg(same) - 0.5, 4).alias("icq"),
    )


def intensity_correlation(px: DataFrame, a: str = "v1", b: str = "v2") -> DataFrame:
    """Centred product of each pixel beside both intensities."""
    out = with_group(px, ["img"], ma=F.avg(a), mb=F.avg(b))
    return out.select(*KEY, a, b, ((F.col(a) - F.col("ma")) * (F.col(b) - F.col("mb"))).alias("product"))


def icq_test(px: DataFrame, a: str = "v1", b: str = "v2") -> DataFrame:
    """Quotient over all pixels; sign test z over the non-zero products only."""
    p = intensity_correlation(px, a, b)
    out = p.groupBy("img").agg(F.sum((F.col("product") > 0).cast("double")).alias("plus"), F.sum((F.col("product") != 0).cast("double")).alias("moved"), F.count(F.lit(1)).alias("n"))
    return out.select("img", (F.col("plus") / F.col("n") - 0.5).alias("icq"), ratio(F.col("plus") - F.col("moved") / 2, F.sqrt("moved") / 2).alias("z"))


def spearman(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Pearson r of average ranks. Ranks come from counts of distinct values, so ties are one row of the window."""
    out = df
    for c in (a, b):
        counts = df.groupBy(key, c).agg(F.count(F.lit(1)).alias("c"))
        upto = F.sum("c").over(W.partitionBy(key).orderBy(c))
        out = out.join(counts.select(key, c, (upto - (F.col("c") - 1) / 2).alias(f"rank_{c}")), [key, c])
    return out.groupBy(key).agg(F.corr(f"rank_{a}", f"rank_{b}").alias("rho"))


def kendall(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """tau-b within each key, by counting inversions of one rank in the order of the other: n log n for a key's n rows."""

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tau = arrays.kendall(pdf[a].to_numpy(), pdf[b].to_numpy())
        return pd.DataFrame({key: [k[0]], "tau": [None if np.isnan(tau) else tau]})

    rows = df.select(key, a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return rows.groupBy(key).applyInPandas(run, rows.select(key).schema.add("tau", "double"))


def costes_threshold(px: DataFrame, a: str = "v1", b: str = "v2", steps: int = 256) -> DataFrame:
    """Total-least-squares line b = slope a + icept; the highest of `steps` thresholds below which r is not positive."""
    m = px.groupBy("img").agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), F.covar_pop(a, b).alias("cab"), F.min(a).alias("lo"), F.max(a).alias("hi"))
    d = F.col("vb") - F.col("va")
    m = m.withColumn("slope", ratio(d + F.sqrt(d * d + 4 * F.col("cab") * F.col("cab")), 2 * F.col("cab"))).withColumn("icept", F.col("mb") - F.col("slope") * F.col("ma"))
    grid = m.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn("ta", F.col("hi") - (F.col("hi") - F.col("lo")) * F.col("k") / steps)
    below = px.join(grid, "img").where((F.col(a) < F.col("ta")) | (F.col(b) < F.col("slope") * F.col("ta") + F.col("icept")))
    rs = below.groupBy("img", "k", "ta", "slope", "icept").agg(F.corr(a, b).alias("r"))
    return rs.where(F.col("r") <= 0).groupBy("img").agg(F.max_by("ta", F.struct(-F.col("k"))).alias("threshold"), F.first("slope").alias("slope"), F.first("icept").alias("icept"))


def mask_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """M1, M2, Jaccard and Dice of two masks for each image; M is 0 for an empty denominator, the others null."""
    both = a.select(*KEY, F.lit(1).alias("a")).join(b.select(*KEY, F.lit(1).alias("b")), KEY, "full_outer")
    n = both.groupBy("img").agg(F.count("a").alias("na"), F.count("b").alias("nb"), F.count(F.col("a") + F.col("b")).alias("ab"), F.count(F.lit(1)).alias("any"))
    return n.select(
        "img",
        F.round(F.coalesce(ratio(F.col("ab"), F.col("na")), F.lit(0.0)), 4).alias("m1"),
        F.round(F.coalesce(ratio(F.col("ab"), F.col("nb")), F.lit(0.0)), 4).alias("m2"),
        F.round(ratio(F.col("ab"), F.col("any")), 4).alias("jaccard"),
        F.round(ratio(2 * F.col("ab"), F.col("na") + F.col("nb")), 4).alias("dice"),
    )


def manders_intensity(px: DataFrame, mask: DataFrame, value: str = "v1") -> DataFrame:
    """Share of a channel's intensity that lies in the other channel's mask."""
    marked = px.join(mask.select(*KEY, F.lit(1).alias("m")), KEY, "left")
    return marked.groupBy("img").agg(F.round(ratio(F.sum(F.when(F.col("m") == 1, F.col(value)).otherwise(0.0)), F.sum(value)), 4).alias("manders"))


def object_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlapping objects of two label relations with shared pixels, centroid distance and whether the pair is one to one."""
    shared = a.select(*KEY, F.col("label").alias("l1")).join(b.select(*KEY, F.col("label").alias("l2")), KEY).groupBy("img", "l1", "l2").agg(F.count(F.lit(1)).alias("pixels"))
    for n, labels in ((1, a), (2, b)):
        centre = labels.groupBy("img", F.col("label").alias(f"l{n}")).agg(F.avg("y").alias(f"y{n}"), F.avg("x").alias(f"x{n}"))
        per = shared.groupBy("img", f"l{n}").agg(F.count(F.lit(1)).alias(f"n{n}"))
        shared = shared.join(centre, ["img", f"l{n}"]).join(per, ["img", f"l{n}"])
    distance = F.hypot(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2"))
    return shared.select("img", "l1", "l2", "pixels", distance.alias("distance"), ((F.col("n1") == 1) & (F.col("n2") == 1)).alias("unique_pair"))


def non_coincident(a: DataFrame, b: DataFrame) -> DataFrame:
    """Objects of a that share no pixel with b, as a share of all for each image."""
    objects = a.select("img", "label").distinct()
    hit = a.join(b.select(*KEY), KEY, "left_semi").select("img", "label").distinct()
    alone = objects.join(hit.withColumn("hit", F.lit(1)), ["img", "label"], "left")
    return alone.groupBy("img").agg(F.count(F.lit(1)).alias("objects"), F.avg(F.col("hit").isNull().cast("double")).alias("alone"))


def threshold_sensitivity(px: DataFrame, base: DataFrame, a: str = "v1", b: str = "v2", shifts=(-0.3, -0.2, -0.1, 0.0, 0.1, 0.2, 0.3)) -> DataFrame:
    """M1 and M2 as both thresholds move by shares of the range above them."""
    grid = base.withColumn("shift", F.explode(F.array(*(F.lit(s) for s in shifts))))
    grid = grid.withColumns({"t1": F.col("t1") + F.col("shift") * (F.col("top1") - F.col("t1")), "t2": F.col("t2") + F.col("shift") * (F.col("top2") - F.col("t2"))})
    on = px.join(grid, "img")
    over1, over2 = F.col(a) > F.col("t1"), F.col(b) > F.col("t2")
    pick = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0.0))
    return on.groupBy("img", "shift").agg(ratio(pick(over1 & over2, a), pick(over1, a)).alias("m1"), ratio(pick(over1 & over2, b), pick(over2, b)).alias("m2"))
