"""Ordered analytics: trajectories, displacement, lifetimes, recovery and ordered traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ratio, with_group
from .spatial import _nearest


def trajectory_metrics(tracks: DataFrame) -> DataFrame:
    """Detections, lifetime (last - first + 1), path, net displacement, speed over detections - 1, confinement, area change."""
    w = W.partitionBy("track_id").orderBy("frame")
    steps = tracks.withColumn("d", F.hypot(F.col("y_um") - F.lag("y_um").over(w), F.col("x_um") - F.lag("x_um").over(w)))
    end = lambda c, f: f(c, "frame")
    s = steps.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("n"), (F.max("frame") - F.min("frame") + 1).alias("lifetime"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("path"),
        *(end(c, f).alias(f"{c}_{k}") for c in ("y_um", "x_um", "area_um2") for k, f in (("first", F.min_by), ("last", F.max_by))), F.avg("area_um2").alias("mean_area"),
    )
    net = F.hypot(F.col("y_um_last") - F.col("y_um_first"), F.col("x_um_last") - F.col("x_um_first"))
    return s.select("track_id", "n", "lifetime", "path", net.alias("net"), ratio(F.col("path"), F.col("n") - 1).alias("speed"), ratio(net, F.col("path")).alias("confinement"), "mean_area", (F.col("area_um2_last") - F.col("area_um2_first")).alias("area_change"))


def lifetime_histogram(tracks: DataFrame) -> DataFrame:
    life = tracks.groupBy("track_id").agg((F.max("frame") - F.min("frame") + 1).alias("lifetime"))
    h = life.groupBy("lifetime").agg(F.count(F.lit(1)).alias("n"))
    return h.crossJoin(F.broadcast(h.agg(F.sum("n").alias("all")))).select("lifetime", "n", (F.col("n") / F.col("all")).alias("fraction"))


def growth_kinetics(tracks: DataFrame, interval: float = 1.0) -> DataFrame:
    """dA/dt of each step, its state against 5 % of the mean area, and running growth and shrinkage."""
    w = W.partitionBy("track_id").orderBy("frame")
    on = with_group(tracks, ["track_id"], mean=F.avg("area_um2"))
    on = on.withColumn("dadt", ratio(F.col("area_um2") - F.lag("area_um2").over(w), (F.col("frame") - F.lag("frame").over(w)) * interval))
    state = F.when(F.col("dadt") > 0.05 * F.col("mean"), "growth").when(F.col("dadt") < -0.05 * F.col("mean"), "shrinkage").otherwise("stable")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    pos, neg = F.greatest(F.coalesce("dadt", F.lit(0.0)), F.lit(0.0)), F.least(F.coalesce("dadt", F.lit(0.0)), F.lit(0.0))
    return on.select("track_id", "frame", "dadt", state.alias("state"), F.sum(pos).over(run).alias("grown"), F.sum(neg).over(run).alias("shrunk"))


def msd_per_track(tracks: DataFrame, most_lag: int, least_length: int = 200) -> DataFrame:
    """Mean squared displacement of each track at each frame lag: pairs on the frame axis, so gaps are no pairs. Lags are
    exploded and equi-joined; a track meets only itself."""
    n = tracks.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_length)
    kept = tracks.join(n, "track_id", "left_semi").select("track_id", "frame", "y_um", "x_um")
    later = kept.select("track_id", F.col("frame").alias("f2"), F.col("y_um").alias("y2"), F.col("x_um").alias("x2"))
    lagged = kept.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(most_lag)))).withColumn("f2", F.col("frame") + F.col("lag"))
    dy, dx = F.col("y2") - F.col("y_um"), F.col("x2") - F.col("x_um")
    return lagged.join(later, ["track_id", "f2"]).groupBy("track_id", "lag").agg(F.avg(dy * dy + dx * dx).alias("msd"), F.count(F.lit(1)).alias("pairs"))


def msd(tracks: DataFrame, most_lag: int, least_length: int = 200, interval: float = 1.0) -> DataFrame:
    """Ensemble: over tracks, not over pairs; deviation of the sample."""
    per = msd_per_track(tracks, most_lag, least_length)
    return per.groupBy("lag").agg(F.avg("msd").alias("msd"), F.stddev("msd").alias("std"), (F.stddev("msd") / F.sqrt(F.count(F.lit(1)))).alias("sem"), F.count(F.lit(1)).alias("n_tracks"), F.sum("pairs").alias("n_pairs")).withColumn("tau_s", F.col("lag") * interval)


def anomalous_exponent(curve: DataFrame, keys: list[str], dimensions: int = 2) -> DataFrame:
    """log-log least squares msd = 2 d D tau^alpha."""
    s = curve.where("msd > 0").groupBy(*keys) if keys else curve.where("msd > 0").groupBy()
    fit = s.agg(F.regr_slope(F.log("msd"), F.log("tau_s")).alias("alpha"), F.regr_intercept(F.log("msd"), F.log("tau_s")).alias("i"), F.regr_r2(F.log("msd"), F.log("tau_s")).alias("r2"))
    return fit.select(*keys, "alpha", (F.exp("i") / (2 * dimensions)).alias("d"), "r2")


def drift_corrected(tracks: DataFrame) -> DataFrame:
    """Positions less the running mean step of the tracks that consecutive observed frames share."""
    frames = tracks.select("frame").distinct()
    ranks = frames.withColumn("rank", F.row_number().over(W.orderBy("frame")))  # as many rows as frames
    on = tracks.join(F.broadcast(ranks), "frame")
    w = W.partitionBy("track_id").orderBy("frame")
    near = F.col("rank") - F.lag("rank").over(w) == 1
    steps = on.withColumns({"sy": F.when(near, F.col("y_um") - F.lag("y_um").over(w)), "sx": F.when(near, F.col("x_um") - F.lag("x_um").over(w))})
    mean = steps.groupBy("frame").agg(F.coalesce(F.avg("sy"), F.lit(0.0)).alias("my"), F.coalesce(F.avg("sx"), F.lit(0.0)).alias("mx"))
    run = W.orderBy("frame").rowsBetween(W.unboundedPreceding, 0)
    drift = mean.select("frame", F.sum("my").over(run).alias("dy"), F.sum("mx").over(run).alias("dx"))
    return tracks.join(F.broadcast(drift), "frame").select("track_id", "frame", (F.col("y_um") - F.col("dy")).alias("y_um"), (F.col("x_um") - F.col("dx")).alias("x_um"))


def kaplan_meier(tracks: DataFrame, total_frames: int) -> DataFrame:
    """Survival of tracks: those alive at the last frame are right-censored, those there at frame 0 left-censored; both stay
    at risk until their duration. A row for each event time and one for 0."""
    life = tracks.groupBy("track_id").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    life = life.select((F.col("b") - F.col("a") + 1).alias("t"), ((F.col("b") < total_frames - 1) & (F.col("a") > 0)).cast("int").alias("event"))
    by = life.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("d"))  # as many rows as durations
    at_risk = F.sum("n").over(W.orderBy(F.desc("t")).rowsBetween(W.unboundedPreceding, 0))
    ev = by.withColumn("at_risk", at_risk).where("d > 0")
    share = 1 - F.col("d") / F.col("at_risk")
    run = W.orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    gone = F.sum((share == 0).cast("int")).over(run)
    s = F.when(gone > 0, 0.0).otherwise(F.exp(F.sum(F.when(share > 0, F.log(share))).over(run)))
    zero = life.agg(F.count(F.lit(1)).alias("at_risk")).select(F.lit(0).alias("t"), "at_risk", F.lit(0).cast("long").alias("d"), F.lit(1.0).alias("s"))
    return ev.select(F.col("t").cast("int").alias("t"), "at_risk", "d", s.alias("s")).unionByName(zero)


def neighbour_persistence(tracks: DataFrame, k: int = 5, radius: float = 3.0) -> DataFrame:
    """Jaccard similarity of each detection's k nearest neighbours with those of its track's previous frame."""
    # the nearest ones within the radius, not all pairs within it, which grow with the square of a frame's detections
    points = tracks.select(F.col("frame").alias("cell"), F.col("track_id").alias("id"), "y_um", "x_um")
    pairs = _nearest(points, k, radius, 0.5).select(F.col("cell").alias("frame"), F.col("id").alias("track_id"), "other", "d")
    rank = F.row_number().over(W.partitionBy("frame", "track_id").orderBy("d", "other"))
    near = pairs.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("frame", "track_id").agg(F.collect_list("other").alias("near"))
    all_ = tracks.select("frame", "track_id").join(near, ["frame", "track_id"], "left").withColumn("near", F.coalesce("near", F.array().cast("array<long>")))
    w = W.partitionBy("track_id").orderBy("frame")
    both = all_.withColumn("before", F.lag("near").over(w)).where("before is not null")
    return both.select("track_id", "frame", ratio(F.size(F.array_intersect("near", "before")), F.size(F.array_union("near", "before"))).alias("jaccard"))


def merges_and_fissions(labels: DataFrame) -> DataFrame:
    """Labels of t + 1 over several of t (merge), and of t under several of t + 1 (fission)."""
    nxt = labels.select("img", (F.col("t") - 1).alias("t"), "y", "x", F.col("label").alias("after"))
    over = labels.join(nxt, ["img", "t", "y", "x"]).select("img", "t", F.col("label").alias("before"), "after").distinct()
    merge = over.groupBy("img", "t", F.col("after").alias("label")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").withColumn("event", F.lit("merge"))
    split = over.groupBy("img", "t", F.col("before").alias("label")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").withColumn("event", F.lit("fission"))
    return merge.unionByName(split)


def records(tracks: DataFrame, interval: float = 1.0) -> DataFrame:
    """Per track its frames and areas in order, and the least-squares growth of its area."""
    t = F.col("frame") * interval
    s = tracks.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("frame", "area_um2"))).alias("r"), F.regr_slope("area_um2", t).alias("growth"))
    return s.select("track_id", F.col("r.frame").alias("frames"), F.col("r.area_um2").alias("areas"), "growth")


def photofading(series: DataFrame, bleached: str, reference: str) -> DataFrame:
    """Bleached signal x ref(0) / ref(t); the factor is 1 where the reference is not positive."""
    first = series.groupBy("series_id").agg(F.min_by(reference, "t").alias("__r0"))
    factor = F.when((F.col(reference) > 0) & (F.col("__r0") > 0), F.col("__r0") / F.col(reference)).otherwise(1.0)
    return series.join(first, "series_id").withColumn("corrected", F.col(bleached) * factor).drop("__r0")


def taylor_normalized(series: DataFrame, value: str, prebleach: float) -> DataFrame:
    """(I - I0) / (Ipre - I0), I0 being the first value of each series."""
    first = series.groupBy("series_id").agg(F.min_by(value, "t").alias("__i0"))
    return series.join(first, "series_id").withColumn("normalized", ratio(F.col(value) - F.col("__i0"), prebleach - F.col("__i0"))).drop("__i0")


def moving_average(series: DataFrame, value: str, window: int = 3, keys=("series_id",), order: str = "t") -> DataFrame:
    half = window // 2
    return series.withColumn("smooth", F.avg(value).over(W.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)))


def coarsening(series: DataFrame) -> DataFrame:
    """R = R0 + K t^(1/3) and R0 + K t^(1/2): the one with the higher R2; 4 points at least."""
    t3, t2 = F.pow("t", F.lit(1 / 3)), F.sqrt("t")
    s = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("v", t3).alias("k3"), F.regr_r2("v", t3).alias("r3"), F.regr_slope("v", t2).alias("k2"), F.regr_r2("v", t2).alias("r2")).where("n >= 4")
    first = F.col("r3") >= F.col("r2")
    return s.select("series_id", F.when(first, "ostwald").otherwise("coalescence").alias("law"), F.when(first, F.col("k3")).otherwise(F.col("k2")).alias("k"), F.greatest("r3", "r2").alias("r2"))


def population_stats(detections: DataFrame, which: list[str]) -> DataFrame:
    """Per frame: members of some classes, their share of all, and median area."""
    mine = F.col("event_type").isin(*which)
    return detections.groupBy("frame").agg(F.sum(mine.cast("int")).alias("n"), F.avg(mine.cast("double")).alias("fraction"), F.median(F.when(mine, F.col("area_um2"))).alias("median_area"))


def force_cycles(trace: DataFrame, smooth: int = 11) -> DataFrame:
    """Half cycles of an ordered distance trace: a new segment begins where the smoothed difference changes its sign."""
    half = smooth // 2
    w = W.partitionBy("series_id").orderBy("t")
    s = trace.withColumn("s", F.avg("v").over(w.rowsBetween(-half, half)))
    s = s.withColumn("g", F.signum(F.col("s") - F.lag("s").over(w)))
    s = s.withColumn("g", F.last(F.when(F.col("g") != 0, F.col("g")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    s = s.withColumn("turn", F.coalesce((F.col("g") != F.lag("g").over(w)).cast("int"), F.lit(0)))
    s = s.withColumn("segment", F.sum("turn").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy("series_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), (F.max("v") - F.min("v")).alias("span"), F.when(F.max("g") > 0, "stretch").otherwise("relax").alias("kind"))


def temporal_correlation(stack: DataFrame) -> DataFrame:
    """Mean Pearson r of adjacent frames, and how well time is sampled."""
    nxt = stack.select("img", (F.col("t") - 1).alias("t"), "y", "x", F.col("v").alias("w"))
    r = stack.join(nxt, ["img", "t", "y", "x"]).groupBy("img", "t").agg(F.corr("v", "w").alias("r")).where("r is not null")
    m = r.groupBy("img").agg(F.avg("r").alias("r"))
    return m.withColumn("sampling", F.when(F.col("r") > 0.9, "oversampled").when(F.col("r") > 0.7, "moderate").otherwise("sparse"))


def viscosity(df: DataFrame, diffusion: str, radius_um: float, celsius: float = 24.0) -> DataFrame:
    """Stokes-Einstein kT / (6 pi R D) in Pa s; null where D or R is not positive."""
    k = 1.380649e-23  # fixed value: Boltzmann's constant, J/K
    d = F.col(diffusion) * 1e-12
    return df.withColumn("viscosity", F.when((F.col(diffusion) > 0) & F.lit(radius_um > 0), F.lit(k * (celsius + 273.15)) / (6 * F.pi() * F.lit(radius_um * 1e-6) * d)))


def without_outlier_tracks(tracks: DataFrame, least: int = 8, low: float = 3.0, high: float = 3.0) -> DataFrame:
    """Tracks whose log mean squared step lies within fences around the median, in 1.4826 MAD, not equally far on both
    sides; with fewer than `least` tracks all stay."""
    from .common import mad

    w = W.partitionBy("track_id").orderBy("frame")
    dy, dx = F.col("y_um") - F.lag("y_um").over(w), F.col("x_um") - F.lag("x_um").over(w)
    per = tracks.withColumn("d", dy * dy + dx * dx).groupBy("track_id").agg(F.avg("d").alias("d")).where("d > 0").select("track_id", F.log("d").alias("l"))
    stats = mad(per, [], "l")
    off = ratio(F.col("l") - F.col("med"), 1.4826 * F.col("mad"))
    bad = per.crossJoin(F.broadcast(stats)).where((F.col("n") >= least) & ((off < -low) | (off > high)))
    return tracks.join(bad.select("track_id"), "track_id", "left_anti")


def step_variance_count(traces: DataFrame) -> DataFrame:
    """Intensity of one molecule from bleaching traces (series_id, t, v): variance of steps over their mean fall, and the
    number of molecules at the start."""
    w = W.partitionBy("series_id").orderBy("t")
    d = traces.withColumn("d", F.lag("v").over(w) - F.col("v"))
    s = d.groupBy("series_id").agg(F.var_samp("d").alias("var"), F.avg("d").alias("fall"), F.min_by("v", "t").alias("first"))
    nu = ratio(F.col("var"), F.abs("fall"))
    return s.select("series_id", nu.alias("unit"), ratio(F.col("first"), nu).alias("molecules"))


def shear_moduli(curve: DataFrame, radius_um: float, celsius: float = 24.0, dimensions: int = 2) -> DataFrame:
    """Storage and loss moduli of an MSD curve (tau_s, msd) by the generalised Stokes-Einstein relation: local log slope by
    central differences, edge rows dropped. The Gamma function is Lanczos' series in column arithmetic."""
    w = W.orderBy("tau_s")  # as many rows as lags
    x, y = F.log("tau_s"), F.log("msd")
    p = curve.select("tau_s", "msd", x.alias("x"), y.alias("y"))
    a, b = F.col("x") - F.lag("x").over(w), F.lead("x").over(w) - F.col("x")
    da, db = (F.col("y") - F.lag("y").over(w)) / a, (F.lead("y").over(w) - F.col("y")) / b
    s = p.withColumn("alpha", (a * db + b * da) / (a + b)).where("alpha is not null")
    k = 1.380649e-23  # fixed value: Boltzmann's constant, J/K
    msd_m2 = F.col("msd") * 1e-12 * 3 / dimensions
    g = F.lit(k * (celsius + 273.15)) / (F.pi() * F.lit(radius_um * 1e-6) * msd_m2 * _gamma(1 + F.col("alpha")))
    angle = F.pi() * F.col("alpha") / 2
    return s.select("tau_s", (1 / F.col("tau_s")).alias("omega"), "alpha", (g * F.cos(angle)).alias("g_storage"), (g * F.sin(angle)).alias("g_loss"))


def _gamma(z):
    """Gamma for arguments of at least 1/2."""
    # fixed values: Lanczos' coefficients for g = 7
    c = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]
    z = z - 1
    x = F.lit(c[0])
    for i, v in enumerate(c[1:], 1):
        x = x + v / (z + i)
    t = z + 7.5
    return F.sqrt(2 * F.pi()) * F.pow(t, z + 0.5) * F.exp(-t) * x


def transitions(curve: DataFrame, share: float = 0.12) -> DataFrame:
    """Onsets of a signal over a temperature cycle (series_id, t, temperature, v): split at the highest temperature; on each
    branch the first temperature at which the signal is `share` of its range above the baseline; and their distance."""
    top = curve.groupBy("series_id").agg(F.max_by("t", F.struct("temperature", -F.col("t"))).alias("split"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    on = curve.join(top, "series_id").where(F.col("v") >= F.col("lo") + share * (F.col("hi") - F.col("lo")))
    s = on.groupBy("series_id").agg(F.min_by("temperature", F.when(F.col("t") <= F.col("split"), F.col("t"))).alias("heating"), F.max_by("temperature", F.when(F.col("t") > F.col("split"), F.col("t"))).alias("cooling"))
    return s.withColumn("hysteresis", F.col("heating") - F.col("cooling"))
