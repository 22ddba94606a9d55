"""Object tables: region statistics, partitioning, outlier flags, replicates, size laws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mad, ratio, with_group

KEY = ["img", "y", "x"]


def region_statistics(labels: DataFrame, px: DataFrame) -> DataFrame:
    """Area, intensity (population deviation), centroid, box, axes, eccentricity and orientation of each label. Axes are
    those of the ellipse with the same second moments, pixels being unit squares."""
    on = labels.select(*KEY, "label").join(px.select(*KEY, "v"), KEY)
    m = on.groupBy("img", "label").agg(
        F.count(F.lit(1)).alias("area"), F.avg("v").alias("mean"), F.median("v").alias("median"), F.stddev_pop("v").alias("std"), F.sum("v").alias("total"),
        F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"),
        (F.var_pop("y") + 1 / 12).alias("vy"), (F.var_pop("x") + 1 / 12).alias("vx"), F.covar_pop("y", "x").alias("c"),
    )
    root = F.sqrt((F.col("vy") - F.col("vx")) * (F.col("vy") - F.col("vx")) + 4 * F.col("c") * F.col("c"))
    both = F.col("vy") + F.col("vx")
    major, minor = 4 * F.sqrt((both + root) / 2), 4 * F.sqrt(F.greatest(F.lit(0.0), (both - root) / 2))
    out = m.withColumns({"major_px": major, "minor_px": minor, "orientation": 0.5 * F.atan2(2 * F.col("c"), F.col("vy") - F.col("vx"))})
    return out.withColumn("eccentricity", F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("minor_px") * F.col("minor_px") / (F.col("major_px") * F.col("major_px"))))).drop("vy", "vx", "c")


def order_parameter(regions: DataFrame) -> DataFrame:
    """|mean exp(2 i angle)| and the preferred angle of each image's objects."""
    c, s = F.avg(F.cos(2 * F.col("orientation"))), F.avg(F.sin(2 * F.col("orientation")))
    return regions.groupBy("img").agg(F.count(F.lit(1)).alias("n"), F.sqrt(c * c + s * s).alias("order"), (0.5 * F.atan2(s, c)).alias("preferred"))


def edge_touching(labels: DataFrame, height: int, width: int, border: int = 0) -> DataFrame:
    near = (F.col("y") <= border) | (F.col("x") <= border) | (F.col("y") >= height - 1 - border) | (F.col("x") >= width - 1 - border)
    return labels.groupBy("img", "label").agg(F.max(near.cast("int")).alias("edge_touching"))


def remove_small(labels: DataFrame, least: int) -> DataFrame:
    if least <= 0:
        return labels
    return labels.join(labels.groupBy("img", "label").count().where(F.col("count") >= least), ["img", "label"], "left_semi").select(*labels.columns)


def outliers(df: DataFrame, value: str, keys: list[str], k: float = 3.5, flag: str = "outlier") -> DataFrame:
    """|v - median| > k x 1.4826 MAD; none with fewer than 3 finite values or a MAD of 0; rows are flagged, never removed."""
    stats = mad(df, keys, value)
    fits = (F.col("n") >= 3) & (F.col("mad") > 0) & (F.abs(F.col(value) - F.col("med")) > k * 1.4826 * F.col("mad"))
    out = df.join(stats, keys, "left") if keys else df.crossJoin(F.broadcast(stats))
    return out.withColumn(flag, F.coalesce(fits, F.lit(False))).drop("med", "mad", "n", "__all")


def summarize_flags(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """'; '-joined names of the flags that are set."""
    return df.withColumn("qc_flags", F.concat_ws("; ", *(F.when(F.col(c), F.lit(name)) for c, name in flags.items())))


def containment_violations(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children whose rounded centroid is in no parent label; a null centroid is no violation."""
    at = children.withColumns({"__y": F.rint("centroid_row").cast("int"), "__x": F.rint("centroid_col").cast("int")})
    p = parents.where("label > 0").select("img", F.col("y").alias("__y"), F.col("x").alias("__x"), F.lit(1).alias("__in"))
    bad = F.col("__in").isNull() & F.col("centroid_row").isNotNull() & F.col("centroid_col").isNotNull()
    return at.join(p, ["img", "__y", "__x"], "left").withColumn("outside", bad).drop("__y", "__x", "__in")


def partition_field(labels: DataFrame, px: DataFrame, percentile: float = 0.10, saturation: float | None = None) -> DataFrame:
    """mean(droplets) / bulk; bulk is the 10th percentile of background, or its mean where that is not above 5 % of it;
    null where over 0.1 % of dense pixels saturate."""
    on = px.select(*KEY, "v").join(labels.select(*KEY, F.lit(1).alias("in")), KEY, "left")
    dense, bulk = F.when(F.col("in") == 1, F.col("v")), F.when(F.col("in").isNull(), F.col("v"))
    hot = F.avg((dense >= saturation).cast("double")) if saturation is not None else F.lit(0.0)
    s = on.groupBy("img").agg(F.avg(dense).alias("dense"), F.percentile(bulk, F.lit(percentile)).alias("p"), F.avg(bulk).alias("m"), hot.alias("hot"))
    ref = F.when((F.col("p") > 0) & (F.col("p") >= 0.05 * F.col("m")), F.col("p")).otherwise(F.col("m"))
    return s.select("img", "dense", ref.alias("bulk"), F.when(F.col("hot") <= 0.001, ratio(F.col("dense"), ref)).alias("k"))


def enrichment(labels: DataFrame, px: DataFrame, background: float = 0.0) -> DataFrame:
    """(dense - background) / (dilute - background) of each image, dilute being all that is not dense."""
    on = px.select(*KEY, "v").join(labels.select(*KEY, F.lit(1).alias("in")), KEY, "left").groupBy("img")
    s = on.agg(F.avg(F.when(F.col("in") == 1, F.col("v"))).alias("dense"), F.avg(F.when(F.col("in").isNull(), F.col("v"))).alias("dilute"))
    return s.withColumn("enrichment", ratio(F.col("dense") - background, F.col("dilute") - background))


def enrichment_per_object(labels: DataFrame, px: DataFrame, shell: int = 5, background: float = 0.0) -> DataFrame:
    """Mean of each object over the mean of the shell around it that is no object; the shell is one join on exploded offsets."""
    from .pixel import footprint

    offsets = F.explode(F.array(*(F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for y, x in footprint("disk", shell))))
    around = labels.select("img", "label", "y", "x", offsets.alias("o")).select("img", "label", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).distinct()
    ring = around.join(labels.select(*KEY), KEY, "left_anti").join(px.select(*KEY, "v"), KEY).groupBy("img", "label").agg(F.avg("v").alias("shell"))
    dense = labels.join(px.select(*KEY, "v"), KEY).groupBy("img", "label").agg(F.avg("v").alias("dense"))
    return dense.join(ring, ["img", "label"], "left").withColumn("enrichment", ratio(F.col("dense") - background, F.col("shell") - background))


def field_summary(labels: DataFrame, px: DataFrame, microns: float) -> DataFrame:
    """Objects, area fraction, radii and density of each field."""
    field = px.groupBy("img").agg(F.count(F.lit(1)).alias("pixels"))
    objects = labels.groupBy("img", "label").agg(F.count(F.lit(1)).alias("a")).withColumn("r", F.sqrt(F.col("a") * microns * microns / F.pi()))
    s = objects.groupBy("img").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("area"), F.avg("r").alias("mean_radius_um"), F.median("r").alias("median_radius_um"), F.stddev_pop("r").alias("std_radius_um"))
    return field.join(s, "img", "left").select("img", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("area", F.lit(0)) / F.col("pixels")).alias("area_fraction"), "mean_radius_um", "median_radius_um", "std_radius_um", (F.coalesce("n", F.lit(0)) / (F.col("pixels") * microns * microns)).alias("density_per_um2"))


def object_ratios(labels: DataFrame, px: DataFrame, num: str, den: str, limit: float) -> DataFrame:
    """Ratio of means, mean of ratios, and share of ratios over a limit, for each label."""
    on = labels.join(px, KEY)
    r = ratio(F.col(num), F.col(den))
    return on.groupBy("img", "label").agg(ratio(F.sum(num), F.sum(den)).alias("ratio_of_means"), F.avg(r).alias("mean_of_ratios"), F.avg((r > limit).cast("double")).alias("over"))


def occupancy(objects: DataFrame, cells: DataFrame, microns: float) -> DataFrame:
    """Area share, count and density of objects in each cell; cells without objects stay."""
    area = cells.groupBy("img", F.col("label").alias("cell")).agg(F.count(F.lit(1)).alias("cell_px"))
    inside = objects.join(cells.select(*KEY, F.col("label").alias("cell")), KEY).groupBy("img", "cell").agg(F.count(F.lit(1)).alias("px"), F.countDistinct("label").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return area.join(inside, ["img", "cell"], "left").select("img", "cell", (F.coalesce("px", F.lit(0)) / F.col("cell_px")).alias("fraction"), n.alias("n"), (n / (F.col("cell_px") * microns * microns)).alias("density"))


def partial_volume(hi: DataFrame, factor: int) -> DataFrame:
    """Share of each native pixel inside a high-resolution object."""
    native = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return hi.groupBy("img", "label", native("y"), native("x")).agg((F.count(F.lit(1)) / (factor * factor)).alias("w"))


def weighted_statistics(weights: DataFrame, px: DataFrame, background: float = 0.0) -> DataFrame:
    """Weighted mean and deviation, Kish's effective n and the background-subtracted sum of each label."""
    on = weights.join(px.select(*KEY, "v"), KEY)
    w, v = F.col("w"), F.col("v")
    s = on.groupBy("img", "label").agg(F.sum(w).alias("sw"), F.sum(w * w).alias("sww"), F.sum(w * v).alias("swv"), F.sum(w * v * v).alias("swvv"))
    mean = F.col("swv") / F.col("sw")
    var = F.greatest(F.lit(0.0), F.col("swvv") / F.col("sw") - mean * mean)
    return s.select("img", "label", (F.col("sw") * F.col("sw") / F.col("sww")).alias("n_eff"), mean.alias("mean"), F.sqrt(var).alias("std"), (F.col("swv") - background * F.col("sw")).alias("total"))


def size_bias(df: DataFrame, radius: str, psf: float, contrast: float = 1.0) -> DataFrame:
    """-tanh(0.75 psf / r) x contrast, and whether the radius is below 1.5 psf."""
    return df.withColumns({"bias": -F.tanh(0.75 * psf / F.col(radius)) * contrast, "sub_resolution": F.col(radius) <= 1.5 * psf})


def box_counts(mask: DataFrame, sizes: list[int]) -> DataFrame:
    """Occupied boxes of each size: sizes are exploded, boxes made distinct map-side."""
    s = mask.withColumn("s", F.explode(F.array(*(F.lit(k) for k in sizes))))
    return s.select("img", "s", F.floor(F.col("y") / F.col("s")).alias("by"), F.floor(F.col("x") / F.col("s")).alias("bx")).distinct().groupBy("img", "s").agg(F.count(F.lit(1)).alias("boxes"))


def fractal_dimension(mask: DataFrame, sizes: list[int]) -> DataFrame:
    return box_counts(mask, sizes).groupBy("img").agg(F.regr_slope(F.log("boxes"), F.log(1 / F.col("s"))).alias("dimension"))


def entropy(px: DataFrame, keys: list[str], bins: int = 256, value: str = "v") -> DataFrame:
    """Shannon entropy (bits) of a min-max histogram; 0 for a constant group."""
    on = with_group(px, keys, lo=F.min(value), hi=F.max(value))
    b = F.least(F.lit(bins - 1), F.coalesce(F.floor(ratio((F.col(value) - F.col("lo")) * bins, F.col("hi") - F.col("lo"))), F.lit(0)))
    h = on.groupBy(*keys, b.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    return h.groupBy(*keys).agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("entropy"))


def kurtosis(px: DataFrame, value: str = "v") -> DataFrame:
    """Excess kurtosis (population) of values within 1.5 interquartile ranges; null for a deviation below 2."""
    from .pixel import iqr_filtered

    return iqr_filtered(px, ["img"], value).groupBy("img").agg(F.when(F.stddev_pop(value) >= 2, F.kurtosis(value)).alias("kurtosis"))


def glcm(px: DataFrame, dy: int, dx: int, levels: int, value: str = "v") -> DataFrame:
    """Contrast, dissimilarity, homogeneity, second moment, energy of the symmetric co-occurrence at one offset."""
    on = with_group(px, ["img"], lo=F.min(value), hi=F.max(value))
    q = on.select(*KEY, F.least(F.lit(levels - 1), F.coalesce(F.floor(ratio((F.col(value) - F.col("lo")) * levels, F.col("hi") - F.col("lo"))), F.lit(0))).alias("g"))
    other = q.select("img", (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col("g").alias("h"))
    pair = q.join(other, KEY)
    both = pair.select("img", "g", "h").unionByName(pair.select("img", F.col("h").alias("g"), F.col("g").alias("h")))
    p = with_group(both.groupBy("img", "g", "h").agg(F.count(F.lit(1)).alias("c")), ["img"], n=F.sum("c")).withColumn("p", F.col("c") / F.col("n"))
    d = F.col("g") - F.col("h")
    asm = F.sum(F.col("p") * F.col("p"))
    return p.groupBy("img").agg(F.sum(F.col("p") * d * d).alias("contrast"), F.sum(F.col("p") * F.abs(d)).alias("dissimilarity"), F.sum(F.col("p") / (1 + d * d)).alias("homogeneity"), asm.alias("asm"), F.sqrt(asm).alias("energy"))


def melt(df: DataFrame, object_type: str, id_col: str, units: dict[str, str], text: list[str] = ()) -> DataFrame:
    """Long form of the numeric columns: one row for each object and measurement that is not null."""
    numeric = [f.name for f in df.schema.fields if f.name not in (id_col, *text) and f.dataType.typeName() in ("double", "float", "integer", "long", "short")]
    long = df.select(F.col(id_col).cast("string").alias("object_id"), *text, *(F.col(c).cast("double").alias(c) for c in numeric)).unpivot(["object_id", *text], numeric, "measurement", "value")
    unit = F.create_map(*(F.lit(x) for kv in units.items() for x in kv))[F.col("measurement")] if units else F.lit(None).cast("string")
    return long.where(F.col("value").isNotNull()).select(F.lit(object_type).alias("object_type"), *long.columns, F.coalesce(unit, F.lit("")).alias("units"))


def to_replicates(long: DataFrame, measurement: str, condition: str, replicate: str, value: str = "value", how: str = "mean") -> DataFrame:
    """One value for each condition and replicate; text that is no number is left out."""
    agg = {"mean": F.avg, "median": F.median, "sum": F.sum, "count": F.count}[how]
    v = F.expr(f"try_cast({value} as double)")
    return long.where(F.col("measurement") == measurement).withColumn("__v", v).where("__v is not null").groupBy(condition, replicate).agg(agg("__v").alias("value"), F.count(F.lit(1)).alias("n"))


def dose_response(reps: DataFrame, dose: str) -> DataFrame:
    return reps.groupBy(dose).agg(F.avg("value").alias("mean"), F.stddev("value").alias("std"), F.count(F.lit(1)).alias("n"), (F.stddev("value") / F.sqrt(F.count(F.lit(1)))).alias("sem"))


def lever_rule(samples: DataFrame, keys: list[str], c: str, phi: str) -> DataFrame:
    """Least squares phi ~ c where phi > 0: Csat = -b / m, Cdense = Csat + 1 / m, usable if R2 > 0.5."""
    s = samples.where(F.col(phi) > 0).groupBy(*keys).agg(F.regr_slope(phi, c).alias("m"), F.regr_intercept(phi, c).alias("b"), F.regr_r2(phi, c).alias("r2"))
    sat = ratio(-F.col("b"), F.col("m"))
    return s.select(*keys, sat.alias("c_sat"), (sat + ratio(F.lit(1.0), F.col("m"))).alias("c_dense"), "r2", (F.col("r2") > 0.5).alias("usable"))


def size_mle(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Lognormal and exponential maximum likelihood, with Akaike's criterion of each and the better one; 20 sizes at least."""
    x = df.where(F.col(value) > 0)
    s = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.log(value)).alias("mu"), F.stddev_pop(F.log(value)).alias("sigma"), F.avg(value).alias("mean")).where("n >= 20 and sigma > 0")
    n, mu, sigma = F.col("n"), F.col("mu"), F.col("sigma")
    log_normal = 4 + 2 * n * (mu + F.log(sigma) + 0.5 * F.log(2 * F.pi()) + 0.5)
    exponential = 2 + 2 * n * (F.log("mean") + 1)
    return s.select(*keys, "n", "mu", "sigma", (1 / F.col("mean")).alias("rate"), log_normal.alias("aic_lognormal"), exponential.alias("aic_exponential"), F.when(log_normal <= exponential, "lognormal").otherwise("exponential").alias("best"))


def feature_card(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Histogram of one column over its range; the last bin is closed. Empty bins have a count of 0."""
    r = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    b = F.least(F.lit(bins - 1), F.coalesce(F.floor(ratio((F.col(value) - F.col("lo")) * bins, F.col("hi") - F.col("lo"))), F.lit(0))).cast("int")
    counts = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(r)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = r.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi")
    return edges.join(counts, "bin", "left").select("bin", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins).alias("edge"), F.coalesce("n", F.lit(0)).alias("n"))


def cohort(df: DataFrame, id: str, value: str, lo: float, hi: float, last: bool = False) -> DataFrame:
    """Members of one bin; only the last bin is closed."""
    upper = F.col(value) <= hi if last else F.col(value) < hi
    return df.where((F.col(value) >= lo) & upper).select(id, value)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """|Pearson| of each pair of columns, in one aggregate; constant columns give null."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    one = df.agg(*(F.abs(F.corr(a, b)).alias(f"{a}|{b}") for a, b in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs))).alias("p")).select("p.*")


def intensity_histogram(px: DataFrame, bins: int = 256, white_noise: float = 0.0) -> DataFrame:
    """Density on [0, p99.9] after the offset is removed; negatives go; fewer than 100 pixels give nothing."""
    v = px.select("img", (F.col("v") - white_noise).alias("v")).where("v >= 0")
    s = v.groupBy("img").agg(F.percentile("v", F.lit(0.999)).alias("top"), F.count(F.lit(1)).alias("all")).where("all >= 100 and top > 0")
    w = F.col("top") / bins
    on = v.join(s, "img").where(F.col("v") <= F.col("top"))
    h = on.groupBy("img", "top", F.least(F.lit(bins - 1), F.floor(F.col("v") / w)).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    return with_group(h, ["img"], n=F.sum("c")).select("img", "bin", (F.col("c") / (F.col("n") * w)).alias("density"))


def global_labels(df: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Running labels over groups: a group's labels follow the largest ones of the groups before it. Groups' maxima are one
    small table; rows are never ordered."""
    tops = df.groupBy(*keys).agg(F.max(label).alias("top"))
    before = F.coalesce(F.sum("top").over(W.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.join(tops.withColumn("before", before), keys).withColumn("global_label", (F.col(label) + F.col("before")).cast("long")).drop("top", "before")


def best_setting(results: DataFrame, positives: str, rate: str, most: float, score: Column, name: str) -> DataFrame:
    """Among settings with positives and a false-positive rate within the limit, the one with the highest score."""
    return results.where((F.col(positives) > 0) & (F.col(rate) <= most)).agg(F.max_by(name, score).alias(name))


def expand_labels(labels: DataFrame, distance: int, height: int, width: int) -> DataFrame:
    """Labels grown to a distance without merging: each free pixel takes the nearest label, of equal ones the smaller."""
    from .pixel import footprint

    shape = F.explode(F.array(*(F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx"), F.lit(y * y + x * x).alias("d")) for y, x in footprint("disk", distance))))
    near = labels.select("img", "label", "y", "x", shape.alias("o")).select("img", "label", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.col("o.d").alias("d"))
    near = near.where((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < height) & (F.col("x") < width))
    return near.groupBy(*KEY).agg(F.min(F.struct("d", "label")).alias("n")).select(*KEY, F.col("n.label").alias("label"))


def transfected(labels: DataFrame, px: DataFrame, least: float = 3.0) -> DataFrame:
    """Cells with (mean - p25 of the frame) / deviation of the background of at least `least`, and each frame's efficiency."""
    on = px.select(*KEY, "v").join(labels.select(*KEY, "label"), KEY, "left")
    frame = on.groupBy("img").agg(F.percentile("v", F.lit(0.25)).alias("p25"), F.stddev_pop(F.when(F.col("label").isNull(), F.col("v"))).alias("noise"))
    cells = on.where("label is not null").groupBy("img", "label").agg(F.avg("v").alias("m")).join(frame, "img")
    scored = cells.select("img", "label", ratio(F.col("m") - F.col("p25"), F.col("noise")).alias("score")).withColumn("kept", F.coalesce(F.col("score") >= least, F.lit(False)))
    return with_group(scored, ["img"], efficiency=F.avg(F.col("kept").cast("double")))


def relabel_by_track(labels: DataFrame, linked: DataFrame) -> DataFrame:
    """label = track + 1 by frame and object; unmatched objects become 0."""
    of = linked.select("img", F.col("frame").alias("t"), F.col("object_id").alias("label"), "track_id")
    return labels.join(of, ["img", "t", "label"], "left").select("img", "t", "y", "x", F.coalesce(F.col("track_id") + 1, F.lit(0)).alias("label"))


def field_trajectories(labels: DataFrame, stack: DataFrame, microns: float = 1.0) -> DataFrame:
    """Per frame: objects, mean and median radius, area fraction, dense and dilute means."""
    field = stack.join(labels.select("img", "t", "y", "x", F.lit(1).alias("in")), ["img", "t", "y", "x"], "left").groupBy("img", "t").agg(
        F.avg(F.when(F.col("in") == 1, F.col("v"))).alias("dense"), F.avg(F.when(F.col("in").isNull(), F.col("v"))).alias("dilute"), (F.count("in") / F.count(F.lit(1))).alias("area_fraction")
    )
    radii = labels.groupBy("img", "t", "label").agg(F.sqrt(F.count(F.lit(1)) * microns * microns / F.pi()).alias("r"))
    r = radii.groupBy("img", "t").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_radius"), F.median("r").alias("median_radius"))
    return field.join(r, ["img", "t"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def volumes(labels: DataFrame, microns: float, step: float) -> DataFrame:
    """Volume, slices and extent of 3-D labels; without a step there is no volume."""
    s = labels.groupBy("img", "label").agg(F.count(F.lit(1)).alias("voxels"), F.countDistinct("t").alias("slices"), ((F.max("t") - F.min("t") + 1) * step).alias("height_um"))
    return s.withColumn("volume_um3", F.when(F.lit(step > 0), F.col("voxels") * microns * microns * step))


def texture(labels: DataFrame, px: DataFrame) -> DataFrame:
    """Coefficient of variation, roughness (deviation after min-max) and contrast of each label."""
    on = labels.join(px.select(*KEY, "v"), KEY).groupBy("img", "label")
    s = on.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return s.select("img", "label", ratio(F.col("s"), F.col("m")).alias("cov"), ratio(F.col("s"), F.col("hi") - F.col("lo")).alias("roughness"), ratio(F.col("hi") - F.col("lo"), F.col("hi") + F.col("lo")).alias("contrast"))
