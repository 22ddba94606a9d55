"""Records about images and tables: metadata of several sources, the consolidated long table, localisation files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import objects, qc

CORE = ["object_type", "object_id", "measurement", "value", "units"]
PROVENANCE = ["operation", "software_version"]
#: Files by suffix, in this order; the first that fits names the kind.
KINDS = (("table", r"\.(csv|tsv|parquet)$"), ("image", r"\.(tif|tiff|png|czi|ims|nd2)$"), ("manifest", r"manifest\.json$"), ("settings", r"\.(json|yaml|yml)$"), ("page", r"\.html?$"))


def merged_metadata(offers: DataFrame, surfaced: tuple[str, ...] = ("pixel_size_um",)) -> DataFrame:
    """Per image and field the value of the source of highest precedence (the lowest `priority`, then name), that source, and
    the other values that disagree. offers: image, field, source, priority, value; null and blank values are no offer."""
    real = offers.where(F.col("value").isNotNull() & (F.trim("value") != ""))
    best = F.min(F.struct("priority", "source", "value")).alias("b")
    s = real.groupBy("image", "field").agg(best, F.collect_set(F.struct("priority", "source", "value")).alias("all"))
    others = F.transform(F.sort_array(F.filter("all", lambda o: o["value"] != F.col("b.value"))), lambda o: F.concat(o["source"], F.lit("="), o["value"]))
    out = s.select("image", "field", F.col("b.value").alias("value"), F.col("b.source").alias("source"), others.alias("o"))
    conflict = F.size("o") > 0
    return out.select("image", "field", "value", "source", F.size("o").alias("n_conflicts"), F.array_join("o", "; ").alias("conflicts"), (conflict & F.col("field").isin(*surfaced)).alias("surfaced"))


def frame_interval(df: DataFrame, nominal: str, derived: str, tolerance: float = 0.15) -> DataFrame:
    """The interval that timestamps give, else the declared one; inconsistent where both are there and differ by more than a
    share of the derived one. Values that are not positive are missing."""
    positive = lambda c: F.when((F.col(c) > 0) & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    n, d = positive(nominal), positive(derived)
    source = F.when(d.isNotNull(), "timestamps").when(n.isNotNull(), "declared")
    return df.withColumns({"interval_s": F.coalesce(d, n), "interval_source": source, "inconsistent": F.coalesce(F.abs(d - n) / d > tolerance, F.lit(False))})


def compared_metadata(values: DataFrame, critical: tuple[str, ...]) -> DataFrame:
    """Per field whether images differ: number of known values, distinct ones, and the severity of a difference. values:
    image, field, value; null is unknown and differs from nothing."""
    s = values.groupBy("field").agg(F.count("value").alias("n_known"), F.countDistinct("value").alias("n_values"))
    return s.withColumns({"differs": F.col("n_values") > 1, "severity": F.when(F.col("field").isin(*critical), "critical").otherwise("info")})


def classified_files(files: DataFrame, path: str, kinds=KINDS) -> DataFrame:
    """Kind and stem of each file by the first pattern that fits its lower-cased name."""
    name = F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))
    kind = F.lit(None).cast("string")
    for k, pattern in reversed(kinds):
        kind = F.when(name.rlike(pattern), k).otherwise(kind)
    return files.withColumns({"kind": F.coalesce(kind, F.lit("other")), "stem": F.regexp_replace(name, r"\.[^.]*$", "")})


def long_columns(conditions: list[str], provenance: list[str] = PROVENANCE) -> list[str]:
    """The fixed order of the consolidated long table's columns."""
    return ["image_stem", *conditions, *CORE, *provenance, "qc_flags", "reliability", "reliability_reasons"]


def long_table(
    wide: DataFrame,
    object_type: str,
    id: str,
    image: str,
    sheet: DataFrame,
    conditions: list[str],
    units: dict[str, str],
    provenance: dict[str, str],
    scored: tuple[str, ...] = (),
    factors: dict[str, float | None] | None = None,
    k: float = 3.5,
) -> DataFrame:
    """The consolidated long table: one row for each image, object and measurement, with the sample's conditions (blank where
    the sheet has none), provenance, the object's quality flags and, of scored measurements, a reliability grade.

    Flags mark measurements k x 1.4826 MAD away from their image's median; a flagged object is half as reliable. Rows are
    never removed. sheet has a row for each image stem (of several, the first by its conditions)."""
    numeric = [c for c, kind in wide.dtypes if c not in (id, image) and kind in ("double", "float", "int", "bigint", "smallint")]
    flagged = wide
    for c in numeric:
        flagged = objects.outliers(flagged, c, [image], k, f"__{c}")
    flagged = objects.summarize_flags(flagged, {f"__{c}": f"{c}_outlier" for c in numeric}).select(image, id, "qc_flags", *numeric)
    long = objects.melt(flagged, object_type, id, units, [image, "qc_flags"]).withColumnRenamed(image, "image_stem")
    one = sheet.groupBy("image_stem").agg(F.min(F.struct(*conditions)).alias("c")).select("image_stem", *(F.col(f"c.{c}").alias(c) for c in conditions))
    out = long.join(one, "image_stem", "left").withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in conditions})
    out = out.withColumns({c: F.lit(v) for c, v in provenance.items()})
    grade, reasons = F.lit(""), F.lit("")
    if factors is not None:
        score = F.lit(1.0)
        for v in factors.values():
            score = score * (1.0 if v is None else v)
        score = score * F.when(F.col("qc_flags") != "", 0.5).otherwise(1.0)
        missing = [name for name, v in factors.items() if v is None]
        g = qc.grade(score, F.lit(bool(missing)))
        why = F.concat_ws("; ", F.when(F.col("qc_flags") != "", "object flagged"), *(F.lit(f"{m} not assessed") for m in missing))
        grade, reasons = F.when(F.col("measurement").isin(*scored), g).otherwise(""), F.when(F.col("measurement").isin(*scored), why).otherwise("")
    return out.withColumns({"reliability": grade, "reliability_reasons": reasons}).select(*long_columns(conditions, list(provenance)))


def localizations(spark: SparkSession, path: str, pixel_um: float | None = None) -> DataFrame:
    """A localisation table (CSV) as frame, y_um, x_um: the unit is in the header (nm, um or px); tables in pixels, or without
    a unit, need a pixel size. Only the header is read on the driver."""
    table = spark.read.option("header", True).csv(path)
    found = {}
    for c in table.columns:
        m = re.fullmatch(r"\s*(x|y|frame)\b\s*[\[(]?\s*(nm|um|µm|px|pix|pixels?)?\s*[\])]?\s*", c, re.I)
        if m:
            found[m[1].lower()] = (c, (m[2] or "").lower())
    if "x" not in found or "y" not in found:
        raise ValueError("no x and y columns")
    scale = {"nm": 1e-3, "um": 1.0, "µm": 1.0}

    def microns(axis: str) -> Column:
        name, unit = found[axis]
        if unit not in scale and pixel_um is None:
            raise ValueError(f"column {name!r} names no physical unit, and there is no pixel size")
        return (F.col(f"`{name}`").cast("double") * (scale[unit] if unit in scale else pixel_um)).alias(f"{axis}_um")

    frame = F.col(f"`{found['frame'][0]}`").cast("long") if "frame" in found else F.lit(None).cast("long")
    return table.select(frame.alias("frame"), microns("y"), microns("x"))


def worst_verdict(signals: DataFrame, keys: list[str], requirements: dict[str, tuple[float, float]]) -> DataFrame:
    """The worst of the required signals: each is ok from its first bound on, warn from its second, else block; a missing one
    blocks."""
    rank = F.lit(0)
    for name, (fine, poor) in requirements.items():
        rank = F.greatest(rank, F.when(F.col(name) >= fine, 0).when(F.col(name) >= poor, 1).otherwise(2))
    return signals.select(*keys, F.get(F.array(F.lit("ok"), F.lit("warn"), F.lit("block")), rank).alias("verdict"))


def evenly_sampled(frames: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """About n rows of each group, evenly spaced from its first to its last one: a sampling operator."""
    at = F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
    size = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    numbered = frames.withColumn("__k", at).join(size, keys)
    step = (F.col("__n") - 1) / F.lit(float(max(1, n - 1)))
    place = F.when(F.col("__n") <= n, True).otherwise(F.floor(F.ceil((F.col("__k") - 0.5) / step) * step + 0.5) == F.col("__k"))
    return numbered.where(place).drop("__k", "__n")
