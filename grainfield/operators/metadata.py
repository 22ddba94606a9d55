"""Text and metadata operators: name tokens, key/value texts, units, clocks, contradictions, layer queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def template_fields(path: Column, pattern: str, names: list[str]) -> list[Column]:
    """Fields of a file name by the groups of a pattern; an empty group is absent."""
    return [F.nullif(F.regexp_extract(path, pattern, k + 1), F.lit("")).alias(n) for k, n in enumerate(names)]


def key_values(text: Column, pair: str = "&", equals: str = "=") -> Column:
    return F.str_to_map(text, F.lit(pair), F.lit(equals))


def elapsed_seconds(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Seconds since each group's first time, with fractions."""
    first = df.groupBy(*keys).agg(F.min(time).alias("__t0"))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return df.join(first, keys).withColumn("elapsed_s", seconds(time) - seconds("__t0")).drop("__t0")


def nearest_key(frames: DataFrame, keyframes: DataFrame, key: str, at: str) -> DataFrame:
    """The nearest key frame of each frame, of two the earlier; key frames of one sequence are few."""
    k = keyframes.select(key, F.col(at).alias("__k"))
    d = F.abs(F.col(at) - F.col("__k"))
    return frames.join(k, key).groupBy(key, at).agg(F.min(F.struct(d.alias("d"), F.col("__k").alias("k"))).alias("n")).select(key, at, F.col("n.k").alias("key_frame"))


def carried_forward(frames: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The last value that is not null, in the order of frames."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    return frames.withColumn(value, F.last(value, ignorenulls=True).over(w))


def contradictions(df: DataFrame, rules: list[tuple[str, int, Column]], id: str) -> DataFrame:
    """A row for each rule that a record breaks, worst first."""
    broken = F.array_compact(F.array(*(F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("rule"))) for name, severity, cond in rules)))
    return df.select(id, F.explode(broken).alias("b")).select(id, "b.severity", "b.rule")


def matching_layers(layers: DataFrame, wanted: dict[str, list[str]], tags: str = "tags") -> DataFrame:
    """Layers whose tags have every wanted key with one of its values; with several candidates none is chosen."""
    cond = F.lit(True)
    for k, values in wanted.items():
        cond = cond & F.coalesce(F.col(tags)[k].isin(*values), F.lit(False))
    found = layers.where(cond)
    n = found.agg(F.count(F.lit(1)).alias("n"))
    return found.crossJoin(F.broadcast(n)).withColumn("state", F.when(F.col("n") == 1, "certain").otherwise("ambiguous")).drop("n")


def controls_comparable(pairs: DataFrame, fields: list[str], tolerance: float = 0.01) -> DataFrame:
    """Whether recorded settings of two controls agree within a tolerance; what is not recorded does not fail."""
    ok = F.lit(True)
    for f in fields:
        a, b = F.col(f"pos_{f}"), F.col(f"neg_{f}")
        ok = ok & F.coalesce(F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b)), F.lit(True))
    return pairs.withColumn("comparable", ok)


def stability(sweeps: DataFrame, keys: list[str], setting: str, value: str, baseline: float) -> DataFrame:
    """(max - min) / |value at the baseline setting| of a sweep, and a verdict."""
    s = sweeps.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("spread"), F.max(F.when(F.col(setting) == baseline, F.col(value))).alias("base"))
    r = F.when(F.col("base") != 0, F.col("spread") / F.abs("base"))
    return s.select(*keys, r.alias("relative_range"), F.when(r <= 0.1, "stable").when(r <= 0.3, "sensitive").when(r.isNotNull(), "unstable").alias("verdict"))
