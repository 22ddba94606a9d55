"""Connected components and what is built on them: image labels, density clusters, redundancy groups, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut


def components(pairs: DataFrame, name: str = "edges") -> DataFrame:
    """(node, root): the smallest node that each node of pairs (a, b) reaches. Large-star and small-star, alternating, until
    every edge is a star's; each round is written, and only a count reaches the driver."""
    edges = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), name)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        new = cut(small, name)
        roots = new.select(F.col("v").alias("u")).distinct()
        stars = new.groupBy("u").count().where("count > 1").isEmpty() and new.join(roots, "u", "left_semi").isEmpty()
        edges = new
        if stars:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def with_components(nodes: DataFrame, pairs: DataFrame, id: str) -> DataFrame:
    """nodes with `component`: the smallest id that each reaches."""
    found = components(pairs)
    return nodes.join(found.withColumnRenamed("node", id), id, "left").withColumn("component", F.coalesce("root", id)).drop("root")


def label_mask(mask: DataFrame, width: int, eight: bool = True) -> DataFrame:
    """Labels of a mask's connected components in each image, numbered by their first pixel in reading order."""
    images = mask.select("img").distinct()
    code = F.xxhash64("img").bitwiseAND((1 << 30) - 1) * (1 << 32)
    px = mask.select("img", "y", "x", (code + F.col("y") * width + F.col("x")).alias("id"))
    steps = [(0, 1), (1, 0), (1, 1), (1, -1)] if eight else [(0, 1), (1, 0)]
    moved = px.select("img", "id", F.explode(F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in steps))).alias("p"))
    pairs = moved.select("img", "id", "p.y", "p.x").join(px.withColumnRenamed("id", "other"), ["img", "y", "x"]).select(F.col("id").alias("a"), F.col("other").alias("b"))
    done = with_components(px, pairs, "id")
    roots = done.select("img", "component").distinct()
    from pyspark.sql import Window as W

    numbers = roots.withColumn("label", F.row_number().over(W.partitionBy("img").orderBy("component")))
    return done.join(numbers, ["img", "component"]).select("img", "y", "x", "label")


def near_pairs(points: DataFrame, radius: float, key: str = "cell", id: str = "id", y: str = "y_um", x: str = "x_um") -> DataFrame:
    """(key, a, b, d) with a < b of points at most a radius apart: each point looks into the 9 grid cells around its own."""
    grid = points.select(key, id, y, x, F.floor(F.col(y) / radius).alias("gy"), F.floor(F.col(x) / radius).alias("gx"))
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    look = grid.withColumn("s", steps).select(key, F.col(id).alias("a"), F.col(y).alias("ya"), F.col(x).alias("xa"), (F.col("gy") + F.col("s.i")).alias("gy"), (F.col("gx") + F.col("s.j")).alias("gx"))
    at = grid.select(key, F.col(id).alias("b"), F.col(y).alias("yb"), F.col(x).alias("xb"), "gy", "gx")
    d = F.hypot(F.col("ya") - F.col("yb"), F.col("xa") - F.col("xb"))
    return look.join(at, [key, "gy", "gx"]).where("a < b").select(key, "a", "b", d.alias("d")).where(F.col("d") <= radius)


def density_clusters(points: DataFrame, eps: float, least: int = 2, key: str = "cell", id: str = "id", y: str = "y_um", x: str = "x_um") -> DataFrame:
    """DBSCAN: points with `least` neighbours (itself included) are cores, cores within eps are one cluster, other points
    within eps of a core join the cluster with the smallest id; the rest is noise (null). ids are unique over all keys."""
    pairs = cut(near_pairs(points, eps, key, id, y, x), "near")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    n = points.select(F.col(id).alias("a")).join(both.groupBy("a").count(), "a", "left").withColumn("n", F.coalesce("count", F.lit(0)) + 1)
    core = cut(n.where(F.col("n") >= least).select("a"), "cores")
    linked = both.join(core, "a", "left_semi").join(core.withColumnRenamed("a", "b"), "b", "left_semi").where("a < b")
    of = with_components(core, linked, "a").withColumnRenamed("component", "cluster")
    border = both.join(core, "a", "left_anti").join(of.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("cluster").alias("cluster"))
    return points.join(of.unionByName(border).withColumnRenamed("a", id), id, "left")


def lineage(edges: DataFrame, start: DataFrame, child: str = "child", parent: str = "parent", most: int = 100) -> DataFrame:
    """All ancestors of the start nodes with their distance, by joining parents until none is new; cycles end."""
    found = cut(start.select(F.col(child).alias("start"), F.col(child).alias("node"), F.lit(0).alias("depth")), "lineage")
    last = found
    for depth in range(1, most + 1):
        step = last.join(edges.select(F.col(child).alias("node"), F.col(parent).alias("up")), "node").select("start", F.col("up").alias("node")).where("node is not null").distinct()
        last = cut(step.join(found, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "lineage")
        if last.isEmpty():
            return found
        found = found.unionByName(last)
    return found
