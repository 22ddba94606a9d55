"""Imaging relations derived from the test tables, as Spark relations and as the same relations in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 32


class Relations:
    """pixels, stack, mask, labels, tracks, points, objects and series of one set of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def pixels(self) -> DataFrame:
        """img, y, x, v1, v2: sums of integers, so independent of order."""
        y, x = (F.col("l_orderkey") % SIDE).cast("int").alias("y"), (F.col("l_partkey") % SIDE).cast("int").alias("x")
        return self.table("lineitem").groupBy(F.col("l_returnflag").alias("img"), y, x).agg(F.sum("l_quantity").alias("v1"), F.sum(F.col("l_linenumber").cast("double")).alias("v2"))

    def channel(self, c: str) -> DataFrame:
        return self.pixels.select("img", "y", "x", F.col(c).alias("v"))

    @cached_property
    def stack(self) -> DataFrame:
        """img, t, y, x, v: frames 0 to 6 on a coarser grid."""
        y, x = (F.col("l_orderkey") % 8).cast("int").alias("y"), (F.col("l_partkey") % 8).cast("int").alias("x")
        return self.table("lineitem").groupBy(F.col("l_returnflag").alias("img"), (F.col("l_linenumber") - 1).cast("int").alias("t"), y, x).agg(F.sum("l_quantity").alias("v"))

    def mask(self, c: str, k: float = 1.0) -> DataFrame:
        """Pixels of a channel above k times their image's mean."""
        m = self.pixels.groupBy("img").agg(F.avg(c).alias("m"))
        return self.pixels.join(m, "img").where(F.col(c) > k * F.col("m")).select("img", "y", "x")

    def labels(self, c: str, k: float = 1.0, side: int = 8) -> DataFrame:
        """The mask in blocks of side x side, numbered by row and column."""
        n = SIDE // side
        label = (F.floor(F.col("y") / side) * n + F.floor(F.col("x") / side) + 1).cast("int")
        return self.mask(c, k).withColumn("label", label)

    @cached_property
    def frame_labels(self) -> DataFrame:
        """img, t, y, x, label: blocks of the bright pixels of each frame, alternately of 4 and 2 pixels."""
        m = self.stack.groupBy("img", "t").agg(F.avg("v").alias("m"))
        side = F.when(F.col("t") % 2 == 0, 4).otherwise(2)
        label = (F.floor(F.col("y") / side) * 4 + F.floor(F.col("x") / side) + 1).cast("int")
        return self.stack.join(m, ["img", "t"]).where("v > m").select("img", "t", "y", "x", label.alias("label"))

    @cached_property
    def tracks(self) -> DataFrame:
        from pyspark.sql import Window as W

        frame = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
        y = F.get_json_object("props", "$.k").cast("double")
        return self.table("events").select(F.col("user_id").alias("track_id"), frame.alias("frame"), y.alias("y_um"), F.col("value").alias("x_um"), F.col("value").alias("area_um2"), "event_type")

    @cached_property
    def points(self) -> DataFrame:
        e = F.col("embedding")
        return self.table("embeddings").select(F.col("label").alias("cell"), F.col("vec_id").alias("id"), (e[0].cast("double") * 100).alias("y_um"), (e[1].cast("double") * 100).alias("x_um"))

    @cached_property
    def areas(self) -> DataFrame:
        """cell, area: of the points' box."""
        return self.points.groupBy("cell").agg(((F.max("y_um") - F.min("y_um")) * (F.max("x_um") - F.min("x_um"))).alias("area"))

    @cached_property
    def objects(self) -> DataFrame:
        o, c = self.table("orders"), self.table("customer")
        return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("label"), F.col("o_custkey").alias("parent"), F.col("o_totalprice").alias("area"), F.col("o_orderpriority").alias("condition"), F.col("c_nationkey").alias("replicate"))

    @cached_property
    def series(self) -> DataFrame:
        """series_id, t, v, ref: values and counts of events by kind and hour of the first ones."""
        e = self.table("events").select(F.col("event_type").alias("series_id"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("h"), F.floor("value").cast("double").alias("v"))
        g = e.groupBy("series_id", "h").agg(F.sum("v").alias("v"), F.count(F.lit(1)).cast("double").alias("ref"))
        from pyspark.sql import Window as W

        return g.select("series_id", F.row_number().over(W.partitionBy("series_id").orderBy("h")).alias("t"), "v", "ref")


def _labels(name: str, c: str, k: float, side: int = 8) -> str:
    n = SIDE // side
    return f"""m_{name} AS (SELECT img, avg({c}) m FROM pixels GROUP BY img),
mask_{name} AS (SELECT p.img, p.y, p.x FROM pixels p JOIN m_{name} USING (img) WHERE p.{c} > {k} * m),
labels_{name} AS (SELECT img, y, x, CAST(floor(y / {side}) * {n} + floor(x / {side}) + 1 AS INT) AS label FROM mask_{name})"""


#: The same relations in SQL; only those that a query names are put before it.
SQL = {
    "pixels": f"pixels AS (SELECT l_returnflag img, CAST(l_orderkey % {SIDE} AS INT) y, CAST(l_partkey % {SIDE} AS INT) x, SUM(l_quantity) v1, SUM(CAST(l_linenumber AS DOUBLE)) v2 FROM lineitem GROUP BY 1, 2, 3)",
    "stack": "stack AS (SELECT l_returnflag img, CAST(l_linenumber - 1 AS INT) t, CAST(l_orderkey % 8 AS INT) y, CAST(l_partkey % 8 AS INT) x, SUM(l_quantity) v FROM lineitem GROUP BY 1, 2, 3, 4)",
    "labels_1": _labels("1", "v1", 1.0),
    "labels_2": _labels("2", "v2", 1.0),
    "labels_big": _labels("big", "v1", 0.8, 16),
    "labels_few": _labels("few", "v1", 1.4, 4),
    "frame_labels": "frame_m AS (SELECT img, t, avg(v) m FROM stack GROUP BY 1, 2), frame_labels AS (SELECT img, t, y, x, CAST(floor(y / (CASE WHEN t % 2 = 0 THEN 4 ELSE 2 END)) * 4 + floor(x / (CASE WHEN t % 2 = 0 THEN 4 ELSE 2 END)) + 1 AS INT) AS label FROM stack JOIN frame_m USING (img, t) WHERE v > m)",
    "tracks": "tracks AS (SELECT user_id track_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) frame, CAST(json_extract_string(props, '$.k') AS DOUBLE) y_um, value x_um, value area_um2, event_type FROM events)",
    "points": "points AS (SELECT label cell, vec_id id, CAST(embedding[1] AS DOUBLE) * 100 y_um, CAST(embedding[2] AS DOUBLE) * 100 x_um FROM embeddings)",
    "areas": "areas AS (SELECT cell, (max(y_um) - min(y_um)) * (max(x_um) - min(x_um)) area FROM points GROUP BY cell)",
    "objects": "objects AS (SELECT o_orderkey label, o_custkey parent, o_totalprice area, o_orderpriority condition, c_nationkey replicate FROM orders JOIN customer ON o_custkey = c_custkey)",
    "series": "series_h AS (SELECT event_type series_id, floor(epoch(ts) / 3600) h, sum(CAST(floor(value) AS DOUBLE)) v, CAST(count(*) AS DOUBLE) ref FROM events GROUP BY 1, 2), series AS (SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY h) AS INT) t, v, ref FROM series_h)",
}
_NEEDS = {"labels_1": ["pixels"], "labels_2": ["pixels"], "labels_big": ["pixels"], "labels_few": ["pixels"], "frame_labels": ["stack"], "areas": ["points"]}


def with_relations(query: str) -> str:
    """The query with the relations that it names before it."""
    import re

    named = [k for k in SQL if re.search(rf"\b{k}\b|\b{k.replace('labels_', 'mask_')}\b", query)]
    need = [k for k in SQL if k in named or any(k in _NEEDS.get(x, ()) for x in named)]
    text = ",\n".join(SQL[k] for k in need)
    if not text:
        return query
    query = query.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if query.startswith(start):
            return f"{start}{text},\n{query.removeprefix(start)}"
    return f"WITH {text}\n{query}"
