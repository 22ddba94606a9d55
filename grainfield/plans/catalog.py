"""All queries of the engine and their SQL, by name.

A query's doubles are rounded to 6 digits on both sides; in the SQL texts R(..) stands for that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coloc, graph, identity, metadata, objects, pixel, planes, qc, spatial, tracks
from ..sources.views import SIDE, Relations, with_relations

_QUERIES: dict[str, Callable[[Relations], DataFrame]] = {}
_SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 digits, without a negative zero."""
    return df.select(*((F.round(F.col(f"`{c}`"), 6) + 0.0).alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in df.dtypes))


def _closing(text: str, at: int) -> int:
    depth = 0
    for k in range(at, len(text)):
        depth += (text[k] == "(") - (text[k] == ")")
        if not depth:
            return k
    raise ValueError(text)


def expanded(sql: str) -> str:
    """R(expression) as the rounded double."""
    import re

    while m := re.search(r"\bR\(", sql):
        end = _closing(sql, m.end() - 1)
        sql = f"{sql[: m.start()]}(round(CAST({sql[m.end() : end]} AS DOUBLE), 6) + CAST(0 AS DOUBLE)){sql[end + 1 :]}"
    return with_relations(sql)


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def add(f: Callable[[Relations], DataFrame]):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = expanded(sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: rounded(f(Relations(spark, sf_dir)))) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- colocalisation

query(
    "coloc_metrics",
    """SELECT p.img, count(*) n, R(round(corr(v1, v2), 4)) pearson, R(round(sum(v1*v2) / sqrt(sum(v1*v1) * sum(v2*v2)), 4)) overlap, R(round(sum(v1*v2) / sum(v1*v1), 4)) k1,
R(round(sum(v1*v2) / sum(v2*v2), 4)) k2, R(round(avg(CASE WHEN (v1 - ma) * (v2 - mb) > 0 THEN 1.0 ELSE 0.0 END) - 0.5, 4)) icq
FROM pixels p JOIN (SELECT img, avg(v1) ma, avg(v2) mb FROM pixels GROUP BY img) m ON p.img = m.img GROUP BY p.img""",
)(lambda r: coloc.pixel_coefficients(r.pixels))
query(
    "coloc_icq_test",
    """WITH d AS (SELECT p.img, (v1 - ma) * (v2 - mb) d FROM pixels p JOIN (SELECT img, avg(v1) ma, avg(v2) mb FROM pixels GROUP BY img) m ON p.img = m.img),
s AS (SELECT img, CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS DOUBLE) plus, CAST(sum(CASE WHEN d <> 0 THEN 1 ELSE 0 END) AS DOUBLE) moved, count(*) n FROM d GROUP BY img)
SELECT img, R(plus / n - 0.5) icq, R((plus - moved / 2) / (sqrt(moved) / 2)) z FROM s""",
)(lambda r: coloc.icq_test(r.pixels))
query(
    "coloc_intensity_products",
    "SELECT p.img, y, x, R(v1) v1, R(v2) v2, R((v1 - ma) * (v2 - mb)) product FROM pixels p JOIN (SELECT img, avg(v1) ma, avg(v2) mb FROM pixels GROUP BY img) m ON p.img = m.img",
)(lambda r: coloc.intensity_correlation(r.pixels))
query(
    "coloc_spearman",
    """WITH k AS (SELECT img, rank() OVER (PARTITION BY img ORDER BY v1) + (count(*) OVER (PARTITION BY img, v1) - 1) / 2.0 a, rank() OVER (PARTITION BY img ORDER BY v2) + (count(*) OVER (PARTITION BY img, v2) - 1) / 2.0 b FROM pixels)
SELECT img, R(corr(CAST(a AS DOUBLE), CAST(b AS DOUBLE))) rho FROM k GROUP BY img""",
)(lambda r: coloc.spearman(r.pixels, "img", "v1", "v2"))
query(
    "coloc_kendall",
    """WITH q AS (SELECT p.img, sign(p.v1 - q.v1) a, sign(p.v2 - q.v2) b FROM pixels p JOIN pixels q ON p.img = q.img AND (p.y < q.y OR (p.y = q.y AND p.x < q.x)))
SELECT img, R(sum(a * b) / sqrt(CAST(sum(abs(a)) AS DOUBLE) * sum(abs(b)))) tau FROM q GROUP BY img""",
)(lambda r: coloc.kendall(r.pixels, "img", "v1", "v2"))
query(
    "coloc_mask_overlap",
    """WITH j AS (SELECT coalesce(a.img, b.img) img, CASE WHEN a.img IS NOT NULL THEN 1 ELSE 0 END a, CASE WHEN b.img IS NOT NULL THEN 1 ELSE 0 END b FROM mask_1 a FULL OUTER JOIN mask_2 b ON a.img = b.img AND a.y = b.y AND a.x = b.x)
SELECT img, R(round(sum(a*b) / CAST(sum(a) AS DOUBLE), 4)) m1, R(round(sum(a*b) / CAST(sum(b) AS DOUBLE), 4)) m2, R(round(sum(a*b) / CAST(count(*) AS DOUBLE), 4)) jaccard, R(round(2 * sum(a*b) / CAST(sum(a) + sum(b) AS DOUBLE), 4)) dice FROM j GROUP BY img""",
)(lambda r: coloc.mask_overlap(r.mask("v1"), r.mask("v2")))
query(
    "coloc_manders_intensity",
    "SELECT p.img, R(round(sum(CASE WHEN m.img IS NOT NULL THEN v1 ELSE 0 END) / sum(v1), 4)) manders FROM pixels p LEFT JOIN mask_2 m ON p.img = m.img AND p.y = m.y AND p.x = m.x GROUP BY p.img",
)(lambda r: coloc.manders_intensity(r.pixels, r.mask("v2")))
query(
    "coloc_object_pairs",
    """WITH s AS (SELECT a.img, a.label l1, b.label l2, count(*) pixels FROM labels_1 a JOIN labels_big b ON a.img = b.img AND a.y = b.y AND a.x = b.x GROUP BY 1, 2, 3),
c1 AS (SELECT img, label, avg(y) cy, avg(x) cx FROM labels_1 GROUP BY 1, 2), c2 AS (SELECT img, label, avg(y) cy, avg(x) cx FROM labels_big GROUP BY 1, 2)
SELECT s.img, l1, l2, pixels, R(sqrt((c1.cy - c2.cy) * (c1.cy - c2.cy) + (c1.cx - c2.cx) * (c1.cx - c2.cx))) distance, count(*) OVER (PARTITION BY s.img, l1) = 1 AND count(*) OVER (PARTITION BY s.img, l2) = 1 AS unique_pair
FROM s JOIN c1 ON s.img = c1.img AND l1 = c1.label JOIN c2 ON s.img = c2.img AND l2 = c2.label""",
)(lambda r: coloc.object_pairs(r.labels("v1"), r.labels("v1", 0.8, 16)))
query(
    "coloc_non_coincident",
    """WITH o AS (SELECT DISTINCT img, label FROM labels_1), h AS (SELECT DISTINCT a.img, a.label FROM labels_1 a JOIN mask_few b ON a.img = b.img AND a.y = b.y AND a.x = b.x)
SELECT o.img, count(*) objects, R(avg(CASE WHEN h.img IS NULL THEN 1.0 ELSE 0.0 END)) alone FROM o LEFT JOIN h ON o.img = h.img AND o.label = h.label GROUP BY o.img""",
)(lambda r: coloc.non_coincident(r.labels("v1"), r.mask("v1", 1.4)))
query(
    "coloc_threshold_sensitivity",
    """WITH b AS (SELECT img, quantile_cont(v1, 0.95) t1, max(v1) top1, quantile_cont(v2, 0.95) t2, max(v2) top2 FROM pixels GROUP BY img), g AS (SELECT b.img, CAST(s AS DOUBLE) s, t1 + s * (top1 - t1) t1, t2 + s * (top2 - t2) t2 FROM b, (VALUES (-0.3), (-0.2), (-0.1), (0.0), (0.1), (0.2), (0.3)) v(s))
SELECT p.img, R(s) AS shift, R(sum(CASE WHEN v1 > t1 AND v2 > t2 THEN v1 ELSE 0 END) / nullif(sum(CASE WHEN v1 > t1 THEN v1 ELSE 0 END), 0)) m1, R(sum(CASE WHEN v1 > t1 AND v2 > t2 THEN v2 ELSE 0 END) / nullif(sum(CASE WHEN v2 > t2 THEN v2 ELSE 0 END), 0)) m2 FROM pixels p JOIN g ON p.img = g.img GROUP BY p.img, s""",
)(lambda r: coloc.threshold_sensitivity(r.pixels, r.pixels.groupBy("img").agg(F.percentile("v1", F.lit(0.95)).alias("t1"), F.max("v1").alias("top1"), F.percentile("v2", F.lit(0.95)).alias("t2"), F.max("v2").alias("top2"))))
query("coloc_costes_threshold")(lambda r: coloc.costes_threshold(r.pixels))
query(
    "coloc_shift_correlation",
    "WITH s AS (SELECT unnest(range(-5, 6)) AS k) SELECT a.img, CAST(k AS INT) AS shift, R(corr(a.v1, b.v2)) r FROM pixels a, s, pixels b WHERE a.img = b.img AND a.y = b.y AND b.x = a.x + k GROUP BY a.img, k",
)(lambda r: spatial.shift_correlation(r.pixels, "v1", "v2", 5))

# ---- pixels

query("px_rescale", "SELECT p.img, y, x, R((v1 - lo) / nullif(hi - lo, 0)) v FROM pixels p JOIN (SELECT img, min(v1) lo, max(v1) hi FROM pixels GROUP BY img) m ON p.img = m.img")(lambda r: pixel.rescale(r.channel("v1")).select("img", "y", "x", "v"))
query("px_invert", "SELECT img, y, x, R(65535 - v1) v FROM pixels")(lambda r: pixel.invert(r.channel("v1"), 65535.0))
query("px_clip_low", "SELECT img, y, x, R(greatest(v1 - 400, 0)) v FROM pixels")(lambda r: pixel.clip_low(r.channel("v1").withColumn("v", F.col("v") - 400)))
query("px_convert_depth", "SELECT img, y, x, CAST(least(255, greatest(0, round(v1 / 1024 * 255))) AS INT) v FROM pixels")(lambda r: pixel.convert_depth(r.channel("v1").withColumn("v", F.col("v") / 1024), 255))
query("px_multiply", "SELECT img, y, x, R(v1 * v2) v FROM pixels")(lambda r: pixel.multiply(r.channel("v1"), r.channel("v2")))
query("px_threshold", "SELECT img, y, x, R(v1) v, CASE WHEN v1 >= 500 THEN 1 ELSE 0 END AS mask FROM pixels")(lambda r: pixel.threshold(r.channel("v1"), F.lit(500)))
query(
    "px_flat_field",
    "WITH g AS (SELECT y, x, avg(v2) - 7.3 g FROM pixels GROUP BY 1, 2), m AS (SELECT avg(g) m FROM g) SELECT img, p.y, p.x, R((v1 - 7.3) * m / nullif(g, 0)) v FROM pixels p JOIN g ON p.y = g.y AND p.x = g.x, m",
)(lambda r: pixel.flat_field(r.channel("v1"), r.channel("v2"), 7.3))
query("px_subtract_background", "SELECT img, y, x, R(greatest(v1 - v2, 0)) v FROM pixels")(lambda r: pixel.subtract_background(r.channel("v1"), r.channel("v2")))
query("px_optical_density", "SELECT img, y, x, R(v1) v, R(least(3, greatest(0, -log10(greatest(v1, 1000 * 0.001 + 1e-9) / 1000)))) od FROM pixels")(lambda r: pixel.optical_density(r.channel("v1"), F.lit(1000.0)))
query("px_ratio", "SELECT img, y, x, R(v1) v1, R(v2) v2, R(CASE WHEN v2 - 5 > 20 THEN (v1 - 10) / (v2 - 5) END) ratio FROM pixels")(lambda r: pixel.ratio_image(r.pixels, "v1", "v2", 10.0, 5.0, 20.0))
query("px_unmix", "SELECT img, y, x, R(v1) v1, R(v2) v2, R((v1 - 0.2 * v2) / 0.98) a1, R((v2 - 0.1 * v1) / 0.98) a2 FROM pixels")(lambda r: pixel.unmix(r.pixels, [[1.0, 0.2], [0.1, 1.0]], ["v1", "v2"]))
query(
    "px_negative_fraction",
    "WITH a AS (SELECT img, (v2 - 0.12 * v1) a FROM pixels), t AS (SELECT img, max(abs(a)) t FROM a GROUP BY img) SELECT a.img, R(avg(CASE WHEN a < -1e-9 * t THEN 1.0 ELSE 0.0 END)) negative FROM a JOIN t ON a.img = t.img GROUP BY a.img",
)(lambda r: pixel.negative_fraction(r.pixels.withColumn("a", F.col("v2") - 0.12 * F.col("v1")), "a"))
query(
    "px_mixing_matrix",
    "WITH c AS (SELECT CASE WHEN img = 'A' THEN 0 ELSE 1 END control, avg(v1) - 3 v1, avg(v2) - 3 v2 FROM pixels WHERE img IN ('A', 'N') GROUP BY 1) SELECT control, R(v1 / (CASE WHEN control = 0 THEN v1 ELSE v2 END)) v1, R(v2 / (CASE WHEN control = 0 THEN v1 ELSE v2 END)) v2 FROM c",
)(lambda r: pixel.mixing_matrix(r.pixels.where("img in ('A', 'N')").withColumn("control", F.when(F.col("img") == "A", 0).otherwise(1)), ["v1", "v2"], 3.0))
query("px_normalize_in_mask", "WITH v AS (SELECT p.img, p.y, p.x, v1 FROM pixels p JOIN mask_2 m ON p.img = m.img AND p.y = m.y AND p.x = m.x) SELECT v.img, y, x, R((v1 - lo) / (hi - lo)) v FROM v JOIN (SELECT img, min(v1) lo, max(v1) hi FROM v GROUP BY img) m ON v.img = m.img")(
    lambda r: pixel.normalize_within_mask(r.channel("v1"), r.mask("v2")).select("img", "y", "x", "v")
)
query("px_image_noise", "SELECT a.img, R(median(abs(b.v1 - a.v1)) * 1.4826 / sqrt(2)) noise FROM pixels a JOIN pixels b ON a.img = b.img AND a.x = b.x AND b.y = a.y + 1 GROUP BY a.img")(lambda r: pixel.image_noise(r.channel("v1")))
query(
    "px_object_noise",
    """WITH d AS (SELECT a.img, b.v1 - a.v1 d FROM pixels a JOIN pixels b ON a.img = b.img AND ((a.x = b.x AND b.y = a.y + 1) OR (a.y = b.y AND b.x = a.x + 1))), m AS (SELECT img, median(d) m FROM d GROUP BY img)
SELECT d.img, R(median(abs(d - m)) * 1.4826 / sqrt(2)) sigma FROM d JOIN m ON d.img = m.img GROUP BY d.img""",
)(lambda r: pixel.object_noise(r.channel("v1")))
query(
    "px_iqr_filter",
    "WITH q AS (SELECT img, quantile_cont(v1, 0.25) a, quantile_cont(v1, 0.75) b FROM pixels GROUP BY img) SELECT p.img, y, x, R(v1) v FROM pixels p JOIN q ON p.img = q.img WHERE v1 BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)",
)(lambda r: pixel.iqr_filtered(r.channel("v1"), ["img"], "v"))
query("px_merge_mean", "SELECT img, y, x, R(least(1000, (v1 + v2) / 2)) v FROM pixels")(lambda r: pixel.merge_layers([r.channel("v1"), r.channel("v2")], "mean", 1000.0))
query("px_merge_max", "SELECT img, y, x, R(least(600, greatest(v1, v2))) v FROM pixels")(lambda r: pixel.merge_layers([r.channel("v1"), r.channel("v2")], "max", 600.0))
query("px_mask_and", "SELECT a.* FROM mask_1 a JOIN mask_2 b ON a.img = b.img AND a.y = b.y AND a.x = b.x")(lambda r: pixel.mask_logic(r.mask("v1"), r.mask("v2"), "and"))
query("px_mask_or", "SELECT * FROM mask_1 UNION SELECT * FROM mask_2")(lambda r: pixel.mask_logic(r.mask("v1"), r.mask("v2"), "or"))
query("px_mask_xor", "(SELECT * FROM mask_1 EXCEPT SELECT * FROM mask_2) UNION ALL (SELECT * FROM mask_2 EXCEPT SELECT * FROM mask_1)")(lambda r: pixel.mask_logic(r.mask("v1"), r.mask("v2"), "xor"))
query("px_log_stretch", "WITH v AS (SELECT img, y, x, ln(1 + v1) l FROM pixels) SELECT v.img, y, x, R((l - lo) / (hi - lo)) v FROM v JOIN (SELECT img, min(l) lo, max(l) hi FROM v GROUP BY img) m ON v.img = m.img")(lambda r: pixel.log_stretch(r.channel("v1")).select("img", "y", "x", "v"))
query(
    "px_extend_to_edges",
    f"""WITH g AS (SELECT i.img, CAST(ty.range AS INT) y, CAST(tx.range AS INT) x FROM (SELECT DISTINCT img FROM pixels) i, range({SIDE}) ty, range({SIDE}) tx)
SELECT g.img, g.y, g.x, R(v1) v FROM g JOIN pixels p ON g.img = p.img AND p.y = least({SIDE - 4}, greatest(3, g.y)) AND p.x = least({SIDE - 4}, greatest(3, g.x))""",
)(lambda r: pixel.extend_to_edges(r.channel("v1"), 3, SIDE, SIDE))
query("px_erode", "SELECT a.img, a.y, a.x FROM mask_1 a JOIN mask_1 b ON a.img = b.img AND (b.y - a.y) * (b.y - a.y) + (b.x - a.x) * (b.x - a.x) <= 1 GROUP BY 1, 2, 3 HAVING count(*) = 5")(lambda r: pixel.erode(r.mask("v1"), "disk", 1))
query(
    "px_dilate",
    f"WITH o AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) v(dy, dx)) SELECT DISTINCT img, y + dy AS y, x + dx AS x FROM mask_few, o WHERE y + dy BETWEEN 0 AND {SIDE - 1} AND x + dx BETWEEN 0 AND {SIDE - 1}",
)(lambda r: pixel.dilate(r.mask("v1", 1.4), "disk", 1, SIDE, SIDE))
query(
    "px_local_mean",
    "SELECT a.img, a.y, a.x, R(avg(b.v1)) mean FROM pixels a JOIN pixels b ON a.img = b.img AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2, 3",
)(lambda r: pixel.neighbourhood(r.channel("v1"), pixel.footprint("square", 1), F.avg("v").alias("mean")))
query("px_crop_to_mask", "WITH b AS (SELECT img, min(y) y0, max(y) y1, min(x) x0, max(x) x1 FROM mask_few WHERE y BETWEEN 8 AND 20 GROUP BY img) SELECT p.img, y, x, R(v1) v FROM pixels p JOIN b ON p.img = b.img WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1")(
    lambda r: pixel.crop_to_mask(r.channel("v1"), r.mask("v1", 1.4).where("y between 8 and 20"))
)
query("px_bounding_boxes", f"SELECT img, label, greatest(min(y) - 2, 0) y0, least(max(y) + 2, {SIDE - 1}) y1, greatest(min(x) - 2, 0) x0, least(max(x) + 2, {SIDE - 1}) x1 FROM labels_1 GROUP BY 1, 2")(lambda r: pixel.bounding_boxes(r.labels("v1"), 2, SIDE, SIDE))

# ---- stacks

query(
    "stack_number_brightness",
    "WITH s AS (SELECT img, y, x, avg(v) m, var_samp(v) s FROM stack GROUP BY 1, 2, 3) SELECT img, y, x, R(m) mean, R(coalesce(s, 0)) AS var, R(CASE WHEN m > 1e-6 AND s > 1e-6 THEN s / m ELSE 0 END) brightness, R(CASE WHEN m > 1e-6 AND s > 1e-6 THEN m * m / s ELSE 0 END) AS number FROM s",
)(lambda r: pixel.number_and_brightness(r.stack))
query(
    "stack_detrend",
    """WITH f AS (SELECT img, t, avg(v) m FROM stack GROUP BY 1, 2), w AS (SELECT img, t, avg(m) OVER (PARTITION BY img) / avg(m) OVER (PARTITION BY img ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) f FROM f)
SELECT s.img, s.t, y, x, R(v * f) v FROM stack s JOIN w ON s.img = w.img AND s.t = w.t""",
)(lambda r: pixel.detrend_frames(r.stack, 4))
query("stack_projection", "SELECT img, y, x, R(max(v)) v FROM stack GROUP BY 1, 2, 3")(lambda r: pixel.projection(r.stack))
query(
    "stack_stats",
    """WITH b AS (SELECT img, min(v) lo, max(v) hi, avg(v) m, stddev_pop(v) s, count(*) n FROM stack GROUP BY img), h AS (SELECT s.img, least(511, floor((v - lo) / ((hi - lo) / 512))) b, count(*) c FROM stack s JOIN b ON s.img = b.img GROUP BY 1, 2),
u AS (SELECT img, b, sum(c) OVER (PARTITION BY img ORDER BY b) u FROM h)
SELECT b.img, R(lo) lo, R(hi) hi, R(m) mean, R(s) std, n, R(min(CASE WHEN u >= n * 1 / 100.0 THEN lo + (b + 1) * ((hi - lo) / 512) END)) p1, R(min(CASE WHEN u >= n * 99 / 100.0 THEN lo + (b + 1) * ((hi - lo) / 512) END)) p99 FROM b JOIN u ON b.img = u.img GROUP BY b.img, lo, hi, m, s, n""",
)(lambda r: pixel.stream_stats(r.stack, ["img"]))
query(
    "stack_focus",
    """WITH f AS (SELECT a.img, a.t, avg((b.v - a.v) * (b.v - a.v)) f FROM stack a JOIN stack b ON a.img = b.img AND a.t = b.t AND a.y = b.y AND b.x = a.x + 2 GROUP BY 1, 2), m AS (SELECT img, median(f) m, max(f) top FROM f GROUP BY img)
SELECT f.img, t, R(f / m) AS relative, f < 0.5 * top AS blurred FROM f JOIN m ON f.img = m.img""",
)(lambda r: qc.focus_series(r.stack))
query(
    "stack_best_slice",
    "WITH f AS (SELECT a.img, a.t, avg((b.v - a.v) * (b.v - a.v)) f FROM stack a JOIN stack b ON a.img = b.img AND a.t = b.t AND a.y = b.y AND b.x = a.x + 2 GROUP BY 1, 2) SELECT img, t FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY f DESC, t) k FROM f) WHERE k = 1",
)(lambda r: qc.best_slice(r.stack))
query(
    "stack_bleaching",
    """WITH m AS (SELECT img, t, median(v) m FROM stack GROUP BY 1, 2), s AS (SELECT img, count(*) n, regr_slope(ln(m), t) k, max_by(m, t) / min_by(m, t) r FROM m GROUP BY img HAVING count(*) >= 4)
SELECT img, n AS frames, R(CASE WHEN k < 0 AND -1 / k <= 10 * n THEN -1 / k END) tau, R(r) remaining, CASE WHEN r >= 0.85 THEN 'good' WHEN r >= 0.5 THEN 'warn' ELSE 'bad' END verdict FROM s""",
)(lambda r: qc.bleaching(r.stack))
query(
    "stack_entropy",
    """WITH m AS (SELECT img, t, min(v) lo, max(v) hi FROM stack GROUP BY 1, 2), b AS (SELECT s.img, s.t, least(63, coalesce(floor((v - lo) * 64 / nullif(hi - lo, 0)), 0)) b, count(*) c FROM stack s JOIN m ON s.img = m.img AND s.t = m.t GROUP BY 1, 2, 3)
SELECT img, t, R(log2(sum(c)) - sum(c * log2(c)) / sum(c)) entropy FROM b GROUP BY 1, 2""",
)(lambda r: objects.entropy(r.stack, ["img", "t"], 64))
query("stack_merge_fission", """WITH o AS (SELECT DISTINCT a.img, a.t, a.label l1, b.label l2 FROM frame_labels a JOIN frame_labels b ON a.img = b.img AND b.t = a.t + 1 AND a.y = b.y AND a.x = b.x)
SELECT img, t, l2 AS label, count(*) n, 'merge' event FROM o GROUP BY 1, 2, 3 HAVING count(*) >= 2 UNION ALL SELECT img, t, l1, count(*), 'fission' FROM o GROUP BY 1, 2, 3 HAVING count(*) >= 2""")(lambda r: tracks.merges_and_fissions(r.frame_labels))
query(
    "stack_temporal_correlation",
    """WITH c AS (SELECT a.img, a.t, corr(a.v, b.v) r FROM stack a JOIN stack b ON a.img = b.img AND b.t = a.t + 1 AND a.y = b.y AND a.x = b.x GROUP BY 1, 2), m AS (SELECT img, avg(r) r FROM c WHERE r IS NOT NULL GROUP BY img)
SELECT img, R(r) r, CASE WHEN r > 0.9 THEN 'oversampled' WHEN r > 0.7 THEN 'moderate' ELSE 'sparse' END sampling FROM m""",
)(lambda r: tracks.temporal_correlation(r.stack))
query("stack_roi_trace", "SELECT img, t, R(avg(v)) v FROM stack WHERE (y - 4) * (y - 4) + (x - 4) * (x - 4) < 9 GROUP BY 1, 2")(lambda r: r.stack.where((F.col("y") - 4) * (F.col("y") - 4) + (F.col("x") - 4) * (F.col("x") - 4) < 9).groupBy("img", "t").agg(F.avg("v").alias("v")))
query("stack_label_traces", "SELECT s.img, label, s.t, R(avg(v)) v FROM stack s JOIN frame_labels l ON s.img = l.img AND s.t = l.t AND s.y = l.y AND s.x = l.x GROUP BY 1, 2, 3")(lambda r: r.stack.join(r.frame_labels, ["img", "t", "y", "x"]).groupBy("img", "label", "t").agg(F.avg("v").alias("v")))

# ---- objects

query(
    "obj_region_statistics",
    """WITH m AS (SELECT l.img, l.label, count(*) area, avg(v1) mean, median(v1) median, stddev_pop(v1) std, sum(v1) total, avg(l.y) cy, avg(l.x) cx, min(l.y) y0, max(l.y) y1, min(l.x) x0, max(l.x) x1, var_pop(l.y) + 1/12.0 vy, var_pop(l.x) + 1/12.0 vx, covar_pop(l.y, l.x) c
FROM labels_1 l JOIN pixels p ON l.img = p.img AND l.y = p.y AND l.x = p.x GROUP BY 1, 2), a AS (SELECT *, 4 * sqrt((vy + vx + sqrt((vy - vx) * (vy - vx) + 4 * c * c)) / 2) major, 4 * sqrt(greatest(0, (vy + vx - sqrt((vy - vx) * (vy - vx) + 4 * c * c)) / 2)) minor FROM m)
SELECT img, label, area, R(mean) mean, R(median) AS median, R(std) std, R(total) total, R(cy) cy, R(cx) cx, y0, y1, x0, x1, R(major) major_px, R(minor) minor_px, R(0.5 * atan2(2 * c, vy - vx)) orientation, R(sqrt(greatest(0, 1 - minor * minor / (major * major)))) eccentricity FROM a""",
)(lambda r: objects.region_statistics(r.labels("v1"), r.channel("v1")))
query(
    "obj_order_parameter",
    """WITH m AS (SELECT img, label, var_pop(y) vy, var_pop(x) vx, covar_pop(y, x) c FROM labels_1 GROUP BY 1, 2), o AS (SELECT img, 0.5 * atan2(2 * c, vy - vx) o FROM m)
SELECT img, count(*) n, R(sqrt(avg(cos(2*o)) * avg(cos(2*o)) + avg(sin(2*o)) * avg(sin(2*o)))) AS "order", R(0.5 * atan2(avg(sin(2*o)), avg(cos(2*o)))) preferred FROM o GROUP BY img""",
)(lambda r: objects.order_parameter(objects.region_statistics(r.labels("v1"), r.channel("v1"))))
query("obj_edge_touching", f"SELECT img, label, max(CASE WHEN y <= 1 OR x <= 1 OR y >= {SIDE - 2} OR x >= {SIDE - 2} THEN 1 ELSE 0 END) edge_touching FROM labels_few GROUP BY 1, 2")(lambda r: objects.edge_touching(r.labels("v1", 1.4, 4), SIDE, SIDE, 1))
query("obj_remove_small", "SELECT l.img, l.y, l.x, l.label FROM labels_few l JOIN (SELECT img, label FROM labels_few GROUP BY 1, 2 HAVING count(*) >= 3) k ON l.img = k.img AND l.label = k.label")(lambda r: objects.remove_small(r.labels("v1", 1.4, 4), 3).select("img", "y", "x", "label"))
query(
    "obj_outliers",
    """WITH m AS (SELECT condition, median(area) m FROM objects GROUP BY 1), d AS (SELECT o.condition, m, median(abs(area - m)) mad FROM objects o JOIN m ON o.condition = m.condition GROUP BY 1, 2)
SELECT label, R(area) area, abs(area - m) > 1.5 * 1.4826 * mad AS outlier, CASE WHEN abs(area - m) > 1.5 * 1.4826 * mad THEN 'size' ELSE '' END qc_flags FROM objects o JOIN d ON o.condition = d.condition""",
)(lambda r: objects.summarize_flags(objects.outliers(r.objects, "area", ["condition"], 1.5), {"outlier": "size"}).select("label", "area", "outlier", "qc_flags"))
query(
    "obj_partition_field",
    """WITH s AS (SELECT p.img, avg(CASE WHEN m.img IS NOT NULL THEN v1 END) d, quantile_cont(CASE WHEN m.img IS NULL THEN v1 END, 0.1) p, avg(CASE WHEN m.img IS NULL THEN v1 END) b FROM pixels p LEFT JOIN mask_1 m ON p.img = m.img AND p.y = m.y AND p.x = m.x GROUP BY p.img)
SELECT img, R(d) dense, R(CASE WHEN p > 0 AND p >= 0.05 * b THEN p ELSE b END) bulk, R(d / (CASE WHEN p > 0 AND p >= 0.05 * b THEN p ELSE b END)) k FROM s""",
)(lambda r: objects.partition_field(r.labels("v1"), r.channel("v1")))
query("obj_enrichment", "SELECT p.img, R(avg(CASE WHEN m.img IS NOT NULL THEN v1 END)) dense, R(avg(CASE WHEN m.img IS NULL THEN v1 END)) dilute, R((avg(CASE WHEN m.img IS NOT NULL THEN v1 END) - 5) / (avg(CASE WHEN m.img IS NULL THEN v1 END) - 5)) enrichment FROM pixels p LEFT JOIN mask_1 m ON p.img = m.img AND p.y = m.y AND p.x = m.x GROUP BY p.img")(
    lambda r: objects.enrichment(r.labels("v1"), r.channel("v1"), 5.0)
)
query(
    "obj_enrichment_per_object",
    """WITH d AS (SELECT l.img, l.label, avg(v1) d FROM labels_few l JOIN pixels p ON l.img = p.img AND l.y = p.y AND l.x = p.x GROUP BY 1, 2),
s AS (SELECT DISTINCT l.img, l.label, p.y, p.x, p.v1 FROM labels_few l JOIN pixels p ON l.img = p.img AND (p.y - l.y) * (p.y - l.y) + (p.x - l.x) * (p.x - l.x) <= 4 WHERE NOT EXISTS (SELECT 1 FROM labels_few k WHERE k.img = p.img AND k.y = p.y AND k.x = p.x)),
a AS (SELECT img, label, avg(v1) s FROM s GROUP BY 1, 2) SELECT d.img, d.label, R(d) dense, R(s) shell, R((d - 5) / (s - 5)) enrichment FROM d LEFT JOIN a ON d.img = a.img AND d.label = a.label""",
)(lambda r: objects.enrichment_per_object(r.labels("v1", 1.4, 4), r.channel("v1"), 2, 5.0))
query(
    "obj_field_summary",
    """WITH f AS (SELECT img, count(*) px FROM pixels GROUP BY img), o AS (SELECT img, label, count(*) a, sqrt(count(*) * 0.25 / pi()) r FROM labels_1 GROUP BY 1, 2), s AS (SELECT img, count(*) n, sum(a) a, avg(r) m, median(r) d, stddev_pop(r) s FROM o GROUP BY img)
SELECT f.img, coalesce(n, 0) n, R(coalesce(a, 0) / CAST(px AS DOUBLE)) area_fraction, R(m) mean_radius_um, R(d) median_radius_um, R(s) std_radius_um, R(coalesce(n, 0) / (px * 0.25)) density_per_um2 FROM f LEFT JOIN s ON f.img = s.img""",
)(lambda r: objects.field_summary(r.labels("v1"), r.channel("v1"), 0.5))
query("obj_ratios", "SELECT l.img, label, R(sum(v1) / sum(v2)) ratio_of_means, R(avg(v1 / v2)) mean_of_ratios, R(avg(CASE WHEN v1 / v2 > 8 THEN 1.0 ELSE 0.0 END)) AS over FROM labels_1 l JOIN pixels p ON l.img = p.img AND l.y = p.y AND l.x = p.x GROUP BY 1, 2".replace("AS over", 'AS "over"'))(
    lambda r: objects.object_ratios(r.labels("v1"), r.pixels, "v1", "v2", 8.0)
)
query(
    "obj_occupancy",
    """WITH c AS (SELECT img, label cell, count(*) px FROM labels_big GROUP BY 1, 2), i AS (SELECT b.img, b.label cell, count(*) px, count(DISTINCT f.label) n FROM labels_big b JOIN labels_few f ON b.img = f.img AND b.y = f.y AND b.x = f.x GROUP BY 1, 2)
SELECT c.img, c.cell, R(coalesce(i.px, 0) / CAST(c.px AS DOUBLE)) fraction, coalesce(n, 0) n, R(coalesce(n, 0) / (c.px * 0.25)) density FROM c LEFT JOIN i ON c.img = i.img AND c.cell = i.cell""",
)(lambda r: objects.occupancy(r.labels("v1", 1.4, 4), r.labels("v1", 0.8, 16), 0.5))
query("obj_partial_volume", "SELECT img, label, CAST(floor(y / 4) AS INT) y, CAST(floor(x / 4) AS INT) x, R(count(*) / 16.0) w FROM labels_1 GROUP BY 1, 2, 3, 4")(lambda r: objects.partial_volume(r.labels("v1"), 4))
query(
    "obj_weighted_statistics",
    """WITH w AS (SELECT l.img, l.label, v2 / 100 w, v1 v FROM labels_1 l JOIN pixels p ON l.img = p.img AND l.y = p.y AND l.x = p.x)
SELECT img, label, R(sum(w) * sum(w) / sum(w*w)) n_eff, R(sum(w*v) / sum(w)) mean, R(sqrt(greatest(0, sum(w*v*v) / sum(w) - sum(w*v) / sum(w) * (sum(w*v) / sum(w))))) std, R(sum(w*v) - 2 * sum(w)) total FROM w GROUP BY 1, 2""",
)(lambda r: objects.weighted_statistics(r.labels("v1").join(r.pixels, ["img", "y", "x"]).select("img", "y", "x", "label", (F.col("v2") / 100).alias("w")), r.channel("v1"), 2.0))
query("obj_size_bias", "SELECT p_partkey, p_size, R(-tanh(0.75 * 3.0 / p_size)) bias, p_size <= 4.5 AS sub_resolution FROM part")(lambda r: objects.size_bias(r.table("part").select("p_partkey", "p_size"), "p_size", 3.0))
query("obj_box_counts", "WITH s AS (SELECT unnest([1, 2, 4, 8, 16]) s), b AS (SELECT DISTINCT img, s, floor(y / s) a, floor(x / s) b FROM mask_few, s) SELECT img, s, count(*) boxes FROM b GROUP BY 1, 2")(lambda r: objects.box_counts(r.mask("v1", 1.4), [1, 2, 4, 8, 16]))
query(
    "obj_fractal_dimension",
    "WITH s AS (SELECT unnest([1, 2, 4, 8, 16]) s), b AS (SELECT DISTINCT img, s, floor(y / s) a, floor(x / s) b FROM mask_few, s), n AS (SELECT img, s, count(*) n FROM b GROUP BY 1, 2) SELECT img, R(regr_slope(ln(n), ln(1.0 / s))) dimension FROM n GROUP BY img",
)(lambda r: objects.fractal_dimension(r.mask("v1", 1.4), [1, 2, 4, 8, 16]))
query(
    "obj_kurtosis",
    "WITH q AS (SELECT img, quantile_cont(v1, 0.25) a, quantile_cont(v1, 0.75) b FROM pixels GROUP BY img) SELECT p.img, R(CASE WHEN stddev_pop(v1) >= 2 THEN kurtosis_pop(v1) END) kurtosis FROM pixels p JOIN q ON p.img = q.img WHERE v1 BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) GROUP BY p.img",
)(lambda r: objects.kurtosis(r.channel("v1")))
query(
    "obj_glcm",
    """WITH m AS (SELECT img, min(v1) lo, max(v1) hi FROM pixels GROUP BY img), q AS (SELECT p.img, y, x, least(15, floor((v1 - lo) * 16 / (hi - lo))) g FROM pixels p JOIN m ON p.img = m.img),
j AS (SELECT a.img, a.g, b.g h FROM q a JOIN q b ON a.img = b.img AND a.y = b.y AND b.x = a.x + 1), s AS (SELECT img, g, h FROM j UNION ALL SELECT img, h, g FROM j), c AS (SELECT img, g, h, count(*) c FROM s GROUP BY 1, 2, 3), p AS (SELECT *, c / CAST(sum(c) OVER (PARTITION BY img) AS DOUBLE) p FROM c)
SELECT img, R(sum(p * (g - h) * (g - h))) contrast, R(sum(p * abs(g - h))) dissimilarity, R(sum(p / (1 + (g - h) * (g - h)))) homogeneity, R(sum(p * p)) asm, R(sqrt(sum(p * p))) energy FROM p GROUP BY img""",
)(lambda r: objects.glcm(r.channel("v1"), 0, 1, 16))
query("obj_melt", "SELECT 'order' object_type, CAST(label AS VARCHAR) object_id, condition, m AS measurement, R(v) AS value, CASE WHEN m = 'area' THEN 'um2' ELSE '' END units FROM (SELECT label, condition, 'area' m, area v FROM objects UNION ALL SELECT label, condition, 'replicate', CAST(replicate AS DOUBLE) FROM objects)")(
    lambda r: objects.melt(r.objects.select("label", "condition", "area", F.col("replicate").cast("int").alias("replicate")), "order", "label", {"area": "um2"}, ["condition"])
)
query("obj_to_replicates", "SELECT condition, replicate, R(avg(area)) AS value, count(*) n FROM objects GROUP BY 1, 2")(lambda r: objects.to_replicates(r.objects.select("condition", "replicate", F.lit("area").alias("measurement"), F.col("area").cast("string").alias("value")), "area", "condition", "replicate"))
query("obj_dose_response", "WITH a AS (SELECT condition, replicate, avg(area) v FROM objects GROUP BY 1, 2) SELECT condition, R(avg(v)) mean, R(stddev(v)) std, count(*) n, R(stddev(v) / sqrt(count(*))) sem FROM a GROUP BY 1")(
    lambda r: objects.dose_response(r.objects.groupBy("condition", "replicate").agg(F.avg("area").alias("value")), "condition")
)
query(
    "obj_lever_rule",
    "WITH f AS (SELECT p_brand b, regr_slope(p_size, p_retailprice) m, regr_intercept(p_size, p_retailprice) i, regr_r2(p_size, p_retailprice) r FROM part WHERE p_size > 0 GROUP BY 1) SELECT b AS p_brand, R(-i / nullif(m, 0)) c_sat, R(-i / nullif(m, 0) + 1 / nullif(m, 0)) c_dense, R(r) r2, r > 0.5 AS usable FROM f",
)(lambda r: objects.lever_rule(r.table("part").withColumn("p_size", F.col("p_size").cast("double")), ["p_brand"], "p_retailprice", "p_size"))
query(
    "obj_size_mle",
    """WITH s AS (SELECT p_brand, count(*) n, avg(ln(p_size)) mu, stddev_pop(ln(p_size)) sg, avg(p_size) m FROM part WHERE p_size > 0 GROUP BY 1 HAVING count(*) >= 20), a AS (SELECT *, 4 + 2 * n * (mu + ln(sg) + 0.5 * ln(2 * pi()) + 0.5) l, 2 + 2 * n * (ln(m) + 1) e FROM s WHERE sg > 0)
SELECT p_brand, n, R(mu) mu, R(sg) sigma, R(1 / m) rate, R(l) aic_lognormal, R(e) aic_exponential, CASE WHEN l <= e THEN 'lognormal' ELSE 'exponential' END best FROM a""",
)(lambda r: objects.size_mle(r.table("part"), ["p_brand"], "p_size"))
query(
    "obj_feature_card",
    """WITH m AS (SELECT min(p_retailprice) lo, max(p_retailprice) hi FROM part), b AS (SELECT CAST(least(19, floor((p_retailprice - lo) * 20 / (hi - lo))) AS INT) b, count(*) n FROM part, m GROUP BY 1)
SELECT CAST(r.range AS INT) bin, R(lo + (hi - lo) * r.range / 20) edge, coalesce(n, 0) n FROM m, range(20) r LEFT JOIN b ON r.range = b.b""",
)(lambda r: objects.feature_card(r.table("part"), "p_retailprice"))
query("obj_cohort", "SELECT label, R(area) area FROM objects WHERE area >= 100000 AND area < 150000")(lambda r: objects.cohort(r.objects, "label", "area", 100000.0, 150000.0))
query("obj_correlations", "SELECT 'l_quantity' a, 'l_extendedprice' b, R(abs(corr(l_quantity, l_extendedprice))) r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', R(abs(corr(l_quantity, l_discount))) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', R(abs(corr(l_extendedprice, l_discount))) FROM lineitem")(
    lambda r: objects.correlation_matrix(r.table("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
)
query(
    "obj_intensity_histogram",
    """WITH s AS (SELECT img, quantile_cont(v1, 0.999) top FROM pixels GROUP BY img HAVING count(*) >= 100), b AS (SELECT p.img, top, least(31, floor(v1 / (top / 32))) b, count(*) c FROM pixels p JOIN s ON p.img = s.img WHERE v1 <= top GROUP BY 1, 2, 3)
SELECT img, CAST(b AS BIGINT) bin, R(c / (sum(c) OVER (PARTITION BY img) * top / 32)) density FROM b""",
)(lambda r: objects.intensity_histogram(r.channel("v1"), 32))
query(
    "obj_global_labels",
    "WITH t AS (SELECT img, max(label) m FROM labels_few GROUP BY img), b AS (SELECT img, coalesce(sum(m) OVER (ORDER BY img ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM t) SELECT l.img, y, x, label, CAST(label + b AS BIGINT) global_label FROM labels_few l JOIN b ON l.img = b.img",
)(lambda r: objects.global_labels(r.labels("v1", 1.4, 4), ["img"]).select("img", "y", "x", "label", "global_label"))

# ---- tracks and series

query(
    "trk_metrics",
    """WITH d AS (SELECT *, sqrt(pow(y_um - lag(y_um) OVER w, 2) + pow(x_um - lag(x_um) OVER w, 2)) d FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
s AS (SELECT track_id, count(*) n, max(frame) - min(frame) + 1 lifetime, coalesce(sum(d), 0) path, sqrt(pow(max_by(y_um, frame) - min_by(y_um, frame), 2) + pow(max_by(x_um, frame) - min_by(x_um, frame), 2)) net, avg(area_um2) mean_area, max_by(area_um2, frame) - min_by(area_um2, frame) ch FROM d GROUP BY 1)
SELECT track_id, n, lifetime, R(path) path, R(net) net, R(path / nullif(n - 1, 0)) speed, R(net / nullif(path, 0)) confinement, R(mean_area) mean_area, R(ch) area_change FROM s""",
)(lambda r: tracks.trajectory_metrics(r.tracks))
query("trk_lifetimes", "WITH l AS (SELECT max(frame) - min(frame) + 1 l FROM tracks GROUP BY track_id), h AS (SELECT l, count(*) n FROM l GROUP BY l) SELECT l AS lifetime, n, R(n / CAST(sum(n) OVER () AS DOUBLE)) fraction FROM h")(lambda r: tracks.lifetime_histogram(r.tracks))
query(
    "trk_growth",
    """WITH g AS (SELECT *, (area_um2 - lag(area_um2) OVER w) / nullif((frame - lag(frame) OVER w) * 0.5, 0) g, avg(area_um2) OVER (PARTITION BY track_id) m FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY frame))
SELECT track_id, frame, R(g) dadt, CASE WHEN g > 0.05 * m THEN 'growth' WHEN g < -0.05 * m THEN 'shrinkage' ELSE 'stable' END state, R(sum(greatest(coalesce(g, 0), 0)) OVER (PARTITION BY track_id ORDER BY frame)) grown, R(sum(least(coalesce(g, 0), 0)) OVER (PARTITION BY track_id ORDER BY frame)) shrunk FROM g""",
)(lambda r: tracks.growth_kinetics(r.tracks, 0.5))
_MSD = """WITH k AS (SELECT track_id FROM tracks GROUP BY 1 HAVING count(*) >= 20), p AS (SELECT a.track_id, b.frame - a.frame AS lag, avg(pow(b.y_um - a.y_um, 2) + pow(b.x_um - a.x_um, 2)) msd, count(*) pairs FROM tracks a JOIN k ON a.track_id = k.track_id JOIN tracks b ON a.track_id = b.track_id AND b.frame - a.frame BETWEEN 1 AND 12 GROUP BY 1, 2)"""
query("trk_msd_per_track", f"{_MSD} SELECT track_id, lag, R(sqrt(msd)) AS rms, pairs FROM p")(lambda r: tracks.msd_per_track(r.tracks, 12, 20).select("track_id", "lag", F.sqrt("msd").alias("rms"), "pairs"))
query("trk_msd", f"{_MSD} SELECT lag, R(avg(msd)) msd, R(stddev(msd)) std, R(stddev(msd) / sqrt(count(*))) sem, count(*) n_tracks, CAST(sum(pairs) AS BIGINT) n_pairs, R(lag * 0.1) tau_s FROM p GROUP BY lag")(lambda r: tracks.msd(r.tracks, 12, 20, 0.1))
query("trk_anomalous_exponent", f"{_MSD}, e AS (SELECT lag * 0.1 tau, avg(msd) msd FROM p GROUP BY lag) SELECT R(regr_slope(ln(msd), ln(tau))) alpha, R(exp(regr_intercept(ln(msd), ln(tau))) / 4) d, R(regr_r2(ln(msd), ln(tau))) r2 FROM e")(lambda r: tracks.anomalous_exponent(tracks.msd(r.tracks, 12, 20, 0.1), []))
query(
    "trk_drift_corrected",
    """WITH s AS (SELECT track_id, frame, y_um, x_um, CASE WHEN frame - lag(frame) OVER w = 1 THEN y_um - lag(y_um) OVER w END sy, CASE WHEN frame - lag(frame) OVER w = 1 THEN x_um - lag(x_um) OVER w END sx FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
m AS (SELECT frame, coalesce(avg(sy), 0) my, coalesce(avg(sx), 0) mx FROM s GROUP BY frame), d AS (SELECT frame, sum(my) OVER (ORDER BY frame) dy, sum(mx) OVER (ORDER BY frame) dx FROM m)
SELECT track_id, t.frame, R(y_um - dy) y_um, R(x_um - dx) x_um FROM tracks t JOIN d ON t.frame = d.frame""",
)(lambda r: tracks.drift_corrected(r.tracks))
query(
    "trk_kaplan_meier",
    """WITH l AS (SELECT max(frame) - min(frame) + 1 t, CASE WHEN max(frame) < 70 - 1 AND min(frame) > 0 THEN 1 ELSE 0 END e FROM (SELECT track_id, frame + track_id % 3 AS frame FROM tracks) GROUP BY track_id), b AS (SELECT t, count(*) n, sum(e) d FROM l GROUP BY t), r AS (SELECT *, sum(n) OVER (ORDER BY t DESC) k FROM b),
s AS (SELECT t, k, d, CASE WHEN sum(CASE WHEN d = k THEN 1 ELSE 0 END) OVER (ORDER BY t) > 0 THEN 0 ELSE exp(sum(CASE WHEN d < k THEN ln(1 - d / CAST(k AS DOUBLE)) END) OVER (ORDER BY t)) END s FROM r WHERE d > 0)
SELECT CAST(t AS INT) t, CAST(k AS BIGINT) at_risk, CAST(d AS BIGINT) d, R(s) s FROM s UNION ALL SELECT 0, count(*), 0, 1.0 FROM l""",
)(lambda r: tracks.kaplan_meier(r.tracks.withColumn("frame", (F.col("frame") + F.col("track_id") % 3).cast("int")), 70))
query(
    "trk_neighbour_persistence",
    """WITH p AS (SELECT a.frame, a.track_id, b.track_id o, row_number() OVER (PARTITION BY a.frame, a.track_id ORDER BY sqrt((a.y_um - b.y_um) * (a.y_um - b.y_um) + (a.x_um - b.x_um) * (a.x_um - b.x_um)), b.track_id) k
FROM tracks a JOIN tracks b ON a.frame = b.frame AND a.track_id <> b.track_id AND sqrt((a.y_um - b.y_um) * (a.y_um - b.y_um) + (a.x_um - b.x_um) * (a.x_um - b.x_um)) <= 60),
n AS (SELECT t.track_id, t.frame, list(o) FILTER (WHERE k <= 3) l FROM tracks t LEFT JOIN p ON p.frame = t.frame AND p.track_id = t.track_id GROUP BY 1, 2),
w AS (SELECT track_id, frame, coalesce(l, []) l, lag(coalesce(l, [])) OVER (PARTITION BY track_id ORDER BY frame) b FROM n)
SELECT track_id, frame, R(len(list_intersect(l, b)) / nullif(CAST(len(list_distinct(list_concat(l, b))) AS DOUBLE), 0)) jaccard FROM w WHERE b IS NOT NULL""",
)(lambda r: tracks.neighbour_persistence(r.tracks, 3, 60.0))
query("trk_records")(lambda r: tracks.records(r.tracks))
query("trk_object_growth", "SELECT track_id, R(regr_slope(area_um2, frame)) growth, count(*) n FROM tracks GROUP BY 1")(lambda r: tracks.records(r.tracks).select("track_id", "growth", F.size("frames").cast("long").alias("n")))
query(
    "trk_population_stats",
    "SELECT frame, CAST(sum(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END) AS BIGINT) n, R(avg(CASE WHEN event_type IN ('click', 'view') THEN 1.0 ELSE 0.0 END)) fraction, R(median(CASE WHEN event_type IN ('click', 'view') THEN area_um2 END)) median_area FROM tracks GROUP BY frame",
)(lambda r: tracks.population_stats(r.tracks, ["click", "view"]))
query("ser_photofading", "WITH f AS (SELECT series_id, min_by(ref, t) r FROM series GROUP BY 1) SELECT s.series_id, t, R(v) v, R(ref) AS ref, R(v * CASE WHEN ref > 0 AND r > 0 THEN r / ref ELSE 1 END) corrected FROM series s JOIN f ON s.series_id = f.series_id")(lambda r: tracks.photofading(r.series, "v", "ref"))
query("ser_taylor", "WITH f AS (SELECT series_id, min_by(v, t) i FROM series GROUP BY 1) SELECT s.series_id, t, R(v) v, R(ref) AS ref, R((v - i) / nullif(1000.0 - i, 0)) normalized FROM series s JOIN f ON s.series_id = f.series_id")(lambda r: tracks.taylor_normalized(r.series, "v", 1000.0))
query("ser_moving_average", "SELECT series_id, t, R(v) v, R(ref) AS ref, R(avg(v) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) smooth FROM series")(lambda r: tracks.moving_average(r.series, "v", 3))
query(
    "ser_coarsening",
    """WITH s AS (SELECT series_id, regr_slope(v, pow(t, 1/3.0)) k3, regr_r2(v, pow(t, 1/3.0)) r3, regr_slope(v, sqrt(t)) k2, regr_r2(v, sqrt(t)) r2 FROM series GROUP BY 1 HAVING count(*) >= 4)
SELECT series_id, CASE WHEN r3 >= r2 THEN 'ostwald' ELSE 'coalescence' END law, R(CASE WHEN r3 >= r2 THEN k3 ELSE k2 END) k, R(greatest(r3, r2)) r2 FROM s""",
)(lambda r: tracks.coarsening(r.series))
query(
    "ser_force_cycles",
    """WITH a AS (SELECT *, avg(v) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) s FROM series), g AS (SELECT *, sign(round(s - lag(s) OVER (PARTITION BY series_id ORDER BY t), 9)) g FROM a),
f AS (SELECT *, last_value(CASE WHEN g <> 0 THEN g END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) h FROM g), u AS (SELECT *, CASE WHEN h <> lag(h) OVER (PARTITION BY series_id ORDER BY t) THEN 1 ELSE 0 END u FROM f),
c AS (SELECT *, CAST(sum(u) OVER (PARTITION BY series_id ORDER BY t) AS BIGINT) seg FROM u) SELECT series_id, seg AS segment, count(*) n, min(t) t0, max(t) t1, R(max(v) - min(v)) span, CASE WHEN max(h) > 0 THEN 'stretch' ELSE 'relax' END kind FROM c GROUP BY 1, 2""",
)(lambda r: tracks.force_cycles(r.series))
query("ser_viscosity", "SELECT track_id, R(d) d, R(CASE WHEN d > 0 THEN 1.380649e-23 * 297.15 / (6 * pi() * 0.1e-6 * d * 1e-12) END) viscosity FROM (SELECT track_id, avg(area_um2) - 50 d FROM tracks GROUP BY 1)")(
    lambda r: tracks.viscosity(r.tracks.groupBy("track_id").agg((F.avg("area_um2") - 50).alias("d")), "d", 0.1)
)

# ---- points

_NN = "WITH p AS (SELECT a.cell, a.id, b.id AS o, sqrt(pow(a.y_um - b.y_um, 2) + pow(a.x_um - b.x_um, 2)) d FROM points a JOIN points b ON a.cell = b.cell AND a.id <> b.id)"
query("pts_nearest", f"{_NN}, n AS (SELECT cell, id, min(d) d FROM p GROUP BY 1, 2) SELECT cell, count(*) n, R(avg(d)) mean, R(median(d)) AS median, R(stddev_pop(d)) std, R(stddev_pop(d) / avg(d)) cv FROM n GROUP BY 1")(lambda r: spatial.nearest_neighbours(r.points))
query("pts_k_nearest", f"{_NN} SELECT cell, id, CAST(k AS INT) AS rank, o AS other, R(d) d FROM (SELECT *, row_number() OVER (PARTITION BY cell, id ORDER BY d, o) k FROM p) WHERE k <= 3")(lambda r: spatial.k_nearest(r.points, 3))
query(
    "pts_ripley",
    f"""{_NN}, n AS (SELECT cell, count(*) n FROM points GROUP BY 1 HAVING count(*) >= 3), r AS (SELECT unnest([5.0, 10.0, 20.0]) r), k AS (SELECT n.cell, r.r, area * (SELECT count(*) FROM p WHERE p.cell = n.cell AND d <= r.r) * (1 + r.r / sqrt(area / pi())) / (n * (n - 1)) k FROM n JOIN areas USING (cell), r)
SELECT cell, R(r) r, R(k) k, R(sqrt(k / pi())) l, R(sqrt(k / pi()) - r) l_minus_r FROM k""",
)(lambda r: spatial.ripley_l(r.points, r.areas, [5.0, 10.0, 20.0]))
query(
    "pts_pair_correlation",
    f"""{_NN}, n AS (SELECT cell, count(*) n FROM points GROUP BY 1), h AS (SELECT cell, CAST(floor(d / 4) AS INT) b, count(*) c FROM p WHERE d < 20 GROUP BY 1, 2)
SELECT n.cell, CAST(q.range AS INT) ring, R(CASE WHEN n > 1 THEN coalesce(c, 0) * area / (n * (n - 1) * pi() * 16 * (2 * q.range + 1)) END) g FROM n JOIN areas USING (cell), range(5) q LEFT JOIN h ON h.cell = n.cell AND h.b = q.range""",
)(lambda r: spatial.pair_correlation(r.points, r.areas, 4.0, 5))
query(
    "pts_grid_entropy",
    """WITH m AS (SELECT cell, min(y_um) y0, max(y_um) y1, min(x_um) x0, max(x_um) x1 FROM points GROUP BY 1), h AS (SELECT p.cell, least(9, floor((y_um - y0) * 10 / (y1 - y0))) a, least(9, floor((x_um - x0) * 10 / (x1 - x0))) b, count(*) c FROM points p JOIN m ON p.cell = m.cell GROUP BY 1, 2, 3)
SELECT cell, R(log2(sum(c)) - sum(c * log2(c)) / sum(c)) entropy, R((log2(sum(c)) - sum(c * log2(c)) / sum(c)) / log2(100)) normalized FROM h GROUP BY 1""",
)(lambda r: spatial.grid_entropy(r.points))
query(
    "pts_kernel_density",
    """WITH s AS (SELECT cell, count(*) n, var_samp(y_um) * pow(count(*), -1/3.0) vy, var_samp(x_um) * pow(count(*), -1/3.0) vx, covar_samp(y_um, x_um) * pow(count(*), -1/3.0) c FROM points GROUP BY 1 HAVING count(*) > 2),
p AS (SELECT a.cell, a.id, a.y_um - b.y_um dy, a.x_um - b.x_um dx FROM points a JOIN points b ON a.cell = b.cell) SELECT p.cell, id, R(sum(exp(-(vx * dy * dy - 2 * c * dy * dx + vy * dx * dx) / (vy * vx - c * c) / 2)) / max(2 * pi() * sqrt(vy * vx - c * c) * n)) density FROM p JOIN s ON p.cell = s.cell GROUP BY 1, 2""",
)(lambda r: spatial.kernel_density(r.points))
query(
    "pts_radial_localization",
    """WITH c AS (SELECT *, avg(y_um) OVER (PARTITION BY cell) cy, avg(x_um) OVER (PARTITION BY cell) cx FROM points), d AS (SELECT cell, sqrt(pow(y_um - cy, 2) + pow(x_um - cx, 2)) r FROM c), t AS (SELECT cell, r, max(r) OVER (PARTITION BY cell) m, count(*) OVER (PARTITION BY cell) n FROM d)
SELECT cell, CAST(floor(r * 10 / m) AS INT) bin, R(count(*) / CAST(max(n) AS DOUBLE)) AS share FROM t WHERE floor(r * 10 / m) < 10 GROUP BY 1, 2""",
)(lambda r: spatial.radial_localization(r.points))
query("pts_near_pairs", "SELECT a.cell, a.id a, b.id b, R(sqrt(pow(a.y_um - b.y_um, 2) + pow(a.x_um - b.x_um, 2))) d FROM points a JOIN points b ON a.cell = b.cell AND a.id < b.id WHERE sqrt(pow(a.y_um - b.y_um, 2) + pow(a.x_um - b.x_um, 2)) <= 6")(lambda r: graph.near_pairs(r.points, 6.0))
query(
    "pts_density_clusters",
    """WITH RECURSIVE p AS (SELECT a.id a, b.id b FROM points a JOIN points b ON a.cell = b.cell AND sqrt(pow(a.y_um - b.y_um, 2) + pow(a.x_um - b.x_um, 2)) <= 5), core AS (SELECT a FROM p GROUP BY a HAVING count(*) >= 3),
l AS (SELECT p.a, p.b FROM p JOIN core c ON p.a = c.a JOIN core d ON p.b = d.a), reach(a, b) AS (SELECT a, a FROM core UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a), cl AS (SELECT a, min(b) c FROM reach GROUP BY a),
bd AS (SELECT p.a, min(cl.c) c FROM p JOIN cl ON p.b = cl.a WHERE p.a NOT IN (SELECT a FROM core) GROUP BY p.a) SELECT id, cell, R(y_um) y_um, R(x_um) x_um, u.c AS cluster FROM points LEFT JOIN (SELECT * FROM cl UNION ALL SELECT * FROM bd) u ON id = u.a""",
)(lambda r: graph.density_clusters(r.points, 5.0, 3))
query(
    "img_label_mask",
    """WITH RECURSIVE m AS (SELECT img, y * 32 + x AS p FROM mask_few), e AS (SELECT a.img, a.p, b.p AS q FROM m a JOIN m b ON a.img = b.img AND abs(a.p // 32 - b.p // 32) <= 1 AND abs(a.p % 32 - b.p % 32) <= 1),
reach(img, p, r) AS (SELECT img, p, p FROM m UNION SELECT e.img, e.q, r.r FROM reach r JOIN e ON r.img = e.img AND r.p = e.p AND e.q > r.r), c AS (SELECT img, p, min(r) r FROM reach GROUP BY 1, 2)
SELECT img, CAST(p // 32 AS INT) y, CAST(p % 32 AS INT) x, CAST(dense_rank() OVER (PARTITION BY img ORDER BY r) AS INT) AS label FROM c""",
)(lambda r: graph.label_mask(r.mask("v1", 1.4), SIDE))
query(
    "img_radial_profile",
    """WITH g AS (SELECT i.img, CAST(k.range AS INT) k FROM (SELECT DISTINCT img FROM pixels) i, range(12) k), h AS (SELECT img, CAST(floor(sqrt(pow(y - 15.5, 2) + pow(x - 15.5, 2)) / 2) AS INT) k, avg(v1) m, stddev_pop(v1) s, count(*) n FROM pixels WHERE sqrt(pow(y - 15.5, 2) + pow(x - 15.5, 2)) < 24 GROUP BY 1, 2)
SELECT g.img, g.k AS ring, R(m) mean, R(s) std, coalesce(n, 0) n FROM g LEFT JOIN h ON g.img = h.img AND g.k = h.k""",
)(lambda r: spatial.radial_profile(r.channel("v1"), 15.5, 15.5, 12, 24.0))
query(
    "img_interface_width",
    """WITH h AS (SELECT img, CAST(floor(sqrt(pow(y - 15.5, 2) + pow(x - 15.5, 2)) / 2) AS INT) k, avg(v1) m FROM pixels WHERE sqrt(pow(y - 15.5, 2) + pow(x - 15.5, 2)) < 24 GROUP BY 1, 2), u AS (SELECT img, k, (m - min(m) OVER (PARTITION BY img)) / (max(m) OVER (PARTITION BY img) - min(m) OVER (PARTITION BY img)) u FROM h)
SELECT img, min(CASE WHEN u <= 0.8 THEN k END) r80, min(CASE WHEN u <= 0.5 THEN k END) r50, min(CASE WHEN u <= 0.2 THEN k END) r20, min(CASE WHEN u <= 0.2 THEN k END) - min(CASE WHEN u <= 0.8 THEN k END) AS width FROM u GROUP BY img""",
)(lambda r: spatial.interface_width(spatial.radial_profile(r.channel("v1"), 15.5, 15.5, 12, 24.0)))
query(
    "img_morans_i",
    """WITH d AS (SELECT p.img, y, x, v1 - m d FROM pixels p JOIN (SELECT img, avg(v1) m FROM pixels GROUP BY img) a ON p.img = a.img), w AS (SELECT a.img, sum(a.d * b.d) s, count(*) w FROM d a JOIN d b ON a.img = b.img AND ((a.y = b.y AND b.x = a.x + 1) OR (a.x = b.x AND b.y = a.y + 1)) GROUP BY 1), o AS (SELECT img, sum(d * d) q, count(*) n FROM d GROUP BY img)
SELECT w.img, R(n * 2 * s / (2 * w * q)) morans_i FROM w JOIN o ON w.img = o.img""",
)(lambda r: spatial.morans_i(r.channel("v1")))
query(
    "trk_linking_conditions",
    "WITH p AS (SELECT a.frame, a.track_id, min(sqrt(pow(a.y_um - b.y_um, 2) + pow(a.x_um - b.x_um, 2))) d FROM tracks a JOIN tracks b ON a.frame = b.frame AND a.track_id <> b.track_id GROUP BY 1, 2), f AS (SELECT frame, median(d) m FROM p GROUP BY 1), s AS (SELECT median(m) m FROM f) SELECT R(m) spacing, R(2.0 / m) r, CASE WHEN 2.0 / m < 0.3 THEN 'ok' WHEN 2.0 / m < 0.6 THEN 'ambiguous' ELSE 'unsafe' END AS level FROM s",
)(lambda r: spatial.linking_conditions(r.tracks, 2.0))

# ---- quality and identity

query("qc_saturation", "SELECT img, R(avg(CASE WHEN v1 >= 900 THEN 1.0 ELSE 0.0 END)) at_top, R(avg(CASE WHEN v1 = 0 THEN 1.0 ELSE 0.0 END)) at_zero, CASE WHEN avg(CASE WHEN v1 >= 900 THEN 1.0 ELSE 0.0 END) < 0.001 THEN 'good' WHEN avg(CASE WHEN v1 >= 900 THEN 1.0 ELSE 0.0 END) < 0.01 THEN 'warn' ELSE 'bad' END verdict FROM pixels GROUP BY img")(
    lambda r: qc.saturation(r.channel("v1"), 900.0)
)
query(
    "qc_signal_to_noise",
    """WITH n AS (SELECT a.img, median(abs(b.v1 - a.v1)) * 1.4826 / sqrt(2) n FROM pixels a JOIN pixels b ON a.img = b.img AND a.x = b.x AND b.y = a.y + 1 GROUP BY a.img), s AS (SELECT img, quantile_cont(v1, 0.95) - quantile_cont(v1, 0.05) s FROM pixels GROUP BY img)
SELECT s.img, R(s / n) snr, CASE WHEN s / n >= 10 THEN 'good' WHEN s / n >= 4 THEN 'warn' ELSE 'bad' END verdict FROM s JOIN n ON s.img = n.img""",
)(lambda r: qc.signal_to_noise(r.channel("v1")))
query("qc_nyquist", "SELECT p_partkey, R(p_size / 40.0 / (0.5 / (4 * 1.4))) ratio, CASE WHEN p_size / 40.0 / (0.5 / (4 * 1.4)) < 0.4 THEN 'oversampled' WHEN p_size / 40.0 / (0.5 / (4 * 1.4)) <= 1.05 THEN 'good' WHEN p_size / 40.0 / (0.5 / (4 * 1.4)) <= 2 THEN 'warn' ELSE 'bad' END verdict FROM part")(
    lambda r: qc.nyquist(r.table("part").select("p_partkey", (F.col("p_size") / 40).alias("px"), F.lit(0.5).alias("w"), F.lit(1.4).alias("na")), "px", "w", "na").select("p_partkey", "ratio", "verdict")
)
query("qc_time_sampling", "SELECT p_partkey, R(p_size / 12.5) ratio, CASE WHEN p_size / 12.5 <= 1 THEN 'good' WHEN p_size / 12.5 <= 2 THEN 'warn' ELSE 'bad' END verdict FROM part")(
    lambda r: qc.time_sampling(r.table("part").select("p_partkey", F.col("p_size").cast("double").alias("i"), F.lit(25.0).alias("s")), "i", "s").select("p_partkey", "ratio", "verdict")
)
_CAL = "WITH s AS (SELECT p_brand b, count(*) n, regr_slope(p_retailprice, p_size) k, regr_intercept(p_retailprice, p_size) i, regr_r2(p_retailprice, p_size) r, regr_syy(p_retailprice, p_size) y, min(p_size) lo, max(p_size) hi FROM part GROUP BY 1 HAVING count(*) >= 3)"
query("qc_calibration", f"{_CAL} SELECT b AS p_brand, n, R(k) slope, R(i) intercept, R(r) r2, R(sqrt(greatest(0, y * (1 - r)) / (n - 2))) residual_std, lo, hi FROM s")(lambda r: qc.calibration(r.table("part"), ["p_brand"], "p_size", "p_retailprice"))
query("qc_concentrations", f"{_CAL} SELECT p_partkey, R(k * (p_size + 10) + i) concentration, CASE WHEN p_size + 10 BETWEEN lo AND hi THEN 'calibrated' ELSE 'extrapolated' END status FROM part JOIN s ON p_brand = b")(
    lambda r: qc.concentrations(r.table("part").withColumn("p_size", F.col("p_size") + 10), qc.calibration(r.table("part"), ["p_brand"], "p_size", "p_retailprice"), ["p_brand"], "p_size").select("p_partkey", "concentration", "status")
)
query("qc_transfer_energy", "SELECT p_partkey, R(CASE WHEN p_size > 5 THEN -0.00198720425864083 * 298.15 * ln(p_retailprice / (p_size - 5)) END) delta_g FROM part")(
    lambda r: qc.transfer_energy(r.table("part").select("p_partkey", F.col("p_retailprice").alias("d"), (F.col("p_size") - 5).cast("double").alias("l")), "d", "l").select("p_partkey", "delta_g")
)
query("qc_pixel_size", "SELECT p_partkey, R(CASE WHEN p_size > 0 AND (p_size <> 1 OR p_partkey % 2 = 0) THEN sqrt(p_size) END) pixel_um FROM part")(
    lambda r: qc.pixel_size(r.table("part").select("p_partkey", F.col("p_size").cast("string").alias("s"), (F.col("p_partkey") % 2 == 0).alias("c")), "s", "c").select("p_partkey", "pixel_um")
)
query("qc_meaningful", "SELECT event_id, lower(trim(event_type)) NOT IN ('', 'none', 'null', 'nan', 'n/a', 'na', 'unknown') AND event_type IS NOT NULL AS ok FROM events")(lambda r: r.table("events").select("event_id", qc.meaningful(F.col("event_type")).alias("ok")))
query(
    "qc_reliability",
    """WITH f AS (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_size / 50.0 END a, CASE WHEN p_size % 5 <> 0 THEN 0.9 END b, p_size % 11 = 0 h FROM part), s AS (SELECT *, CASE WHEN h THEN 0 WHEN a IS NULL AND b IS NULL THEN NULL ELSE coalesce(a, 1) * coalesce(b, 1) END s FROM f)
SELECT p_partkey, R(s) score, CASE WHEN h THEN 'unreliable' WHEN s >= 0.85 THEN CASE WHEN a IS NULL THEN 'moderate' ELSE 'high' END WHEN s >= 0.6 THEN 'moderate' WHEN s >= 0.3 THEN 'low' ELSE 'unreliable' END grade, concat_ws(',', CASE WHEN a IS NULL THEN 'a' END, CASE WHEN b IS NULL THEN 'b' END) missing FROM s""",
)(
    lambda r: qc.reliability(
        r.table("part").select("p_partkey", F.when(F.col("p_size") % 7 != 0, F.col("p_size") / 50).alias("a"), F.when(F.col("p_size") % 5 != 0, F.lit(0.9)).alias("b"), (F.col("p_size") % 11 == 0).alias("h")), ["a", "b"], ["a"], "h"
    ).select("p_partkey", "score", "grade", "missing")
)
query("id_entities", "SELECT label, 'set1/segment/cell/-/' || parent || '/' || label AS entity_id, 'set2/segment/cell/-/' || parent || '/' || label AS moved FROM objects")(
    lambda r: r.objects.select("label", identity.entity_id(F.lit("set1"), "segment", "cell", F.col("label"), parent=F.col("parent")).alias("entity_id")).withColumn("moved", identity.migrate(F.col("entity_id"), "set1", "set2"))
)
query("id_active", "SELECT label, R(area) area FROM objects WHERE parent IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")(lambda r: identity.active(r.objects, r.table("customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("parent")), "parent").select("label", "area"))
query("id_children", "SELECT c_custkey, count(o_orderkey) n_children, min(o_orderkey) first_child, max(o_orderkey) last_child FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")(
    lambda r: identity.children_of(r.table("customer").select("c_custkey"), r.table("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("child")), ["c_custkey"])
)
query("id_tier", "SELECT p_partkey, CASE WHEN p_size = 1 THEN 'pinned' WHEN p_size < 10 THEN 'selected' WHEN p_size > 40 THEN 'excluded' ELSE 'filtered_in' END tier FROM part")(
    lambda r: r.table("part").select("p_partkey", identity.tier(F.col("p_size") == 1, F.col("p_size") < 10, F.col("p_size") > 40).alias("tier"))
)
query("id_stem", r"SELECT page_id, regexp_replace(string_split(url, '/')[-1], '\.[^.]*$', '') stem FROM pages")(lambda r: r.table("pages").select("page_id", identity.stem(F.col("url")).alias("stem")))
query(
    "id_attach_samples",
    "SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE n_name END), ''), CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, 'file') AS condition FROM customer JOIN nation ON c_nationkey = n_nationkey",
)(
    lambda r: identity.attach_samples(
        r.table("customer").select("c_custkey", F.col("c_custkey").cast("string").alias("stem"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("app_condition"), F.lit("file").alias("name_condition")),
        r.table("customer").join(r.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("dir/"), F.col("c_custkey").cast("string"), F.lit(".tif")).alias("stem"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("n_name")).alias("condition")),
        ["condition"],
    ).select("c_custkey", "condition")
)

# ---- kernels on planes, tracks and series, and what SQL cannot hold in time: no SQL


def _detections(r: Relations) -> DataFrame:
    return r.tracks.select(F.col("event_type").alias("img"), "frame", F.col("track_id").alias("object_id"), "y_um", "x_um", "area_um2")


#: A full grid, and sums along both axes with mirrored borders: what the separable kernels compute.
_GRID = f"grid AS (SELECT i.img, CAST(a.y AS INT) y, CAST(b.x AS INT) x, coalesce(p.v1, 0) v FROM (SELECT DISTINCT img FROM pixels) i, range({SIDE}) a(y), range({SIDE}) b(x) LEFT JOIN pixels p ON p.img = i.img AND p.y = a.y AND p.x = b.x)"


def _mirror(c: str) -> str:
    return f"(CASE WHEN {c} < 0 THEN -1 - ({c}) WHEN {c} >= {SIDE} THEN {2 * SIDE - 1} - ({c}) ELSE {c} END)"


def _along(name: str, of: str, kernel: str, axis: str) -> str:
    other = "x" if axis == "y" else "y"
    return f"{name} AS (SELECT g.img, g.y, g.x, sum(w * n.v) v FROM {of} g, {kernel} k, {of} n WHERE n.img = g.img AND n.{other} = g.{other} AND n.{axis} = {_mirror(f'g.{axis} + k.i')} GROUP BY 1, 2, 3)"


def _bell(name: str, sigma: float) -> str:
    r = max(1, int(4 * sigma + 0.5))
    return f"{name} AS (SELECT i, exp(-0.5 * i * i / {sigma * sigma}) / sum(exp(-0.5 * i * i / {sigma * sigma})) OVER () w FROM range({-r}, {r + 1}) t(i))"


def _smooth(name: str, of: str, kernel: str) -> str:
    return f"{_along(name + 'y', of, kernel, 'y')}, {_along(name, name + 'y', kernel, 'x')}"


_BOX = f"box AS (SELECT i, 1 / 9.0 w FROM range(-4, 5) t(i)), square AS (SELECT img, y, x, v * v v FROM grid), {_smooth('m', 'grid', 'box')}, {_smooth('q', 'square', 'box')}, st AS (SELECT m.img, m.y, m.x, m.v m, sqrt(greatest(q.v - m.v * m.v, 0)) s FROM m JOIN q ON m.img = q.img AND m.y = q.y AND m.x = q.x)"
_PLANES = {
    "gaussian": f"WITH {_GRID}, {_bell('k', 1.0)}, {_smooth('s', 'grid', 'k')} SELECT img, y, x, R(v) v FROM s",
    "dog": f"WITH {_GRID}, {_bell('k', 1.0)}, {_bell('l', 2.0)}, {_smooth('s', 'grid', 'k')}, {_smooth('t', 'grid', 'l')} SELECT s.img, s.y, s.x, R(s.v - t.v) v FROM s JOIN t ON s.img = t.img AND s.y = t.y AND s.x = t.x",
    "log": f"""WITH {_GRID}, {_bell('k', 1.5)}, d AS (SELECT i, w * (i * i / 5.0625 - 1 / 2.25) - avg(w * (i * i / 5.0625 - 1 / 2.25)) OVER () w FROM k),
{_along('a1', 'grid', 'd', 'y')}, {_along('a2', 'a1', 'k', 'x')}, {_along('b1', 'grid', 'k', 'y')}, {_along('b2', 'b1', 'd', 'x')} SELECT a2.img, a2.y, a2.x, R(a2.v + b2.v) v FROM a2 JOIN b2 ON a2.img = b2.img AND a2.y = b2.y AND a2.x = b2.x""",
    "median": f"WITH {_GRID} SELECT g.img, g.y, g.x, R(median(n.v)) v FROM grid g, range(-1, 2) a(i), range(-1, 2) b(j), grid n WHERE n.img = g.img AND n.y = {_mirror('g.y + i')} AND n.x = {_mirror('g.x + j')} GROUP BY 1, 2, 3",
    "niblack": f"WITH {_GRID}, {_BOX} SELECT g.img, g.y, g.x, R(CASE WHEN v > m + 0.5 * s THEN 1 ELSE 0 END) v FROM grid g JOIN st ON g.img = st.img AND g.y = st.y AND g.x = st.x",
    "sauvola": f"WITH {_GRID}, {_BOX}, r AS (SELECT img, (max(v) - min(v)) / 2 r FROM grid GROUP BY img) SELECT g.img, g.y, g.x, R(CASE WHEN v > m * (1 + 0.2 * (s / r - 1)) THEN 1 ELSE 0 END) v FROM grid g JOIN st ON g.img = st.img AND g.y = st.y AND g.x = st.x JOIN r ON r.img = g.img",
}
_AROUND = f"JOIN grid n ON n.img = g.img AND n.y = {_mirror('g.y + i')} AND n.x = {_mirror('g.x + j')}"
_PLANES |= {
    "local_contrast": f"WITH {_GRID}, {_bell('k', 4.0)}, {_smooth('s', 'grid', 'k')}, p AS (SELECT img, quantile_cont(v, 0.05) p FROM grid GROUP BY img) SELECT g.img, g.y, g.x, R(g.v / (s.v + p + 1e-6)) v FROM grid g JOIN s ON g.img = s.img AND g.y = s.y AND g.x = s.x JOIN p ON p.img = g.img",
    "bilateral": f"WITH {_GRID}, w AS (SELECT g.img, g.y, g.x, n.v, exp(-0.5 * (i * i + j * j) / 2.25) * exp(-0.5 * (n.v - g.v) * (n.v - g.v) / 2500) w FROM grid g CROSS JOIN range(-2, 3) a(i) CROSS JOIN range(-2, 3) b(j) {_AROUND}) SELECT img, y, x, R(sum(v * w) / sum(w)) v FROM w GROUP BY 1, 2, 3",
    "rolling_ball": f"""WITH {_GRID}, disk AS (SELECT i, j FROM range(-4, 5) a(i), range(-4, 5) b(j) WHERE i * i + j * j <= 16), e AS (SELECT g.img, g.y, g.x, min(n.v) v FROM grid g CROSS JOIN disk {_AROUND} GROUP BY 1, 2, 3),
d AS (SELECT g.img, g.y, g.x, max(n.v) v FROM e g CROSS JOIN disk {_AROUND.replace('JOIN grid n', 'JOIN e n')} GROUP BY 1, 2, 3) SELECT g.img, g.y, g.x, R(greatest(g.v - 0.75 * d.v, 0)) v FROM grid g JOIN d ON g.img = d.img AND g.y = d.y AND g.x = d.x""",
}
for _name in planes.FILTERS:
    query(f"plane_{_name}", _PLANES.get(_name))(lambda r, name=_name: planes.filtered(r.channel("v1"), name))
query("plane_thresholds")(lambda r: planes.thresholds(r.channel("v1")))
query("plane_segment")(lambda r: planes.segmented(planes.filtered(r.channel("v1"), "gaussian", sigma=1.5)))
query("plane_blobs")(lambda r: planes.blobs(r.channel("v1")))
query("plane_spots")(lambda r: planes.spots(planes.filtered(r.channel("v1"), "dog"), 1.0, 60.0))
query("plane_spectra")(lambda r: planes.spectra(r.channel("v1")))
query("plane_drifts")(lambda r: planes.drifts(r.stack))
query("coloc_block_shuffle_test")(lambda r: planes.block_shuffle_test(r.pixels))
query("trk_link_greedy")(lambda r: planes.link_greedy(_detections(r), 5.0))
query("trk_link_optimal")(lambda r: planes.link_optimal(_detections(r), 5.0))
query("ser_fit_recovery")(lambda r: planes.fitted(r.series, "recovery"))
query("ser_fit_decay")(lambda r: planes.fitted(r.series, "decay"))
query("obj_compare_conditions")(lambda r: planes.compared(r.objects.groupBy(F.lit("area").alias("measurement"), "condition", "replicate").agg(F.avg("area").alias("value")), ["measurement"], "condition"))

# ---- metadata

query("meta_template", r"SELECT page_id, nullif(regexp_extract(url, '^(https?)://([^/]+)/?([^?]*)', 1), '') scheme, nullif(regexp_extract(url, '^(https?)://([^/]+)/?([^?]*)', 2), '') host, nullif(regexp_extract(url, '^(https?)://([^/]+)/?([^?]*)', 3), '') path FROM pages")(
    lambda r: r.table("pages").select("page_id", *metadata.template_fields(F.col("url"), r"^(https?)://([^/]+)/?([^?]*)", ["scheme", "host", "path"]))
)
query("meta_key_values", "SELECT event_id, CAST(value AS INT) AS a, event_type b FROM (SELECT event_id, CAST(floor(value) AS INT) value, event_type FROM events)")(
    lambda r: r.table("events").select("event_id", metadata.key_values(F.concat(F.lit("a="), F.floor("value").cast("string"), F.lit("&b="), F.col("event_type"))).alias("m")).select("event_id", F.col("m")["a"].cast("int").alias("a"), F.col("m")["b"].alias("b"))
)
query("meta_elapsed", "WITH m AS (SELECT user_id, min(ts) t FROM events GROUP BY 1) SELECT event_id, R((epoch_us(ts) - epoch_us(t)) / 1e6) elapsed_s FROM events e JOIN m ON e.user_id = m.user_id")(lambda r: metadata.elapsed_seconds(r.table("events"), ["user_id"], "ts").select("event_id", "elapsed_s"))
query("meta_nearest_key", "SELECT track_id, frame, arg_min(k, abs(frame - k) * 1000 + k) AS key_frame FROM (SELECT t.track_id, t.frame, u.frame k FROM tracks t JOIN tracks u ON t.track_id = u.track_id AND u.frame % 10 = 0) GROUP BY 1, 2")(
    lambda r: metadata.nearest_key(r.tracks.select("track_id", "frame"), r.tracks.where("frame % 10 = 0").select("track_id", "frame"), "track_id", "frame")
)
query("meta_carried_forward", "SELECT track_id, frame, R(last_value(CASE WHEN frame % 5 = 0 THEN x_um END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) v FROM tracks")(
    lambda r: metadata.carried_forward(r.tracks.select("track_id", "frame", F.when(F.col("frame") % 5 == 0, F.col("x_um")).alias("v")), "track_id", "frame", "v")
)
query("meta_contradictions", "SELECT p_partkey, 2 severity, 'large and cheap' AS rule FROM part WHERE p_size > 40 AND p_retailprice < 1000 UNION ALL SELECT p_partkey, 1, 'small' FROM part WHERE p_size < 5")(
    lambda r: metadata.contradictions(r.table("part"), [("large and cheap", 2, (F.col("p_size") > 40) & (F.col("p_retailprice") < 1000)), ("small", 1, F.col("p_size") < 5)], "p_partkey")
)
query("meta_layers", "SELECT p_partkey, 'ambiguous' state FROM part WHERE p_brand IN (SELECT min(p_brand) FROM part) AND p_size = 7 AND (SELECT count(*) FROM part WHERE p_brand IN (SELECT min(p_brand) FROM part) AND p_size = 7) > 1 UNION ALL SELECT p_partkey, 'certain' FROM part WHERE p_brand IN (SELECT min(p_brand) FROM part) AND p_size = 7 AND (SELECT count(*) FROM part WHERE p_brand IN (SELECT min(p_brand) FROM part) AND p_size = 7) = 1")(
    lambda r: metadata.matching_layers(r.table("part").select("p_partkey", F.create_map(F.lit("brand"), F.when(F.col("p_brand") == r.table("part").agg(F.min("p_brand")).scalar(), "first").otherwise("other"), F.lit("size"), F.col("p_size").cast("string")).alias("tags")), {"brand": ["first"], "size": ["7"]}).select("p_partkey", "state")
)
query("meta_controls", "SELECT p_partkey, coalesce(abs(p_size - 20) <= 0.5 * greatest(p_size, 20), true) AS comparable FROM part")(
    lambda r: metadata.controls_comparable(r.table("part").select("p_partkey", F.col("p_size").alias("pos_gain"), F.lit(20).alias("neg_gain"), F.lit(None).cast("double").alias("pos_exposure"), F.lit(1.0).alias("neg_exposure")), ["gain", "exposure"], 0.5).select("p_partkey", "comparable")
)
query(
    "meta_stability",
    """WITH s AS (SELECT l_orderkey, max(l_quantity) - min(l_quantity) s, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) b FROM lineitem GROUP BY 1), r AS (SELECT l_orderkey, s / nullif(abs(b), 0) r FROM s)
SELECT l_orderkey, R(r) relative_range, CASE WHEN r <= 0.1 THEN 'stable' WHEN r <= 0.3 THEN 'sensitive' WHEN r IS NOT NULL THEN 'unstable' END verdict FROM r""",
)(lambda r: metadata.stability(r.table("lineitem"), ["l_orderkey"], "l_linenumber", "l_quantity", 1.0))

# ---- further objects, checks and series

query(
    "obj_expand_labels",
    f"""WITH o AS (SELECT a.range - 2 dy, b.range - 2 dx FROM range(5) a, range(5) b WHERE (a.range - 2) * (a.range - 2) + (b.range - 2) * (b.range - 2) <= 4), n AS (SELECT img, CAST(y + dy AS INT) y, CAST(x + dx AS INT) x, dy * dy + dx * dx d, label FROM labels_few, o)
SELECT img, y, x, CAST(arg_min(label, d * 10000 + label) AS INT) AS label FROM n WHERE y BETWEEN 0 AND {SIDE - 1} AND x BETWEEN 0 AND {SIDE - 1} GROUP BY 1, 2, 3""",
)(lambda r: objects.expand_labels(r.labels("v1", 1.4, 4), 2, SIDE, SIDE))
query(
    "obj_transfected",
    """WITH f AS (SELECT p.img, quantile_cont(v1, 0.25) q, stddev_pop(CASE WHEN l.img IS NULL THEN v1 END) s FROM pixels p LEFT JOIN labels_few l ON p.img = l.img AND p.y = l.y AND p.x = l.x GROUP BY p.img),
c AS (SELECT l.img, l.label, (avg(v1) - max(q)) / max(s) s FROM labels_few l JOIN pixels p ON p.img = l.img AND p.y = l.y AND p.x = l.x JOIN f ON f.img = l.img GROUP BY 1, 2)
SELECT img, label, R(s) score, s >= 4 AS kept, R(avg(CASE WHEN s >= 4 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY img)) efficiency FROM c""",
)(lambda r: objects.transfected(r.labels("v1", 1.4, 4), r.channel("v1"), 4.0))
query("obj_relabel_by_track", "SELECT img, t, y, x, CAST(CASE WHEN label % 3 = 0 THEN label * 10 + 1 ELSE 0 END AS INT) AS label FROM frame_labels")(
    lambda r: objects.relabel_by_track(r.frame_labels, r.frame_labels.where("label % 3 = 0").select("img", F.col("t").alias("frame"), F.col("label").alias("object_id"), (F.col("label") * 10).alias("track_id")).distinct())
)
query(
    "obj_field_trajectories",
    """WITH f AS (SELECT s.img, s.t, avg(CASE WHEN l.img IS NOT NULL THEN v END) d, avg(CASE WHEN l.img IS NULL THEN v END) u, count(l.img) / CAST(count(*) AS DOUBLE) a FROM stack s LEFT JOIN frame_labels l ON s.img = l.img AND s.t = l.t AND s.y = l.y AND s.x = l.x GROUP BY 1, 2),
q AS (SELECT img, t, label, sqrt(count(*) / pi()) r FROM frame_labels GROUP BY 1, 2, 3), m AS (SELECT img, t, count(*) n, avg(r) r, median(r) d FROM q GROUP BY 1, 2)
SELECT f.img, f.t, R(f.d) dense, R(u) dilute, R(a) area_fraction, coalesce(n, 0) n, R(r) mean_radius, R(m.d) median_radius FROM f LEFT JOIN m ON f.img = m.img AND f.t = m.t""",
)(lambda r: objects.field_trajectories(r.frame_labels, r.stack))
query("obj_volumes", "SELECT img, label, count(*) voxels, count(DISTINCT t) slices, R((max(t) - min(t) + 1) * 0.3) height_um, R(count(*) * 0.25 * 0.3) volume_um3 FROM frame_labels GROUP BY 1, 2")(lambda r: objects.volumes(r.frame_labels, 0.5, 0.3))
query(
    "obj_texture",
    "SELECT l.img, label, R(stddev_pop(v1) / avg(v1)) cov, R(stddev_pop(v1) / nullif(max(v1) - min(v1), 0)) roughness, R((max(v1) - min(v1)) / (max(v1) + min(v1))) contrast FROM labels_1 l JOIN pixels p ON l.img = p.img AND l.y = p.y AND l.x = p.x GROUP BY 1, 2",
)(lambda r: objects.texture(r.labels("v1"), r.channel("v1")))
query(
    "img_local_variance_ratio",
    "WITH n AS (SELECT a.img, a.y, a.x, var_pop(b.v1) s FROM pixels a JOIN pixels b ON a.img = b.img AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2, 3), l AS (SELECT img, avg(s) s FROM n GROUP BY 1), g AS (SELECT img, var_pop(v1) v FROM pixels GROUP BY 1) SELECT l.img, R(s / v) ratio FROM l JOIN g ON l.img = g.img",
)(lambda r: spatial.local_variance_ratio(r.channel("v1")))
query(
    "img_morans_headroom",
    """WITH d AS (SELECT p.img, y, x, v1 - m d FROM pixels p JOIN (SELECT img, avg(v1) m FROM pixels GROUP BY img) a ON p.img = a.img), w AS (SELECT a.img, sum(a.d * b.d) s, count(*) w FROM d a JOIN d b ON a.img = b.img AND ((a.y = b.y AND b.x = a.x + 1) OR (a.x = b.x AND b.y = a.y + 1)) GROUP BY 1), o AS (SELECT img, sum(d * d) q, count(*) n FROM d GROUP BY img),
h AS (SELECT w.img, 1 - n * s / (w * q) h FROM w JOIN o ON w.img = o.img) SELECT img, R(h) headroom, CASE WHEN h < 0.02 THEN 'saturated' WHEN h < 0.15 THEN 'close' ELSE 'usable' END state FROM h""",
)(lambda r: spatial.headroom(spatial.morans_i(r.channel("v1"))))
query(
    "qc_edge_width",
    """WITH g AS (SELECT a.img, sqrt(pow((s.v1 - n.v1) / 2, 2) + pow((e.v1 - w.v1) / 2, 2)) g FROM pixels a JOIN pixels s ON s.img = a.img AND s.y = a.y + 1 AND s.x = a.x JOIN pixels n ON n.img = a.img AND n.y = a.y - 1 AND n.x = a.x JOIN pixels e ON e.img = a.img AND e.y = a.y AND e.x = a.x + 1 JOIN pixels w ON w.img = a.img AND w.y = a.y AND w.x = a.x - 1),
q AS (SELECT img, quantile_cont(g, 0.999) g FROM g GROUP BY 1), d AS (SELECT img, quantile_cont(v1, 0.995) - quantile_cont(v1, 0.005) d FROM pixels GROUP BY 1) SELECT d.img, R(d / (g * sqrt(2 * pi()))) edge_width_px FROM d JOIN q ON d.img = q.img""",
)(lambda r: qc.edge_width(r.channel("v1")))
query(
    "qc_vignetting",
    f"""WITH b AS (SELECT img, least(23, floor(sqrt(pow(y - {(SIDE - 1) / 2}, 2) + pow(x - {(SIDE - 1) / 2}, 2)) / sqrt(2 * pow({(SIDE - 1) / 2}, 2)) * 24)) b, avg(v1) m FROM pixels GROUP BY 1, 2), r AS (SELECT img, arg_max(m, b) / arg_min(m, b) r FROM b GROUP BY 1)
SELECT img, R(r) ratio, CASE WHEN r >= 0.9 THEN 'good' WHEN r >= 0.7 THEN 'warn' ELSE 'bad' END verdict FROM r""",
)(lambda r: qc.vignetting(r.channel("v1"), SIDE, SIDE))
query("qc_frame_adequacy", "WITH f AS (SELECT img, count(DISTINCT t) n FROM stack GROUP BY 1) SELECT img, n AS frames, R(sqrt(2.0 / (n - 1))) relative_error, CASE WHEN n < 4 THEN 'none' WHEN n < 16 THEN 'unreliable' WHEN n < 64 THEN 'usable' WHEN n < 256 THEN 'recommended' ELSE 'well sampled' END AS level FROM f")(lambda r: qc.frame_adequacy(r.stack))
query(
    "trk_without_outliers",
    """WITH d AS (SELECT track_id, pow(y_um - lag(y_um) OVER w, 2) + pow(x_um - lag(x_um) OVER w, 2) d FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY frame)), l AS (SELECT track_id, ln(avg(d)) l FROM d GROUP BY 1 HAVING avg(d) > 0), m AS (SELECT median(l) m FROM l), a AS (SELECT median(abs(l - m)) a FROM l, m)
SELECT track_id, count(*) n FROM tracks WHERE track_id NOT IN (SELECT track_id FROM l, m, a WHERE (l - m) / (1.4826 * a) < -1.5 OR (l - m) / (1.4826 * a) > 1) GROUP BY 1""",
)(lambda r: tracks.without_outlier_tracks(r.tracks, 8, 1.5, 1.0).groupBy("track_id").agg(F.count(F.lit(1)).alias("n")))
query(
    "ser_step_variance",
    "WITH d AS (SELECT series_id, t, v, lag(v) OVER (PARTITION BY series_id ORDER BY t) - v d FROM series), s AS (SELECT series_id, var_samp(d) / nullif(abs(avg(d)), 0) u, arg_min(v, t) f FROM d GROUP BY 1) SELECT series_id, R(u) unit, R(f / u) molecules FROM s",
)(lambda r: tracks.step_variance_count(r.series))
query(
    "trk_shear_moduli",
    f"""{_MSD}, e AS (SELECT lag * 0.1 tau, avg(msd) msd FROM p GROUP BY lag), s AS (SELECT tau, msd, ln(tau) x, ln(msd) y FROM e), n AS (SELECT *, lag(x) OVER (ORDER BY tau) x0, lead(x) OVER (ORDER BY tau) x2, lag(y) OVER (ORDER BY tau) y0, lead(y) OVER (ORDER BY tau) y2 FROM s),
a AS (SELECT tau, msd, ((x - x0) * (y2 - y) / (x2 - x) + (x2 - x) * (y - y0) / (x - x0)) / (x2 - x0) a FROM n WHERE x0 IS NOT NULL AND x2 IS NOT NULL), g AS (SELECT *, 1.380649e-23 * 297.15 / (pi() * 0.1e-6 * msd * 1e-12 * 3 / 2 * gamma(1 + a)) g FROM a)
SELECT R(tau) tau_s, R(1 / tau) omega, R(a) alpha, R(g * cos(pi() * a / 2)) g_storage, R(g * sin(pi() * a / 2)) g_loss FROM g""",
)(lambda r: tracks.shear_moduli(tracks.msd(r.tracks, 12, 20, 0.1), 0.1))
query(
    "ser_transitions",
    """WITH c AS (SELECT series_id, t, 40 - abs(t - 300) / 10.0 temp, v FROM series), k AS (SELECT series_id, arg_max(t, temp * 100000 - t) s, min(v) lo, max(v) hi FROM c GROUP BY 1), o AS (SELECT c.*, s FROM c JOIN k ON c.series_id = k.series_id WHERE v >= lo + 0.5 * (hi - lo)),
r AS (SELECT series_id, arg_min(temp, CASE WHEN t <= s THEN t END) h, arg_max(temp, CASE WHEN t > s THEN t END) c FROM o GROUP BY 1) SELECT series_id, R(h) heating, R(c) cooling, R(h - c) hysteresis FROM r""",
)(lambda r: tracks.transitions(r.series.withColumn("temperature", 40 - F.abs(F.col("t") - 300) / 10.0), 0.5))


from . import measures  # noqa: E402, F401  registers its queries
