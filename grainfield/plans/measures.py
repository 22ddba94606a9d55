"""Queries per cell, per frame, of lines, records and models, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cells, objects, planes, records, tracks
from ..sources.views import SIDE, Relations
from .catalog import query

_STACK2 = """stack2 AS (SELECT l_returnflag img, CAST(l_linenumber - 1 AS INT) t, CAST(l_orderkey % 8 AS INT) y, CAST(l_partkey % 8 AS INT) x, sum(l_quantity) v1, sum(floor(l_extendedprice / 1000)) v2 FROM lineitem GROUP BY 1, 2, 3, 4)"""


def _stack2(r: Relations) -> DataFrame:
    """img, t, y, x, v1, v2: two channels of each frame, sums of integers."""
    y, x = (F.col("l_orderkey") % 8).cast("int").alias("y"), (F.col("l_partkey") % 8).cast("int").alias("x")
    return r.table("lineitem").groupBy(F.col("l_returnflag").alias("img"), (F.col("l_linenumber") - 1).cast("int").alias("t"), y, x).agg(F.sum("l_quantity").alias("v1"), F.sum(F.floor(F.col("l_extendedprice") / 1000)).cast("double").alias("v2"))


# ---- cells and frames

query(
    "cell_enrichment",
    """WITH i AS (SELECT p.img, p.y, p.x, p.v1 v, b.label cell, l.label FROM pixels p JOIN labels_big b ON p.img = b.img AND p.y = b.y AND p.x = b.x LEFT JOIN labels_few l ON p.img = l.img AND p.y = l.y AND p.x = l.x),
w AS (SELECT img, cell, count(DISTINCT label) n, avg(CASE WHEN label IS NOT NULL THEN v END) d, avg(CASE WHEN label IS NULL THEN v END) u FROM i GROUP BY 1, 2),
s AS (SELECT DISTINCT l.img, l.label, i.cell, i.y, i.x, i.v FROM labels_few l JOIN i ON l.img = i.img AND i.label IS NULL AND abs(i.y - l.y) + abs(i.x - l.x) <= 2),
g AS (SELECT img, cell, label, avg(v) r FROM s GROUP BY 1, 2, 3), o AS (SELECT l.img, l.label, avg(v1) m FROM labels_few l JOIN pixels p ON l.img = p.img AND l.y = p.y AND l.x = p.x GROUP BY 1, 2),
h AS (SELECT img, cell, median(CASE WHEN r > 0 THEN m / r END) e FROM (SELECT DISTINCT img, cell, label FROM i WHERE label IS NOT NULL) JOIN g USING (img, cell, label) JOIN o USING (img, label) GROUP BY 1, 2)
SELECT img, cell, n, R(CASE WHEN u > 0 THEN d / u END) enrichment, R(e) median_enrichment, R(d) dense_mean, R(u) dilute_mean FROM w LEFT JOIN h USING (img, cell)""",
)(lambda r: cells.cell_enrichment(r.labels("v1", 1.4, 4), r.labels("v1", 0.8, 16), r.channel("v1"), 2))
query(
    "cell_summary",
    """WITH c AS (SELECT img, label cell, count(*) * 0.25 a FROM labels_big GROUP BY 1, 2), o AS (SELECT l.img, b.label cell, l.label, count(*) * 0.25 a FROM labels_few l JOIN labels_big b ON l.img = b.img AND l.y = b.y AND l.x = b.x GROUP BY 1, 2, 3),
s AS (SELECT img, cell, count(*) n, sum(a) t, avg(a) m FROM o GROUP BY 1, 2)
SELECT img, cell, R(a) cell_um2, coalesce(n, 0) n, R(coalesce(t, 0)) objects_um2, R(coalesce(t, 0) / a) coverage, R(sqrt(coalesce(m, 0) / pi())) mean_radius_um FROM c LEFT JOIN s USING (img, cell)""",
)(lambda r: cells.cell_summary(r.labels("v1", 1.4, 4), r.labels("v1", 0.8, 16), 0.5))
query(
    "cell_fractals",
    """WITH o AS (SELECT l.img, b.label cell, l.label, l.y, l.x FROM labels_1 l JOIN labels_big b ON l.img = b.img AND l.y = b.y AND l.x = b.x), z AS (SELECT unnest([2, 4, 8, 16]) s),
w AS (SELECT img, cell, regr_slope(ln(n), ln(1.0 / s)) cell_dimension FROM (SELECT img, cell, s, count(*) n FROM (SELECT DISTINCT img, cell, s, y // s, x // s FROM o, z) GROUP BY 1, 2, 3) GROUP BY 1, 2),
k AS (SELECT img, cell, label, count(*) px, min(y) y0, min(x) x0, max(y) - min(y) + 1 h, max(x) - min(x) + 1 w FROM o GROUP BY 1, 2, 3 HAVING count(*) >= 16),
e AS (SELECT img, cell, label, CASE WHEN count(*) > 1 THEN regr_slope(ln(n), ln(1.0 / s)) END d FROM (SELECT img, cell, label, s, count(*) n FROM (SELECT DISTINCT o.img, o.cell, o.label, s, (y - y0) // s, (x - x0) // s FROM o JOIN k USING (img, cell, label), z
 WHERE s <= pow(2, floor(log2(least(h, w))) - 1) AND y - y0 < (h // s) * s AND x - x0 < (w // s) * s) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
t AS (SELECT img, cell, avg(d) m, stddev_pop(d) sd, avg(px) a, count(*) n FROM k LEFT JOIN e USING (img, cell, label) GROUP BY 1, 2)
SELECT img, cell, total_area, R(cell_dimension) cell_dimension, R(m) mean_dimension, R(sd) std_dimension, R(a) mean_area, coalesce(n, 0) n FROM (SELECT img, cell, count(*) total_area FROM o GROUP BY 1, 2) LEFT JOIN w USING (img, cell) LEFT JOIN t USING (img, cell)""",
)(lambda r: cells.cell_fractals(r.labels("v1"), r.labels("v1", 0.8, 16), SIDE))
query(
    "cell_outside_statistics",
    """WITH o AS (SELECT p.img, p.v1 v, l.img IS NULL AS free FROM pixels p LEFT JOIN labels_1 l ON p.img = l.img AND p.y = l.y AND p.x = l.x), s AS (SELECT img, sum(CASE WHEN free THEN 1 ELSE 0 END) n, quantile_cont(v, 0.25) p FROM o GROUP BY img),
b AS (SELECT o.img, v FROM o JOIN s ON o.img = s.img WHERE CASE WHEN n >= 100 THEN free ELSE v <= p END), m AS (SELECT img, median(v) m, stddev_pop(v) s FROM b GROUP BY img),
d AS (SELECT b.img, 1.4826 * median(abs(v - m)) d FROM b JOIN m ON b.img = m.img GROUP BY b.img)
SELECT img, R(m) AS level, R(CASE WHEN d > 0 THEN d ELSE greatest(s, 1e-6) END) noise FROM m JOIN d USING (img)""",
)(lambda r: cells.outside_statistics(r.channel("v1"), r.labels("v1"), 100))
query(
    "cell_background_region",
    """WITH o AS (SELECT p.img, p.v1 v, a.img IS NOT NULL AS r, b.img IS NOT NULL AS d FROM pixels p LEFT JOIN mask_2 a ON p.img = a.img AND p.y = a.y AND p.x = a.x LEFT JOIN mask_few b ON p.img = b.img AND p.y = b.y AND p.x = b.x),
s AS (SELECT img, avg(CASE WHEN r THEN v END) region, avg(CASE WHEN NOT r AND NOT d THEN v END) dilute FROM o GROUP BY img) SELECT img, R(region) region, R(dilute) dilute, coalesce(dilute > 0 AND region >= 0.8 * dilute, false) suspect FROM s""",
)(lambda r: cells.background_region(r.channel("v1"), r.mask("v2"), r.mask("v1", 1.4)))
query(
    "frame_shapes",
    """WITH m AS (SELECT img, t, label, avg(y) cy, avg(x) cx, count(*) n, min(y) y0, max(y) y1, min(x) x0, max(x) x1, var_pop(y) + 1 / 12.0 vy, var_pop(x) + 1 / 12.0 vx, covar_pop(y, x) c FROM frame_labels GROUP BY 1, 2, 3),
g AS (SELECT *, sqrt((vy - vx) * (vy - vx) + 4 * c * c) r FROM m), a AS (SELECT *, 4 * sqrt((vy + vx + r) / 2) major, 4 * sqrt(greatest(0.0, (vy + vx - r) / 2)) minor FROM g)
SELECT img, t, label, R(cy * 0.5) y_um, R(cx * 0.5) x_um, R(n * 0.25) area_um2, R(round(major * 0.5, 5)) major_um, R(round(minor * 0.5, 5)) minor_um, R(round(sqrt(greatest(0.0, 1 - minor * minor / (major * major))), 4)) eccentricity, y0, x0, y1, x1 FROM a""",
)(lambda r: cells.shape(r.frame_labels, ["img", "t"], 0.5).withColumns({"major_um": F.round("major_um", 5), "minor_um": F.round("minor_um", 5), "eccentricity": F.round("eccentricity", 4)}))
query(
    "img_lacunarity",
    f"""WITH z AS (SELECT unnest([2, 4, 8, 5]) s), g AS (SELECT img, s, y, x FROM (SELECT DISTINCT img FROM mask_1), z, range({SIDE}) a(y), range({SIDE}) b(x) WHERE y < {SIDE} - s + s % 2 AND x < {SIDE} - s + s % 2),
b AS (SELECT g.img, s, g.y, g.x, count(m.img) m FROM g LEFT JOIN mask_1 m ON g.img = m.img AND m.y >= g.y AND m.y < g.y + s AND m.x >= g.x AND m.x < g.x + s GROUP BY 1, 2, 3, 4)
SELECT img, CAST(s AS INT) box_size, R(avg(CAST(m AS DOUBLE) * m) / (avg(CAST(m AS DOUBLE)) * avg(CAST(m AS DOUBLE)))) lacunarity FROM b GROUP BY 1, 2""",
)(lambda r: cells.lacunarity(r.mask("v1"), SIDE, SIDE, [2, 4, 8, 5]))
query(
    "img_line_profile",
    """WITH s AS (SELECT k AS pos, j, 4 + 0.6 * k + 0.8 * (j - 1) y, 3 + 0.8 * k - 0.6 * (j - 1) x FROM range(0, 21) a(k), range(0, 3) b(j)),
w AS (SELECT pos, j, CAST(floor(y) AS INT) + dy y, CAST(floor(x) AS INT) + dx x, (1 - abs(y - floor(y) - dy)) * (1 - abs(x - floor(x) - dx)) w FROM s, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx)),
n AS (SELECT * FROM w WHERE w > 1e-12), c AS (SELECT pos, count(*) need FROM n GROUP BY pos), o AS (SELECT img, pos, j, sum(v1 * w) v, count(*) have FROM pixels p JOIN n ON p.y = n.y AND p.x = n.x GROUP BY 1, 2, 3)
SELECT img, CAST(o.pos AS INT) pos, R(avg(v)) v FROM o JOIN c ON o.pos = c.pos GROUP BY img, o.pos, need HAVING sum(have) = need""",
)(lambda r: cells.line_profile(r.channel("v1"), (4.0, 3.0, 16.0, 19.0), 3))
_LINE = "l AS (SELECT img, t, x AS pos, {0} FROM {1} WHERE y = 3 AND x BETWEEN 1 AND 6)"
query("stack_kymograph", f"WITH {_LINE.format('v', 'stack')} SELECT img, t, pos - 1 AS pos, R(v) v FROM l")(lambda r: cells.line_profile(r.stack, (3.0, 1.0, 3.0, 6.0), 1, "max", ["img", "t"]))
query("stack_kymograph_correlation", f"WITH {_STACK2}, {_LINE.format('v1, v2', 'stack2')} SELECT img, t, R(corr(v1, v2)) pearson, count(*) n FROM l GROUP BY 1, 2")(lambda r: cells.kymograph_correlation(_stack2(r), (3.0, 1.0, 3.0, 6.0), "v1", "v2"))
_SEAMS = """d AS (SELECT a.img, a.t, a.x, avg(abs(a.v - b.v)) d FROM stack a JOIN stack b ON a.img = b.img AND a.t = b.t AND a.y = b.y AND a.x = b.x + 1 GROUP BY 1, 2, 3),
o AS (SELECT a.img, a.t, a.x, a.d, count(b.d) n, median(b.d) m, stddev_pop(b.d) s FROM d a LEFT JOIN d b ON a.img = b.img AND a.t = b.t AND a.x <> b.x AND abs(a.x - b.x) <= 3 GROUP BY 1, 2, 3, 4),
z AS (SELECT img, t, x, CASE WHEN n >= 3 THEN (d - m) / (s + 1e-12) ELSE 0 END z FROM o)"""
query("stack_seams", f"WITH {_SEAMS} SELECT img, t, x, R(z) z, z >= 1.5 AS seam FROM z")(lambda r: cells.column_seams(r.stack, ["img", "t"], 3, 1.5))
query("stack_persistent_seams", f"WITH {_SEAMS} SELECT img, x, R(avg(CASE WHEN z >= 1.5 THEN 1.0 ELSE 0.0 END)) AS share, avg(CASE WHEN z >= 1.5 THEN 1.0 ELSE 0.0 END) >= 0.4 AS persistent FROM z GROUP BY 1, 2")(
    lambda r: cells.persistent_seams(cells.column_seams(r.stack, ["img", "t"], 3, 1.5), 0.4)
)
query(
    "stack_coefficients",
    f"""WITH {_STACK2}, m AS (SELECT img, t, avg(v1) a, avg(v2) b FROM stack2 GROUP BY 1, 2)
SELECT s.img, s.t, R(corr(v1, v2)) pearson, R(sum(v1 * v2) / sqrt(sum(v1 * v1) * sum(v2 * v2))) overlap, R(sum(CASE WHEN v2 > b THEN v1 END) / sum(v1)) m1, R(sum(CASE WHEN v1 > a THEN v2 END) / sum(v2)) m2 FROM stack2 s JOIN m ON s.img = m.img AND s.t = m.t GROUP BY 1, 2""",
)(lambda r: cells.frame_coefficients(_stack2(r)))
query(
    "stack_object_overlap",
    """WITH b AS (SELECT img, t, y, x, y // 2 AS label FROM stack WHERE v % 3 = 0), h AS (SELECT DISTINCT a.img, a.t, a.label FROM frame_labels a JOIN b USING (img, t, y, x)),
a AS (SELECT o.img, o.t, count(*) n_a, count(h.label) n_touching FROM (SELECT DISTINCT img, t, label FROM frame_labels) o LEFT JOIN h USING (img, t, label) GROUP BY 1, 2), c AS (SELECT img, t, count(DISTINCT label) n_b FROM b GROUP BY 1, 2)
SELECT img, t, coalesce(n_a, 0) n_a, coalesce(n_b, 0) n_b, coalesce(n_touching, 0) n_touching, R(n_touching / CAST(n_a AS DOUBLE)) AS share FROM a FULL JOIN c USING (img, t)""",
)(lambda r: cells.frame_object_overlap(r.frame_labels, r.stack.where("v % 3 = 0").select("img", "t", "y", "x", F.floor(F.col("y") / 2).alias("label"))))
query(
    "stack_trend_preservation",
    f"""WITH {_STACK2}, f AS (SELECT img, t, avg(v1) a, avg(v2) b FROM stack2 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY a, t) ra, row_number() OVER (PARTITION BY img ORDER BY b, t) rb,
sign(a - lag(a) OVER w) = sign(b - lag(b) OVER w) AS same FROM f WINDOW w AS (PARTITION BY img ORDER BY t)) SELECT img, R(corr(ra, rb)) spearman, R(corr(a, b)) pearson, R(avg(CAST(same AS INT))) steps FROM k GROUP BY img""",
)(lambda r: cells.trend_preservation(_stack2(r).groupBy("img", "t").agg(F.avg("v1").alias("a"), F.avg("v2").alias("b")), ["img"], "a", "b"))
query(
    "stack_bleach_corrected",
    "SELECT img, t, y, x, R(CASE WHEN t < 5 THEN least(1.0, greatest(0.0, v / 1000 * (1 + t / 10.0))) ELSE v / 1000 END) v FROM stack",
)(lambda r: cells.bleach_corrected(r.stack.withColumn("v", F.col("v") / 1000), r.stack.select("img", "t").distinct().where("t < 5").withColumn("factor", 1 + F.col("t") / 10)))
for _how, _sql in (("or", "greatest(coalesce(v1, 0), coalesce(c, 0))"), ("add", "coalesce(v1, 0) + coalesce(c, 0)"), ("replace", "coalesce(c, v1)")):
    query(f"px_stitch_{_how}", f"WITH k AS (SELECT p.img, p.y, p.x, v2 * 2 c FROM pixels p JOIN mask_1 m ON p.img = m.img AND p.y = m.y AND p.x = m.x) SELECT img, y, x, R({_sql}) v FROM pixels FULL JOIN k USING (img, y, x)")(
        lambda r, how=_how: cells.stitched(r.channel("v1"), r.pixels.join(r.mask("v1"), ["img", "y", "x"]).select("img", "y", "x", (F.col("v2") * 2).alias("v")), how)
    )
query("obj_renumbered", "SELECT l.img, l.y, l.x, CAST(n AS INT) label FROM labels_few l JOIN (SELECT img, label, row_number() OVER (PARTITION BY img ORDER BY label) + 10 n FROM (SELECT DISTINCT img, label FROM labels_few)) USING (img, label)")(
    lambda r: cells.renumbered(r.labels("v1", 1.4, 4), 10)
)
query(
    "px_bands",
    """WITH e AS (SELECT img, quantile_cont(v1, 0.25) a, quantile_cont(v1, 0.5) b, quantile_cont(v1, 0.75) c, quantile_cont(v1, 0.95) d FROM pixels GROUP BY img)
SELECT p.img, CAST(CASE WHEN v1 >= c THEN 1 WHEN v1 >= b THEN 2 ELSE 3 END AS INT) band, count(*) pixels FROM pixels p JOIN e ON p.img = e.img WHERE v1 >= a AND v1 <= d GROUP BY 1, 2""",
)(lambda r: cells.image_bands_share(cells.bands(r.channel("v1"), [0.25, 0.5, 0.75, 0.95])))
query(
    "obj_size_confound",
    """WITH g AS (SELECT condition g, avg(sqrt(area) / 60) r FROM objects GROUP BY 1), b AS (SELECT *, -tanh(0.75 * 1.5 / r) b FROM g), p AS (SELECT x.g group_a, y.g group_b, x.r r_a, y.r r_b, (1 + y.b) / (1 + x.b) - 1 a FROM b x JOIN b y ON x.g < y.g)
SELECT group_a, group_b, R(r_a) r_a, R(r_b) r_b, R(a) apparent, CASE WHEN abs(a) < 0.02 THEN 'ok' WHEN abs(a) < 0.05 THEN 'mild' ELSE 'warning' END AS level FROM p""",
)(lambda r: cells.size_confound(r.objects.withColumn("radius", F.sqrt("area") / 60), [], "condition", "radius", 1.5))
query("pts_to_point", "SELECT cell, id, R(sqrt((y_um - 3) * (y_um - 3) + (x_um + 2) * (x_um + 2))) distance FROM points")(lambda r: cells.to_region(r.points, "point", 3.0, -2.0).select("cell", "id", "distance"))
query(
    "pts_to_segment",
    """WITH t AS (SELECT cell, id, y_um, x_um, greatest(0.0, least(1.0, ((y_um + 5) * 10 + (x_um + 4) * 6) / 136.0)) t FROM points) SELECT cell, id, R(sqrt((y_um + 5 - 10 * t) * (y_um + 5 - 10 * t) + (x_um + 4 - 6 * t) * (x_um + 4 - 6 * t))) distance FROM t""",
)(lambda r: cells.to_region(r.points, "segment", -5.0, -4.0, 5.0, 2.0).select("cell", "id", "distance"))
query(
    "trk_bead_classes",
    """WITH m AS (SELECT event_type, median(value) m FROM events GROUP BY 1), u AS (SELECT e.event_type, median(value) u FROM events e JOIN m ON e.event_type = m.event_type WHERE value <= m GROUP BY 1)
SELECT e.event_type, event_id, R(value / u) units, CASE WHEN value / u >= 1.6 THEN 'aggregate' ELSE 'single' END bead_class FROM events e JOIN u ON e.event_type = u.event_type WHERE u <> 0""",
)(lambda r: cells.bead_classes(r.table("events").select("event_type", "event_id", "value"), ["event_type"], "value").select("event_type", "event_id", "units", "bead_class"))
query("ser_prebleach", "WITH p AS (SELECT series_id, avg(v) p FROM series WHERE t <= 5 GROUP BY 1) SELECT s.series_id, t, R(v / nullif(p, 0)) v FROM series s JOIN p ON s.series_id = p.series_id")(lambda r: cells.prebleach_normalized(r.series, 5))
query("ser_capillary_velocity", "SELECT series_id, R(regr_slope(v, ref)) slope, R(regr_intercept(v, ref)) intercept, R(regr_r2(v, ref)) r2, count(*) n FROM series GROUP BY 1")(lambda r: cells.linear_fit(r.series, ["series_id"], "ref", "v"))

query(
    "stack_sedimentation",
    """WITH a AS (SELECT img, t, label, sqrt(count(*) / pi()) r FROM frame_labels GROUP BY 1, 2, 3), r AS (SELECT img, t, count(*) n, avg(r) r FROM a GROUP BY 1, 2), f AS (SELECT s.img, s.t, count(l.img) / CAST(count(*) AS DOUBLE) p FROM stack s LEFT JOIN frame_labels l ON s.img = l.img AND s.t = l.t AND s.y = l.y AND s.x = l.x GROUP BY 1, 2),
g AS (SELECT img, count(*) frames, regr_slope(p, t) ps, regr_r2(p, t) p2, regr_slope(n, t) ns, regr_r2(n, t) n2, regr_slope(r, t) rs, regr_r2(r, t) r2 FROM f JOIN r USING (img, t) GROUP BY img), k AS (SELECT *, coalesce(ps > 0 AND p2 > 0.3, false) sed, coalesce(rs > 0 AND r2 > 0.3, false) co FROM g)
SELECT img, frames, R(ps) area_fraction_slope, R(p2) area_fraction_r2, R(ns) n_slope, R(n2) n_r2, R(rs) mean_radius_slope, R(r2) mean_radius_r2, CASE WHEN frames < 4 THEN 'insufficient_data' WHEN sed AND co THEN 'both' WHEN sed THEN 'sedimentation' WHEN co THEN 'coarsening' ELSE 'stable' END process,
sed AND coalesce(ns > 0, false) settling_corroborated, co AND coalesce(ns < 0, false) coarsening_corroborated FROM k""",
)(lambda r: cells.sedimentation(objects.field_trajectories(r.frame_labels, r.stack), ["img"]))
query(
    "qc_pinhole_crosstalk",
    """WITH m AS (SELECT l.img, l.label, avg(v1) m FROM labels_few l JOIN pixels p ON l.img = p.img AND l.y = p.y AND l.x = p.x GROUP BY 1, 2), b AS (SELECT img, label FROM m WHERE m >= (SELECT median(n.m) FROM m n WHERE n.img = m.img)),
g AS (SELECT p.img, p.y, p.x, p.v1 v, min(abs(p.y - l.y) + abs(p.x - l.x)) d, min(CASE WHEN b.label IS NOT NULL THEN abs(p.y - l.y) + abs(p.x - l.x) END) e FROM pixels p LEFT JOIN labels_few l ON p.img = l.img LEFT JOIN b ON l.img = b.img AND l.label = b.label GROUP BY 1, 2, 3, 4),
s AS (SELECT img, median(CASE WHEN e <= 2 AND d > 1 THEN v END) a, median(CASE WHEN coalesce(d, 99) > 2 THEN v END) z FROM g GROUP BY img), u AS (SELECT *, (a - z) / greatest(abs(z), 1e-6) u FROM s)
SELECT img, R(a) AS local, R(z) distant, R(u) elevation, CASE WHEN u < 0.1 THEN 'good' WHEN u < 0.3 THEN 'warn' WHEN u IS NOT NULL THEN 'bad' ELSE 'na' END status FROM u""".replace("AS local", 'AS "local"'),
)(lambda r: cells.pinhole_crosstalk(r.labels("v1", 1.4, 4), r.channel("v1"), 2, 1, 2))
query(
    "obj_local_partition",
    """WITH g AS (SELECT l.img, l.label, p.y, p.x, p.v1 v, min(abs(p.y - l.y) + abs(p.x - l.x)) d FROM labels_few l JOIN pixels p ON p.img = l.img AND abs(p.y - l.y) + abs(p.x - l.x) <= 4 GROUP BY 1, 2, 3, 4, 5),
r AS (SELECT img, label, avg(v) u, count(*) n FROM g WHERE d > 1 AND NOT EXISTS (SELECT 1 FROM labels_few k WHERE k.img = g.img AND k.y = g.y AND k.x = g.x) GROUP BY 1, 2), o AS (SELECT l.img, l.label, avg(v1) m, max(CASE WHEN v1 >= 900 THEN 1 ELSE 0 END) h FROM labels_few l JOIN pixels p ON l.img = p.img AND l.y = p.y AND l.x = p.x GROUP BY 1, 2)
SELECT img, label, R(m) dense, R(u) dilute, coalesce(n, 0) ring_px, h = 1 AS saturated, R(CASE WHEN u > 5 THEN (m - 5) / (u - 5) END) k, R(m / nullif(u, 0)) contrast FROM o LEFT JOIN r USING (img, label)""",
)(lambda r: cells.local_partition(r.labels("v1", 1.4, 4), r.channel("v1"), 1, 3, 5.0, 900.0))
query("meta_plausible_size", "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 9 > 0 THEN p_size * (p_partkey % 5 - 1) END BETWEEN 0.001 AND 100, false) ok FROM part")(
    lambda r: r.table("part").select("p_partkey", cells.plausible_size(F.when(F.col("p_partkey") % 9 > 0, F.col("p_size") * (F.col("p_partkey") % 5 - 1))).alias("ok"))
)

# ---- models as expressions

query(
    "model_curves",
    """SELECT p_partkey, R(3 * exp(-(p_size - 20) * (p_size - 20) / 72.0) + 0.5) gaussian, R(2 * exp(-((p_size - 25) * (p_size - 25) / 50.0 + (p_partkey % 50 - 10) * (p_partkey % 50 - 10) / 32.0)) + 1) gaussian_2d,
R(4 * exp(-p_size / 7.5) + 0.1 * p_size + 2) fusion, R(16.49 * (1 - 0.5 * sqrt(4.11 / (greatest(p_size, 1e-6) * 50.0)) + p_size / 1500.0)) wlc,
R(2.5 * (1 / tanh(p_size * 1.5 / 4.11) - 1 / (p_size * 1.5 / 4.11)) * (1 + p_size / 800.0)) fjc, R(1.25 / ((1 / tanh(p_size * 1.5 / 4.11) - 1 / (p_size * 1.5 / 4.11)) * (1 + p_size / 800.0))) contour FROM part WHERE p_size > 0""",
)(
    lambda r: r.table("part").where("p_size > 0").select(
        "p_partkey",
        cells.gaussian(F.col("p_size"), 3.0, 20.0, 6.0, 0.5).alias("gaussian"),
        cells.gaussian_2d(F.col("p_size"), F.col("p_partkey") % 50, 2.0, 25.0, 10.0, 5.0, 4.0, 1.0).alias("gaussian_2d"),
        cells.fusion_relaxation(F.col("p_size"), 4.0, 7.5, 0.1, 2.0).alias("fusion"),
        cells.worm_like_chain(F.col("p_size").cast("double")).alias("wlc"),
        cells.freely_jointed_chain(F.col("p_size").cast("double"), 2.5).alias("fjc"),
        cells.chain_contour(F.col("p_size").cast("double"), F.lit(1.25)).alias("contour"),
    )
)
query(
    "model_viscosity_interval",
    """WITH d AS (SELECT p_partkey, p_retailprice / 1000 d, p_retailprice / 1000 - p_size / 40.0 lo, p_retailprice / 1000 + p_size / 40.0 hi FROM part), k AS (SELECT *, 1.380649e-23 * 297.15 / (6 * pi() * 0.05 * 1e-18) k FROM d)
SELECT p_partkey, R(CASE WHEN d > 0 THEN k / d END) viscosity, R(CASE WHEN hi > 0 THEN k / hi END) AS lower, R(round(CASE WHEN lo > 1e-3 THEN k / lo END, 3)) AS upper, NOT lo > 1e-3 AS unbounded, coalesce(CASE WHEN lo > 1e-3 THEN hi / lo END > 1.5, true) wide FROM k""".replace("AS lower", 'AS "lower"').replace("AS upper", 'AS "upper"'),
)(lambda r: _viscosity(r))


def _viscosity(r: Relations) -> DataFrame:
    d, w = F.col("p_retailprice") / 1000, F.col("p_size") / 40.0
    low = F.when(d - w > 1e-3, d - w)
    found = r.table("part").select("p_partkey", *(c.alias(n) for n, c in cells.viscosity_interval(d, low, d + w, 0.05).items()))
    return found.withColumn("upper", F.round("upper", 3))


# ---- records

_OFFERS = """offers AS (SELECT 'i' || (o_orderkey % 300) image, o_orderpriority source, CAST(substr(o_orderpriority, 1, 1) AS INT) priority, u.field, u.value FROM orders,
LATERAL (SELECT unnest([{'field': 'pixel_size_um', 'value': CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CAST(o_custkey % 3 AS VARCHAR) END}, {'field': 'objective', 'value': CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END}]) u) )"""


def _offers(r: Relations) -> DataFrame:
    """image, field, source, priority, value: what several sources say about images."""
    size, lens = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise((F.col("o_custkey") % 3).cast("string")), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus"))
    said = F.explode(F.array(F.struct(F.lit("pixel_size_um").alias("field"), size.alias("value")), F.struct(F.lit("objective").alias("field"), lens.alias("value")))).alias("u")
    image = F.concat(F.lit("i"), (F.col("o_orderkey") % 300).cast("string")).alias("image")
    return r.table("orders").select(image, F.col("o_orderpriority").alias("source"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), said).select("image", "u.field", "source", "priority", "u.value")


query(
    "meta_merged",
    f"""WITH {_OFFERS}, k AS (SELECT DISTINCT * FROM offers WHERE value IS NOT NULL AND trim(value) <> ''), b AS (SELECT image, field, min({{'p': priority, 's': source, 'v': value}}) b FROM k GROUP BY 1, 2),
o AS (SELECT b.image, b.field, b.b, list_transform(list_sort(list({{'p': priority, 's': source, 'v': value}}) FILTER (WHERE value <> b.b.v)), lambda z: z.s || '=' || z.v) o FROM b JOIN k ON b.image = k.image AND b.field = k.field GROUP BY 1, 2, 3)
SELECT image, field, b.v AS value, b.s AS source, CAST(coalesce(len(o), 0) AS INT) n_conflicts, coalesce(array_to_string(o, '; '), '') AS conflicts, coalesce(len(o), 0) > 0 AND field = 'pixel_size_um' AS surfaced FROM o""",
)(lambda r: records.merged_metadata(_offers(r)))
query(
    "meta_compared",
    f"WITH {_OFFERS} SELECT field, count(value) n_known, count(DISTINCT value) n_values, count(DISTINCT value) > 1 AS differs, CASE WHEN field = 'pixel_size_um' THEN 'critical' ELSE 'info' END severity FROM offers GROUP BY field",
)(lambda r: records.compared_metadata(_offers(r), ("pixel_size_um", "bit_depth")))
query(
    "meta_frame_interval",
    """WITH k AS (SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN CAST(p_size AS DOUBLE) END n, CASE WHEN p_partkey % 3 > 0 THEN p_size * (0.8 + (p_partkey % 5) / 10.0) END d FROM part)
SELECT p_partkey, R(coalesce(d, n)) interval_s, CASE WHEN d IS NOT NULL THEN 'timestamps' WHEN n IS NOT NULL THEN 'declared' END interval_source, coalesce(abs(d - n) / d > 0.15, false) inconsistent FROM k""",
)(
    lambda r: records.frame_interval(
        r.table("part").select("p_partkey", F.when(F.col("p_size") % 4 > 0, F.col("p_size")).otherwise(0).alias("n"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_size") * (0.8 + (F.col("p_partkey") % 5) / 10)).alias("d")), "n", "d"
    ).select("p_partkey", "interval_s", "interval_source", "inconsistent")
)
query(
    "meta_files",
    r"""WITH f AS (SELECT page_id, lower(regexp_extract(url, '([^/\\]*)$', 1)) || (CASE page_id % 4 WHEN 0 THEN '.tif' WHEN 1 THEN '_manifest.json' WHEN 2 THEN '.csv' ELSE '' END) n FROM pages)
SELECT page_id, CASE WHEN regexp_matches(n, '\.(csv|tsv|parquet)$') THEN 'table' WHEN regexp_matches(n, '\.(tif|tiff|png|czi|ims|nd2)$') THEN 'image' WHEN regexp_matches(n, 'manifest\.json$') THEN 'manifest' WHEN regexp_matches(n, '\.(json|yaml|yml)$') THEN 'settings' WHEN regexp_matches(n, '\.html?$') THEN 'page' ELSE 'other' END kind,
regexp_replace(n, '\.[^.]*$', '') stem FROM f""",
)(
    lambda r: records.classified_files(
        r.table("pages").select("page_id", F.concat("url", F.when(F.col("page_id") % 4 == 0, ".tif").when(F.col("page_id") % 4 == 1, "_manifest.json").when(F.col("page_id") % 4 == 2, ".csv").otherwise("")).alias("path")), "path"
    ).select("page_id", "kind", "stem")
)
query(
    "meta_verdicts",
    "SELECT c_custkey, CASE greatest(CASE WHEN c_acctbal >= 5000 THEN 0 WHEN c_acctbal >= 0 THEN 1 ELSE 2 END, CASE WHEN c_nationkey >= 5 THEN 0 WHEN c_nationkey >= 1 THEN 1 ELSE 2 END) WHEN 0 THEN 'ok' WHEN 1 THEN 'warn' ELSE 'block' END verdict FROM customer",
)(lambda r: records.worst_verdict(r.table("customer"), ["c_custkey"], {"c_acctbal": (5000, 0), "c_nationkey": (5, 1)}))
query(
    "meta_sampled_frames",
    """WITH k AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 k, count(*) OVER (PARTITION BY event_type) n FROM events),
w AS (SELECT DISTINCT event_type, CASE WHEN n <= 7 THEN i ELSE floor(i * ((n - 1) / 6.0) + 0.5) END k FROM (SELECT DISTINCT event_type, n FROM k), range(7) r(i)) SELECT k.event_type, k.event_id FROM k JOIN w ON k.event_type = w.event_type AND k.k = w.k""",
)(lambda r: records.evenly_sampled(r.table("events").select("event_type", "event_id"), ["event_type"], "event_id", 7))
query(
    "long_table",
    """WITH o AS (SELECT 'img' || replicate image_stem, label, area, CAST(parent AS DOUBLE) parent FROM objects), u AS (SELECT image_stem, label, 'area' AS measurement, area AS value FROM o UNION ALL SELECT image_stem, label, 'parent', parent FROM o),
m AS (SELECT image_stem, measurement, median(value) m FROM u GROUP BY 1, 2), d AS (SELECT u.image_stem, u.measurement, any_value(m) m, median(abs(value - m)) d, count(*) n FROM u JOIN m USING (image_stem, measurement) GROUP BY 1, 2),
f AS (SELECT u.*, d.n >= 3 AND d > 0 AND abs(value - m) > 1.2 * 1.4826 * d AS flag FROM u JOIN d USING (image_stem, measurement)),
q AS (SELECT image_stem, label, string_agg(measurement || '_outlier', '; ' ORDER BY measurement) FILTER (WHERE flag) qc FROM f GROUP BY 1, 2),
s AS (SELECT 'img' || n_nationkey image_stem, n_name genotype, r_name site FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 > 0)
SELECT f.image_stem, coalesce(genotype, '') genotype, coalesce(site, '') site, 'droplet' AS object_type, CAST(f.label AS VARCHAR) object_id, f.measurement, R(value) AS value, CASE f.measurement WHEN 'area' THEN 'um2' ELSE '' END units, 'orders' AS operation, '1' AS software_version, coalesce(qc, '') qc_flags,
CASE WHEN f.measurement <> 'area' THEN '' WHEN qc IS NULL THEN 'moderate' ELSE 'low' END reliability, CASE WHEN f.measurement <> 'area' THEN '' WHEN qc IS NULL THEN 'calibration not assessed' ELSE 'object flagged; calibration not assessed' END reliability_reasons
FROM f JOIN q USING (image_stem, label) LEFT JOIN s ON f.image_stem = s.image_stem""",
)(lambda r: _long(r))


def _long(r: Relations) -> DataFrame:
    image = lambda c: F.concat(F.lit("img"), F.col(c).cast("string")).alias("image_stem")
    wide = r.objects.select(image("replicate"), "label", "area", F.col("parent").cast("double").alias("parent"))
    n, g = r.table("nation"), r.table("region")
    sheet = n.join(g, n.n_regionkey == g.r_regionkey).where("n_nationkey % 3 > 0").select(image("n_nationkey"), F.col("n_name").alias("genotype"), F.col("r_name").alias("site"))
    return records.long_table(wide, "droplet", "label", "image_stem", sheet, ["genotype", "site"], {"area": "um2"}, {"operation": "orders", "software_version": "1"}, ("area",), {"image_qc": 0.9, "calibration": None}, 1.2)


# ---- grouped kernels, held against brute force in the tests

query("ser_fit_two_decays")(lambda r: planes.fitted(r.series, "two_decays"))
query("ser_fit_relaxation")(lambda r: planes.fitted(r.series.withColumn("v", 1 + F.col("v") / 100), "relaxation"))
query("trk_confinement")(lambda r: planes.fitted(tracks.msd(r.tracks, 12, 5).select(F.lit("all").alias("series_id"), F.col("lag").cast("double").alias("t"), F.col("msd").alias("v")), "confinement"))
query("cell_matched")(lambda r: cells.matched(r.labels("v1", 1.4, 4), r.labels("v2", 1.4, 4), 3.0))
query("pts_merged_in_time")(lambda r: planes.merged_in_time(r.points.withColumn("frame", F.col("id") % 50), ["cell"], 8.0, 1))
query("pts_hulls")(lambda r: planes.hulls(r.points, ["cell"]))
query("pts_spanning_trees")(lambda r: planes.spanning_trees(r.points, ["cell"]))
