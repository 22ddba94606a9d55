"""The registered optimal linker takes every detection."""

import os

import numpy as np
import pytest

from grainfield.functions import fits
from grainfield.operators import planes
from grainfield.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_optimal_linking_takes_all_events(spark):
    linked = catalog.queries()["trk_link_optimal"](spark, SF)
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert linked.count() == events.count()
    assert linked.select("object_id").distinct().count() == events.select("user_id").distinct().count()
    assert linked.select("img", "frame", "track_id").distinct().count() == linked.count()


def test_optimal_links_cost_the_least_in_every_frame(spark):
    """Replayed from the tracks found: no frame has a cheaper assignment, copies, changed areas and missed frames included."""
    rng, reach, gap = np.random.default_rng(3), 5.0, 2
    frames = [t for t in range(14) if t not in (4, 9, 10)]
    rows = []
    for t in frames:
        points = rng.integers(0, 12, (10, 2)) + rng.integers(0, 2, (10, 2)) / 2
        points = np.r_[points, points[:4], points[:2]]
        rows += [("a", t, k, float(y), float(x), float(1 + (k % 3) * (y % 2))) for k, (y, x) in enumerate(points)]
    rows.append(("a", 3, 99, None, 1.0, 1.0))
    docs = spark.createDataFrame(rows, "img string, frame int, object_id long, y_um double, x_um double, area_um2 double")
    found = planes.link_optimal(docs, reach, gap).toPandas()
    assert len(found) == len(rows)
    s, birth, open_ = reach / 2, 0.5 * 4 + 0.3, {}
    for t in frames:
        part = found[found["frame"] == t]
        open_ = {k: o for k, o in open_.items() if t - o[5] <= gap + 1}
        assert part["track_id"].is_unique
        ids, cost, paid = list(open_), np.full((len(open_), len(part) + len(open_)), 1e6), 0.0
        for i, (y, x, vy, vx, area, last) in enumerate(open_.values()):
            dt = t - last
            d = np.hypot(part["y_um"] - (y + vy * dt), part["x_um"] - (x + vx * dt)).to_numpy()
            c = d**2 / (2 * (s * dt) ** 2) + 0.3 * np.abs(np.log(part["area_um2"].to_numpy() / area))
            cost[i, : len(part)] = np.where(d <= reach * dt, c, 1e6)
            cost[i, len(part) + i] = 2 * birth
        for j, r in enumerate(part.itertuples()):
            old = open_.get(r.track_id)
            if old is not None:
                paid += cost[ids.index(r.track_id), j]
                g = t - old[5]
                open_[r.track_id] = (r.y_um, r.x_um, (r.y_um - old[0]) / g, (r.x_um - old[1]) / g, r.area_um2, t)
            else:
                open_[r.track_id] = (r.y_um, r.x_um, 0.0, 0.0, r.area_um2, t)
        paid += 2 * birth * len(set(ids) - set(part["track_id"]))
        if ids:
            assert paid == pytest.approx(sum(cost[i, j] for i, j in fits.assignment(cost)))


def test_cheapest_columns_that_are_free_need_no_search(monkeypatch):
    pushed = []
    monkeypatch.setattr(fits.heapq, "heappush", lambda heap, x: pushed.append(x) or heap.append(x))
    n = 50
    edges = [[(j, 1.0 + abs(i - j)) for j in range(n)] for i in range(n)]
    assert fits.sparse_transport(edges, [3] * n, [3] * n, 200.0) == [{i: 3} for i in range(n)]
    assert not pushed
