"""Operators that no relational plan expresses: numpy kernels on one plane, track set or series at a time, as grouped maps.

A group is one plane of one image (and frame), one frame sequence or one series: its size is the acquisition's, not the
corpus's, and groups are dealt out by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, fits


def _dense(pdf: pd.DataFrame, value: str) -> tuple[np.ndarray, int, int]:
    """The plane of a group's pixels; missing pixels are 0."""
    y0, x0 = int(pdf["y"].min()), int(pdf["x"].min())
    out = np.zeros((int(pdf["y"].max()) - y0 + 1, int(pdf["x"].max()) - x0 + 1))
    out[pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0] = pdf[value].to_numpy()
    return out, y0, x0


def map_planes(px: DataFrame, kernel, keys: list[str] = ("img",), value: str = "v", out: str = "v", kind: str = "double") -> DataFrame:
    """kernel(array) -> array of the same shape for each plane; pixel rows (keys, y, x, out)."""
    keys = list(keys)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a, y0, x0 = _dense(pdf, value)
        new = np.asarray(kernel(a))
        y, x = np.indices(a.shape)
        made = pd.DataFrame({"y": y.ravel() + y0, "x": x.ravel() + x0, out: new.ravel()})
        for k, v in zip(keys, key, strict=True):
            made.insert(0, k, v)
        return made[[*keys, "y", "x", out]]

    kinds = dict(px.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "y int, x int", f"{out} {kind}"])
    return px.select(*keys, "y", "x", value).groupBy(*keys).applyInPandas(run, schema)


def per_plane(px: DataFrame, kernel, schema: str, keys: list[str] = ("img",), value: str = "v") -> DataFrame:
    """kernel(array) -> list of rows for each plane; schema names the rows' columns."""
    keys, names = list(keys), [x.split()[0] for x in schema.split(",")]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a, _, _ = _dense(pdf, value)
        made = pd.DataFrame(kernel(a), columns=names)
        for k, v in zip(reversed(keys), reversed(key), strict=True):
            made.insert(0, k, v)
        return made

    kinds = dict(px.dtypes)
    return px.select(*keys, "y", "x", value).groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema]))


FILTERS = {
    "gaussian": lambda a, sigma=1.0: arrays.gaussian(a, sigma),
    "dog": lambda a, low=1.0, high=2.0: arrays.difference_of_gaussians(a, low, high),
    "log": lambda a, sigma=1.5: arrays.laplacian_of_gaussian(a, sigma),
    "bilateral": lambda a, r=2, space=1.5, value=50.0: arrays.bilateral(a, r, space, value),
    "bandpass": lambda a, low=0.02, high=0.25: arrays.bandpass(a, low, high),
    "median": lambda a, r=1: arrays.median(a, r),
    "rolling_ball": lambda a, radius=4: arrays.rolling_ball_removed(a, radius),
    "local_contrast": lambda a, sigma=4.0: arrays.local_contrast(a, sigma),
    "equalize": lambda a, tiles=4: arrays.equalized(a, tiles),
    "niblack": lambda a, size=9, k=-0.5: (a > arrays.niblack(a, size, k)).astype(float),
    "sauvola": lambda a, size=9, k=0.2: (a > arrays.sauvola(a, size, k)).astype(float),
    "distance": lambda a, t=None: arrays.distance(a > (arrays.otsu(a) if t is None else t)),
}
THRESHOLDS = {"otsu": arrays.otsu, "li": arrays.li, "triangle": arrays.triangle}


def filtered(px: DataFrame, name: str, keys=("img",), **options) -> DataFrame:
    kernel = FILTERS[name]
    return map_planes(px, lambda a: kernel(a, **options), keys)


def filtered_arrays(planes: DataFrame, name: str, **options) -> DataFrame:
    """A filter over planes that are rows (.., height, width, data array<double>), as sources give them: each row is mapped
    where it is, without pixel rows or a shuffle. A null plane stays null."""
    kernel = FILTERS[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {f: k for k, f in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):  # one plane at a time, so memory is a plane's
                row = batch.slice(k, 1)
                data = row.column(at["data"])
                if data.null_count:
                    yield row
                    continue
                shape = row.column(at["height"])[0].as_py(), row.column(at["width"])[0].as_py()
                new = np.asarray(kernel(np.asarray(data.flatten(), np.float64).reshape(shape), **options), np.float64)
                made = pa.ListArray.from_arrays(pa.array([0, new.size], pa.int32()), pa.array(new.ravel()))
                yield pa.record_batch([made if f == "data" else row.column(i) for f, i in at.items()], names=batch.schema.names)

    return planes.mapInArrow(run, planes.schema)


def thresholds(px: DataFrame) -> DataFrame:
    """Global thresholds of each image, and the two of three classes."""
    return per_plane(px, lambda a: [(arrays.otsu(a), arrays.li(a), arrays.triangle(a), *arrays.multi_otsu(a))], "otsu double, li double, triangle double, low double, high double")


def segmented(px: DataFrame, method: str = "otsu", least: int = 6, split: bool = True) -> DataFrame:
    """Labels of the pixels above a global threshold: holes filled, touching objects split, small ones dropped."""
    at = THRESHOLDS[method]

    def kernel(a: np.ndarray) -> np.ndarray:
        m = arrays.fill_holes(a > at(a))
        lab = arrays.split_touching(m) if split else arrays.label(m)
        keep = np.bincount(lab.ravel()) >= least
        keep[0] = False
        number = np.cumsum(keep) * keep
        return number[lab]

    return map_planes(px, kernel, out="label", kind="long").where("label > 0")


def blobs(px: DataFrame, sigmas=(1.0, 1.5, 2.0, 3.0), least: float = 0.1, keys=("img",)) -> DataFrame:
    """Blobs of the min-max normalised plane."""

    def kernel(a):
        span = np.ptp(a)
        return arrays.detect_blobs((a - a.min()) / span, list(sigmas), least) if span else []

    return per_plane(px, kernel, "y int, x int, sigma double, response double", keys)


def spots(px: DataFrame, sigma: float, least: float) -> DataFrame:
    return per_plane(px, lambda a: arrays.clean(a, sigma, least), "y int, x int, flux double")


def spectra(px: DataFrame) -> DataFrame:
    """Correlation length, and the width of the autocorrelation's central peak."""

    def kernel(a):
        c = arrays.autocorrelation(a)
        y, x = np.indices(c.shape)
        r = np.hypot(y - c.shape[0] // 2, x - c.shape[1] // 2)
        return [(arrays.correlation_length(a), float(r[c < np.exp(-1)].min(initial=r.max())))]

    return per_plane(px, kernel, "correlation_length int, radius_1e double")


def drifts(stack: DataFrame) -> DataFrame:
    """Shift of each frame against its image's first frame."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        planes = {}
        for t, part in pdf.groupby("t"):
            planes[t] = np.zeros((h, w))
            planes[t][part["y"], part["x"]] = part["v"]
        first = planes[min(planes)]
        return pd.DataFrame([(key[0], t, *arrays.shift_between(first, p)) for t, p in sorted(planes.items())], columns=["img", "t", "dy", "dx"])

    return stack.groupBy("img").applyInPandas(run, "img string, t int, dy double, dx double")


def block_shuffle_test(px: DataFrame, simulations: int = 99, seed: int = 0) -> DataFrame:
    """p of the Pearson r of two channels against shuffles of blocks twice the correlation length: (hits + 1) / (n + 1).
    Each simulation draws from its own seed sequence, so results do not depend on how work is split."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a, _, _ = _dense(pdf, "v1")
        b, _, _ = _dense(pdf, "v2")
        r = float(np.corrcoef(a.ravel(), b.ravel())[0, 1])
        size = max(1, 2 * arrays.correlation_length(a))
        h, w = a.shape[0] // size * size, a.shape[1] // size * size
        if h == 0 or w == 0:
            return pd.DataFrame([(key[0], r, size, float("nan"))], columns=["img", "r", "block", "p"])
        blocks = b[:h, :w].reshape(h // size, size, w // size, size).swapaxes(1, 2).reshape(-1, size, size)
        base, hits = a[:h, :w].ravel(), 0
        for k in range(simulations):
            rng = np.random.default_rng([seed, k])
            mixed = blocks[rng.permutation(len(blocks))].reshape(h // size, w // size, size, size).swapaxes(1, 2).reshape(h, w)
            hits += abs(np.corrcoef(base, mixed.ravel())[0, 1]) >= abs(r)
        return pd.DataFrame([(key[0], r, size, (hits + 1) / (simulations + 1))], columns=["img", "r", "block", "p"])

    return px.groupBy("img").applyInPandas(run, "img string, r double, block int, p double")


class GreedyLinker:
    """Frame by frame: each open track proposes its nearest detection within reach; of contenders the nearest wins, losers
    and unclaimed detections begin tracks. A track stays open for `gap` missed frames. This is also the stream's state."""

    def __init__(self, reach: float, gap: int = 1, tracks: list | None = None, next_id: int = 0):
        self.reach, self.gap, self.tracks, self.next_id = reach, gap, tracks or [], next_id  # (id, y, x, last frame)

    def frame(self, t: int, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        self.tracks = [k for k in self.tracks if t - k[3] <= self.gap + 1]
        out, claims = np.full(len(y), -1), {}
        for n, (_, ty, tx, _) in enumerate(self.tracks):
            if len(y):
                d = np.hypot(y - ty, x - tx)
                j = int(np.argmin(d))
                if d[j] <= self.reach and (j not in claims or d[j] < claims[j][0]):
                    claims[j] = (d[j], n)
        for j in range(len(y)):
            if j in claims:
                n = claims[j][1]
                self.tracks[n] = (self.tracks[n][0], float(y[j]), float(x[j]), t)
                out[j] = self.tracks[n][0]
            else:
                self.tracks.append((self.next_id, float(y[j]), float(x[j]), t))
                out[j] = self.next_id
                self.next_id += 1
        return out


def _linked(pdf: pd.DataFrame, step) -> pd.DataFrame:
    parts = []
    for t, part in pdf.sort_values(["frame", "object_id"]).groupby("frame", sort=True):
        parts.append(part.assign(track_id=step(int(t), part)))
    return pd.concat(parts) if parts else pdf.assign(track_id=pd.Series(dtype="int64"))


def _classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in the order of their first places, how many each has, and all places by class and then in order."""
    order = np.lexsort(rows.T)
    ranked = rows[order]
    new = np.r_[True, (ranked[1:] != ranked[:-1]).any(axis=1)]
    first, of = order[new], np.empty(len(rows), np.int64)  # the sort is stable
    names = np.empty(len(first), np.int64)
    names[np.argsort(first)] = np.arange(len(first))
    of[order] = names[np.cumsum(new) - 1]
    return rows[np.sort(first)], np.bincount(of), np.argsort(of, kind="stable")


def _taken(of: np.ndarray, many: np.ndarray, counts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Places that flows of so many from these classes take, each class's in order."""
    order, starts = np.argsort(of, kind="stable"), np.cumsum(counts) - counts
    upto = np.cumsum(many[order]) - many[order]
    same = np.searchsorted(of[order], of[order])  # the class's first flow
    start = np.empty(len(of), np.int64)
    start[order] = starts[of[order]] + upto - upto[same]
    total = np.cumsum(many)
    return places[np.repeat(start - total + many, many) + np.arange(total[-1])]


LINKED = "img string, frame int, object_id long, y_um double, x_um double, area_um2 double, track_id long"
_COLUMNS = [x.split()[0] for x in LINKED.split(", ")]


def link_greedy(detections: DataFrame, reach: float = 2.0, gap: int = 1) -> DataFrame:
    """Greedy nearest-neighbour linking of detections (img, frame, object_id, y_um, x_um, area_um2) within each image."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        linker = GreedyLinker(reach, gap)
        return _linked(pdf, lambda t, p: linker.frame(t, p["y_um"].to_numpy(), p["x_um"].to_numpy()))[_COLUMNS]

    return detections.select(*_COLUMNS[:-1]).groupBy("img").applyInPandas(run, LINKED)


def link_optimal(detections: DataFrame, reach: float = 2.0, gap: int = 2, sigma: float | None = None, area_weight: float = 0.3) -> DataFrame:
    """Optimal linking: cost d^2 / 2 (sigma gap)^2 + weight |ln area ratio| with velocity prediction, against births and deaths."""
    s = sigma or reach / 2
    birth = 0.5 * (reach / s) ** 2 + area_weight

    def near(tracks: np.ndarray, found: np.ndarray, t: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(track, detection, cost) of links within reach, those of a track together; pairs are looked at within reach along x only."""
        by_x = np.argsort(found[:, 1], kind="stable")
        y1, x1, area1 = found[by_x].T
        dt = t - tracks[:, 5]
        y0, x0, wide = tracks[:, 0] + tracks[:, 2] * dt, tracks[:, 1] + tracks[:, 3] * dt, reach * dt * (1 + 1e-9) + 1e-9
        low, high = np.searchsorted(x1, x0 - wide), np.searchsorted(x1, x0 + wide, "right")
        many = np.maximum(high - low, 0)
        total = np.cumsum(many)
        part = total // (1 << 20)
        for k in np.split(np.arange(len(tracks)), np.flatnonzero(np.diff(part)) + 1):
            i = np.repeat(k, many[k])
            j = np.arange(len(i)) + np.repeat(low[k] - (total[k] - many[k] - (total[k[0]] - many[k[0]])), many[k])
            d = np.hypot(y1[j] - y0[i], x1[j] - x0[i])
            c = d**2 / (2 * (s * dt[i]) ** 2) + area_weight * np.abs(np.log(area1[j] / np.maximum(tracks[i, 4], 1e-9)))
            # a link that costs no less than a death and a birth is in no better assignment
            good = (d <= reach * dt[i]) & (c < 2 * birth)
            yield i[good], by_x[j[good]], c[good]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "object_id"])
        frames, linked = pdf["frame"].to_numpy(), np.zeros(len(pdf), np.int64)
        rows = np.stack([pdf["y_um"].to_numpy(float), pdf["x_um"].to_numpy(float), np.maximum(pdf["area_um2"].to_numpy(float), 1e-9)], 1)
        ids, open_, next_id = np.zeros(0, np.int64), np.zeros((0, 6)), 0  # y, x, vy, vx, area, last
        edges = np.flatnonzero(np.r_[True, frames[1:] != frames[:-1], True]) if len(frames) else []
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            t, p, out = int(frames[start]), rows[start:end], linked[start:end]
            stay = t - open_[:, 5] <= gap + 1
            ids, open_, free = ids[stay], open_[stay], np.ones(end - start, bool)
            if len(ids):
                # equal tracks and equal detections are classes, however many copies they have
                tracks, of_tracks, at_tracks = _classes(open_)
                found, of_found, at_found = _classes(p)
                i, j, c = (np.concatenate(x) for x in zip(*near(tracks, found, t), strict=True))
                flows = fits.sparse_transport((np.searchsorted(i, np.arange(len(tracks) + 1)), j, c), of_tracks.tolist(), of_found.tolist(), 2 * birth)
                flat = np.array([(i, j, many) for i, to in enumerate(flows) for j, many in to.items()], np.int64).reshape(-1, 3)
                if len(flat):
                    at, to = _taken(flat[:, 0], flat[:, 2], of_tracks, at_tracks), _taken(flat[:, 1], flat[:, 2], of_found, at_found)
                    old, new = open_[at], p[to]
                    open_[at] = np.c_[new[:, :2], (new[:, :2] - old[:, :2]) / (t - old[:, 5:]), new[:, 2], np.full(len(to), t)]
                    out[to], free[to] = ids[at], False
            new = p[free]
            out[free] = names = np.arange(next_id, next_id + len(new))
            next_id += len(new)
            ids, open_ = np.r_[ids, names], np.r_[open_, np.c_[new[:, :2], np.zeros((len(new), 2)), new[:, 2], np.full(len(new), t)]]
        return pdf.assign(track_id=linked)[_COLUMNS]

    return detections.select(*_COLUMNS[:-1]).groupBy("img").applyInPandas(run, LINKED)


def fitted(series: DataFrame, model: str = "recovery", value: str = "v") -> DataFrame:
    """A model of each series (series_id, t, value) by bounded least squares: recovery, decay, two_decays, relaxation of an
    aspect ratio, or confinement of a displacement curve (t > 0). Fewer than 5 points give nulls."""
    models = {"recovery": (fits.fit_recovery, ["a", "b", "half", "mobile", "r2"]), "decay": (fits.fit_decay, ["top", "tau", "floor", "r2"])}
    more = {"two_decays": (fits.fit_two_decays, ["a", "tau_a", "c", "tau_c", "floor", "r2"]), "relaxation": (fits.fit_relaxation, ["start", "tau", "r2"]), "confinement": (fits.fit_confinement, ["gap", "confined", "plateau", "size", "exponent"])}
    fit, names = (models | more)[model]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t, v = pdf["t"].to_numpy(float), pdf["v"].to_numpy(float)
        found = fit(t, v) if len(t) >= 5 else dict.fromkeys(names)
        return pd.DataFrame([(key[0], *(found[n] for n in names))], columns=["series_id", *names])

    return series.select("series_id", F.col("t").cast("double").alias("t"), F.col(value).cast("double").alias("v")).groupBy("series_id").applyInPandas(run, ", ".join(["series_id string", *(f"{n} double" for n in names)]))


def compared(reps: DataFrame, keys: list[str], condition: str, parametric: bool = False) -> DataFrame:
    """Test of replicate values (condition, value) between conditions, for each key; refused groups give nulls."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        groups = [g["value"].to_numpy(float) for _, g in pdf.sort_values([condition, "value"]).groupby(condition)]
        try:
            row = fits.compare(groups, parametric)
        except ValueError:
            row = ("refused", None, None)
        return pd.DataFrame([(*key, *row, len(groups))], columns=[*keys, "test", "statistic", "p", "groups"])

    kinds = dict(reps.dtypes)
    return reps.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "test string, statistic double, p double, groups int"]))


def assigned(pairs: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """One-to-one matches among candidate pairs (keys, p_label, t_label, distance) of each group: as many as can be, of the
    least total distance. A group's candidates are an image's objects within reach of each other."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, r = np.unique(pdf["p_label"].to_numpy(), return_inverse=True)
        columns, c = np.unique(pdf["t_label"].to_numpy(), return_inverse=True)
        edges: list[list[tuple[int, float]]] = [[] for _ in rows]
        for i, j, d in sorted(zip(r.tolist(), c.tolist(), pdf["distance"].tolist(), strict=True)):
            edges[i].append((j, d))
        chosen = {(i, j) for i, j in enumerate(fits.sparse_assignment(edges, len(columns), 2 * len(rows) * reach + 1)) if j >= 0}
        return pdf[[(i, j) in chosen for i, j in zip(r.tolist(), c.tolist(), strict=True)]]

    return pairs.groupBy(*keys).applyInPandas(run, pairs.schema)


def merged_in_time(points: DataFrame, keys: list[str], radius: float, gap: int) -> DataFrame:
    """Localisations of a group (frame, y_um, x_um) that repeat within a radius of their first one, and within `gap` frames
    of the last one taken in, as one mean position each. First come, first served in order of frame (then y, x): the rule is
    sequential, so a group, as one field of view, is one task."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "y_um", "x_um"], kind="stable")
        f, y, x = (pdf[c].to_numpy() for c in ("frame", "y_um", "x_um"))
        used, out = np.zeros(len(f), bool), []
        for i in range(len(f)):
            if used[i]:
                continue
            group = [i]
            # a later one can only join while it is near the first one in time, or the last one taken in
            for j in range(i + 1, len(f)):
                if f[j] - f[group[-1]] > gap:
                    break
                if not used[j] and (x[j] - x[i]) ** 2 + (y[j] - y[i]) ** 2 <= radius**2:
                    group.append(j)
            used[group] = True
            out.append((*key, int(f[i]), float(y[group].mean()), float(x[group].mean()), len(group)))
        return pd.DataFrame(out, columns=[*keys, "frame", "y_um", "x_um", "n"])

    schema = points.select(*keys).schema.add("frame", "long").add("y_um", "double").add("x_um", "double").add("n", "long")
    return points.groupBy(*keys).applyInPandas(run, schema)


def hulls(points: DataFrame, keys: list[str]) -> DataFrame:
    """Convex hull of each group's points: area, perimeter, compactness, number of corners; null for fewer than three."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = sorted({(float(a), float(b)) for a, b in zip(pdf["x_um"], pdf["y_um"], strict=True)})
        if len(p) < 3:
            return pd.DataFrame([(*key, None, None, None, None)], columns=[*keys, "area", "perimeter", "compactness", "corners"])
        corner = []
        for side in (p, p[::-1]):
            chain: list[tuple[float, float]] = []
            for q in side:
                while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (q[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (q[0] - chain[-2][0]):
                    chain.pop()
                chain.append(q)
            corner += chain[:-1]
        x, y = np.array(corner).T
        area = abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2
        length = np.hypot(np.diff(x, append=x[0]), np.diff(y, append=y[0])).sum()
        return pd.DataFrame([(*key, area, length, 4 * np.pi * area / length**2 if length else None, len(x))], columns=[*keys, "area", "perimeter", "compactness", "corners"])

    schema = points.select(*keys).schema.add("area", "double").add("perimeter", "double").add("compactness", "double").add("corners", "long")
    return points.groupBy(*keys).applyInPandas(run, schema)


def spanning_trees(points: DataFrame, keys: list[str]) -> DataFrame:
    """Edges of each group's minimum spanning tree: number, total, mean and deviation of lengths. One row of distances at a
    time is held, so memory grows with a group's points, time with their square."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x_um"].to_numpy(float), pdf["y_um"].to_numpy(float)
        near, left, edges, at = np.full(len(x), np.inf), np.ones(len(x), bool), [], 0
        for _ in range(len(x) - 1):
            left[at] = False
            near = np.minimum(near, np.hypot(x - x[at], y - y[at]))
            at = int(np.argmin(np.where(left, near, np.inf)))
            edges.append(near[at])
        e = np.array(edges)
        row = (*key, len(e), float(e.sum()), float(e.mean()) if len(e) else None, float(e.std()) if len(e) else None)
        return pd.DataFrame([row], columns=[*keys, "edges", "total", "mean", "std"])

    schema = points.select(*keys).schema.add("edges", "long").add("total", "double").add("mean", "double").add("std", "double")
    return points.groupBy(*keys).applyInPandas(run, schema)
