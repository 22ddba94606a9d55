"""Array kernels on single planes, in numpy only: filters, thresholds, morphology, distances, watershed, spectra."""

from __future__ import annotations

import heapq

import numpy as np


def _padded(a: np.ndarray, r: int, mode: str = "symmetric") -> np.ndarray:
    return np.pad(a, r, mode=mode)


def correlate_axis(a: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """1-D correlation along an axis with mirrored borders."""
    r = len(kernel) // 2
    pad = [(r, r) if k == axis else (0, 0) for k in range(a.ndim)]
    p = np.pad(a.astype(float), pad, mode="symmetric")
    return sum(w * np.take(p, range(k, k + a.shape[axis]), axis=axis) for k, w in enumerate(kernel))


def gaussian_kernel(sigma: float, truncate: float = 4.0, order: int = 0) -> np.ndarray:
    r = max(1, int(truncate * sigma + 0.5))
    x = np.arange(-r, r + 1)
    g = np.exp(-0.5 * (x / sigma) ** 2)
    g /= g.sum()
    if order == 2:
        g = g * (x**2 / sigma**4 - 1 / sigma**2)
        g -= g.mean()
    return g


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    if sigma <= 0:
        return a.astype(float)
    k = gaussian_kernel(sigma)
    for axis in range(a.ndim):
        a = correlate_axis(a, k, axis)
    return a


def difference_of_gaussians(a: np.ndarray, low: float, high: float) -> np.ndarray:
    return gaussian(a, low) - gaussian(a, high)


def laplacian_of_gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    g, d = gaussian_kernel(sigma), gaussian_kernel(sigma, order=2)
    out = np.zeros(a.shape)
    for axis in range(a.ndim):
        part = a.astype(float)
        for k in range(a.ndim):
            part = correlate_axis(part, d if k == axis else g, k)
        out += part
    return out


def box_mean(a: np.ndarray, size: int) -> np.ndarray:
    k = np.full(size, 1 / size)
    for axis in range(a.ndim):
        a = correlate_axis(a, k, axis)
    return a


def windows(a: np.ndarray, shape: np.ndarray, mode: str = "symmetric") -> np.ndarray:
    """Values under a footprint around each pixel, along a new last axis."""
    r = shape.shape[0] // 2
    p = _padded(a, r, mode)
    offsets = np.argwhere(shape)
    return np.stack([p[y : y + a.shape[0], x : x + a.shape[1]] for y, x in offsets], axis=-1)


def disk(r: int) -> np.ndarray:
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    return y * y + x * x <= r * r


def median(a: np.ndarray, r: int) -> np.ndarray:
    return np.median(windows(a, np.ones((2 * r + 1, 2 * r + 1), bool)), axis=-1)


def grey_erosion(a: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return windows(a, shape).min(axis=-1)


def grey_dilation(a: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return windows(a, shape).max(axis=-1)


def grey_opening(a: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return grey_dilation(grey_erosion(a, shape), shape)


def rolling_ball_removed(a: np.ndarray, radius: int, share: float = 0.75) -> np.ndarray:
    """a less a share of its opening with a disk, held at 0."""
    return np.maximum(a - share * grey_opening(a, disk(radius)), 0)


def bilateral(a: np.ndarray, r: int, sigma_space: float, sigma_value: float) -> np.ndarray:
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    near = np.exp(-0.5 * (y * y + x * x) / sigma_space**2).ravel()
    w = windows(a.astype(float), np.ones((2 * r + 1, 2 * r + 1), bool))
    weight = near * np.exp(-0.5 * ((w - a[..., None]) / sigma_value) ** 2)
    return (w * weight).sum(-1) / weight.sum(-1)


def bandpass(a: np.ndarray, low: float, high: float) -> np.ndarray:
    """Frequencies (cycles a pixel) within [low, high]."""
    fy, fx = np.fft.fftfreq(a.shape[0])[:, None], np.fft.fftfreq(a.shape[1])[None, :]
    f = np.hypot(fy, fx)
    return np.fft.ifft2(np.fft.fft2(a) * ((f >= low) & (f <= high))).real


def local_contrast(a: np.ndarray, sigma: float) -> np.ndarray:
    return a / (gaussian(a, sigma) + np.percentile(a, 5) + 1e-6)


def equalized(a: np.ndarray, tiles: int = 4, bins: int = 64, clip: float = 0.02) -> np.ndarray:
    """Contrast-limited adaptive equalisation: tile histograms, clipped, interpolated between tile centres."""
    lo, hi = a.min(), a.max()
    if hi <= lo:
        return np.zeros(a.shape)
    q = np.minimum(((a - lo) / (hi - lo) * bins).astype(int), bins - 1)
    ys, xs = np.linspace(0, a.shape[0], tiles + 1).astype(int), np.linspace(0, a.shape[1], tiles + 1).astype(int)
    maps = np.zeros((tiles, tiles, bins))
    for i in range(tiles):
        for j in range(tiles):
            part = q[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)]
            h = np.bincount(part.ravel(), minlength=bins) / part.size
            h = np.minimum(h, max(clip, 1 / bins))
            maps[i, j] = np.cumsum(h + (1 - h.sum()) / bins)
    cy, cx = (ys[:-1] + ys[1:] - 1) / 2, (xs[:-1] + xs[1:] - 1) / 2
    fy, fx = np.interp(np.arange(a.shape[0]), cy, np.arange(tiles)), np.interp(np.arange(a.shape[1]), cx, np.arange(tiles))
    i0, j0 = np.minimum(fy.astype(int), tiles - 1), np.minimum(fx.astype(int), tiles - 1)
    i1, j1 = np.minimum(i0 + 1, tiles - 1), np.minimum(j0 + 1, tiles - 1)
    wy, wx = (fy - i0)[:, None], (fx - j0)[None, :]
    at = lambda i, j: maps[i[:, None], j[None, :], q]
    return (1 - wy) * ((1 - wx) * at(i0, j0) + wx * at(i0, j1)) + wy * ((1 - wx) * at(i1, j0) + wx * at(i1, j1))


# thresholds


def histogram(a: np.ndarray, bins: int = 256) -> tuple[np.ndarray, np.ndarray]:
    counts, edges = np.histogram(a, bins)
    return counts.astype(float), (edges[:-1] + edges[1:]) / 2


def otsu(a: np.ndarray) -> float:
    c, mid = histogram(a)
    w0, w1 = np.cumsum(c)[:-1], c.sum() - np.cumsum(c)[:-1]
    s = np.cumsum(c * mid)
    m0, m1 = s[:-1] / np.maximum(w0, 1), (s[-1] - s[:-1]) / np.maximum(w1, 1)
    return float(mid[np.argmax(w0 * w1 * (m0 - m1) ** 2)])


def multi_otsu(a: np.ndarray, bins: int = 128) -> tuple[float, float]:
    """Two thresholds of three classes: all pairs of cuts at once."""
    c, mid = histogram(a, bins)
    n, s = np.r_[0, np.cumsum(c)], np.r_[0, np.cumsum(c * mid)]
    i, j = np.triu_indices(bins - 1, 1)
    score = np.zeros(len(i))
    for lo, hi in ((np.zeros_like(i), i + 1), (i + 1, j + 1), (j + 1, np.full_like(j, bins))):
        score += (s[hi] - s[lo]) ** 2 / np.maximum(n[hi] - n[lo], 1e-12)
    k = int(np.argmax(score))
    return float(mid[i[k]]), float(mid[j[k]])


def li(a: np.ndarray) -> float:
    """Minimum cross-entropy by fixed-point iteration."""
    low = a.min()
    b = a - low + 1e-9
    t = b.mean()
    for _ in range(200):
        fore, back = b[b > t], b[b <= t]
        if not len(fore) or not len(back):
            break
        m1, m0 = fore.mean(), back.mean()
        new = (m1 - m0) / (np.log(m1) - np.log(max(m0, 1e-12)))
        if abs(new - t) < 1e-6 * max(1.0, abs(t)):
            break
        t = new
    return float(t + low - 1e-9)


def triangle(a: np.ndarray) -> float:
    c, mid = histogram(a)
    peak, used = int(np.argmax(c)), np.flatnonzero(c)
    left, right = used[0], used[-1]
    end = right if right - peak >= peak - left else left
    x = np.arange(min(peak, end), max(peak, end) + 1)
    if len(x) < 2:
        return float(mid[peak])
    line = np.interp(x, sorted((peak, end)), [c[k] for k in sorted((peak, end))])
    return float(mid[x[np.argmax(line - c[x])]])


def niblack(a: np.ndarray, size: int, k: float) -> np.ndarray:
    m = box_mean(a, size)
    return m - k * np.sqrt(np.maximum(box_mean(a.astype(float) ** 2, size) - m * m, 0))


def sauvola(a: np.ndarray, size: int, k: float, spread: float | None = None) -> np.ndarray:
    m = box_mean(a, size)
    s = np.sqrt(np.maximum(box_mean(a.astype(float) ** 2, size) - m * m, 0))
    return m * (1 + k * (s / (spread or (a.max() - a.min()) / 2 or 1.0) - 1))


# masks


def erode(m: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return windows(m, shape, "constant").all(axis=-1)


def dilate(m: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return windows(m, shape, "constant").any(axis=-1)


def label(m: np.ndarray, eight: bool = True) -> np.ndarray:
    """Connected components numbered in reading order: smallest index spread by pointer jumping."""
    big = m.size
    root = np.where(m, np.arange(m.size).reshape(m.shape), big)
    shape = np.ones((3, 3), bool) if eight else disk(1)
    while True:
        p = np.pad(root, 1, constant_values=big)
        new = np.min([p[y : y + m.shape[0], x : x + m.shape[1]] for y, x in np.argwhere(shape)], axis=0)
        new = np.where(m, new, big)
        flat = np.r_[new.ravel(), big]
        new = np.where(m, flat[new], big)
        if (new == root).all():
            break
        root = new
    out = np.zeros(m.shape, np.int64)
    out[m] = np.unique(root[m], return_inverse=True)[1] + 1
    return out


def fill_holes(m: np.ndarray) -> np.ndarray:
    back = label(~np.pad(m, 1), eight=False)
    return (back != back[0, 0])[1:-1, 1:-1]


def distance(m: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance to the nearest background pixel: column distances, then the lower envelope along rows."""
    h, w = m.shape
    d = np.where(m, np.inf, 0.0)
    for y in range(1, h):
        d[y] = np.minimum(d[y], d[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        d[y] = np.minimum(d[y], d[y + 1] + 1)
    gap = (np.arange(w)[:, None] - np.arange(w)[None, :]) ** 2.0
    # one row at a time, so memory is the square of the width, not the height times that
    return np.sqrt(np.array([(row**2 + gap).min(axis=1) for row in d]).reshape(h, w))


def inversions(ranks: np.ndarray) -> int:
    """Pairs of places whose ranks (0 ..) stand in falling order. Bit by bit from the highest: among places with equal
    higher bits, each 0 is inverted with the 1s before it."""
    now, total = np.asarray(ranks, np.int64), 0
    for bit in range(int(now.max(initial=0)).bit_length() - 1, -1, -1):
        ones = now >> bit & 1
        upto = np.cumsum(ones)
        first = np.flatnonzero(np.r_[True, np.diff(now >> (bit + 1)) != 0])
        before = np.repeat(np.r_[0, upto][first], np.diff(np.r_[first, len(now)]))
        total += int((upto - before)[ones == 0].sum())
        now = now[np.argsort(now >> bit, kind="stable")]
    return total


def kendall(a: np.ndarray, b: np.ndarray) -> float:
    """tau-b in n log n: discordant pairs are inversions of b in the order of a; nan without spread."""
    _, a = np.unique(a, return_inverse=True)
    _, b = np.unique(b, return_inverse=True)
    tied = lambda k: int((k * (k - 1) // 2).sum())
    order = np.lexsort((b, a))
    pairs = len(a) * (len(a) - 1) // 2
    in_a, in_b = tied(np.bincount(a)), tied(np.bincount(b))
    in_both = tied(np.unique(a * (int(b.max(initial=0)) + 1) + b, return_counts=True)[1])
    free = float(pairs - in_a) * float(pairs - in_b)
    return (pairs - in_a - in_b + in_both - 2 * inversions(b[order])) / free**0.5 if free > 0 else float("nan")


def peaks(a: np.ndarray, least: float, r: int = 1) -> np.ndarray:
    """Coordinates of local maxima above `least`; of a plateau the first pixel."""
    top = (a == grey_dilation(a, np.ones((2 * r + 1, 2 * r + 1), bool))) & (a > least)
    lab = label(top)
    return np.array([np.argwhere(lab == k)[0] for k in range(1, lab.max() + 1)]).reshape(-1, 2)


def watershed(a: np.ndarray, seeds: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Flooding of a from labelled seeds within a mask, lowest first; ties in the order of arrival."""
    out, heap, n = np.where(m, seeds, 0), [], 0
    for y, x in np.argwhere(out > 0):
        heapq.heappush(heap, (a[y, x], n, y, x))
        n += 1
    while heap:
        _, _, y, x = heapq.heappop(heap)
        for dy, dx in ((-1, 0), (0, -1), (0, 1), (1, 0)):
            v, u = y + dy, x + dx
            if 0 <= v < a.shape[0] and 0 <= u < a.shape[1] and m[v, u] and not out[v, u]:
                out[v, u] = out[y, x]
                heapq.heappush(heap, (a[v, u], n, v, u))
                n += 1
    return out


def split_touching(m: np.ndarray, least: float = 1.0, sigma: float = 1.0) -> np.ndarray:
    """Labels of a mask, touching objects split along the watershed of the smoothed distance."""
    d = distance(m)
    s = gaussian(d, sigma) * m
    seeds = np.zeros(m.shape, np.int64)
    for k, (y, x) in enumerate(peaks(s, least), 1):
        seeds[y, x] = k
    rest = label(m)
    for k in range(1, rest.max() + 1):
        inside = rest == k
        if not seeds[inside].any():
            y, x = np.argwhere(inside)[0]
            seeds[y, x] = seeds.max() + 1
    return watershed(-s, seeds, m)


# spectra and shifts


def autocorrelation(a: np.ndarray) -> np.ndarray:
    """Mean-subtracted circular autocorrelation, scaled to [0, 1], zero shift in the centre."""
    f = np.fft.fft2(a - a.mean())
    c = np.fft.fftshift(np.fft.ifft2(f * f.conj()).real)
    return (c - c.min()) / (np.ptp(c) or 1.0)


def correlation_length(a: np.ndarray, most: int = 64) -> int:
    """First lag along rows at which the autocorrelation is below 1/e."""
    f = np.fft.fft(a - a.mean(), axis=1)
    c = np.fft.ifft(f * f.conj(), axis=1).real.mean(axis=0)
    c = c / (c[0] or 1.0)
    below = np.flatnonzero(c[: min(most, len(c) // 2) + 1] < np.exp(-1))
    return int(below[0]) if len(below) else min(most, len(c) // 2)


def shift_between(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Shift of b against a by phase correlation, refined by a parabola around the peak."""
    f = np.fft.fft2(b) * np.fft.fft2(a).conj()
    c = np.fft.ifft2(f / np.maximum(np.abs(f), 1e-12)).real
    at = np.unravel_index(np.argmax(c), c.shape)
    out = []
    for axis, k in enumerate(at):
        n = c.shape[axis]
        line = [c[tuple((k + d) % n if ax == axis else v for ax, v in enumerate(at))] for d in (-1, 0, 1)]
        den = line[0] - 2 * line[1] + line[2]
        sub = 0.5 * (line[0] - line[2]) / den if abs(den) > 1e-12 else 0.0
        out.append(float((k + n // 2) % n - n // 2 + sub))
    return out[0], out[1]


def detect_blobs(a: np.ndarray, sigmas: list[float], least: float) -> list[tuple[int, int, float, float]]:
    """(y, x, sigma, response) of maxima over space and scale of the normalised negative Laplacian."""
    stack = np.stack([-(s**2) * laplacian_of_gaussian(a, s) for s in sigmas])
    best, which = stack.max(axis=0), stack.argmax(axis=0)
    return [(int(y), int(x), float(sigmas[which[y, x]]), float(best[y, x])) for y, x in peaks(best, least)]


def clean(a: np.ndarray, sigma: float, least: float, gain: float = 0.5, most: int = 10_000) -> list[tuple[int, int, float]]:
    """Spots by repeated peak finding and subtraction of a scaled point spread; flux adds up by place."""
    r = int(4 * sigma + 1)
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    psf = np.exp(-0.5 * (y * y + x * x) / sigma**2)
    rest, flux = _padded(a.astype(float), r, "constant"), {}
    inside = rest[r:-r, r:-r]
    for _ in range(most):
        py, px = np.unravel_index(np.argmax(inside), inside.shape)
        top = inside[py, px]
        if top < least:
            break
        rest[py : py + 2 * r + 1, px : px + 2 * r + 1] -= gain * top * psf
        flux[py, px] = flux.get((py, px), 0.0) + gain * top
    return [(int(k[0]), int(k[1]), float(v)) for k, v in sorted(flux.items())]
