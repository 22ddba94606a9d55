"""Kernels against closed forms and brute force."""

import itertools
import math

import numpy as np
import pytest

from grainfield.functions import arrays, fits

RNG = np.random.default_rng(3)


def test_filters_keep_constants_and_sums():
    flat = np.full((20, 24), 7.0)
    for kernel in (lambda a: arrays.gaussian(a, 2), lambda a: arrays.box_mean(a, 5), lambda a: arrays.median(a, 1), lambda a: arrays.bilateral(a, 2, 1.0, 1.0)):
        assert np.allclose(kernel(flat), 7)
    assert np.allclose(arrays.difference_of_gaussians(flat, 1, 2), 0) and np.allclose(arrays.laplacian_of_gaussian(flat, 1.5), 0, atol=1e-6)
    dot = np.zeros((41, 41))
    dot[20, 20] = 1
    assert arrays.gaussian(dot, 2).sum() == pytest.approx(1) and arrays.gaussian(dot, 2)[20, 20] == pytest.approx(1 / (2 * math.pi * 4), rel=0.02)


def test_bandpass_keeps_its_band():
    x = np.arange(64)
    slow, fast = np.cos(2 * np.pi * x * 2 / 64), np.cos(2 * np.pi * x * 16 / 64)
    a = np.tile(slow + fast, (64, 1))
    assert np.allclose(arrays.bandpass(a, 0.2, 0.3), np.tile(fast, (64, 1)), atol=1e-9)


def test_thresholds_part_two_and_three_levels():
    two = np.r_[RNG.normal(10, 1, 5000), RNG.normal(50, 2, 3000)]
    for f in (arrays.otsu, arrays.li):
        assert 13 < f(two) < 45
    assert 10 < arrays.triangle(two) < 50
    low, high = arrays.multi_otsu(np.r_[two, RNG.normal(90, 2, 3000)])
    assert 13 < low < 45 and 55 < high < 85


def test_distance_and_labels():
    m = RNG.random((17, 23)) < 0.8
    back = np.argwhere(~m)
    want = np.array([[0 if not m[y, x] else np.sqrt(((back - (y, x)) ** 2).sum(1)).min() for x in range(23)] for y in range(17)])
    assert np.allclose(arrays.distance(m), want)
    lab = arrays.label(m)
    seen = set()
    for y, x in np.argwhere(m):
        for dy, dx in itertools.product((-1, 0, 1), repeat=2):
            v, u = y + dy, x + dx
            if 0 <= v < 17 and 0 <= u < 23 and m[v, u]:
                assert lab[v, u] == lab[y, x]
        seen.add(lab[y, x])
    assert seen == set(range(1, lab.max() + 1)) and (lab > 0).sum() == m.sum()


def test_fill_holes_and_split():
    y, x = np.indices((40, 60))
    ring = (np.hypot(y - 20, x - 20) < 12) & (np.hypot(y - 20, x - 20) > 6)
    assert (arrays.fill_holes(ring) == (np.hypot(y - 20, x - 20) < 12)).all()
    two = (np.hypot(y - 20, x - 20) < 10) | (np.hypot(y - 20, x - 36) < 10)
    split = arrays.split_touching(two)
    assert split.max() == 2 and split[20, 14] != split[20, 42] and ((split > 0) == two).all()


def test_puncta_are_found():
    y, x = np.indices((128, 128))
    a = RNG.normal(100, 5, (128, 128))
    truth = [(16 + 24 * i, 16 + 24 * j) for i in range(5) for j in range(4)]
    for cy, cx in truth:
        a += 500 * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * 2.0**2))
    found = [(p[0], p[1]) for p in arrays.detect_blobs((a - a.min()) / np.ptp(a), [1.5, 2.0, 2.5], 0.2)]
    assert len(found) == 20 and all(min(math.hypot(fy - cy, fx - cx) for fy, fx in found) < 2 for cy, cx in truth)
    cleaned = arrays.clean(np.maximum(a - 120, 0), 2.0, 100.0)
    assert 20 * (480 - 100) <= sum(f for *_, f in cleaned) <= 20 * 520  # up to the stopping level stays behind


def test_shift_is_recovered():
    a = arrays.gaussian(RNG.random((64, 64)), 1.5)
    assert arrays.shift_between(a, np.roll(a, (3, -5), (0, 1))) == pytest.approx((3, -5), abs=0.05)


def test_fits_recover_their_parameters():
    t = np.linspace(0, 60, 80)
    r = fits.fit_recovery(t, fits.recovery(t, 0.2, 0.8, 7.0))
    assert (r["a"], r["b"], r["half"], r["mobile"]) == pytest.approx((0.2, 0.8, 7.0, 0.75), rel=1e-4)
    d = fits.fit_decay(t, fits.decay(t, 100, 12, 20) + RNG.normal(0, 0.5, 80))
    assert d["tau"] == pytest.approx(12, rel=0.1) and d["r2"] > 0.99
    y, x = np.indices((15, 15))
    s = fits.fit_spot(30 * np.exp(-((y - 6.7) ** 2 + (x - 7.4) ** 2) / (2 * 1.8**2)) + 5)
    assert (s["cy"], s["cx"], s["sigma"]) == pytest.approx((6.7, 7.4, 1.8), rel=1e-3)


def test_assignment_is_optimal():
    for n, m in ((1, 1), (3, 5), (5, 3), (6, 6)):
        c = RNG.random((n, m))
        got = sum(c[i, j] for i, j in fits.assignment(c))
        small = min(n, m)
        best = min(sum(c[i, j] for i, j in zip(rows, cols)) for rows in itertools.combinations(range(n), small) for cols in itertools.permutations(range(m), small))
        assert got == pytest.approx(best)


def test_sparse_assignment_is_optimal():
    for k in range(60):
        n, m, skip = (*RNG.integers(1, 15, 2), RNG.choice([0.3, 0.8, 3.0]))
        c = np.where(RNG.random((n, m)) < RNG.choice([0.2, 0.6, 1.0]), RNG.random((n, m)), np.inf)
        if k % 3 == 0:
            c = np.round(c, 1)
        of = fits.sparse_assignment([[(j, x) for j, x in enumerate(row.tolist()) if x < np.inf] for row in c], m, skip)
        used = [j for j in of if j >= 0]
        assert len(used) == len(set(used))
        full = np.full((n, m + n), 1e6)
        full[:, :m] = np.where(c < np.inf, c, 1e6)
        full[np.arange(n), m + np.arange(n)] = skip
        assert sum(c[i, j] if j >= 0 else skip for i, j in enumerate(of)) == pytest.approx(sum(full[i, j] for i, j in fits.assignment(full)))


def test_p_values_of_tables():
    assert fits.t_p(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert fits.f_p(4.10, 2, 10) == pytest.approx(0.05, abs=5e-4)
    assert fits.chi2_p(5.991, 2) == pytest.approx(0.05, abs=1e-4)
    assert fits.ranks(np.array([3, 1, 3, 2])).tolist() == [3.5, 1, 3.5, 2]
    with pytest.raises(ValueError):
        fits.compare([np.array([1.0]), np.array([1.0, 2.0])])
    assert fits.compare([np.arange(20.0), np.arange(20.0) + 30])[2] < 1e-5
    assert fits.compare([RNG.normal(0, 1, 30) for _ in range(3)], parametric=True)[2] > 0.001


def test_threshold_masks_follow_the_local_mean():
    a = np.tile(np.linspace(0, 100, 64), (64, 1))
    a[::8, ::8] += 30
    assert ((a > arrays.niblack(a, 9, -1.5))[::8, ::8][1:-1, 1:-1]).all()


def test_sparse_transport_costs_what_the_assignment_of_all_copies_costs():
    rng = np.random.default_rng(8)
    for _ in range(60):
        n, m, skip = int(rng.integers(1, 6)), int(rng.integers(1, 6)), 1.2
        c = np.where(rng.random((n, m)) < 0.7, rng.integers(0, 9, (n, m)) / 4, np.inf)
        supply, capacity = rng.integers(1, 5, n).tolist(), rng.integers(1, 5, m).tolist()
        edges = [[(j, x) for j, x in enumerate(row.tolist()) if x < np.inf] for row in c]
        flow = fits.sparse_transport(edges, supply, capacity, skip)
        assert all(sum(f.values()) <= s for f, s in zip(flow, supply, strict=True))
        assert all(sum(f.get(j, 0) for f in flow) <= k for j, k in enumerate(capacity))
        cost = sum(many * c[i, j] for i, f in enumerate(flow) for j, many in f.items()) + skip * (sum(supply) - sum(sum(f.values()) for f in flow))
        copies = np.repeat(np.repeat(c, supply, 0), capacity, 1)
        of = fits.sparse_assignment([[(j, x) for j, x in enumerate(row.tolist()) if x < np.inf] for row in copies], copies.shape[1], skip)
        assert np.isclose(cost, sum(copies[i, j] if j >= 0 else skip for i, j in enumerate(of)))


def test_sparse_transport_moves_whole_classes():
    """A million copies of each row and column take the steps of one."""
    many = 1_000_000
    assert fits.sparse_transport([[(0, 1.0), (1, 2.0)], [(0, 0.5)]], [many, many], [many, many], 9.0) == [{1: many}, {0: many}]
