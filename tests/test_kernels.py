import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framewright.kernels import geometry as G
from framewright.kernels import hierarchy as H
from framewright.kernels import segmentation as S
from framewright.kernels import statistics as K


def steps(rng, sizes, d=1, noise=0.1):
    return np.concatenate([np.full((n, d), rng.normal(0, 3)) + rng.normal(0, noise, (n, d)) for n in sizes])


def exhaustive(cost, penalty, size, jump):
    grid = [0, *S._grid(cost.n, jump).tolist()]
    best = {0: (-penalty, ())}
    for b in grid[1:]:
        options = [(v + cost(a, b) + penalty, bk + ((a,) if a else ())) for a, (v, bk) in best.items() if b - a >= max(size, cost.least)]
        if options:
            best[b] = min(options, key=lambda o: o[0])
    return best.get(cost.n, (None, ()))[0]


def total(cost, bkps, penalty):
    ends = [0, *bkps, cost.n]
    return sum(cost(a, b) for a, b in zip(ends, ends[1:])) + penalty * len(bkps)


@pytest.mark.parametrize("name", ["l2", "rbf", "l1", "normal", "rank", "mahalanobis"])
@pytest.mark.parametrize("seed", range(3))
def test_pelt_is_optimal(name, seed):
    rng = np.random.default_rng(seed)
    x = steps(rng, rng.integers(5, 20, 4), 2, 0.5)
    cost = S.COSTS[name](x)
    for penalty in (0.5, 3.0):
        found = S.pelt(cost, penalty, 2, 1)
        if name in ("l2", "rbf", "mahalanobis"):  # pruning is exact where splitting never costs more
            assert abs(total(cost, found, penalty) - exhaustive(cost, penalty, 2, 1)) < 1e-8
        assert all(b - a >= 2 for a, b in zip([0, *found], [*found, len(x)]))


@pytest.mark.parametrize("method", ["pelt", "binseg", "bottomup", "window", "kernelcpd"])
def test_planted_step(method):
    rng = np.random.default_rng(1)
    x = S.signal_matrix(np.r_[rng.normal(0, 0.1, 100), rng.normal(5, 0.1, 100)][:, None])
    found = S.detect(x, method, "l2", 5.0, jump=5, width=40)
    assert found == [100]


def test_dynamic_finds_exact_number():
    rng = np.random.default_rng(2)
    x = np.r_[np.zeros(20), np.ones(30) * 4, np.ones(25) * -3][:, None] + rng.normal(0, 0.05, (75, 1))
    assert S.dynamic(S.L2(x), 2, 2, 1) == [20, 50]
    assert S.detect(x, "dynp", "l2", n_bkps=2, jump=1) == [20, 50]
    assert S.binary(S.L2(x), 2, None, 2, 1) == [20, 50]


def test_linear_and_autoregressive_costs():
    t = np.arange(60.0)
    y = np.where(t < 30, 2 * t, 60 - t)
    x = np.column_stack([y, t, np.ones(60)])
    assert S.dynamic(S.Linear(x), 1, 3, 1) in ([30], [29], [31])
    assert S.Autoregressive(y)(0, 30) < 1e-6 + S.Autoregressive(y)(10, 50)


def test_signal_matrix_and_grid():
    x = np.array([[1, np.inf, 3], [2, 4, 3], [3, np.nan, 3.0]])
    z = S.signal_matrix(x)
    assert z.shape == (3, 1) and abs(z.mean()) < 1e-12 and abs(z.std() - 1) < 1e-12
    grid = S.penalty_grid(1000, 5)
    assert abs(grid[0] - 0.2 * math.log(1000)) < 1e-9 and abs(grid[-1] - 5 * math.log(1000)) < 1e-9
    assert S.detect(np.zeros((1, 1))) == []


def test_recrossings():
    assert S.suppress_recrossings(np.array(list("AABAACCA")), 2).tolist() == list("AAAAACCA")
    assert S.suppress_recrossings(np.array(list("AABCC")), 2).tolist() == list("AABCC")


@pytest.mark.parametrize("method", ["ward", "average", "complete", "single", "weighted"])
def test_linkage_against_plain(method):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(14, 3))
    d0 = H.pairwise(x)
    z = H.linkage(d0, method)
    clusters = {i: [i] for i in range(14)}
    d = {frozenset((i, j)): d0[i, j] for i in range(14) for j in range(i)}
    heights, new = [], 14
    while len(clusters) > 1:
        a, b = min((tuple(p) for p in d), key=lambda p: d[frozenset(p)])
        h = d[frozenset((a, b))]
        heights.append(h)
        for k in list(clusters):
            if k in (a, b):
                continue
            da, db = d.pop(frozenset((a, k))), d.pop(frozenset((b, k)))
            na, nb, nk = len(clusters[a]), len(clusters[b]), len(clusters[k])
            d[frozenset((new, k))] = {"ward": math.sqrt(max(0, ((na + nk) * da**2 + (nb + nk) * db**2 - nk * h**2) / (na + nb + nk))), "average": (na * da + nb * db) / (na + nb), "complete": max(da, db), "single": min(da, db), "weighted": (da + db) / 2}[method]
        del d[frozenset((a, b))]
        clusters[new] = clusters.pop(a) + clusters.pop(b)
        new += 1
    assert np.allclose(np.sort(z[:, 2]), np.sort(heights))
    assert (z[:, 3][-1]) == 14


def test_cut_and_silhouette():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.1, (10, 2)) for c in (0, 5, 10)])
    d = H.pairwise(x)
    labels = H.cut(H.linkage(d), 3)
    assert [set(labels[k * 10 : k * 10 + 10]) for k in range(3)] == [{1}, {2}, {3}]
    assert H.silhouette(d, labels) > 0.9
    assert H.medoids(d, labels).keys() == {1, 2, 3}


@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 1000))
@settings(max_examples=80, deadline=None)
def test_assignment(n, m, seed):
    cost = np.random.default_rng(seed).normal(size=(n, m))
    pairs = H.assign(cost)
    got = sum(cost[a, b] for a, b in pairs)
    small, large = (n, m) if n <= m else (m, n)
    best = min(sum(cost[(i, p[i]) if n <= m else (p[i], i)] for i in range(small)) for p in itertools.permutations(range(large), small))
    assert len(pairs) == small and abs(got - best) < 1e-9


def test_assignment_forbidden():
    cost = np.array([[np.inf, 1.0, 5], [2, np.inf, 1], [1, 4, np.inf]])
    assert H.assign(cost) == [(0, 1), (1, 2), (2, 0)]


def test_families():
    assert H.families(4, [(0, 1), (1, 2)], "single") == [0, 0, 0, 1]
    assert H.families(4, [(0, 1), (1, 2)], "complete") == [0, 0, 1, 2]


def test_superposition():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(12, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    b = a @ q + 3
    assert G.rmsd_superposed(a, b) < 1e-9
    assert G.rmsd_rotated(a, a @ q) < 1e-9 and G.rmsd_rotated(a, b) > 0.1
    mirror = a * [1, 1, -1]
    assert G.rmsd_superposed(a, mirror) > 0.1 and G.rmsd_superposed(a, mirror, True) < 1e-9
    assert np.allclose(G.superpose(a, a, b), b)


def test_matched():
    a, b = np.arange(12.0).reshape(4, 3), np.arange(100.0, 109.0).reshape(3, 3)
    p, q = G.matched(a, b, [1, 2, 2, 5], [0, 2, 5])
    assert np.array_equal(p, a[[1, 3]]) and np.array_equal(q, b[[1, 2]])
    p, q = G.matched(a, b, [1, 2, 2, 5], [2, 2, 9])
    assert np.array_equal(p, a[[1, 2]]) and np.array_equal(q, b[[0, 1]])
    p, q = G.matched(a[:3], b)
    assert np.array_equal(p, a[:3]) and np.array_equal(q, b)
    assert not len(G.matched(a, b, [1, 2, 3, 4], [5, 6, 7])[0])
    with pytest.raises(ValueError):
        G.matched(a, b)


def test_shape_plane_strain():
    line = np.column_stack([np.arange(9.0), np.zeros(9), np.zeros(9)])
    s = G.shape(line)
    assert abs(s["anisotropy"] - 1) < 1e-9 and abs(s["rg"] ** 2 - line[:, 0].var()) < 1e-9
    normal, rms = G.plane(np.array([[0, 0, 1], [1, 0, 1], [0, 1, 1], [1, 1, 1.0]]))
    assert abs(abs(normal[2]) - 1) < 1e-9 and rms < 1e-9
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20, 3))
    assert np.nanmax(G.affine_strain(np.array([x, x, x]), 1)) < 1e-9 and np.isnan(G.affine_strain(np.array([x, x, x]))).all()
    frames = rng.normal(size=(30, 7, 3)) + 5
    for window, lag in ((10, 1), (3, 2), (1, 1)):
        want = np.full(30, np.nan)
        for t in range(window, 30 - lag):
            a, b = frames[t - window : t].reshape(-1, 3), frames[t - window + lag : t + lag].reshape(-1, 3)
            f = np.linalg.lstsq(np.c_[a, np.ones(len(a))], b, rcond=None)[0][:3]
            want[t] = np.linalg.norm(0.5 * (f.T @ f - np.eye(3)))
        assert np.allclose(G.affine_strain(frames, window, lag), want, equal_nan=True)


def test_volume_and_cavities():
    p, r = np.array([[0.0, 0, 0]]), np.array([2.0])
    grid, _ = G.voxels(p, r, 0.1, 0.5)
    assert abs(grid.sum() * 1e-3 - 4 / 3 * math.pi * 8) < 0.5
    shell = np.zeros((9, 9, 9), bool)
    shell[2:7, 2:7, 2:7] = True
    shell[4, 4, 4] = False
    assert G.cavities(shell).sum() == 1
    shell[4, 4, :4] = False
    assert G.cavities(shell).sum() == 0
    v = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1.0]])
    f = np.array([[0, 2, 1], [0, 1, 3], [0, 3, 2], [1, 2, 3]])
    assert abs(G.mesh_volume(v, f) - 1 / 6) < 1e-12


def test_hull_and_pairs():
    pts = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1.0]])
    assert set(G.hull(pts)) == {0, 1, 2, 3}
    c = np.array([[1, 0, 0], [-1, 0, 0], [0, 2, 0], [0, -2, 0.0]])
    assert [(i, j) for i, j, _ in G.opposite_pairs(c)] == [(2, 3), (0, 1)]


def test_bh_and_permutation():
    q = K.bh(np.array([0.01, 0.04, 0.03, np.nan, 0.5]))
    assert np.allclose(q[[0, 1, 2, 4]], [0.04, 0.16 / 3, 0.16 / 3, 0.5]) and np.isnan(q[3])
    rng = np.random.default_rng(7)
    y = np.repeat([0, 1], 30)
    x = np.column_stack([y + rng.normal(0, 0.2, 60), rng.normal(size=60), np.ones(60)])
    eta, p = K.permutation_p(x, y, 199)
    assert p[0] == 1 / 200 and p[1] > 0.02 and np.isnan(eta[2]) and np.isnan(p[2])


def test_signed_rank_and_pearson():
    assert abs(K.wilcoxon(np.array([1, 2, 3, 4, 5, 6.0])) - 2 / 64) < 1e-12
    assert K.wilcoxon(np.array([1.0, -1, 2, -2])) == 1.0
    exact = sum(1 for s in itertools.product((0, 1), repeat=8) if min(sum(k + 1 for k, v in enumerate(s) if v), 36 - sum(k + 1 for k, v in enumerate(s) if v)) <= 6) / 256
    assert abs(K.wilcoxon(np.array([1, 2, -3, 4, 5, 6, 7, 8.0]) * [1, -1, 1, 1, 1, 1, 1, 1]) - exact) < 0.2
    assert abs(K.pearson_p(0.5, 10) - 0.1411) < 1e-3
    assert abs(K.incomplete_beta(2, 3, 0.4) - 0.5248) < 1e-4


def test_two_sample():
    a, b = np.array([0.0, 1, 3]), np.array([5.0, 6, 8])
    assert K.wasserstein(a, b) == 5
    brute = 2 * np.abs(a[:, None] - b).mean() - np.abs(a[:, None] - a).mean() - np.abs(b[:, None] - b).mean()
    assert abs(K.energy_distance(a, b) - brute) < 1e-12
    rng = np.random.default_rng(8)
    x, blocks = np.r_[rng.normal(0, 1, 60), rng.normal(3, 1, 60)], np.repeat(np.arange(12), 10)
    assert K.block_energy_p(x, np.repeat([0, 1], 60), blocks)[1] < 0.05


def test_populations_and_peaks():
    rng = np.random.default_rng(9)
    two = np.r_[rng.normal(0, 1, 200), rng.normal(8, 1, 150)]
    assert K.two_populations(two, np.arange(350) % 7)["verdict"] == "two_populations"
    assert K.two_populations(rng.normal(size=300))["verdict"] == "one_population"
    assert K.two_populations(two[:5])["verdict"] == "too_few"
    found = [p for p, _, _ in K.histogram_peaks(two, 0.25)]
    assert len(found) == 2 and abs(found[0]) < 0.5 and abs(found[1] - 8) < 0.5


def test_information():
    t = np.diag([10, 20, 30])
    assert abs(K.adjusted_mutual_information(t) - 1) < 1e-9
    rng = np.random.default_rng(10)
    a, b = rng.integers(0, 4, 400), rng.integers(0, 4, 400)
    table = np.zeros((4, 4))
    np.add.at(table, (a, b), 1)
    assert abs(K.adjusted_mutual_information(table)) < 0.03


def test_hold_out_and_relabelling():
    rng = np.random.default_rng(11)
    y = np.repeat([0, 1], 40)
    x = np.column_stack([y * 3 + rng.normal(0, 1, 80), rng.normal(size=80)])
    assert K.balanced_accuracy(x, y, np.arange(80) % 8, 4, 2) > 0.85
    m = np.array([[0, 1, 2], [2, 1, 0]])
    r = np.array([[1, 2, 3], [3, 2, 1], [9, 9, 9.0]])
    d = K.permuted_distances(r, m)
    assert d[0, 1] == 0 and d[0, 2] == K.permuted_distance(r[0], r[2], m)
    assert K.best_profile_r(r[0], r[1], m) > 0.999
    assert (K.reorient(r[:2], r[0], m) == r[0]).all()
    assert abs(K.coverage(x[:40], x[:40], np.array([[0, 1]]), 0.95) - 0.95) < 0.04


def test_automorphisms():
    octahedron = [(i, j) for i in range(6) for j in range(i + 1, 6) if j != i + 3]
    found = K.automorphisms(octahedron, 6)
    assert len(found) == 48
    centres = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1], [-1, 0, 0], [0, -1, 0], [0, 0, -1.0]])
    assert sum(K.proper(p, centres) for p in found) == 24


def test_lda_and_tica():
    rng = np.random.default_rng(12)
    y = np.repeat([0, 1, 2], 50)
    x = rng.normal(size=(150, 4))
    x[:, 2] += 4 * y
    scores, load = K.lda(x, y)
    assert abs(load[2, 0]) > 3 * abs(np.delete(load[:, 0], 2)).max()
    n = 4000
    slow = np.cumsum(rng.normal(size=n)) * 0.01
    z = np.column_stack([rng.normal(size=n), slow + 0.1 * rng.normal(size=n)])
    z -= z.mean(axis=0)
    found = K.tica(z.T @ z / (n - 1), z[:-1].T @ z[1:] / (n - 1), 2)
    assert abs(found["vectors"][1, 0]) > abs(found["vectors"][0, 0]) and found["timescales"][0] > found["timescales"][1]


def test_gini_and_scores():
    assert K.gini(np.array([5, 5, 5])) == 0 and K.gini(np.array([0, 0, 9])) > 0.6
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.normal(c, 0.1, (20, 2)) for c in (0, 5)])
    s = K.cluster_scores(x, np.repeat([0, 1], 20))
    assert s["davies_bouldin"] < 0.2 and s["calinski_harabasz"] > 1000
    assert random.Random(1) is not None
