"""Rigid superposition, shape, planes, strain, hulls and voxels of one frame."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np


def matched(a: np.ndarray, b: np.ndarray, ids_a: Sequence | None = None, ids_b: Sequence | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The points of a and b, row by row, that both have at a finite place: by their ids, or as they stand if either has none."""
    if ids_a is None or ids_b is None:
        if len(a) != len(b):
            raise ValueError(f"{len(a)} and {len(b)} points can only be matched by ids")
    elif not np.array_equal(ids_a, ids_b):
        at = {key: n for n, key in enumerate(_numbered(ids_b))}
        both = [(m, at[key]) for m, key in enumerate(_numbered(ids_a)) if key in at]
        a, b = a[[m for m, _ in both]], b[[n for _, n in both]]
    known = np.isfinite(a).all(axis=1) & np.isfinite(b).all(axis=1)
    return a[known], b[known]


def _numbered(ids: Sequence) -> Iterator[tuple]:
    """Each id with the number of equal ones before it."""
    seen: Counter = Counter()
    for i in ids:
        yield i, seen[i]
        seen[i] += 1


def rotation(mobile: np.ndarray, reference: np.ndarray, reflect: bool = False) -> np.ndarray:
    """The rotation that brings mobile nearest to reference, both taken as they stand."""
    u, _, vt = np.linalg.svd(mobile.T @ reference)
    sign = 1.0 if reflect else np.sign(np.linalg.det(u @ vt))
    return u @ np.diag([1.0, 1.0, sign or 1.0]) @ vt


def rmsd_rotated(a: np.ndarray, b: np.ndarray) -> float:
    """After the best rotation about the origin; nothing is centred."""
    return float(np.sqrt(((a @ rotation(a, b) - b) ** 2).sum(axis=1).mean()))


def rmsd_superposed(a: np.ndarray, b: np.ndarray, reflect: bool = False) -> float:
    """After centring both and the best rotation, with reflections if allowed."""
    a, b = a - a.mean(axis=0), b - b.mean(axis=0)
    return float(np.sqrt(((a @ rotation(a, b, reflect) - b) ** 2).sum(axis=1).mean()))


def superpose(points: np.ndarray, mobile: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """All points moved as the selection mobile must move to lie on reference."""
    centre = mobile.mean(axis=0)
    return (points - centre) @ rotation(mobile - centre, reference - reference.mean(axis=0)) + reference.mean(axis=0)


def shape(points: np.ndarray) -> dict[str, float]:
    """Gyration radius and tensor: eigenvalues ascending, asphericity, acylindricity and relative anisotropy."""
    x = points - points.mean(axis=0)
    l1, l2, l3 = np.linalg.eigvalsh(x.T @ x / len(x))
    rg2 = l1 + l2 + l3
    asph, acyl = l3 - (l1 + l2) / 2, l2 - l1
    kappa = (asph**2 + 0.75 * acyl**2) / rg2**2 if rg2 > 0 else 0.0
    return {"rg": float(np.sqrt(max(rg2, 0))), "eig_1": float(l1), "eig_2": float(l2), "eig_3": float(l3), "asphericity": float(asph), "acylindricity": float(acyl), "anisotropy": float(kappa)}


def plane(points: np.ndarray) -> tuple[np.ndarray, float]:
    """The normal of the best plane through the points, and their root mean square distance from it."""
    x = points - points.mean(axis=0)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    normal = vt[-1] if len(vt) == 3 else np.array([0.0, 0.0, 1.0])
    return normal, float(np.sqrt(((x @ normal) ** 2).mean()))


def affine_strain(frames: np.ndarray, window: int = 10, lag: int = 1) -> np.ndarray:
    """For each frame how far one affine map departs from a rotation: the least-squares map, with a shift, of all points
    of the ``window`` frames before it to where they are ``lag`` frames later. NaN until the window is full and where no later frame is.

    Sums of products up to each frame give those of every window, so time grows with the frames alone.
    """
    n, points = len(frames), frames.shape[1]
    out = np.full(n, np.nan)
    at = np.arange(window, n - lag)
    if not len(at) or not points:
        return out
    a, b = frames[: n - lag], frames[lag:]
    middle = frames.mean(axis=(0, 1))
    a, b = a - middle, b - middle

    def over(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
        return total[at] - total[at - window]

    count = window * points
    sa, sb = over(a.sum(axis=1)), over(b.sum(axis=1))
    aa = over(np.einsum("tpi,tpj->tij", a, a)) - np.einsum("ti,tj->tij", sa, sa) / count
    ab = over(np.einsum("tpi,tpj->tij", a, b)) - np.einsum("ti,tj->tij", sa, sb) / count
    f = np.linalg.pinv(aa, rcond=1e-12, hermitian=True) @ ab
    out[at] = np.linalg.norm((np.swapaxes(f, 1, 2) @ f - np.eye(3)) / 2, axis=(1, 2))
    return out


def opposite_pairs(centres: np.ndarray) -> list[tuple[int, int, float]]:
    """Disjoint pairs, the farthest first: half as many as there are points."""
    n = len(centres)
    d = sorted(((float(np.linalg.norm(centres[i] - centres[j])), i, j) for i in range(n) for j in range(i + 1, n)), key=lambda x: (-x[0], x[1], x[2]))
    used, out = set(), []
    for v, i, j in d:
        if i not in used and j not in used:
            used |= {i, j}
            out.append((i, j, v))
    return out


def hull(points: np.ndarray) -> list[int]:
    """Corners of the convex hull in the plane, counter-clockwise."""
    order = sorted(range(len(points)), key=lambda k: tuple(points[k]))
    cross = lambda o, a, b: (points[a][0] - points[o][0]) * (points[b][1] - points[o][1]) - (points[a][1] - points[o][1]) * (points[b][0] - points[o][0])

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and cross(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return order if len(order) < 3 else half(order) + half(order[::-1])


def voxels(points: np.ndarray, radii: np.ndarray, spacing: float, pad: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Which cells of a grid around the points lie within a radius of one, and the grid's corner."""
    low = points.min(axis=0) - radii.max() - pad
    shape_ = np.ceil((points.max(axis=0) + radii.max() + pad - low) / spacing).astype(int) + 1
    grid = np.zeros(shape_, bool)
    for p, r in zip(points, radii):
        a = np.maximum(np.floor((p - r - low) / spacing).astype(int), 0)
        b = np.minimum(np.ceil((p + r - low) / spacing).astype(int) + 1, shape_)
        axes = [low[k] + spacing * np.arange(a[k], b[k]) - p[k] for k in range(3)]
        near = axes[0][:, None, None] ** 2 + axes[1][None, :, None] ** 2 + axes[2][None, None, :] ** 2 <= r * r
        grid[a[0] : b[0], a[1] : b[1], a[2] : b[2]] |= near
    return grid, low


def density(points: np.ndarray, radii: np.ndarray, spacing: float, sigma: float = 0.5, level: float = 0.5, pad: float = 3.0) -> np.ndarray:
    """Cells where the sum of Gaussians around the points reaches a level."""
    low = points.min(axis=0) - 3 * radii.max() - pad
    shape_ = np.ceil((points.max(axis=0) + 3 * radii.max() + pad - low) / spacing).astype(int) + 1
    axes = [low[k] + spacing * np.arange(shape_[k]) for k in range(3)]
    out = np.zeros(shape_)
    for p, r in zip(points, radii):
        s = (sigma * r) ** 2 * 2
        gx, gy, gz = (np.exp(-((ax - c) ** 2) / s) for ax, c in zip(axes, p))
        out += gx[:, None, None] * gy[None, :, None] * gz[None, None, :]
    return out >= level


def cavities(inside: np.ndarray) -> np.ndarray:
    """Empty cells that no path of empty neighbours joins to the grid's border."""
    empty = ~inside
    reached = np.zeros_like(inside)
    for axis in range(3):
        for side in (0, -1):
            at = [slice(None)] * 3
            at[axis] = side
            reached[tuple(at)] = empty[tuple(at)]
    while True:
        grown = reached.copy()
        for axis in range(3):
            a, b = [slice(None)] * 3, [slice(None)] * 3
            a[axis], b[axis] = slice(1, None), slice(None, -1)
            grown[tuple(a)] |= reached[tuple(b)]
            grown[tuple(b)] |= reached[tuple(a)]
        grown &= empty
        if (grown == reached).all():
            return empty & ~reached
        reached = grown


def mesh_volume(vertices: np.ndarray, faces: np.ndarray) -> float:
    """The signed volume of a closed triangle mesh."""
    a, b, c = (vertices[faces[:, k]] for k in range(3))
    return float(np.einsum("ij,ij->i", a, np.cross(b, c)).sum() / 6)
