"""Small batched dense algebra on numpy, used inside vectorised UDFs.

Everything works on leading batch dimensions, so one Arrow batch of seams or
graph edges is solved with a handful of numpy calls.
"""

from __future__ import annotations

import numpy as np

EYE3 = np.eye(3)


def so3_exp(vectors: np.ndarray) -> np.ndarray:
    """Rotation matrices of rotation vectors, shape (..., 3) to (..., 3, 3)."""
    angle = np.linalg.norm(vectors, axis=-1)
    small = angle < 1e-12
    unit = vectors / np.where(small, 1.0, angle)[..., None]
    skew = np.zeros(vectors.shape[:-1] + (3, 3))
    skew[..., 0, 1], skew[..., 0, 2] = -unit[..., 2], unit[..., 1]
    skew[..., 1, 0], skew[..., 1, 2] = unit[..., 2], -unit[..., 0]
    skew[..., 2, 0], skew[..., 2, 1] = -unit[..., 1], unit[..., 0]
    sine, versine = np.sin(angle)[..., None, None], (1 - np.cos(angle))[..., None, None]
    return np.where(small[..., None, None], EYE3, EYE3 + sine * skew + versine * (skew @ skew))


def so3_log(rotations: np.ndarray) -> np.ndarray:
    trace = np.trace(rotations, axis1=-2, axis2=-1)
    angle = np.arccos(np.clip((trace - 1) * 0.5, -1.0, 1.0))
    axis = np.stack(
        [
            rotations[..., 2, 1] - rotations[..., 1, 2],
            rotations[..., 0, 2] - rotations[..., 2, 0],
            rotations[..., 1, 0] - rotations[..., 0, 1],
        ],
        axis=-1,
    )
    with np.errstate(divide="ignore", invalid="ignore"):
        factor = np.where(angle < 1e-8, 0.5, angle / (2 * np.sin(angle)))
    return axis * factor[..., None]


def sim3_apply(s, r, t, points):
    return s[..., None] * np.einsum("...ij,...j->...i", r, points) + t


def sim3_compose(outer, inner):
    s, r, t = outer
    return s * inner[0], r @ inner[1], sim3_apply(s, r, t, inner[2])


def sim3_inverse(transform):
    s, r, t = transform
    back = np.swapaxes(r, -1, -2)
    inverse = 1.0 / s
    return inverse, back, -inverse[..., None] * np.einsum("...ij,...j->...i", back, t)


def horn_rotation(cross_covariance: np.ndarray) -> np.ndarray:
    """Rotations maximising trace(R S) for source-by-target covariances S.

    The unit quaternion is the leading eigenvector of Horn's symmetric 4x4
    matrix; batches go through one ``eigh`` call.
    """
    s = cross_covariance
    horn = np.empty(s.shape[:-2] + (4, 4))
    horn[..., 0, 0] = np.trace(s, axis1=-2, axis2=-1)
    horn[..., 1:, 1:] = s + np.swapaxes(s, -1, -2) - horn[..., 0, 0][..., None, None] * EYE3
    for axis, (i, j) in enumerate(((1, 2), (2, 0), (0, 1)), start=1):
        horn[..., 0, axis] = horn[..., axis, 0] = s[..., i, j] - s[..., j, i]
    w, x, y, z = np.moveaxis(np.linalg.eigh(horn)[1][..., -1], -1, 0)
    rotation = np.empty(s.shape)
    rotation[..., 0, :] = np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], -1)
    rotation[..., 1, :] = np.stack([2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], -1)
    rotation[..., 2, :] = np.stack([2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)], -1)
    return rotation


def smallest_eigenvector(symmetric: np.ndarray) -> np.ndarray:
    return np.linalg.eigh(symmetric)[1][..., 0]


def rank_truncated_solve(matrix: np.ndarray, gradient: np.ndarray, tolerance: float):
    """Pseudo-solve ``H x = -g`` over the well-conditioned eigen-directions."""
    values, vectors = np.linalg.eigh(matrix)
    keep = (values > tolerance * values.max(axis=-1, keepdims=True)) & (values > 1e-15)
    projected = np.einsum("...ij,...i->...j", vectors, -gradient)
    weights = np.where(keep, projected / np.where(keep, values, 1.0), 0.0)
    return np.einsum("...ij,...j->...i", vectors, weights), keep.sum(axis=-1)


def symmetric_from_upper(flat: np.ndarray, size: int) -> np.ndarray:
    """Full matrices from row-wise upper triangles, shape (n, size*(size+1)/2)."""
    full = np.zeros(flat.shape[:-1] + (size, size))
    rows, columns = np.triu_indices(size)
    full[..., rows, columns] = flat
    full[..., columns, rows] = flat
    return full
