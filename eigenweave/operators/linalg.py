"""Small dense linear algebra of the driver and of per-party statistics."""

from __future__ import annotations

import numpy as np


def pack(matrix: np.ndarray) -> np.ndarray:
    """Upper triangle of a symmetric matrix, row by row."""
    return matrix[np.triu_indices(matrix.shape[0])]


def unpack(packed: np.ndarray, d: int) -> np.ndarray:
    out = np.empty((d, d))
    rows, cols = np.triu_indices(d)
    out[rows, cols] = packed
    out[cols, rows] = packed
    return out


def canonical(vectors: np.ndarray) -> np.ndarray:
    """Rows with the sign that makes the entry of largest magnitude (the first of equals) positive."""
    if not vectors.size:
        return vectors
    at = np.argmax(np.round(np.abs(vectors), 12), axis=1)
    sign = np.sign(vectors[np.arange(len(vectors)), at])
    return vectors * np.where(sign == 0, 1, sign)[:, None] + 0.0


def eigen_desc(matrix: np.ndarray, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues, falling, and the k first eigenvectors as canonical rows."""
    values, vectors = np.linalg.eigh(matrix)
    return values[::-1], canonical(vectors[:, ::-1].T[:k])


def nearest_psd(matrix: np.ndarray) -> np.ndarray:
    """Symmetrised, and shifted by (1e-6 - smallest eigenvalue) if that is negative."""
    sym = (matrix + matrix.T) / 2
    low = float(np.linalg.eigvalsh(sym)[0])
    return sym + (1e-6 - low) * np.eye(len(sym)) if low < 0 else sym
