"""Rows of vectors as numpy matrices, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def usable(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows whose vector is there and holds only finite numbers (and has ``width`` components, where
    that is given), and those vectors as doubles; shorter ones end in zeros."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = pc.list_flatten(column).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
    ok = (bad[ends] == bad[ends - sizes]) & column.is_valid().to_numpy(zero_copy_only=False)
    if width is not None:
        ok &= sizes == width
    rows = np.flatnonzero(ok)
    sizes, starts = sizes[rows], (ends - sizes)[rows]
    wide = int(sizes.max(initial=0)) if width is None else width
    if not len(rows) or not wide:
        return rows, np.zeros((len(rows), wide))
    place = np.arange(wide)[None]
    inside = place < sizes[:, None]
    return rows, np.where(inside, x[np.minimum(starts[:, None] + place, len(x) - 1)], 0.0)


def floored(x: np.ndarray, scale: float, most: int) -> np.ndarray:
    """floor(scale * x) as int64, held within -+most."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -float(most), float(most)).astype(np.int64)
