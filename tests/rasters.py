"""Frames from numpy arrays and back, for tests."""

from __future__ import annotations

import numpy as np

from rastrel.model import PIXELS


def frame(spark, *images):
    rows = []
    for i, a in enumerate(images):
        a = np.asarray(a)
        a = a[..., None] if a.ndim == 2 else a
        h, w, c = a.shape
        rows += [(i, w, h, y, x, k, int(a[y, x, k])) for y in range(h) for x in range(w) for k in range(c)]
    return spark.createDataFrame(rows, PIXELS)


def array(px, image_id=0):
    rows = px.where(px.image_id == image_id).select("y", "x", "c", "v").collect()
    out = np.full((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1, max(r.c for r in rows) + 1), -999, dtype=object)
    for r in rows:
        assert out[r.y, r.x, r.c] == -999
        out[r.y, r.x, r.c] = r.v
    assert (out != -999).all()
    return out.astype(float)[..., 0] if out.shape[2] == 1 else out.astype(float)
