"""Frame encoders as a plug-in point.

An encoder is any picklable object with ``dims`` and ``encode(list_of_bytes) -> float array [n, dims]``; it is
built once per executor process.  No model weights ship here.  ``ByteStatsEncoder`` is a deterministic stand-in for
tests and plumbing: it has no visual meaning whatever.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_LOADED: dict = {}


class ByteStatsEncoder:
    """STAND-IN, NOT A MODEL: a normalised byte histogram folded to ``dims`` numbers."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def encode(self, frames: list[bytes]) -> np.ndarray:
        out = np.zeros((len(frames), self.dims))
        for i, f in enumerate(frames):
            out[i] = np.bincount(np.frombuffer(f, np.uint8) % self.dims, minlength=self.dims)
        return out


def bgr_to_rgb(pixels: np.ndarray) -> np.ndarray:
    return pixels[..., ::-1]


def loaded(factory: Callable[[], object], name: str) -> object:
    """The encoder of this process, built at the first call."""
    if name not in _LOADED:
        _LOADED[name] = factory()
    return _LOADED[name]


def unit_vectors(model: object, frames: list) -> list[np.ndarray | None]:
    """A unit vector for each frame; null for frames that are missing or empty, encode to zero, or make the encoder fail (alone, too)."""
    ok = [i for i, x in enumerate(frames) if x is not None and len(x)]
    out: list[np.ndarray | None] = [None] * len(frames)
    if not ok:
        return out
    try:
        v = np.asarray(model.encode([frames[i] for i in ok]), dtype=np.float64)
    except Exception:
        if len(ok) == 1:
            return out
        for i in ok:  # one bad frame must not take the batch with it
            out[i] = unit_vectors(model, [frames[i]])[0]
        return out
    norms = np.linalg.norm(v, axis=1)
    for row, i in enumerate(ok):
        if norms[row] > 0:
            out[i] = (v[row] / norms[row]).astype(np.float32)
    return out


def hsv(pixels: np.ndarray) -> np.ndarray:
    """8-bit hue (0-179), saturation and value of BGR pixels, as numbers."""
    p = pixels.astype(np.float64)
    top, low = p.max(axis=-1), p.min(axis=-1)
    span = top - low
    b, g, r = p[..., 0], p[..., 1], p[..., 2]
    safe = np.where(span > 0, span, 1.0)
    turn = np.where(top == r, (g - b) / safe, np.where(top == g, 2 + (b - r) / safe, 4 + (r - g) / safe))
    hue = np.where(span > 0, (turn * 30) % 180, 0.0)
    return np.stack([np.round(hue) % 180, np.round(255 * span / np.where(top > 0, top, 1.0)), top], axis=-1)


def hsv_change(before: np.ndarray, after: np.ndarray) -> float:
    """How much a BGR frame differs from the one before it: the mean over hue, saturation and value of their mean differences."""
    return float(np.abs(hsv(after) - hsv(before)).mean()) if before.shape == after.shape and before.size else 0.0


def frame_encoder(factory: Callable[[], object], name: str) -> Callable[[Column], Column]:
    """A pandas UDF ``binary -> array<float>`` with unit norm; frames that fail or encode to zero give null.

    It counts as not deterministic, so that a filter on its result does not run it again.
    """

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(factory, name)
        for s in batches:
            yield pd.Series(unit_vectors(model, list(s)), dtype=object)

    return encode.asNondeterministic()
