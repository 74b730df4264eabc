"""Frame-rate arithmetic.  All casts truncate toward zero."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_FPS = 30.0


def fps_or_default(fps: Column) -> Column:
    return F.coalesce(F.nullif(fps.cast("double"), F.lit(0.0)), F.lit(DEFAULT_FPS))


def interval_of(fps: Column) -> Column:
    """Frames between centres: one a second, at least one."""
    return F.greatest(F.lit(1).cast("long"), fps_or_default(fps).cast("long"))


def radius_of(fps: Column, k_seconds: float = 0.5) -> Column:
    return F.greatest(F.lit(1).cast("long"), (fps_or_default(fps) * F.lit(float(k_seconds))).cast("long"))
