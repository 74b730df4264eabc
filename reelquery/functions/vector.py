"""Vector arithmetic on array columns, in double precision and inside the JVM.

Every function takes and returns Columns, so Catalyst sees plain expressions.  A null vector gives null.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; null when the lengths differ."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column, zero: str = "null") -> Column:
    """Unit vector.  ``zero`` says what a zero vector becomes: ``null``, ``keep`` (stays zero) or ``raise``."""
    if zero not in ("null", "keep", "raise"):
        raise ValueError(f"unknown zero policy: {zero!r}")
    # the vector and its norm are bound to names, as an expression inside the lambda is evaluated for every component
    bound = F.transform(F.array(doubles(v)), lambda p: F.struct(p.alias("v"), l2_norm(p).alias("n")))

    def scaled(p: Column) -> Column:
        unit = F.transform(p["v"], lambda x: x / p["n"])
        if zero == "keep":
            return F.when(p["n"] == 0, p["v"]).otherwise(unit)
        if zero == "raise":
            return F.when(p["n"] == 0, F.raise_error(F.lit("zero vector cannot be normalised")).cast("array<double>")).otherwise(unit)
        return F.when(p["n"] > 0, unit)

    return F.get(F.transform(bound, scaled), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when either side is a zero vector."""
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))


def score_of(cos: Column) -> Column:
    """The search score of a cosine: (1 + cos) / 2."""
    return (cos + 1.0) / 2.0


def cosine_of(score: Column) -> Column:
    return score * 2.0 - 1.0


def pool(window: Column, method: str = "mean") -> Column:
    """One vector from an array of equally long vectors: ``mean``, ``max`` or ``center`` (index n // 2).

    An empty window gives null; an unknown method is an error.
    """
    size = F.size(window)
    dims = F.sequence(F.lit(0), F.size(F.get(window, F.lit(0))) - 1)
    if method == "mean":
        out = F.transform(dims, lambda i: F.aggregate(window, F.lit(0.0), lambda s, v: s + F.get(v, i).cast("double")) / size)
    elif method == "max":
        out = F.transform(dims, lambda i: F.array_max(F.transform(window, lambda v: F.get(v, i).cast("double"))))
    elif method == "center":
        out = doubles(F.get(window, F.floor(size / 2).cast("int")))
    else:
        raise ValueError(f"unknown pooling method: {method!r}; use 'mean', 'max' or 'center'")
    return F.when(size > 0, out)


def embed_window(window: Column, method: str = "mean") -> Column:
    """Pooled and renormalised window vector; null where pooling gives the zero vector."""
    return normalize(pool(window, method), zero="null")
