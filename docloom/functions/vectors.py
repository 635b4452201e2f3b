"""Vector functions as Column expressions; sums run in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "euclidean")


def literal(vector: Sequence[float]) -> Column:
    """A query vector as a constant array<double>."""
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def distance(a: Column, b: Column) -> Column:
    def squared(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.sqrt(F.aggregate(F.zip_with(a, b, squared), F.lit(0.0), lambda s, x: s + x))


def score(a: Column, b: Column, metric: str = "cosine") -> Column:
    """``dot`` and ``cosine`` are the inner product (cosine: of unit vectors); ``euclidean`` is 1 / (1 + distance)."""
    if metric in ("cosine", "dot"):
        return dot(a, b)
    if metric == "euclidean":
        return 1 / (1 + distance(a, b))
    raise ValueError(f"Unsupported metric: {metric}")


def rounded(x: Column, places: int) -> Column:
    """Rounded half away from zero; unlike Spark's ``round``, a negative number that rounds to zero keeps its sign."""
    x = x.cast("double")
    return F.signum(x) * F.round(F.abs(x), places)


def l2_normalize(v: Column, least: float = 1e-12) -> Column:
    """Unit-length float vector; norms under ``least`` divide by ``least``."""
    length = F.greatest(norm(v), F.lit(least))
    return F.transform(v, lambda x: (x.cast("double") / length).cast("float"))


def mean_pool(tokens: Column, mask: Column, least: float = 1e-9) -> Column:
    """Mean of the token vectors (array<array<float>>) whose mask is 1, in double precision; the divisor is at least ``least``."""
    kept = F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda t: t["m"] != 0)
    total = F.aggregate(
        F.transform(kept, lambda t: F.transform(t["v"], lambda x: x.cast("double"))),
        F.transform(F.get(tokens, F.lit(0)), lambda x: F.lit(0.0)),
        lambda s, v: F.zip_with(s, v, lambda x, y: x + y),
    )
    share = F.greatest(F.size(kept).cast("double"), F.lit(least))
    return F.transform(total, lambda x: x / share)


def cls_pool(tokens: Column) -> Column:
    """The first token's vector."""
    return F.get(tokens, F.lit(0))
