"""Vector expressions on array columns, all JVM-side. Arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_doubles(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y))


def cosine(a: Column | str, b: Column | str) -> Column:
    """dot / sqrt(n1 * n2); 0 where a norm is 0 or the sizes differ."""
    a, b = _col(a), _col(b)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def q8_scale(v: Column | str) -> Column:
    """Largest magnitude / 127; 1 for a zero vector or one with a value that isn't finite."""
    v = as_doubles(v)
    most = F.array_max(F.transform(v, F.abs))
    return F.when(F.exists(v, lambda x: ~finite(x)) | (most == 0) | most.isNull(), F.lit(1.0)).otherwise(most / F.lit(127.0))


def q8_values(v: Column | str) -> Column:
    """Rounded half up (towards plus infinity), clamped to +-127; values that aren't finite are 0."""
    inverse = F.lit(1.0) / q8_scale(v)
    return F.transform(as_doubles(v), lambda x: F.when(finite(x), F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.floor(x * inverse + F.lit(0.5)).cast("double")))).otherwise(F.lit(0.0)).cast("int"))


def q8_dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def q8_cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two quantised vectors by integer sums; vectors of different sizes are an error."""
    a, b = _col(a), _col(b)
    norm = F.sqrt((q8_dot(a, a) * q8_dot(b, b)).cast("double"))
    value = F.when(norm == 0, F.lit(0.0)).otherwise(q8_dot(a, b) / norm)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in size")).cast("double")).otherwise(value)


def dequantize(q: Column | str, scale: Column | str) -> Column:
    scale = _col(scale)
    return F.transform(_col(q), lambda x: x * scale)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column | str) -> Column:
    """Divided by the norm; unchanged where that is 0 or not finite."""
    n = norm(v)
    return F.when(finite(n) & (n > 0), F.transform(as_doubles(v), lambda x: x / n)).otherwise(as_doubles(v))


def sanitize(v: Column | str, limit: float = 0.5) -> Column:
    """Values that aren't finite become 0; more than ``limit`` of them is an error."""
    v = as_doubles(v)
    bad = F.size(F.filter(v, lambda x: ~finite(x)))
    return F.when(bad > F.size(v) * limit, F.raise_error(F.lit("too many invalid values")).cast("array<double>")).otherwise(F.transform(v, lambda x: F.when(finite(x), x).otherwise(F.lit(0.0))))


def blend(q: Column | str, other: Column | str, weight: float) -> Column:
    """(1 - w) q + w other; q itself where there is no other vector or the weight is 0."""
    q, other = as_doubles(q), as_doubles(other)
    if not weight:
        return q
    return F.when(other.isNull(), q).otherwise(F.zip_with(q, other, lambda x, y: x * F.lit(1.0 - weight) + y * F.lit(float(weight))))
