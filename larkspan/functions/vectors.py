"""Vector functions on array columns, in built-in higher-order expressions (double precision throughout).

Where lengths differ, or a vector is null or holds a null, distances are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def _paired(a: Column, b: Column, f) -> Column:
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), f)))


def dot(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a.cast("array<double>"), lambda x: x * x)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null if either is all zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_paired(a, b, lambda x, y: (x - y) * (x - y)))


def l1_distance(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: F.abs(x - y))


def hamming_distance(a: Column, b: Column) -> Column:
    """Between bit vectors packed as byte values (see quantize_binary)."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.cast("int").bitwiseXOR(y.cast("int")))), F.lit(0), lambda s, x: s + x))


def dimension(a: Column) -> Column:
    return F.when(a.isNotNull(), F.size(a))


def element_type(a: Column) -> Column:
    """``float32``, ``int8`` or ``bit`` by the array's element type."""
    kind = F.typeof(a)
    return F.when(kind == "array<float>", "float32").when(kind == "array<tinyint>", "int8").when(kind == "array<smallint>", "bit")


def to_text(a: Column) -> Column:
    return F.to_json(a)


def from_text(c: Column) -> Column:
    return F.from_json(c, "array<float>")


def add(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: x + y))


def subtract(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: x - y))


def rounded(a: Column, digits: int = 6) -> Column:
    """Elements rounded as SQL on doubles does it: scaled, to the nearest integer, halves away from zero. What is rounded
    to zero keeps its sign (-0.0), which ``F.round`` drops."""

    def one(x: Column) -> Column:
        r = F.round(x * 10.0**digits) / 10.0**digits
        return F.when(r == 0, x * 0.0).otherwise(r)

    return F.transform(a.cast("array<double>"), one)


def part(a: Column, start: int, end: int) -> Column:
    """Elements ``start`` to ``end`` (exclusive), counted from 0."""
    if not 0 <= start < end:
        raise ValueError("a part needs 0 <= start < end")
    return F.when(F.size(a) >= end, F.slice(a, start + 1, end - start))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a.cast("array<double>"), lambda x: x / n))


def quantize_binary(a: Column) -> Column:
    """One bit for each element, set if it is positive, lowest bit first, packed into bytes (0 to 255)."""
    byte = lambda i: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.when(F.element_at(a, (i * 8 + j + 1).cast("int")) > 0, F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2), j).cast("int")).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when((F.size(a) > 0) & (F.size(a) % 8 == 0), F.transform(F.sequence(F.lit(0), (F.size(a) / 8).cast("int") - 1), byte).cast("array<smallint>"))


def quantize_int8(a: Column) -> Column:
    """Elements of the unit range in steps of 2/255, from -128."""
    return F.transform(a.cast("array<double>"), lambda x: ((x + 1) / F.lit(2.0 / 255) - 128).cast("tinyint"))


def elements(a: Column) -> Column:
    """Generator of ``(pos, value)``."""
    return F.posexplode(a).alias("pos", "value")
