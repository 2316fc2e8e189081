"""Vector expressions over arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def same_dims(a: Column, b: Column, value: Column) -> Column:
    """value, or an error if the vectors differ in length."""
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors of different dimensions")).cast("double"))


def inner_product(a: Column, b: Column) -> Column:
    return same_dims(a, b, _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y)))


def l2_distance(a: Column, b: Column) -> Column:
    return same_dims(a, b, F.sqrt(_sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(_double(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector has no length."""
    return F.try_divide(inner_product(a, b), norm(a) * norm(b))


def sign_words(a: Column, bits: int = 32) -> Column:
    """The signs of the components, `bits` of them in each long."""
    n = F.ceil(F.size(a) / bits).cast("int")
    word = lambda k: F.aggregate(F.slice(a, k * bits + 1, bits), F.lit(0).cast("long"), lambda acc, x: acc * 2 + (x > 0).cast("long"))
    return F.transform(F.sequence(F.lit(0), n - 1), word)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
