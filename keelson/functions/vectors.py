"""Vector functions. Dense vectors are arrays of doubles, sparse ones arrays of struct(fea int, val double), fea from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _same(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length"))).otherwise(value)


def negate(v: Column) -> Column:
    return F.transform(v, lambda x: -x)


def scale(v: Column, c: float | Column) -> Column:
    return F.transform(v, lambda x: x * c)


def divide(v: Column, c: float | Column) -> Column:
    return F.transform(v, lambda x: x / c)


def scale_with_intercept(v: Column, c: float | Column) -> Column:
    """v * c with c appended."""
    return F.concat(scale(v, c), F.array(F.lit(c) if not isinstance(c, Column) else c))


def add(a: Column, b: Column) -> Column:
    return _same(a, b, F.zip_with(a, b, lambda x, y: x + y))


def subtract(a: Column, b: Column) -> Column:
    return _same(a, b, F.zip_with(a, b, lambda x, y: x - y))


def dot(a: Column, b: Column) -> Column:
    return _same(a, b, F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def dot_with_intercept(p: Column, x: Column) -> Column:
    """The last entry of p is the bias."""
    return dot(F.slice(p, 1, F.size(p) - 1), x) + F.element_at(p, -1)


def squared_distance(a: Column, b: Column) -> Column:
    return _same(a, b, F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def divide_by(v: Column, by: Column) -> Column:
    """Element-wise, leaving elements whose divisor is zero."""
    return _same(v, by, F.zip_with(v, by, lambda x, d: F.when(d != 0, x / d).otherwise(x)))


def multiply_by(v: Column, by: Column) -> Column:
    """Element-wise, the inverse of divide_by."""
    return _same(v, by, F.zip_with(v, by, lambda x, d: F.when(d != 0, x * d).otherwise(x)))


def to_sparse(v: Column) -> Column:
    """Non-zero entries in order."""
    return F.filter(F.transform(v, lambda x, i: F.struct(i.alias("fea"), x.alias("val"))), lambda e: e["val"] != 0)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once per row, even where lambdas inside refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _merged(s: Column) -> Column:
    """Features once each; repeated ones are added up."""
    keys = F.array_distinct(F.transform(s, lambda e: e["fea"]))
    added = F.transform(keys, lambda k: F.struct(k.alias("fea"), F.aggregate(F.filter(s, lambda e: e["fea"] == k), F.lit(0.0), lambda t, e: t + e["val"]).alias("val")))
    return F.when(F.size(keys) == F.size(s), s).otherwise(added)


def _side(s: Column, side: int) -> Column:
    return F.transform(s, lambda e: F.struct(e["fea"].cast("int").alias("fea"), F.lit(side).alias("side"), e["val"].alias("val")))


def _meet(a: Column, b: Column, body) -> Column:
    """body(merged entries) of two sparse vectors sorted together by feature: equal features stand side by side, so one pass finds them."""
    return _let(F.sort_array(F.concat(_side(a, 0), _side(b, 1))), body)


def to_dense(s: Column, n: int | Column) -> Column:
    """Length n; repeated features are added up."""
    n = F.lit(n) if isinstance(n, int) else n
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    zeros = F.transform(places, lambda i: F.struct(i.alias("fea"), F.lit(0.0).alias("val")))

    def filled(j: Column) -> Column:
        after = F.transform(j, lambda e, i: F.struct(e["side"].alias("side"), F.when(F.get(j, i + 1)["fea"] == e["fea"], F.get(j, i + 1)["val"]).otherwise(F.lit(0.0)).alias("val")))
        return F.transform(F.filter(after, lambda e: e["side"] == 0), lambda e: e["val"])

    return _meet(zeros, _merged(s), filled)


def sparse_scale(s: Column, c: float | Column) -> Column:
    return F.transform(s, lambda e: F.struct(e["fea"].alias("fea"), (e["val"] * c).alias("val")))


def sparse_negate(s: Column) -> Column:
    return sparse_scale(s, -1.0)


def sparse_divide(s: Column, c: float | Column) -> Column:
    return F.transform(s, lambda e: F.struct(e["fea"].alias("fea"), (e["val"] / c).alias("val")))


def sparse_add(a: Column, b: Column, n: int | Column) -> Column:
    """Dense sum of two sparse vectors."""
    return add(to_dense(a, n), to_dense(b, n))


def sparse_subtract(a: Column, b: Column, n: int | Column) -> Column:
    return subtract(to_dense(a, n), to_dense(b, n))


def dense_sparse_dot(d: Column, s: Column) -> Column:
    return F.aggregate(s, F.lit(0.0), lambda t, e: t + e["val"] * F.get(d, e["fea"]))


def sparse_dot(a: Column, b: Column) -> Column:
    """Over features that both hold, by a merge."""
    product = lambda j: F.transform(j, lambda e, i: F.when(F.get(j, i + 1)["fea"] == e["fea"], e["val"] * F.get(j, i + 1)["val"]).otherwise(F.lit(0.0)))
    return F.aggregate(_meet(_merged(a), _merged(b), product), F.lit(0.0), lambda t, x: t + x)


def sparse_dot_with_intercept(p: Column, s: Column) -> Column:
    """Dense parameters with the bias last."""
    return dense_sparse_dot(p, s) + F.element_at(p, -1)


def sort_sparse(s: Column) -> Column:
    return F.array_sort(s)


def resize(v: Column, n: int) -> Column:
    """Cut, or filled with zeros."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), n)), 1, n)


def set_at(v: Column, i: int, value: float) -> Column:
    return F.transform(v, lambda x, k: F.when(k == i, F.lit(value)).otherwise(x))
