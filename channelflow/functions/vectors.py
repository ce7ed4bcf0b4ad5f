"""Expressions over array<double> columns: sample vectors and prototype maps. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(v: Column, w: Column) -> Column:
    return total(F.zip_with(v, w, lambda x, y: x * y))


def mean(v: Column) -> Column:
    return F.try_divide(total(v), F.size(v))


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def centred(v: Column) -> Column:
    """Average reference: the mean over channels taken off."""
    return let(mean(v), lambda m: F.transform(v, lambda x: x - m))


def standardised(v: Column) -> Column:
    """v centred, and then of length 1; null if it is constant."""
    return let(centred(v), unit)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """v over its length; null for the zero vector."""
    return let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)))


def spread(v: Column) -> Column:
    """Population standard deviation over channels: the global field power."""
    return let(centred(v), lambda c: F.sqrt(F.try_divide(dot(c, c), F.size(c))))


def root_mean_square(v: Column) -> Column:
    return F.sqrt(F.try_divide(dot(v, v), F.size(v)))


def correlation(v: Column, w: Column) -> Column:
    """Spatial correlation of two vectors; null where one is constant."""
    return let(
        F.struct(centred(v).alias("a"), centred(w).alias("b")),
        lambda p: F.try_divide(dot(p["a"], p["b"]), norm(p["a"]) * norm(p["b"])),
    )


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def reordered(v: Column, order: Column) -> Column:
    """The elements at the given places, from 0. An order that is no permutation of v's places is an error."""
    places = F.sequence(F.lit(0), F.size(v) - 1)
    right = (F.size(v) == F.size(order)) & ((F.size(v) == 0) | (F.array_sort(order.cast("array<int>")) == places))
    return F.when(right, F.transform(order, lambda i: F.get(v, i))).otherwise(F.raise_error(F.lit("no permutation of the places")))


def next_power_of_two(x: Column) -> Column:
    """The least exponent whose power of two reaches |x|; 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.ceil(F.log2(F.abs(x)))).cast("long")


def choose(n: Column, k: Column) -> Column:
    """n over k, for n up to 20; 0 outside of 0 to n."""
    return F.when((k < 0) | (k > n), 0).otherwise(F.factorial(n) / (F.factorial(k) * F.factorial(n - k))).cast("long")


def ceil_to(x: Column, digits: int) -> Column:
    return F.ceil(x * 10**digits) / 10**digits


def ramp(x: Column, middle: float, steepness: float) -> Column:
    """Logistic ramp from 0 to 1."""
    return 1 / (1 + F.exp(-steepness * (x - middle)))


def condensed_place(i: Column, j: Column, n: Column) -> Column:
    """Where the pair (i, j) of n things, i <> j, stands in the condensed list of pairs: (0, 1), (0, 2), ..., (1, 2), ..."""
    long = lambda x: x.cast("long")
    a, b = long(F.least(i, j)), long(F.greatest(i, j))
    return pairs_before(a, long(n)) + b - 1 - a


def pairs_before(i: Column, n: Column) -> Column:
    """Places of the condensed list before the first pair of i; both are longs."""
    return i * n - F.call_function("div", i * (i + 1), F.lit(2).cast("long"))


def square_place(k: Column, n: Column) -> Column:
    """The pair that stands at a place of the condensed list, as struct<i, j>. The row is found in doubles and put right by one in longs, which is exact for up to 80 million things."""
    k, n = k.cast("long"), n.cast("long")
    wide = (2 * n - 1).cast("double")
    near = F.floor((wide - F.sqrt(F.greatest(wide * wide - 8 * k.cast("double"), F.lit(0.0)))) / 2).cast("long")
    row = lambda i: F.when(pairs_before(i, n) > k, i - 1).when(pairs_before(i + 1, n) <= k, i + 1).otherwise(i)
    return let(let(near, row), lambda i: F.struct(i.alias("i"), (k - pairs_before(i, n) + 1 + i).alias("j")))
