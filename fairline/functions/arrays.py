"""Small numeric folds over bounded array columns (look-back windows of a few weeks)."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Without this, an expression repeated inside lambdas is evaluated per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bound(fn: Callable[..., Column]) -> Callable[..., Column]:
    """Bind the first argument of an expression function with ``let``."""
    @wraps(fn)
    def wrapped(value: Column, *args, **kwargs) -> Column:
        return let(value, lambda v: fn(v, *args, **kwargs))

    return wrapped


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


@bound
def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


@bound
def variance(a: Column) -> Column:
    """Sample variance, null below two values."""
    n = F.size(a)
    squares = F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    return F.when(n > 1, let(total(a), lambda t: F.greatest((squares - t * t / n) / (n - 1), F.lit(0.0))))


@bound
def last_n(a: Column, n: int) -> Column:
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n)


@bound
def last(a: Column) -> Column:
    return F.get(a, F.size(a) - 1)


@bound
def differences(a: Column) -> Column:
    """First differences; empty below two values."""
    length = F.greatest(F.size(a) - 1, F.lit(0))
    return F.zip_with(F.slice(a, 2, length), F.slice(a, 1, length), lambda x, y: x - y)


@bound
def slope(a: Column) -> Column:
    """Least-squares slope against the index 0..n-1, null below two values."""
    n = F.size(a)
    centred = F.transform(a, lambda y, i: y * (i - (n - 1) / 2.0))
    return F.when(n > 1, total(centred) * 12.0 / (n * (n * n - 1)))


@bound
def curvature(a: Column) -> Column:
    """Quadratic coefficient against the index, through the orthogonal second-degree polynomial."""
    n = F.size(a)

    def p(i):
        return (i - (n - 1) / 2.0) * (i - (n - 1) / 2.0) - (n * n - 1) / 12.0

    top = total(F.transform(a, lambda y, i: y * p(i)))
    bottom = total(F.transform(a, lambda y, i: p(i) * p(i)))
    return F.when(n > 2, top / bottom)
