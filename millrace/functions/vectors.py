"""Expressions over array columns; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it inside lambdas.

    A column merely mentioned in a lambda body may be inlined by the optimizer and run
    again for every element; as the element of a one-element array it cannot.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def indices(n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def softmax(scores: str | Column) -> Column:
    def shares(v: Column) -> Column:
        powers = bind(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
        return bind(powers, lambda e: bind(total(e), lambda s: F.transform(e, lambda x: x / s)))

    return bind(_col(scores), shares)


def log_sum_exp(scores: str | Column) -> Column:
    return bind(
        _col(scores),
        lambda v: bind(F.array_max(v), lambda top: top + F.log(total(F.transform(v, lambda x: F.exp(x - top))))),
    )


def argmax(scores: str | Column) -> Column:
    """0-based position of the largest value, the first one on ties."""
    v = _col(scores)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def relu(v: str | Column) -> Column:
    return F.transform(_col(v), lambda x: F.greatest(F.lit(0.0), x))


def elu(v: str | Column, alpha: float = 1.0) -> Column:
    return F.transform(_col(v), lambda x: F.when(x > 0, x).otherwise(F.lit(alpha) * (F.exp(x) - F.lit(1.0))))


def min_max(v: str | Column) -> Column:
    """Scale one vector to [0, 1]; a constant vector becomes zeros."""
    return bind(
        _col(v),
        lambda a: bind(
            F.struct(F.array_min(a).alias("lo"), F.array_max(a).alias("hi")),
            lambda r: F.transform(
                a, lambda x: F.when(r["hi"] == r["lo"], F.lit(0.0)).otherwise((x - r["lo"]) / (r["hi"] - r["lo"]))
            ),
        ),
    )


def one_hot_label(label: str | Column, classes: int) -> Column:
    """k indicator values for an integer label."""
    return F.transform(indices(classes), lambda j: (j == _col(label)).cast("int"))


def dropout(v: str | Column, p: float, seed: int, key: str | Column) -> Column:
    """Zero each element with probability ``p``, scale the kept ones by 1 / (1 - p)."""
    from millrace.functions.scalar import hash_uniform

    key = _col(key)
    return F.transform(
        _col(v),
        lambda x, i: F.when(hash_uniform(seed, key, i) > F.lit(p), x / F.lit(1.0 - p)).otherwise(F.lit(0.0)),
    )
