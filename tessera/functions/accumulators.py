"""Accumulators (features) that compile to Catalyst aggregates and compose with ``&``.

``Feature.columns(values)`` gives named aggregates over the given component columns; partial aggregation is the merge
of accumulators, sliding frames are the taking back. Empty groups give each feature's identity where the result has one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Feature:
    def __init__(self, *parts: tuple[str, Callable[[list[Column]], Column]]):
        self.parts = dict(parts)

    def __and__(self, other: Feature) -> Feature:
        """Both features in one pass; a feature named twice is worked out once."""
        return Feature(*(self.parts | other.parts).items())

    def columns(self, values: list[str | Column], prefix: str = "") -> list[Column]:
        xs = [F.col(v) if isinstance(v, str) else v for v in values]
        return [f(xs).alias(prefix + name) for name, f in self.parts.items()]


def _each(f: Callable[[Column], Column]) -> Callable[[list[Column]], Column]:
    return lambda xs: f(xs[0]) if len(xs) == 1 else F.struct(*[f(x).alias(f"c{k}") for k, x in enumerate(xs)])


def _int_mean(x: Column) -> Column:
    """Mean in the sum's type: integers truncate; no values give 0."""
    s, n = F.coalesce(F.sum(x), F.lit(0)), F.count(x)
    q = F.floor(F.abs(s) / F.greatest(n, F.lit(1))).cast("bigint")
    return F.when(s < 0, -q).otherwise(q)


def _inertia(xs: list[Column]) -> Column:
    n, dim = F.count(xs[0]), len(xs)
    spread = sum((F.sum(x * x) - F.sum(x) * F.sum(x) / F.greatest(n, F.lit(1)) for x in xs[1:]), F.sum(xs[0] * xs[0]) - F.sum(xs[0]) * F.sum(xs[0]) / F.greatest(n, F.lit(1)))
    scale = n * n if dim == 2 else F.pow(n, F.lit(1 + 2 / dim))
    return F.when(n > 0, spread / F.greatest(scale, F.lit(1))).otherwise(F.lit(0.0))


count = Feature(("count", lambda xs: F.count(xs[0])))
sum_ = Feature(("sum", _each(lambda x: F.coalesce(F.sum(x), F.lit(0)))))
mean_int = Feature(("mean", _each(_int_mean)))
mean = Feature(("mean", _each(F.avg)))
min_ = Feature(("min", lambda xs: F.min(xs[0]) if len(xs) == 1 else F.min(F.struct(*xs))))
max_ = Feature(("max", lambda xs: F.max(xs[0]) if len(xs) == 1 else F.max(F.struct(*xs))))
minmax = min_ & max_
inf = Feature(("inf", _each(F.min)))
sup = Feature(("sup", _each(F.max)))
infsup = inf & sup
all_ = Feature(("all", lambda xs: F.coalesce(F.bool_and(xs[0]), F.lit(True))))
any_ = Feature(("any", lambda xs: F.coalesce(F.bool_or(xs[0]), F.lit(False))))
variance = Feature(("variance", lambda xs: F.coalesce(sum((F.var_pop(x) for x in xs[1:]), F.var_pop(xs[0])), F.lit(0.0))))
covariance = Feature(("covariance", lambda xs: F.array(*[F.array(*[F.covar_pop(a, b) for b in xs]) for a in xs])))
moment_of_inertia = Feature(("inertia", _inertia))
points = Feature(("points", lambda xs: F.array_sort(F.collect_list(F.struct(*xs)))))
state = Feature(("n", lambda xs: F.count(xs[0])), ("s1", lambda xs: F.sum(xs[0])), ("s2", lambda xs: F.sum(xs[0] * xs[0])))


def only(feature: Feature, condition: Column) -> Feature:
    """The feature over what passes the condition."""
    return Feature(*((name, lambda xs, f=f: f([F.when(condition, x) for x in xs])) for name, f in feature.parts.items()))


def accumulate(px: DataFrame, feature: Feature, by: list[str] = ["image_id"], values: list[str] = ["v"]) -> DataFrame:
    return px.groupBy(*by).agg(*feature.columns(values))


def fold(px: DataFrame, init: Column, step: Callable[[Column, Column], Column], by: list[str] = ["image_id"]) -> DataFrame:
    """Left fold of ``v`` in scan order. An image's rows meet in one array: for operations that don't commute."""
    rows = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    return px.groupBy(*by).agg(F.aggregate(rows, init, lambda acc, r: step(acc, r["v"])).alias("acc"))


def by_label(px: DataFrame, feature: Feature, values: list[str] = ["v"]) -> DataFrame:
    """Features of every label 0..max by image, labels without pixels included (with the identity of sums and counts)."""
    got = px.groupBy("image_id", "label").agg(*feature.columns(values))
    every = px.groupBy("image_id").agg(F.max("label").alias("_n")).select("image_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long"))).alias("label"))
    out = every.join(got, ["image_id", "label"], "left")
    return out.fillna(0, [c for c in ("count", "sum") if c in out.columns and dict(out.dtypes)[c] in ("bigint", "double", "int")])


def sliding(px: DataFrame, feature: Feature, before: int, after: int, along: str = "x", values: list[str] = ["v"]) -> DataFrame:
    """Features over the values from ``before`` sites behind to ``after`` ahead along a line: values leave as others come."""
    other = "y" if along == "x" else "x"
    w = Window.partitionBy("image_id", other).orderBy(along).rangeBetween(-before, after)
    return px.select("*", *[c.over(w).alias(n) for n, c in zip(feature.parts, [f([F.col(v) for v in values]) for f in feature.parts.values()])])


def skyline(df: DataFrame, by: list[str], dims: list[str], minimal: bool = True) -> DataFrame:
    """Minimal (or maximal) elements under the product order: distinct vectors that no other dominates.

    Two dimensions need one sorted pass: a vector stays if it is better in the second than all that are as good in the
    first. More dimensions compare distinct vectors by an anti-join within the group.
    """
    d = df.select(*by, *dims).distinct()
    if len(dims) == 2:
        a, b = dims
        order = [F.col(a), F.col(b)] if minimal else [F.desc(a), F.desc(b)]
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        best = (F.min(b) if minimal else F.max(b)).over(w)
        return d.withColumn("_best", best).where(F.col("_best").isNull() | ((F.col(b) < F.col("_best")) if minimal else (F.col(b) > F.col("_best")))).drop("_best")
    o = d.select(*by, *[F.col(c).alias(f"_{c}") for c in dims])
    cond = None
    for c in by:
        one = d[c] == o[c]
        cond = one if cond is None else cond & one
    for c in dims:
        cond = cond & ((o[f"_{c}"] <= d[c]) if minimal else (o[f"_{c}"] >= d[c]))
    differ = None
    for c in dims:
        one = o[f"_{c}"] != d[c]
        differ = one if differ is None else differ | one
    return d.join(o, cond & differ, "left_anti")


def psnr(a: DataFrame, b: DataFrame, channels: list[str], peak: float = 255.0) -> DataFrame:
    """Mean squared error over all channels and the peak signal-to-noise ratio of two images of one domain."""
    both = a.join(b.select("image_id", "y", "x", *[F.col(c).alias(f"_{c}") for c in channels]), ["image_id", "y", "x"])
    se = sum(((F.col(c) - F.col(f"_{c}")).cast("double") * (F.col(c) - F.col(f"_{c}")) for c in channels[1:]), (F.col(channels[0]) - F.col(f"_{channels[0]}")).cast("double") * (F.col(channels[0]) - F.col(f"_{channels[0]}")))
    got = both.groupBy("image_id").agg((F.sum(se) / (F.count("*") * len(channels))).alias("mse"))
    return got.withColumn("psnr", F.when(F.col("mse") > 0, F.lit(20.0) * F.log10(F.lit(peak)) - F.lit(10.0) * F.log10("mse")))
