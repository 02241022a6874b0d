"""Neighbourhood aggregates: windows, structuring elements, kernels and structural morphology.

Rectangles run as two window passes, along lines and then across, each partitioned by image and line. Other elements
scatter every pixel to the sites it counts for and group by site: one shuffle with partial aggregation, no self-join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.rasters import K

Offsets = tuple[tuple[int, int], ...]

C4: Offsets = ((-1, 0), (0, -1), (0, 1), (1, 0))
C8: Offsets = tuple((y, x) for y in (-1, 0, 1) for x in (-1, 0, 1) if (y, x) != (0, 0))
C2_V: Offsets = ((-1, 0), (1, 0))
C2_H: Offsets = ((0, -1), (0, 1))
WINC4, WINC8, WINC2_V, WINC2_H = (tuple(sorted((*n, (0, 0)))) for n in (C4, C8, C2_V, C2_H))


def rectangle(height: int, width: int) -> Offsets:
    """Centred, of odd sides."""
    if height % 2 == 0 or width % 2 == 0:
        raise ValueError("sides must be odd")
    return tuple((y, x) for y in range(-(height // 2), height // 2 + 1) for x in range(-(width // 2), width // 2 + 1))


def ball(radius: float) -> Offsets:
    k = int(radius)
    return tuple((y, x) for y in range(-k, k + 1) for x in range(-k, k + 1) if y * y + x * x <= radius * radius)


def is_rectangle(se: Offsets) -> tuple[int, int] | None:
    """(half height, half width) if the element is a centred rectangle: then it runs as two passes."""
    h, w = max(abs(y) for y, _ in se), max(abs(x) for _, x in se)
    return (h, w) if set(se) == set(rectangle(2 * h + 1, 2 * w + 1)) else None


def scatter(px: DataFrame, se: Offsets, columns: list[str]) -> DataFrame:
    """Every pixel at each site whose window holds it: rows (image_id, y, x, dy, dx, columns), dy and dx from site to pixel."""
    off = F.array(*[F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for y, x in se])
    s = px.select(*K, *columns, F.explode(off).alias("_o"))
    return s.select("image_id", (F.col("y") - F.col("_o.dy")).cast("int").alias("y"), (F.col("x") - F.col("_o.dx")).cast("int").alias("x"), F.col("_o.dy").alias("dy"), F.col("_o.dx").alias("dx"), *columns)


def window(px: DataFrame, se: Offsets, aggs: dict[str, Column], columns: list[str] = ["v"]) -> DataFrame:
    """Aggregates over each site's window; sites outside the domain neither count nor appear. Sites whose window is
    empty get nulls."""
    own = px.select(*K, F.lit(True).alias("_own"), *[F.lit(None).cast(dict(px.dtypes)[c]).alias(c) for c in columns])
    rows = scatter(px, se, columns).drop("dy", "dx").withColumn("_own", F.lit(None).cast("boolean")).unionByName(own)
    got = rows.groupBy(*K).agg(F.max("_own").alias("_own"), *[a.alias(n) for n, a in aggs.items()])
    return got.where("_own").drop("_own")


def _two_pass(px: DataFrame, half: tuple[int, int], f: Callable[[Column | str], Column], c: str = "v") -> DataFrame:
    for along, across, k in (("x", "y", half[1]), ("y", "x", half[0])):
        if k:
            px = px.withColumn(c, f(c).over(Window.partitionBy("image_id", across).orderBy(along).rangeBetween(-k, k)))
    return px


def _morph(px: DataFrame, se: Offsets, f, columns: list[str]) -> DataFrame:
    half = is_rectangle(se)
    if half:
        out = px.select(*K, *columns)
        for c in columns:
            out = _two_pass(out, half, f, c)
        return out
    return window(px, se, {c: f(c) for c in columns}, columns).select(*K, *columns)


def dilate(px: DataFrame, se: Offsets, columns: list[str] = ["v"], order: str = "less") -> DataFrame:
    """Supremum over the window; what is outside the domain is neutral. Several columns: channel by channel."""
    return _morph(px, se, F.max if order == "less" else F.min, columns)


def erode(px: DataFrame, se: Offsets, columns: list[str] = ["v"], order: str = "less") -> DataFrame:
    return _morph(px, se, F.min if order == "less" else F.max, columns)


def opening(px: DataFrame, se: Offsets, columns: list[str] = ["v"]) -> DataFrame:
    """Erosion, then dilation, by the same element (not reflected)."""
    return dilate(erode(px, se, columns), se, columns)


def closing(px: DataFrame, se: Offsets, columns: list[str] = ["v"]) -> DataFrame:
    return erode(dilate(px, se, columns), se, columns)


def gradient(px: DataFrame, se: Offsets) -> DataFrame:
    """Dilation less erosion, in one pass over both."""
    half = is_rectangle(se)
    if half:
        both = px.select(*K, F.col("v").alias("hi"), F.col("v").alias("lo"))
        both = _two_pass(_two_pass(both, half, F.max, "hi"), half, F.min, "lo")
    else:
        both = window(px, se, {"hi": F.max("v"), "lo": F.min("v")})
    return both.select(*K, F.abs(F.col("hi") - F.col("lo")).alias("v"))


def external_gradient(px: DataFrame, se: Offsets) -> DataFrame:
    half = is_rectangle(se)
    if half:
        both = _two_pass(px.select(*K, "v", F.col("v").alias("hi")), half, F.max, "hi")
    else:
        both = px.select(*K, "v").join(window(px, se, {"hi": F.max("v")}), K)
    return both.select(*K, F.abs(F.col("hi") - F.col("v")).alias("v"))


class Kernel:
    """A neighbourhood expression g(p) = A(f(p, n)) over named columns: ``Kernel(F.max, lambda p, n: n["v"] - p["v"])``.

    Columns that the expression doesn't read at the neighbour aren't scattered, and those that it doesn't read at the
    point aren't joined back.
    """

    class _Names:
        def __init__(self, prefix: str):
            self.prefix, self.used = prefix, []

        def __getitem__(self, name: str) -> Column:
            if name not in self.used:
                self.used.append(name)
            return F.col(self.prefix + name)

    def __init__(self, aggregate: Callable[[Column], Column], expression: Callable):
        self.aggregate, self.point, self.near = aggregate, self._Names("p_"), self._Names("n_")
        self.expression = expression(self.point, self.near)

    def execute(self, px: DataFrame, se: Offsets) -> DataFrame:
        far = scatter(px, se, self.near.used).withColumnsRenamed({c: f"n_{c}" for c in self.near.used})
        here = px.select(*K, *[F.col(c).alias(f"p_{c}") for c in self.point.used])
        return here.join(far, K).groupBy(*K).agg(self.aggregate(self.expression).alias("v"))


def edges(px: DataFrame, nb: Offsets = C4, columns: list[str] = ["v"]) -> DataFrame:
    """Undirected edges of the grid graph, each once: (image_id, y, x, qy, qx, columns of both ends, those of q with q_)."""
    forward = [o for o in nb if o > (0, 0)]
    far = scatter(px, tuple(forward), columns)
    far = far.select(*K, (F.col("y") + F.col("dy")).cast("int").alias("qy"), (F.col("x") + F.col("dx")).cast("int").alias("qx"), *[F.col(c).alias(f"q_{c}") for c in columns])
    return px.select(*K, *columns).join(far, K)
