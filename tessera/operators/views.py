"""Views, joins, set operations and sorts of rasters: projections and joins on the site columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.rasters import K


def transform(px: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """Point-wise; lazy, as any DataFrame. Further columns stay."""
    return px.withColumn("v", f(F.col("v")))


def zip_images(*images: DataFrame) -> DataFrame:
    """Equi-join on the site: v0, v1, ... of images with one domain."""
    named = [p.select(*K, F.col("v").alias(f"v{k}")) for k, p in enumerate(images)]
    return reduce(lambda a, b: a.join(b, K), named)


def combine(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    return zip_images(a, b).select(*K, f(F.col("v0"), F.col("v1")).alias("v"))


def where(px: DataFrame, predicate: Column) -> DataFrame:
    """Sites that pass."""
    return px.where(predicate).select(*K)


def restrict(px: DataFrame, sites: DataFrame) -> DataFrame:
    """``ima | domain``: a semi-join."""
    return px.join(sites.select(*K), K, "left_semi")


def exclude(px: DataFrame, sites: DataFrame) -> DataFrame:
    return px.join(sites.select(*K), K, "left_anti")


def box(px: DataFrame, y0: int, x0: int, y1: int, x1: int, sy: int = 1, sx: int = 1) -> DataFrame:
    """Sub-image of a half-open, maybe strided box; a filter that reaches the scan."""
    out = px.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))
    return out.where(((F.col("y") - y0) % sy == 0) & ((F.col("x") - x0) % sx == 0)) if sy * sx > 1 else out


def paste(src: DataFrame, dst: DataFrame) -> DataFrame:
    """dst with src's values on src's domain."""
    return dst.join(src.select(*K, F.col("v").alias("_v")), K, "left").select(*K, F.coalesce("_v", "v").alias("v"))


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row by image: whether sites and values are all equal."""
    j = a.select(*K, F.struct("v").alias("a")).join(b.select(*K, F.struct("v").alias("b")), K, "full")
    return j.groupBy("image_id").agg(F.bool_and(F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("equal"))


def fill(px: DataFrame, value, on: Column | None = None) -> DataFrame:
    return px.withColumn("v", F.lit(value) if on is None else F.when(on, F.lit(value)).otherwise(F.col("v")))


def transpose(px: DataFrame) -> DataFrame:
    return px.select("image_id", F.col("x").alias("y"), F.col("y").alias("x"), "v")


def translate(px: DataFrame, dy: int, dx: int) -> DataFrame:
    return px.withColumns({"y": (F.col("y") + dy).cast("int"), "x": (F.col("x") + dx).cast("int")})


def cast(px: DataFrame, t) -> DataFrame:
    from tessera.functions.values import wrap

    return transform(px, lambda v: wrap(v, t))


def rim(px: DataFrame, k: int) -> DataFrame:
    """Sites up to ``k`` outside each image's bounding box, with the box (y0, x0, h, w). One row by image is expanded."""
    b = px.groupBy("image_id").agg(F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") - F.min("y") + 1).alias("h"), (F.max("x") - F.min("x") + 1).alias("w"))
    s = b.withColumn("y", F.explode(F.sequence(F.col("y0") - k, F.col("y0") + F.col("h") + k - 1))).withColumn("x", F.explode(F.sequence(F.col("x0") - k, F.col("x0") + F.col("w") + k - 1)))
    return s.where(~((F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y0") + F.col("h")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + F.col("w"))))


def pad(px: DataFrame, k: int, mode: str = "value", value=0) -> DataFrame:
    """The image with a border of ``k`` sites: a value, or the image mirrored (as often as needed)."""
    outside = rim(px, k)
    if mode == "value":
        return px.select(*K, "v").unionByName(outside.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.lit(value).cast(dict(px.dtypes)["v"]).alias("v")))

    def fold(c: str, o: str, n: str) -> Column:
        q = F.pmod(F.col(c) - F.col(o), 2 * F.col(n))
        return (F.when(q < F.col(n), q).otherwise(2 * F.col(n) - 1 - q) + F.col(o)).cast("int")

    src = outside.select("image_id", F.col("y").cast("int").alias("_y"), F.col("x").cast("int").alias("_x"), fold("y", "y0", "h").alias("y"), fold("x", "x0", "w").alias("x"))
    got = src.join(px.select(*K, "v"), K).select("image_id", F.col("_y").alias("y"), F.col("_x").alias("x"), "v")
    return px.select(*K, "v").unionByName(got)


def stretch(px: DataFrame, low: float, high: float, integer: bool = True) -> DataFrame:
    """Affine map of each image's range to [low, high], truncated for integers; constant images go to ``low``."""
    r = px.groupBy("image_id").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    y = F.when(F.col("_hi") > F.col("_lo"), F.lit(float(low)) + (F.col("v") - F.col("_lo")) * (F.lit(float(high - low)) / (F.col("_hi") - F.col("_lo")))).otherwise(F.lit(float(low)))
    return px.join(r, "image_id").select(*K, (y.cast("int") if integer else y).alias("v"))


def line(px: DataFrame, y0: int, x0: int, y1: int, x1: int) -> DataFrame:
    """The image's values along a line, both ends included."""
    from tessera.operators.kernels import bresenham

    sites = px.sparkSession.createDataFrame(bresenham((y0, x0), (y1, x1)), "y int, x int")
    return px.join(F.broadcast(sites), ["y", "x"]).select(*K, "v")


def ranked(px: DataFrame, descending: bool = False) -> DataFrame:
    """Sites by value, stable in scan order: rank from 0 within the image."""
    v = F.desc("v") if descending else F.asc("v")
    return px.select(*K, "v", (F.row_number().over(Window.partitionBy("image_id").orderBy(v, "y", "x")) - 1).alias("rank"))


def k_most(df: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """The k largest values of each group as a descending array. Groups are cut to k rows before they are gathered."""
    w = Window.partitionBy(*by).orderBy(F.desc(value))
    return df.select(*by, value).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy(*by).agg(F.reverse(F.array_sort(F.collect_list(value))).alias("most"))


def border(px: DataFrame) -> DataFrame:
    """Pixels on the rim of each image's bounding box."""
    b = px.groupBy("image_id").agg(F.min("y").alias("_y0"), F.min("x").alias("_x0"), F.max("y").alias("_y1"), F.max("x").alias("_x1"))
    on = (F.col("y") == F.col("_y0")) | (F.col("y") == F.col("_y1")) | (F.col("x") == F.col("_x0")) | (F.col("x") == F.col("_x1"))
    return px.join(b, "image_id").where(on).select(*K, "v")


def border_median(px: DataFrame) -> DataFrame:
    """Median of the rim's values: the mean of the middle two, truncated, if they are even in number."""
    b = border(px)
    w = Window.partitionBy("image_id").orderBy("v")
    r = b.withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy("image_id")))
    mid = r.where((F.col("_r") == F.floor((F.col("_n") + 1) / 2)) | (F.col("_r") == F.floor(F.col("_n") / 2) + 1))
    return mid.groupBy("image_id").agg(F.floor(F.avg("v")).cast("int").alias("median"))
