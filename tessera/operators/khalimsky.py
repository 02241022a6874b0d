"""The doubled grid: pixels on even sites (2-faces), edges between them (1-faces), corners (0-faces)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.rasters import K


def face() -> Column:
    """Dimension of a site: 2, 1 or 0."""
    return 2 - F.pmod("y", F.lit(2)) - F.pmod("x", F.lit(2))


def immerse(px: DataFrame) -> DataFrame:
    """Each site of the doubled grid with the interval (lo, hi) of the pixels around it."""
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    s = px.select("image_id", "y", "x", "v", near.alias("o")).select("image_id", (F.col("y") * 2 + F.col("o.a")).alias("y"), (F.col("x") * 2 + F.col("o.b")).alias("x"), "v")
    b = px.groupBy("image_id").agg((F.min("y") * 2).alias("ya"), (F.max("y") * 2).alias("yb"), (F.min("x") * 2).alias("xa"), (F.max("x") * 2).alias("xb"))
    got = s.groupBy(*K).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return got.join(b, "image_id").where("y >= ya and y <= yb and x >= xa and x <= xb").select(*K, "lo", "hi")


def unimmerse(px: DataFrame) -> DataFrame:
    """The 2-faces as an image again."""
    return px.where(face() == 2).select("image_id", (F.col("y") / 2).cast("int").alias("y"), (F.col("x") / 2).cast("int").alias("x"), "v")


def add_border(px: DataFrame, value: DataFrame | None = None) -> DataFrame:
    """The image with a border of one pixel: the median of its rim, or (image_id, median) as given."""
    from tessera.operators.views import border_median, rim

    value = border_median(px) if value is None else value
    out = rim(px, 1).select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).join(value, "image_id")
    return px.select(*K, "v").unionByName(out.select(*K, F.col("median").alias("v")))
