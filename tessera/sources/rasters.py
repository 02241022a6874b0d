"""Rasters as tables px(image_id, y, x, v): from tables, rows, buffers and constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = ["image_id", "y", "x"]


def from_embeddings(spark: SparkSession, sf_dir: str, side: int = 64, levels: int = 256) -> DataFrame:
    """Grey rasters from the vectors of ``embeddings``: a vector is a line, 64 lines an image; images are then cut into
    squares of ``side``. Values: component * 64 + 128, floored, within 0..255, in ``levels`` equal steps."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id is not null and embedding is not null")
    df = df.select(F.col("vec_id").alias("vec_id"), F.posexplode("embedding").alias("c", "e"))
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col("e").cast("double") * 640 + 128))).cast("int")
    tiles = 64 // side
    image = F.floor(F.col("vec_id") / side) * tiles + F.floor(F.col("c") / side)
    return df.select(image.cast("long").alias("image_id"), (F.col("vec_id") % side).cast("int").alias("y"), (F.col("c") % side).cast("int").alias("x"), F.floor(v / (256 // levels)).cast("int").alias("v"))


def colour_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px(image_id, y, x, r, g, b): three neighbouring components of a vector make a pixel; 21 to a line."""
    px = from_embeddings(spark, sf_dir).where("x < 63")
    at = lambda k: F.max(F.when(F.col("x") % 3 == k, F.col("v")))
    return px.groupBy("image_id", "y", F.floor(F.col("x") / 3).cast("int").alias("x")).agg(at(0).alias("r"), at(1).alias("g"), at(2).alias("b"))


def from_rows(spark: SparkSession, rows: list[list], image_id: int = 0) -> DataFrame:
    """An image from nested lists, for small literals."""
    data = [(image_id, y, x, v) for y, r in enumerate(rows) for x, v in enumerate(r)]
    kind = "boolean" if rows and rows[0] and isinstance(rows[0][0], bool) else "double" if any(isinstance(v, float) for r in rows for v in r) else "int"
    return spark.createDataFrame(data, f"image_id long, y int, x int, v {kind}")


def from_buffer(df: DataFrame, buffer: str, ncols: str = "ncols") -> DataFrame:
    """Rows (image_id, array of values in scan order, width) to pixels, without a shuffle."""
    p = df.select("image_id", F.col(ncols).alias("_w"), F.posexplode(buffer).alias("_i", "v"))
    return p.select("image_id", F.floor(F.col("_i") / F.col("_w")).cast("int").alias("y"), (F.col("_i") % F.col("_w")).cast("int").alias("x"), "v")


def domain(df: DataFrame, height: str = "h", width: str = "w") -> DataFrame:
    """Sites of boxes (image_id, h, w)."""
    ys = df.select("image_id", F.explode(F.sequence(F.lit(0), F.col(height) - 1)).alias("y"), F.col(width).alias("_w")).where(f"`{'_w'}` > 0")
    return ys.select("image_id", F.col("y").cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.col("_w") - 1)).cast("int").alias("x"))


def constant(sites: DataFrame, value) -> DataFrame:
    return sites.select(*K, F.lit(value).alias("v"))


def iota(sites: DataFrame, start: int = 0) -> DataFrame:
    """Values start, start + 1, ... in scan order. Lines are counted first, so that no image meets in one window."""
    lines = sites.groupBy("image_id", "y").agg(F.count("*").alias("_n"))
    base = lines.select("image_id", "y", (F.sum("_n").over(Window.partitionBy("image_id").orderBy("y")) - F.col("_n")).alias("_base"))
    w = Window.partitionBy("image_id", "y").orderBy("x")
    return sites.join(base, ["image_id", "y"]).select(*K, (F.col("_base") + F.row_number().over(w) - 1 + start).cast("long").alias("v"))


def bounds(px: DataFrame) -> DataFrame:
    """Half-open bounding boxes."""
    return px.groupBy("image_id").agg(F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1"))


def imprint(px: DataFrame) -> DataFrame:
    """Lines of text, one for each image row: values right-aligned to the image's widest, separated by spaces."""
    wide = px.groupBy("image_id").agg(F.max(F.length(F.col("v").cast("string"))).alias("_w"))
    rows = px.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("_r")).join(wide, "image_id")
    return rows.select("image_id", "y", F.array_join(F.transform("_r", lambda s: F.lpad(s["v"].cast("string"), F.col("_w"), F.lit(" "))), " ").alias("line"))
