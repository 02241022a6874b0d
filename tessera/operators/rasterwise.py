"""Runs a kernel over each image (or tile) as numpy arrays: one task holds one image."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.rasters import K

#: Spark types of numpy result arrays by kind.
ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


class Grid:
    """One image: ``mask`` (height, width) and a dense array for each value column; (y0, x0) is its first corner."""

    def __init__(self, table: pa.Table, columns: list[str]):
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        self.image = table.column("image_id")[0].as_py()
        self.y0, self.x0 = int(y.min()), int(x.min())
        h, w = int(y.max()) - self.y0 + 1, int(x.max()) - self.x0 + 1
        self.mask = np.zeros((h, w), bool)
        at = (y - self.y0, x - self.x0)
        self.mask[at] = True
        self.data: dict[str, np.ndarray] = {}
        for c in columns:
            v = table.column(c).to_numpy(zero_copy_only=False)
            d = np.zeros((h, w), bool if v.dtype == bool else np.int64 if v.dtype.kind in "iu" else float)
            d[at] = v
            self.data[c] = d

    def __getitem__(self, c: str) -> np.ndarray:
        return self.data[c]

    def pixels(self, **values: np.ndarray) -> dict[str, np.ndarray]:
        """Columns image_id, y, x and the given (height, width) arrays over the domain."""
        y, x = np.nonzero(self.mask)
        return {"image_id": np.full(len(y), self.image), "y": y + self.y0, "x": x + self.x0, **{k: a[y, x] for k, a in values.items()}}

    def rows(self, **columns) -> dict:
        n = len(next(iter(columns.values())))
        return {"image_id": np.full(n, self.image), **columns}


REPO = str(Path(__file__).resolve().parents[2])


def ship(spark) -> None:
    """Lets Python workers import this package where the driver found it by its own path only."""
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, env.get("PYTHONPATH")) if x)


def checkpoints(spark) -> None:
    """Sets the folder of checkpoints: the shared one that spark.checkpoint.dir names; an own one only where it is unset."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        import tempfile

        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tessera-"))


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, worked out once and written to the folder of checkpoints, for plans that read them several times."""
    checkpoints(df.sparkSession)
    return df.checkpoint()


def per_image(px: DataFrame, kernel: Callable[[Grid], dict], schema: str, columns: list[str] = ["v"]) -> DataFrame:
    """``kernel`` takes a Grid and returns columns for ``schema``. Rows of an image meet in one task; pixels that
    repeat a site overwrite each other; null values count as 0."""
    ship(px.sparkSession)
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]

    def run(table: pa.Table) -> pa.Table:
        out = kernel(Grid(table, columns))
        return pa.table({n.strip("`"): pa.array(np.asarray(out[n.strip("`")]) if not isinstance(out[n.strip("`")], list) else out[n.strip("`")], ARROW[t]) for n, t in fields})

    filled = px.select(*[F.col(c).cast("long" if c == "image_id" else "int").alias(c) for c in K], *[F.coalesce(F.col(c), F.lit(0).cast(dict(px.dtypes)[c]) if dict(px.dtypes)[c] != "boolean" else F.lit(False)).alias(c) for c in columns])
    return filled.groupBy("image_id").applyInArrow(run, schema)
