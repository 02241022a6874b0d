"""Connected operators: labelling, hole filling, area filters, reconstruction, distance transforms, region graphs, cuts.

Each runs a kernel by image. ``blobs_tiled`` labels images of any size: tiles in parallel, then the labels that touch
across seams are joined.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import kernels as k
from tessera.operators.rasterwise import Grid, checkpoints, per_image, stored
from tessera.sources.rasters import K

SITE = "image_id long, y int, x int"


def blobs(px: DataFrame, nb: str = "c4") -> DataFrame:
    """Labels 1..n of true pixels by the scan order of each component's first pixel; 0 elsewhere."""
    return per_image(px, lambda g: g.pixels(label=k.label(g["v"].astype(bool) & g.mask, k.NEIGHBOURS[nb])), f"{SITE}, label long")


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, root) of edges (a, b): the smallest node reachable, by hooking and pointer doubling. Lineage is cut by
    reliable checkpoints every round (spark.checkpoint.dir)."""
    checkpoints(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct().checkpoint()
    every = both.select(F.col("a").alias("node")).distinct()
    if nodes is not None:
        every = every.unionByName(nodes.select("node")).distinct()
    at = every.select("node", F.col("node").alias("root")).checkpoint()
    while True:
        near = both.join(at.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("m"))
        hook = at.join(near, "node", "left").select("node", F.least("root", F.coalesce("m", "root")).alias("root"), F.col("root").alias("old"))
        jump = hook.select(F.col("node").alias("root"), F.col("root").alias("top"))
        nxt = hook.join(jump, "root", "left").select("node", F.least("root", F.coalesce("top", "root")).alias("root"), "old").checkpoint()
        if nxt.where("root <> old").isEmpty():
            return nxt.select("node", "root")
        at = nxt.select("node", "root")


def blobs_tiled(px: DataFrame, nb: str = "c4", tile: int = 512) -> DataFrame:
    """``blobs`` for images of any size: a task holds one tile, or the components that start in one row of tiles. Only
    parts that meet a seam take part in joining; labels are numbered by rows of tiles, each from the count of those before."""
    wide = 1 << 32
    t = px.withColumns({"_ty": F.floor(F.col("y") / tile), "_tx": F.floor(F.col("x") / tile)})
    keyed = t.select(F.struct("image_id", "_ty", "_tx").alias("_tile"), "image_id", "y", "x", "v")

    def run(table):
        import pyarrow as pa

        g = Grid(table, ["v"])
        lab = k.label(g["v"].astype(bool) & g.mask, k.NEIGHBOURS[nb]).ravel()
        first: dict[int, int] = {}
        for p in np.nonzero(lab)[0].tolist():
            first.setdefault(int(lab[p]), p)
        w = g.mask.shape[1]
        # a label's name is its first pixel, as (y, x) in one number
        name = np.array([0] + [(first[i] // w + g.y0) * wide + first[i] % w + g.x0 for i in range(1, len(first) + 1)])
        out = g.pixels(part=name[lab].reshape(g.mask.shape), on=(lab > 0).reshape(g.mask.shape))
        return pa.table({c: pa.array(a) for c, a in out.items()}).select(["image_id", "y", "x", "part", "on"]).cast(pa.schema([("image_id", pa.int64()), ("y", pa.int32()), ("x", pa.int32()), ("part", pa.int64()), ("on", pa.bool_())]))

    local = stored(keyed.groupBy("_tile").applyInArrow(run, f"{SITE}, part long, on boolean"))
    rim = local.where("on").where((F.col("y") % tile).isin(0, tile - 1) | (F.col("x") % tile).isin(0, tile - 1))
    off = [o for o in k.NEIGHBOURS[nb] if o > (0, 0)]
    steps = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in off])
    far = rim.select("image_id", F.col("part").alias("q"), F.col("y").alias("qy"), F.col("x").alias("qx"), F.explode(steps).alias("o"))
    far = far.select("image_id", "q", (F.col("qy") - F.col("o.dy")).alias("y"), (F.col("qx") - F.col("o.dx")).alias("x"))
    node = lambda c: F.struct("image_id", c)
    seams = rim.join(far, K).where("part <> q").select(node("part").alias("a"), node(F.col("q").alias("part")).alias("b")).distinct()
    parts = local.where("on").select(node("part").alias("node")).distinct()
    met = connected_components(seams)
    roots = parts.join(met, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    block = F.expr(f"root.part div {wide * tile}").alias("block")
    heads = roots.select("root").distinct().select("root", F.col("root.image_id").alias("image_id"), block)
    w = Window.partitionBy("image_id").orderBy("block")
    before = heads.groupBy("image_id", "block").agg(F.count("*").alias("n")).select("image_id", "block", (F.sum("n").over(w) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("image_id", "block").orderBy("root.part"))
    order = heads.withColumn("nth", nth).join(before, ["image_id", "block"]).select("root", (F.col("before") + F.col("nth")).alias("label"))
    named = roots.join(order, "root").select(F.col("node.image_id").alias("image_id"), F.col("node.part").alias("part"), "label")
    return local.join(named.withColumn("on", F.lit(True)), ["image_id", "part", "on"], "left").select(*K, F.coalesce("label", F.lit(0)).alias("label"))


def saturate(px: DataFrame, nb: str = "c4", y: int = 0, x: int = 0) -> DataFrame:
    """Fills holes of the true pixels, seen from a site of the background."""
    return per_image(px, lambda g: g.pixels(v=k.saturate(g["v"].astype(bool), g.mask, k.NEIGHBOURS[nb], (y - g.y0, x - g.x0))), f"{SITE}, v boolean")


def area_opening(px: DataFrame, area: int, nb: str = "c4") -> DataFrame:
    return per_image(px, lambda g: g.pixels(v=k.area_opening(g["v"], g.mask, k.NEIGHBOURS[nb], area)), f"{SITE}, v int")


def area_closing(px: DataFrame, area: int, nb: str = "c4") -> DataFrame:
    return per_image(px, lambda g: g.pixels(v=k.area_opening(g["v"], g.mask, k.NEIGHBOURS[nb], area, -1)), f"{SITE}, v int")


def closing_by_reconstruction(px: DataFrame, nb: str = "c4", order: str = "less") -> DataFrame:
    """px(v, marker) with v <= marker: the level of f at which each component first reaches its marker."""
    sign = 1 if order == "less" else -1
    return per_image(px, lambda g: g.pixels(v=k.closing_by_reconstruction(g["v"], g["marker"], g.mask, k.NEIGHBOURS[nb], sign)), f"{SITE}, v int", ["v", "marker"])


def leveling(px: DataFrame) -> DataFrame:
    """Closing by reconstruction by four neighbours, then its dual by eight."""

    def run(g: Grid):
        f, m = g["v"], g["marker"]
        up = k.closing_by_reconstruction(f, np.maximum(f, m), g.mask, k.C4, 1)
        return g.pixels(v=k.closing_by_reconstruction(up, np.minimum(up, m), g.mask, k.C8, -1))

    return per_image(px, run, f"{SITE}, v int", ["v", "marker"])


def chamfer(px: DataFrame, nb: str = "c4") -> DataFrame:
    """Steps to the nearest false pixel or to the outside of the image's box."""
    return per_image(px, lambda g: g.pixels(v=k.chamfer(g["v"].astype(bool) & g.mask, k.NEIGHBOURS[nb])), f"{SITE}, v int")


def extinction(px: DataFrame, nb: str = "c4") -> DataFrame:
    return per_image(px, lambda g: g.pixels(v=k.extinction(g["v"], g.mask, k.NEIGHBOURS[nb])), f"{SITE}, v int")


def flat_zones(px: DataFrame, nb: str = "c4") -> DataFrame:
    return per_image(px, lambda g: g.pixels(label=k.flat_zones(g["v"], g.mask, k.NEIGHBOURS[nb])), f"{SITE}, label long")


def influence_zones(px: DataFrame, nb: str = "c4") -> DataFrame:
    return per_image(px, lambda g: g.pixels(label=k.grow_zones(g["v"].astype(bool) & g.mask, g.mask, k.NEIGHBOURS[nb])[0]), f"{SITE}, label long")


def rag(px: DataFrame, nb: str = "c4") -> DataFrame:
    """Region adjacency: pairs a < b of components of true pixels whose zones, grown at one pace, touch."""

    def run(g: Grid):
        pairs = sorted(k.grow_zones(g["v"].astype(bool) & g.mask, g.mask, k.NEIGHBOURS[nb])[1])
        return g.rows(a=[p[0] for p in pairs], b=[p[1] for p in pairs])

    return per_image(px, run, "image_id long, a long, b long")


def graph_cut(px: DataFrame, smooth: float, low: float, high: float, nb: str = "c4") -> DataFrame:
    """Binary labelling of least energy: |v - low| for label 0, |v - high| for 1, ``smooth`` for unequal neighbours; the
    energy is repeated in every row."""

    def run(g: Grid):
        lab, e = k.graph_cut(g["v"], g.mask, k.NEIGHBOURS[nb], smooth, np.abs(g["v"] - low), np.abs(g["v"] - high))
        return g.pixels(label=lab, energy=np.full(g.mask.shape, float(e)))

    return per_image(px, run, f"{SITE}, label int, energy double")


def mean_shift(px: DataFrame, hs: float = 3.0, hr: float = 20.0) -> DataFrame:
    return per_image(px, lambda g: g.pixels(v=k.mean_shift(g["v"], hs, hr)), f"{SITE}, v double")


def superpixels(px: DataFrame, step: int = 8, compactness: float = 20.0) -> DataFrame:
    return per_image(px, lambda g: g.pixels(label=k.superpixels(g["v"], step, compactness)), f"{SITE}, label long")


def shapes(px: DataFrame, nb: str = "c4") -> DataFrame:
    """Inclusion lattice's members: (image_id, shape, p) with p the flat index of a pixel; shapes are numbered by size, then pixels."""

    def run(g: Grid):
        found = sorted(k.cut_shapes(g["v"], g.mask, k.NEIGHBOURS[nb]), key=lambda s: (len(s), s))
        return g.rows(shape=[i for i, s in enumerate(found) for _ in s], p=[p for s in found for p in s])

    return per_image(px, run, "image_id long, shape long, p long")


def inclusion(members: DataFrame) -> DataFrame:
    """Covering pairs (image_id, below, above) of shapes: inclusions without another shape in between. Shared pixels are counted by a join on the pixel."""
    size = members.groupBy("image_id", "shape").agg(F.count("*").alias("n"))
    pairs = members.select("image_id", "p", F.col("shape").alias("below")).join(members.select("image_id", "p", F.col("shape").alias("above")), ["image_id", "p"]).where("below < above")
    both = pairs.groupBy("image_id", "below", "above").agg(F.count("*").alias("m")).join(size.withColumnsRenamed({"shape": "below", "n": "nb"}), ["image_id", "below"])
    inside = both.where("m = nb").select("image_id", "below", "above")
    via = inside.select("image_id", "below", F.col("above").alias("mid")).join(inside.select("image_id", F.col("below").alias("mid"), "above"), ["image_id", "mid"]).select("image_id", "below", "above").distinct()
    return inside.join(via, ["image_id", "below", "above"], "left_anti")


def convex_hull(px: DataFrame) -> DataFrame:
    """Corners of the hull of each image's true pixels, counter-clockwise: (image_id, corner, y, x)."""

    def run(g: Grid):
        y, x = np.nonzero(g["v"].astype(bool) & g.mask)
        hull = k.convex_hull(list(zip((y + g.y0).tolist(), (x + g.x0).tolist())))
        return g.rows(corner=list(range(len(hull))), y=[p[0] for p in hull], x=[p[1] for p in hull])

    return per_image(px, run, "image_id long, corner int, y int, x int")
