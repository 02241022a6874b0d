"""Barrier distances, tree distances, spanning trees, shortest paths and seeded segmentation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import kernels as k
from tessera.operators import trees
from tessera.operators.forest import Forest, by_tree, with_tree
from tessera.operators.rasterwise import Grid, per_image
from tessera.sources.rasters import K

SITE = "image_id long, y int, x int"


def _seeds(g: Grid, which: str | None) -> np.ndarray:
    """Seeds from a column, or sides of the image: any of t, b, l, r."""
    if which is None:
        return g["seed"].astype(bool)
    s = np.zeros(g.mask.shape, bool)
    s[0, :] |= "t" in which
    s[-1, :] |= "b" in which
    s[:, 0] |= "l" in which
    s[:, -1] |= "r" in which
    return s


def _map(px: DataFrame, f, sides: str | None, columns: list[str] = ["v"]) -> DataFrame:
    return per_image(px, lambda g: g.pixels(d=f(g, _seeds(g, sides))), f"{SITE}, d int", columns + ([] if sides else ["seed"]))


def fast_mbd(px: DataFrame, sides: str | None = "tblr", passes: int = 3) -> DataFrame:
    """Minimum barrier distance by raster scans from the image's border (or a column ``seed``): an upper bound of the exact one."""
    return _map(px, lambda g, s: k.raster_scan_mbd(g["v"], s, passes), sides)


def waterflow_mbd(px: DataFrame, sides: str | None = "tblr") -> DataFrame:
    """Best-first approximation; every value, the top one too, has its bucket."""
    return _map(px, lambda g, s: k.waterflow_mbd(g["v"], s), sides)


def exact_mbd(px: DataFrame, sides: str | None = "tblr") -> DataFrame:
    return _map(px, lambda g, s: k.exact_mbd(g["v"], s), sides)


def colour(px: DataFrame, sides: str | None = "tblr", how: str = "waterflow") -> DataFrame:
    """Barrier distance of px(r, g, b) along one path for all three channels: their ranges dr, dg, db on the path whose
    summed range d is least, by ``waterflow`` or raster ``scan``."""
    f = {"waterflow": k.joint_waterflow, "scan": k.joint_raster_scan}[how]

    def run(g: Grid):
        r, gr, b = f([g[c] for c in "rgb"], _seeds(g, sides))
        return g.pixels(dr=r, dg=gr, db=b, d=r + gr + b)

    return per_image(px, run, f"{SITE}, dr int, dg int, db int, d int", ["r", "g", "b"] + ([] if sides else ["seed"]))


def mst(px: DataFrame, nb: str = "c4") -> DataFrame:
    """Minimum spanning tree of the grid with weights |v(p) - v(q)|: (image_id, p, q, w) by flat index."""

    def run(g: Grid):
        f = g["v"].ravel()
        t = k.spanning_tree(g.mask, lambda p, q: np.abs(f[p] - f[q]), k.NEIGHBOURS[nb])
        return g.rows(p=[e[0] for e in t], q=[e[1] for e in t], w=[int(e[2]) for e in t])

    return per_image(px, run, "image_id long, p long, q long, w int")


def mst_mbd(px: DataFrame, sides: str | None = "tblr") -> DataFrame:
    """Barrier distance along the minimum spanning tree."""

    def f(g: Grid, s: np.ndarray):
        v = g["v"].ravel()
        return k.tree_barrier(g["v"], k.spanning_tree(g.mask, lambda p, q: np.abs(v[p] - v[q]), k.C4), s)

    return _map(px, f, sides)


def dahu(px: DataFrame, sides: str | None = "tblr") -> DataFrame:
    """Dahu pseudo-distance to the seeds on the tree of shapes: a pass up and one down carry the range of levels."""

    def f(g: Grid, s: np.ndarray):
        parent, level = k.tree_of_shapes(g["v"])
        node, ids, ups = k.tree_tables(parent, level)
        lev = {int(i): int(level[i]) for i in ids}
        d = k.dahu_on_tree(ids.tolist(), ups.tolist(), lev, set(node[s.ravel()].tolist()))
        return np.array([d[int(n)] for n in node]).reshape(g.mask.shape)

    return _map(px, f, sides)


def interval_dahu(px: DataFrame, sides: str | None = "tblr") -> DataFrame:
    """Dahu distance by flooding intervals of the doubled grid, without a tree."""
    return _map(px, lambda g, s: k.interval_dahu(g["v"], s), sides)


def dahu_pairs(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Dahu distance of pairs of nodes (image_id, a, b): the range of levels along the tree path through their least
    common ancestor. Pairs as in ``trees.lca``."""
    return path_ranges(nodes, pairs, ["level"]).withColumnRenamed("d_level", "d")


def path_ranges(nodes: DataFrame, pairs: DataFrame, values: list[str]) -> DataFrame:
    """The range d_<value> of each whole-numbered column of ``nodes`` along the tree path between a and b; with the
    channels of ``node_colours``, the colour form of the Dahu distance. Pairs as in ``trees.lca``."""

    def run(f: Forest, rows: pa.Table) -> dict:
        a, b, top = trees._pairs(f, rows)
        out = {"a": f.id[a], "b": f.id[b]}
        for c in values:
            v = f[c].astype(np.int64)
            (la, ha), (lb, hb) = (f.span(x, f.depth[x] - f.depth[top], v) for x in (a, b))
            out[f"d_{c}"] = np.maximum(ha, hb) - np.minimum(la, lb)
        return out

    schema = ", ".join(["image_id long, a long, b long", *[f"d_{c} int" for c in values]])
    return with_tree(nodes.select("image_id", "node_id", "parent_id", *values), pairs.select("image_id", "a", "b"), run, schema)


def node_colours(pmap: DataFrame, px: DataFrame, channels: list[str] = ["r", "g", "b"]) -> DataFrame:
    """Nodes of ``pmap`` with the median colour of their own pixels in lexicographic order (the upper one of two)."""
    own = pmap.select(*K, "node_id").join(px, K).groupBy("image_id", "node_id", *channels).agg(F.count("*").alias("n"))
    w = Window.partitionBy("image_id", "node_id")
    ranked = own.withColumns({"_to": F.sum("n").over(w.orderBy(*channels)), "_all": F.sum("n").over(w)})
    middle = ranked.where((F.col("_to") > F.floor(F.col("_all") / 2)) & (F.col("_to") - F.col("n") <= F.floor(F.col("_all") / 2)))
    return trees.nodes_of(pmap).join(middle.select("image_id", "node_id", *channels), ["image_id", "node_id"])


def dahu_ranges(nodes: DataFrame, seeds: list[str], values: list[str]) -> DataFrame:
    """Dahu distance of all nodes to several sets of seeds at once: ``nodes`` has a boolean column for each set and
    whole-numbered ``values``. A pass up and one down carry the values' ranges, that of the least sum first (ties: the first
    child listed): columns <set>_<value>, -1 in trees without a seed."""

    def run(f: Forest) -> dict:
        v = np.stack([f[c].astype(np.int64) for c in values], 1)
        out = {"node_id": f.id}
        for s in seeds:
            fixed = f[s].astype(bool)
            low, top, known = v.copy(), v.copy(), fixed.copy()

            def offer(to: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
                a, b = np.minimum(a, v[to]), np.maximum(b, v[to])
                cost = (b - a).sum(1)
                by = np.lexsort((np.arange(len(to)), cost, to))
                by = by[np.r_[True, to[by][1:] != to[by][:-1]]] if len(by) else by
                by = by[~known[to[by]] | (cost[by] < (top[to[by]] - low[to[by]]).sum(1))]
                low[to[by]], top[to[by]], known[to[by]] = a[by], b[by], True

            for n, u in f.rise():
                go = known[n] & ~fixed[u]
                offer(u[go], low[n[go]], top[n[go]])
            for n, u in f.down():
                go = known[u] & ~fixed[n]
                offer(n[go], low[u[go]], top[u[go]])
            for k_, c in enumerate(values):
                out[f"{s}_{c}"] = np.where(known, top[:, k_] - low[:, k_], -1)
        return out

    schema = ", ".join(["image_id long, node_id long", *[f"{s}_{c} int" for s in seeds for c in values]])
    return by_tree(nodes.select("image_id", "node_id", "parent_id", *seeds, *values), run, schema)


def touching(pmap: DataFrame, sides: dict[str, str]) -> DataFrame:
    """(image_id, node_id) and a boolean for each name of ``sides``, which is no column of the nodes: has the node an own
    pixel on one of these sides (of t, b, l, r) of its image?"""
    box = pmap.groupBy("image_id").agg(F.min("y").alias("_t"), F.max("y").alias("_b"), F.min("x").alias("_l"), F.max("x").alias("_r"))
    on = {c: F.col(a) == F.col(f"_{c}") for c, a in (("t", "y"), ("b", "y"), ("l", "x"), ("r", "x"))}
    p = pmap.select(*K, "node_id").join(box, "image_id")
    any_ = lambda names: reduce(lambda x, y: x | y, [on[c] for c in names])
    return p.groupBy("image_id", "node_id").agg(*[F.bool_or(any_(c)).alias(n) for n, c in sides.items()])


def dahu_by_sides(pmap: DataFrame, nodes: DataFrame, sides: dict[str, str], values: list[str]) -> DataFrame:
    """Dahu distance of every pixel to the named sets of sides: ``nodes`` with ``values``, columns <name>_<value>."""
    got = dahu_ranges(nodes.join(touching(pmap, sides), ["image_id", "node_id"]), list(sides), values)
    return pmap.select(*K, "node_id").join(got, ["image_id", "node_id"]).drop("node_id")


def k_max_distance(nodes: DataFrame, k_most: int = 200) -> DataFrame:
    """Sum of the largest ``k_most`` level jumps from each node up to the root, for all but roots; sums don't wrap."""

    def run(f: Forest) -> dict:
        level, d = f["level"].astype(np.int64), np.zeros(len(f), np.int64)
        place, most = np.zeros(len(f), np.int64), np.zeros((len(f.layers[0]), 0), np.int64)  # jumps of the layer above
        place[f.layers[0]] = np.arange(len(f.layers[0]))
        for n, u in f.down():
            most = np.sort(np.c_[most[place[u]], np.abs(level[n] - level[u])], axis=1)[:, -k_most:]
            place[n] = np.arange(len(n))
            d[n] = most.sum(axis=1)
        return {"node_id": f.id[f.up >= 0], "d": d[f.up >= 0]}

    return by_tree(nodes.select("image_id", "node_id", "parent_id", "level"), run, "image_id long, node_id long, d long")


def tree_dijkstra(px: DataFrame, kind: str = "tos") -> DataFrame:
    """px(v, mark): nodes of marked pixels are sources (nodes with two marks are none); every pixel gets the mark of the
    nearest along the tree, steps costing the level difference plus 0.1, and that cost. Ties go to the smaller mark."""
    from tessera.operators.trees import _build

    def run(g: Grid):
        node, ids, ups, level = _build(g, kind, k.C4)
        near: dict[int, list] = {}
        for i, u in zip(ids.tolist(), ups.tolist()):
            if u >= 0:
                c = abs(float(level[i] - level[u])) + 0.1
                near.setdefault(i, []).append((u, c))
                near.setdefault(u, []).append((i, c))
        marks: dict[int, set[int]] = {}
        for n, m in zip(node.tolist(), g["mark"].ravel().tolist()):
            if n >= 0 and m > 0:
                marks.setdefault(n, set()).add(int(m))
        best: dict[int, tuple[float, int]] = {}
        for m in sorted({next(iter(s)) for s in marks.values() if len(s) == 1}):
            for n, (c, _) in k.shortest_paths(near, {n: 0.0 for n, s in marks.items() if s == {m}}).items():
                if n not in best or round(c, 6) < round(best[n][0], 6):
                    best[n] = (c, m)
        got = [best.get(int(n), (-1.0, 0)) for n in node]
        return g.pixels(label=np.array([b[1] for b in got]).reshape(g.mask.shape), cost=np.array([b[0] for b in got], float).reshape(g.mask.shape))

    return per_image(px, run, f"{SITE}, label int, cost double", ["v", "mark"])


def image_dijkstra(px: DataFrame, nb: str = "c4") -> DataFrame:
    """px(v, seed): cost of the cheapest path of steps |v(p) - v(q)| + 1 to a seed."""

    def run(g: Grid):
        f, near = g["v"].ravel().tolist(), k.adjacency(g.mask, k.NEIGHBOURS[nb])
        graph = {p: [(q, abs(f[p] - f[q]) + 1) for q in n] for p, n in enumerate(near)}
        got = k.shortest_paths(graph, {p: 0 for p in np.nonzero(g["seed"].ravel())[0].tolist()})
        return g.pixels(d=np.array([got[p][0] if p in got else -1 for p in range(len(f))]).reshape(g.mask.shape))

    return per_image(px, run, f"{SITE}, d int", ["v", "seed"])


def a_star(px: DataFrame, start: tuple[int, int], goal: tuple[int, int], nb: str = "c8") -> DataFrame:
    """Shortest path over true pixels: (image_id, step, y, x); none, no rows."""

    def run(g: Grid):
        free = g["v"].astype(bool) & g.mask
        s, t = (start[0] - g.y0, start[1] - g.x0), (goal[0] - g.y0, goal[1] - g.x0)
        inside = all(0 <= p[0] < free.shape[0] and 0 <= p[1] < free.shape[1] for p in (s, t))
        path = k.a_star(free, s, t, k.NEIGHBOURS[nb]) if inside else []
        return g.rows(step=list(range(len(path))), y=[p[0] + g.y0 for p in path], x=[p[1] + g.x0 for p in path])

    return per_image(px, run, "image_id long, step int, y int, x int")


def nearest_seed(d1: DataFrame, d2: DataFrame) -> DataFrame:
    """Two-class segmentation: 0 where the first distance is smaller, else 255."""
    return d1.select(*K, F.col("d").alias("_a")).join(d2.select(*K, F.col("d").alias("_b")), K).select(*K, F.when(F.col("_a") < F.col("_b"), 0).otherwise(255).alias("v"))


def path_cost(r: str = "r", g: str = "g", b: str = "b", how: str = "max"):
    """A colour distance as one number: largest, Euclidean, or the sum of integer thirds."""
    if how == "max":
        return F.greatest(r, g, b)
    if how == "euclid":
        return F.sqrt((F.col(r) * F.col(r) + F.col(g) * F.col(g) + F.col(b) * F.col(b)).cast("double"))
    return F.floor(F.col(r) / 3).cast("int") + F.floor(F.col(g) / 3).cast("int") + F.floor(F.col(b) / 3).cast("int")


def contrast(v: str = "v", low: int = 40, high: int = 200):
    return F.when(F.col(v) <= low, 0).when(F.col(v) >= high, 255).otherwise(F.floor((F.col(v) - low) * 255.0 / (high - low)).cast("int"))
