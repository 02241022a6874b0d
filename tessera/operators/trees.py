"""Component trees as tables: nodes(image_id, node_id, parent_id, level, area, depth) and pmap(image_id, y, x, node_id).

A node's id is the flat index of its first pixel in scan order; the root's parent is null; parents are listed before
children. Trees are built by a kernel by image. Filters, roll-ups and paths run by image, too, over the table of nodes
(``forest``), linear in nodes; values meet nodes and pixels by joins. ``closure`` lists every node's ancestors, for what
needs them all: nodes times depth rows, by doubling.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import kernels as k
from tessera.operators.forest import ARROW, Forest, by_tree, with_tree
from tessera.operators.rasterwise import Grid, per_image
from tessera.sources.rasters import K

NODES = "image_id long, node_id long, parent_id long, level int, area long, depth int"


def _build(g: Grid, kind: str, nb) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if kind == "tos":
        parent, level = k.tree_of_shapes(g["v"], g.mask)
    else:
        parent, level = k.max_tree(g["v"], g.mask, nb, 1 if kind == "max" else -1), g["v"].ravel()
    return *k.tree_tables(parent, level), level


def node_map(px: DataFrame, kind: str = "max", nb: str = "c4") -> DataFrame:
    """pmap with each node's level, parent, area and depth beside it, from one run of the kernel: kind ``max``, ``min`` or ``tos`` (tree of shapes; on a sub-domain, one tree for each connected part)."""

    def run(g: Grid):
        node, ids, ups, level = _build(g, kind, k.NEIGHBOURS[nb])
        area, at, depth = k.areas(node, ids, ups), {}, {}
        for i, u in zip(ids.tolist(), ups.tolist()):
            at[i], depth[i] = u, 0 if u < 0 else depth[u] + 1
        n = [int(x) for x in node[g.mask.ravel()]]
        y, x = np.nonzero(g.mask)
        return g.rows(y=y + g.y0, x=x + g.x0, node_id=n, parent_id=[None if at[i] < 0 else at[i] for i in n], level=[int(level[i]) for i in n], area=[area[i] for i in n], depth=[depth[i] for i in n])

    return per_image(px, run, "image_id long, y int, x int, node_id long, parent_id long, level int, area long, depth int")


def nodes_of(pmap: DataFrame) -> DataFrame:
    """The nodes table of ``node_map``: every node has a pixel of its own."""
    return pmap.select("image_id", "node_id", "parent_id", "level", "area", "depth").distinct()


def closure(nodes: DataFrame) -> DataFrame:
    """(image_id, node_id, anc, dist): every node with itself (dist 0) and all its ancestors, by depth."""
    steps = nodes.where("parent_id is not null").select("image_id", "node_id", F.col("parent_id").alias("anc"), F.lit(1).alias("dist"))
    deep = nodes.agg(F.max("depth")).first()[0] or 0
    reach = 1
    while reach < deep:
        far = steps.select("image_id", F.col("node_id").alias("anc"), F.col("anc").alias("top"), F.col("dist").alias("more"))
        edge = steps.where(F.col("dist") == reach)
        steps = steps.unionByName(edge.join(far, ["image_id", "anc"]).select("image_id", "node_id", F.col("top").alias("anc"), (F.col("dist") + F.col("more")).alias("dist")))
        reach *= 2
    own = nodes.select("image_id", "node_id", F.col("node_id").alias("anc"), F.lit(0).alias("dist"))
    return own.unionByName(steps)


def _bare(nodes: DataFrame, *columns) -> DataFrame:
    return nodes.select("image_id", "node_id", "parent_id", *columns)


def depths(nodes: DataFrame) -> DataFrame:
    """Depth of every node; 0 for the root."""
    return by_tree(_bare(nodes), lambda f: {"node_id": f.id, "depth": f.depth}, "image_id long, node_id long, depth int")


def proper(pmap: DataFrame, px: DataFrame, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates over each node's own pixels."""
    return pmap.select(*K, "node_id").join(px, K).groupBy("image_id", "node_id").agg(*[a.alias(n) for n, a in aggs.items()])


def rolled_up(pmap: DataFrame, px: DataFrame, aggs: dict[str, tuple[Column, str]], nodes: DataFrame) -> DataFrame:
    """Aggregates over each node's subtree: ``aggs`` gives for each name the aggregate over pixels, a number, and how
    partial results merge (sum, min or max). Pixels are summed up by node, then nodes by image from the leaves up; null
    is left out, and nodes without a pixel in ``px`` at or below them give no row."""
    own = proper(pmap, px, {n: a for n, (a, _) in aggs.items()}).withColumn("_own", F.lit(1))
    kinds = dict(own.dtypes)
    rows = _bare(nodes).join(own, ["image_id", "node_id"], "left")
    merge = {n: how for n, (_, how) in aggs.items()}
    ufunc = {"sum": np.add, "min": np.minimum, "max": np.maximum}

    def run(f: Forest) -> dict:
        some = f.roll(f.table.column("_own").is_valid().to_numpy().astype(np.int64), np.add) > 0
        out = {"node_id": f.id[some]}
        for n, how in merge.items():
            c = f.table.column(n)
            real = kinds[n] in ("double", "float")
            far = (np.inf if real else np.iinfo(np.int64).max) * (1 if how == "min" else -1)
            v = c.cast(ARROW["double" if real else "long"]).fill_null(0 if how == "sum" else far).to_numpy(zero_copy_only=False)
            known = f.roll(c.is_valid().to_numpy().astype(np.int64), np.add) > 0
            out[n] = pa.array(f.roll(v, ufunc[how])[some], mask=~known[some])
        return out

    wide = {n: ("double" if kinds[n] in ("double", "float") else "long") if how == "sum" else kinds[n] for n, how in merge.items()}
    return by_tree(rows, run, ", ".join(["image_id long", "node_id long", *[f"{n} {t}" for n, t in wide.items()]]))


def _marked(nodes: DataFrame, keep: Column, *columns) -> DataFrame:
    return _bare(nodes, *columns, F.coalesce(keep, F.lit(False)).alias("_keep"))


def nearest(nodes: DataFrame, keep: Column, keys: list[str] = ["image_id"]) -> DataFrame:
    """(keys, node_id, anc, dist, level, above): the nearest kept node upwards, itself included, the steps to it and its
    level, and the nearest kept one that is not the node itself (null: none). Roots are always kept, nodes for which
    ``keep`` is null are not."""

    def run(f: Forest) -> dict:
        at = f.nearest(f["_keep"].astype(bool))
        above = np.where(f.up >= 0, at[f.up], 0)
        return {"node_id": f.id, "anc": f.id[at], "dist": f.depth - f.depth[at], "level": f["level"][at], "above": pa.array(f.id[above], mask=f.up < 0)}

    rows = _marked(nodes, keep, "level", *[c for c in keys if c != "image_id"])
    return by_tree(rows, run, ", ".join([*[f"{c} {'long' if c == 'image_id' else dict(nodes.dtypes)[c]}" for c in keys], "node_id long, anc long, dist int, level int, above long"]), keys)


def filter_direct(nodes: DataFrame, keep: Column) -> DataFrame:
    """(image_id, node_id, level) with the level of the nearest kept ancestor-or-self; the root is always kept."""
    return nearest(nodes, keep).select("image_id", "node_id", "level")


def _pruned(nodes: DataFrame, keep: Column, alive: Callable[[Forest, np.ndarray], np.ndarray]) -> DataFrame:
    def run(f: Forest) -> dict:
        at = f.nearest(alive(f, f["_keep"].astype(bool) | (f.up < 0)))
        return {"node_id": f.id, "level": f["level"][at]}

    return by_tree(_marked(nodes, keep, "level"), run, "image_id long, node_id long, level int")


def filter_min(nodes: DataFrame, keep: Column) -> DataFrame:
    """A failing node takes its subtree with it: kept if all ancestors-or-self pass (the root counts as passing)."""

    def alive(f: Forest, ok: np.ndarray) -> np.ndarray:
        for n, u in f.down():
            ok[n] &= ok[u]
        return ok

    return _pruned(nodes, keep, alive)


def filter_max(nodes: DataFrame, keep: Column) -> DataFrame:
    """A node stays if it or any descendant passes; the root stays."""
    return _pruned(nodes, keep, lambda f, ok: f.roll(ok, np.logical_or))


def area_filter_mean(pmap: DataFrame, nodes: DataFrame, px: DataFrame, area: int) -> DataFrame:
    """Pixels of nodes of at least ``area`` keep their values; others take the truncated mean of the own pixels of the
    nearest such ancestor (the root else)."""
    mean = proper(pmap, px, {"s": F.sum("v"), "n": F.count("v")}).select("image_id", F.col("node_id").alias("anc"), F.floor(F.col("s") / F.col("n")).cast("int").alias("m"))
    near = nearest(nodes, F.col("area") >= area).select("image_id", "node_id", "anc", "dist").join(mean, ["image_id", "anc"])
    return pmap.select(*K, "node_id").join(px.select(*K, "v"), K).join(near, ["image_id", "node_id"]).select(*K, F.when(F.col("dist") == 0, F.col("v")).otherwise(F.col("m")).alias("v"))


def cut(nodes: DataFrame, criterion: Column) -> DataFrame:
    """A node takes its parent's value while its parent fulfils the criterion."""

    def run(f: Forest) -> dict:
        c = f["_keep"].astype(bool)
        at = f.nearest(~((f.up >= 0) & c[f.up]))
        return {"node_id": f.id, "level": f["level"][at]}

    return by_tree(_marked(nodes, criterion, "level"), run, "image_id long, node_id long, level int")


def reconstruct(pmap: DataFrame, values: DataFrame, value: str = "level") -> DataFrame:
    """out(p) = value of node(p)."""
    return pmap.select(*K, "node_id").join(values.select("image_id", "node_id", value), ["image_id", "node_id"]).select(*K, F.col(value).alias("v"))


def parents_after(nodes: DataFrame, kept: Column) -> DataFrame:
    """Kept nodes re-attached to their nearest kept proper ancestor: (image_id, node_id, parent_id)."""
    return nearest(nodes, kept).where("dist = 0").select("image_id", "node_id", F.col("above").alias("parent_id"))


def children(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent_id is not null").select("image_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("child_id"))


def neighbours(nodes: DataFrame) -> DataFrame:
    """The tree as an image: a node's neighbours are its parent and its children."""
    up = nodes.where("parent_id is not null").select("image_id", "node_id", F.col("parent_id").alias("near_id"))
    return up.unionByName(up.select("image_id", F.col("near_id").alias("node_id"), F.col("node_id").alias("near_id")))


def subtree(up: DataFrame, root: Column) -> DataFrame:
    """Rows of the closure below one node."""
    return up.where(F.col("anc") == root).select("image_id", "anc", "node_id", "dist")


def _pairs(f: Forest, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs of a and b, and their least common ancestors; without those that have none."""
    both = np.unique(np.stack([f.at(rows.column("a")), f.at(rows.column("b"))]), axis=1)
    top = f.lca(*both)
    return both[0][top >= 0], both[1][top >= 0], top[top >= 0]


def lca(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Least common ancestors of pairs (image_id, a, b): (…, lca, da, db) with the steps from both ends. Pairs that
    repeat give one row; those with a null, with what is no node, or of two trees give none."""

    def run(f: Forest, rows: pa.Table) -> dict:
        a, b, top = _pairs(f, rows)
        return {"a": f.id[a], "b": f.id[b], "lca": f.id[top], "da": f.depth[a] - f.depth[top], "db": f.depth[b] - f.depth[top]}

    return with_tree(_bare(nodes), pairs.select("image_id", "a", "b"), run, "image_id long, a long, b long, lca long, da int, db int")


def paths(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(image_id, a, b, inside, node_id): the nodes that hold one pixel only of two, one of a and one of b: those from a
    (``inside``) and from b up to below their least common ancestor. Pairs as in ``lca``."""

    def run(f: Forest, rows: pa.Table) -> dict:
        a, b, top = _pairs(f, rows)
        out = {c: [np.zeros(0, np.int64)] for c in ("a", "b", "inside", "node_id")}
        for inside, start in ((1, a), (0, b)):
            which, at = np.arange(len(a)), start
            while len(which):
                on = at != top[which]
                which, at = which[on], at[on]
                for c, v in (("a", f.id[a[which]]), ("b", f.id[b[which]]), ("inside", np.full(len(at), inside)), ("node_id", f.id[at])):
                    out[c].append(v)
                at = f.up[at]
        return {c: np.concatenate(v) for c, v in out.items()}

    got = with_tree(_bare(nodes), pairs.select("image_id", "a", "b"), run, "image_id long, a long, b long, inside int, node_id long")
    return got.withColumn("inside", F.col("inside") == 1)


def preorder(nodes: DataFrame) -> DataFrame:
    """(image_id, node_id, n): numbers by which the nodes of a subtree follow one another."""
    return by_tree(_bare(nodes), lambda f: {"node_id": f.id, "n": f.preorder()}, "image_id long, node_id long, n long")


def smallest_enclosing(pmap_a: DataFrame, pmap_b: DataFrame, nodes_a: DataFrame, nodes_b: DataFrame) -> DataFrame:
    """For each node of tree A the smallest node of tree B that holds all its pixels: the least common ancestor in B of
    the first and the last of their nodes in B's preorder."""
    number = preorder(nodes_b)
    px = pmap_b.select(*K, "node_id").join(number, ["image_id", "node_id"]).select(*K, F.col("n").alias("v"))
    ends = rolled_up(pmap_a, px, {"lo": (F.min("v"), "min"), "hi": (F.max("v"), "max")}, nodes_a)
    name = lambda end, to: number.select("image_id", F.col("n").alias(end), F.col("node_id").alias(to))
    named = ends.join(name("lo", "a"), ["image_id", "lo"]).join(name("hi", "b"), ["image_id", "hi"])
    return named.join(lca(nodes_b, named), ["image_id", "a", "b"]).select("image_id", "node_id", F.col("lca").alias("other_id"))


def on_contour(pmap: DataFrame, nodes: DataFrame, edge_value: DataFrame) -> DataFrame:
    """(image_id, node_id, s, n): for every grid edge, its value is added to all nodes that hold one end only: counted at
    both ends, taken off twice where they meet, and summed up the tree. ``edge_value``: (image_id, y, x, qy, qx, e)."""
    m = pmap.select(*K, "node_id")
    e = edge_value.join(m.withColumnRenamed("node_id", "a"), K).join(m.select("image_id", F.col("y").alias("qy"), F.col("x").alias("qx"), F.col("node_id").alias("b")), ["image_id", "qy", "qx"])
    e = e.where("a <> b").groupBy("image_id", "a", "b").agg(F.sum("e").alias("s"), F.count("*").alias("n"))  # edges between the same nodes at once
    kind = dict(e.dtypes)["s"]

    def run(f: Forest, rows: pa.Table) -> dict:
        a, b = f.at(rows.column("a")), f.at(rows.column("b"))
        top = f.lca(a, b)
        out = {}
        for c in "sn":
            w = np.where(top >= 0, rows.column(c).fill_null(0).to_numpy(zero_copy_only=False), 0)
            own = np.zeros(len(f), w.dtype)
            for at, times in ((a, 1), (b, 1), (top, -2)):
                np.add.at(own, at[top >= 0], times * w[top >= 0])
            out[c] = f.roll(own, np.add)
        some = out["n"] > 0
        return {"node_id": f.id[some], "s": out["s"][some], "n": out["n"][some]}

    return with_tree(_bare(nodes), e, run, f"image_id long, node_id long, s {kind}, n long")


def heights(nodes: DataFrame) -> DataFrame:
    """Summed level differences from each node up to the root: (image_id, node_id, height)."""
    return by_tree(_bare(nodes, "level"), lambda f: {"node_id": f.id, "height": _heights(f)}, "image_id long, node_id long, height long")


def _heights(f: Forest) -> np.ndarray:
    level = f["level"].astype(np.int64)
    out = np.zeros(len(f), np.int64)
    for n, u in f.down():
        out[n] = out[u] + np.abs(level[n] - level[u])
    return out


def mser(nodes: DataFrame, eps: int, kind: str = "diff", relative: bool = False) -> DataFrame:
    """Stability of nodes under a change of ``eps`` levels: A+ is the area of the first ancestor-or-self that far (the
    root else), A- the largest area of nodes that reach this one so; difference, ratio or norm. ``relative``: far by the
    level differences summed up along the way, not by that of the ends."""

    def run(f: Forest) -> dict:
        hit = f.first_far(_heights(f) if relative else f["level"].astype(np.int64), eps)
        area = f["area"].astype(np.int64)
        plus, minus = area[hit], np.zeros(len(f), np.int64)
        np.maximum.at(minus, hit, area)
        value = {"diff": lambda: plus - minus, "ratio": lambda: area / plus, "norm": lambda: (plus - minus) / area}[kind]()
        return {"node_id": f.id, "mser": value.astype(float)}

    return by_tree(_bare(nodes, "level", "area"), run, "image_id long, node_id long, mser double")


def alpha_tree(px: DataFrame, nb: str = "c4") -> DataFrame:
    """(image_id, node_id, parent_id, alpha): leaves are pixels by flat index; merges at one distance share a node."""

    def run(g: Grid):
        t = k.alpha_tree(g["v"], g.mask, k.NEIGHBOURS[nb])
        return g.rows(node_id=[r[0] for r in t], parent_id=[None if r[1] < 0 else r[1] for r in t], alpha=[int(r[2]) for r in t])

    return per_image(px, run, "image_id long, node_id long, parent_id long, alpha int")


def alpha_cut(px: DataFrame, bound: float, nb: str = "c4") -> DataFrame:
    """Cut of the α-tree by extent: a pixel's zone is the highest node above it whose values all lie less than ``bound``
    apart; a pixel that has none such above it is its own zone. Zones are numbered in scan order."""

    def run(g: Grid):
        rows = k.alpha_tree(g["v"], g.mask, k.NEIGHBOURS[nb])
        zone = k.cut_by_extent({r[0]: r[1] for r in rows}, g["v"].ravel(), bound)
        names: dict[int, int] = {}
        lab = np.zeros(g.mask.size, np.int64)
        for i in np.nonzero(g.mask.ravel())[0].tolist():
            lab[i] = names.setdefault(zone[i], len(names) + 1)
        return g.pixels(label=lab.reshape(g.mask.shape))

    return per_image(px, run, "image_id long, y int, x int, label long")


def alpha_zones(px: DataFrame, alpha: int, nb: str = "c4") -> DataFrame:
    """Partition at one level of the α-tree: zones linked by steps of at most ``alpha``, numbered in scan order."""

    def run(g: Grid):
        p, q = k.edges(g.mask, k.NEIGHBOURS[nb])
        f = g["v"].ravel()
        near = np.abs(f[p] - f[q]) <= alpha
        up = list(range(f.size))
        for a, b in zip(p[near].tolist(), q[near].tolist()):
            a, b = k.find(up, a), k.find(up, b)
            if a != b:
                up[max(a, b)] = min(a, b)
        names: dict[int, int] = {}
        lab = np.zeros(f.size, np.int64)
        for i in np.nonzero(g.mask.ravel())[0].tolist():
            lab[i] = names.setdefault(k.find(up, i), len(names) + 1)
        return g.pixels(label=lab.reshape(g.mask.shape))

    return per_image(px, run, "image_id long, y int, x int, label long")


def simplify_energy(px: DataFrame, scale: float, kind: str = "tos") -> DataFrame:
    """Mumford-Shah simplification on the tree: nodes by falling contour gradient merge into their canonical parent if
    that lowers squared error plus ``scale`` times contour length; pixels take the mean of what they end in, truncated."""

    def run(g: Grid):
        v = g["v"]
        node, ids, ups, _ = _build(g, kind, k.C4)
        at = dict(zip(ids.tolist(), ups.tolist()))
        depth: dict[int, int] = {}
        for i, u in at.items():
            depth[i] = 0 if u < 0 else depth[u] + 1
        length, grad = dict.fromkeys(at, 0), dict.fromkeys(at, 0.0)
        f = v.ravel()
        for p, q in zip(*(e.tolist() for e in k.edges(g.mask, k.C4))):
            a, b = int(node[p]), int(node[q])
            while a != b:
                if depth[a] < depth[b]:
                    a, b = b, a
                length[a] += 1
                grad[a] += abs(float(f[p] - f[q]))
                a = at[a]
        n, s, s2 = dict.fromkeys(at, 0), dict.fromkeys(at, 0.0), dict.fromkeys(at, 0.0)
        for p in np.nonzero(node >= 0)[0].tolist():
            i, x = int(node[p]), float(f[p])
            n[i] += 1
            s[i] += x
            s2[i] += x * x
        into = {i: i for i in at}
        contour = dict(length)
        sse = lambda c, t, t2: t2 - t * t / c if c else 0.0
        for i in sorted((i for i in at if at[i] >= 0), key=lambda i: (-grad[i] / max(1, length[i]), i)):
            r, u = k.find(into, i), k.find(into, at[i])
            if r == u:
                continue
            joined = sse(n[r] + n[u], s[r] + s[u], s2[r] + s2[u])
            if joined - sse(n[r], s[r], s2[r]) - sse(n[u], s[u], s2[u]) < scale * contour[i]:
                into[r] = u
                n[u] += n[r]
                s[u] += s[r]
                s2[u] += s2[r]
        out = np.array([int(s[r] // n[r]) if (i >= 0 and n[r := k.find(into, int(i))]) else 0 for i in node]).reshape(v.shape)
        return g.pixels(v=out)

    return per_image(px, run, "image_id long, y int, x int, v int")
