"""Attributes and filters on trees of nodes, multivariate trees of shapes and what is segmented with them.

Node attributes are joins on ``nodes`` and ``pmap`` and walks over the nodes. What depends on an order of nodes (filters on the
tree as a graph, greedy detection, merging shapes of several trees) runs by image over numpy arrays.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import kernels as k
from tessera.operators import neighbours as nb
from tessera.operators import trees
from tessera.operators.forest import Forest, by_tree, with_tree
from tessera.operators.rasterwise import Grid, per_image
from tessera.sources.rasters import K

SITE = "image_id long, y int, x int"


def gradient_magnitude(px: DataFrame, pmap: DataFrame, nodes: DataFrame, levels: int) -> DataFrame:
    """1 less the mean contrast along each node's contour, contrast as a share of ``levels`` - 1; 1 for the root."""
    e = nb.edges(px).select(*K, "qy", "qx", (1 - F.abs(F.col("v") - F.col("q_v")) / (levels - 1)).alias("e"))
    got = trees.on_contour(pmap, nodes, e).select("image_id", "node_id", (F.col("s") / F.col("n")).alias("a"))
    return nodes.select("image_id", "node_id").join(got, ["image_id", "node_id"], "left").fillna(1.0, ["a"])


def pattern_spectrum(nodes: DataFrame, attribute: DataFrame, step: float = 0.1) -> DataFrame:
    """How much area lies in nodes of each step of the attribute: (image_id, bin, n, area)."""
    own = nodes.join(attribute, ["image_id", "node_id"])
    return own.groupBy("image_id", F.floor(F.col("a") / step + 1e-9).alias("bin")).agg(F.count("*").alias("n"), F.sum("area").alias("area"))


def mean_on_nodes(px: DataFrame, pmap: DataFrame, nodes: DataFrame, whole: bool = True) -> DataFrame:
    """Pixels take the truncated mean of their node's component (``whole``) or of its own pixels."""
    if whole:
        t = trees.rolled_up(pmap, px, {"s": (F.sum("v"), "sum"), "n": (F.count("v"), "sum")}, nodes)
    else:
        t = trees.proper(pmap, px, {"s": F.sum("v"), "n": F.count("v")})
    return trees.reconstruct(pmap, t.withColumn("m", F.floor(F.col("s") / F.col("n")).cast("int")), "m")


def regional_energy(px: DataFrame, pmap: DataFrame, nodes: DataFrame, radius: int = 1) -> DataFrame:
    """Meaningfulness: variance inside, outside and over both of a band of ``radius`` pixels along each node's contour.
    Inside: pixels of the node whose ball leaves it; outside: others whose ball meets it. One row of a ball's pair is
    first brought to pairs of a pixel and a node."""
    m = pmap.select(*K, "node_id").join(px.select(*K, "v"), K)
    ball = tuple(o for o in nb.ball(radius) if o != (0, 0))
    far = nb.scatter(m.select(*K, F.col("node_id").alias("b")), ball, ["b"]).select(*K, "b")
    pairs = m.select(*K, "v", F.col("node_id").alias("a")).join(far, K).where("a <> b").select(*K, "v", "a", "b").distinct()
    path = trees.paths(nodes, pairs.select("image_id", "a", "b").distinct())
    both = pairs.join(path, ["image_id", "a", "b"]).select(*K, "v", "node_id", "inside").distinct()
    var = lambda c: F.coalesce(F.var_pop(F.when(c, F.col("v"))), F.lit(0.0))
    return both.groupBy("image_id", "node_id").agg(var(F.col("inside")).alias("internal"), var(~F.col("inside")).alias("external"), F.var_pop("v").alias("total"))


def coverage(labels: DataFrame, pmap: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each label of (image_id, y, x, label) the best Jaccard index of its pixels with a node's. Counts of a label
    and a node go up the tree, those that meet in a node are summed up. Pixels that no node holds only count as the
    label's; labels without any other give no row."""
    cell = labels.join(pmap.select(*K, "node_id"), K).groupBy("image_id", "label", "node_id").agg(F.count("*").alias("n"))
    size = labels.groupBy("image_id", "label").agg(F.count("*").alias("size"))
    rows = cell.join(size, ["image_id", "label"]).withColumn("label", F.col("label").cast("long"))

    def run(f: Forest, r: pa.Table) -> dict:
        names, of = np.unique(r.column("label").to_numpy(zero_copy_only=False), return_inverse=True)
        sizes, n, at = (r.column("size").to_numpy(zero_copy_only=False), r.column("n").to_numpy(zero_copy_only=False), f.at(r.column("node_id")))
        total, best, area = np.zeros(len(names), np.int64), np.zeros(len(names)), f["area"].astype(np.int64)
        total[of] = sizes
        own = np.where(at >= 0, f.depth[at], -1)
        label, node, count = (np.zeros(0, np.int64),) * 3
        for d in range(len(f.layers) - 1, -1, -1):
            here = own == d
            key, back = np.unique(np.r_[label, of[here]] * len(f) + np.r_[node, at[here]], return_inverse=True)
            if not len(key):
                continue
            count = np.bincount(back, np.r_[count, n[here]]).astype(np.int64)
            label, node = np.divmod(key, len(f))
            np.maximum.at(best, label, count / (total[label] + area[node] - count))
            keep = f.up[node] >= 0
            label, node, count = label[keep], f.up[node[keep]], count[keep]
        return {"label": names, "jaccard": best}

    return with_tree(nodes.select("image_id", "node_id", "parent_id", "area"), rows, run, "image_id long, label long, jaccard double")


def thicken(pmap: DataFrame, nodes: DataFrame) -> DataFrame:
    """Keeps level lines that don't touch, from the leaves up: (image_id, node_id, depth), the depth of the nearest kept
    node upwards. A line reaches up to the least depth on its inside and the pixels beside it by four neighbours; a node
    goes if it is deeper than what a kept line inside it, below no other kept one, reaches. The root stays."""
    p = pmap.select(*K, "node_id", "depth")
    beside = nb.scatter(p, nb.C4, ["depth"]).groupBy(*K).agg(F.min("depth").alias("_near"))
    reach = p.join(beside, K, "left").groupBy("image_id", "node_id").agg(F.min(F.least("depth", "_near")).alias("reach"))

    def run(f: Forest) -> dict:
        line = f.roll(f["reach"].astype(np.int64), np.minimum)
        bound = np.full(len(f), np.iinfo(np.int64).max)
        for n in reversed(f.layers):
            kept, u = f.depth[n] <= bound[n], f.up[n]
            up = u >= 0
            np.minimum.at(bound, u[up], np.where(kept, line[n], bound[n])[up])
        at = f.nearest(f.depth <= bound)
        return {"node_id": f.id, "depth": f.depth[at]}

    return by_tree(nodes.select("image_id", "node_id", "parent_id").join(reach, ["image_id", "node_id"]), run, "image_id long, node_id long, depth int")


class Tree:
    """A component tree by image for kernels: ids parents first, parent, level, own pixels, area, depth, children."""

    def __init__(self, g: Grid, kind: str = "tos", column: str = "v"):
        v = g[column]
        if kind == "tos":
            parent, level = k.tree_of_shapes(v)
        else:
            parent, level = k.max_tree(v, g.mask, k.C4, 1 if kind == "max" else -1), v.ravel()
        self.node, ids, ups = k.tree_tables(parent, level)
        self.ids, self.up = ids.tolist(), dict(zip(ids.tolist(), ups.tolist()))
        self.level = {i: int(level[i]) for i in self.ids}
        self.area = k.areas(self.node, ids, ups)
        self.kids: dict[int, list[int]] = {i: [] for i in self.ids}
        self.depth: dict[int, int] = {}
        for i in self.ids:
            u = self.up[i]
            self.depth[i] = 0 if u < 0 else self.depth[u] + 1
            if u >= 0:
                self.kids[u].append(i)
        self.root = self.ids[0]

    def lca(self, a: int, b: int) -> int:
        while a != b:
            if self.depth[a] < self.depth[b]:
                a, b = b, a
            a = self.up[a]
        return a

    def near(self, i: int) -> list[int]:
        return ([self.up[i]] if self.up[i] >= 0 else []) + self.kids[i]

    def contour(self, f: np.ndarray, mask: np.ndarray) -> dict[int, tuple[int, float]]:
        """Edges and their summed contrast on each node's contour."""
        out = {i: (0, 0.0) for i in self.ids}
        flat = f.ravel()
        for p, q in zip(*(e.tolist() for e in k.edges(mask, k.C4))):
            a, b = int(self.node[p]), int(self.node[q])
            c = abs(float(flat[p]) - float(flat[q]))
            while a != b:
                if self.depth[a] < self.depth[b]:
                    a, b = b, a
                out[a] = (out[a][0] + 1, out[a][1] + c)
                a = self.up[a]
        return out

    def paint(self, value: dict[int, float]) -> np.ndarray:
        return np.array([value[int(n)] if n >= 0 else 0 for n in self.node])

    def kept_level(self, keep: Callable[[int], bool]) -> dict[int, int]:
        out: dict[int, int] = {}
        for i in self.ids:
            out[i] = self.level[i] if self.up[i] < 0 or keep(i) else out[self.up[i]]
        return out


def tree_extinction(t: Tree, a: dict[int, float]) -> dict[int, float]:
    """Dynamics of the attribute's minima on the tree as a graph; 0 elsewhere. Ties go to the node listed first."""
    rank = {i: n for n, i in enumerate(t.ids)}
    order = sorted(t.ids, key=lambda i: (a[i], rank[i]))
    up: dict[int, int] = {}
    low: dict[int, int] = {}
    out = dict.fromkeys(t.ids, 0.0)

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x in order:
        up[x] = low[x] = x
        for n in t.near(x):
            if n in up:
                p, q = find(x), find(n)
                if p != q:
                    one, two = low[p], low[q]
                    if (a[one], rank[one]) > (a[two], rank[two]):
                        one, two = two, one
                    out[two] = abs(a[x] - a[two])
                    up[p] = q
                    low[q] = one
    out[low[find(order[0])]] = abs(a[order[-1]] - a[order[0]])
    return out


def close_attribute(t: Tree, a: dict[int, float], least: int) -> tuple[dict[int, float], set[int]]:
    """Area closing of an attribute on the tree as a graph: minima of fewer than ``least`` nodes are filled; returns the
    closed attribute and the nodes that are still the bottom of a minimum."""
    rank = {i: n for n, i in enumerate(t.ids)}
    order = sorted(t.ids, key=lambda i: (a[i], rank[i]))
    par: dict[int, int] = {}
    zpar: dict[int, int] = {}
    size: dict[int, int] = {}
    bottom: dict[int, int] = {}

    def find(x: int) -> int:
        while zpar[x] != x:
            zpar[x] = zpar[zpar[x]]
            x = zpar[x]
        return x

    for x in order:
        par[x] = zpar[x] = bottom[x] = x
        size[x] = 1
        for n in t.near(x):
            if n in zpar:
                y = find(n)
                if y != x:
                    par[y] = zpar[y] = x
                    size[x] += size[y]
                    if (a[bottom[y]], rank[bottom[y]]) < (a[bottom[x]], rank[bottom[x]]):
                        bottom[x] = bottom[y]
    closed = dict(a)
    for x in reversed(order):
        if size[x] < least and par[x] != x:
            closed[x], bottom[x] = closed[par[x]], bottom[par[x]]
    return closed, {x for x in t.ids if bottom[x] == x}


def _energy(t: Tree, f: np.ndarray, mask: np.ndarray, length_weight: float) -> dict[int, float]:
    """Squared error left by a node and the band around it against both together, plus ``length_weight`` over its contour's length."""
    flat = f.ravel().astype(float)
    near = k.adjacency(mask, k.C4)
    sums = {i: np.zeros(6) for i in t.ids}
    for p in np.nonzero(t.node >= 0)[0].tolist():
        seen: set[int] = set()
        for q in near[p]:
            b = int(t.node[q])
            top = t.lca(int(t.node[p]), b)
            n = int(t.node[p])
            while n != top:
                seen.add(n)
                n = t.up[n]
            while b != top:
                seen.add(-b - 1)
                b = t.up[b]
        x = flat[p]
        for n in seen:
            (sums[n] if n >= 0 else sums[-n - 1])[[0, 1, 2] if n >= 0 else [3, 4, 5]] += (1, x, x * x)
    sse = lambda n, s, s2: s2 - s * s / n if n else 0.0
    out, contour = {}, t.contour(f, mask)
    for i in t.ids:
        s = sums[i]
        both = sse(s[0] + s[3], s[1] + s[4], s[2] + s[5])
        parts = sse(*s[:3]) + sse(*s[3:])
        out[i] = (parts / both if both > 1e-12 else 0.0) + (length_weight / contour[i][0] if contour[i][0] else 0.0)
    return out


def shape_energy(px: DataFrame, length_weight: float = 1.0) -> DataFrame:
    """Energy of every node of the tree of shapes: (image_id, node_id, energy)."""

    def run(g: Grid):
        t = Tree(g)
        e = _energy(t, g["v"], g.mask, length_weight)
        return g.rows(node_id=t.ids, energy=[e[i] for i in t.ids])

    return per_image(px, run, "image_id long, node_id long, energy double")


def shape_extinction(px: DataFrame, length_weight: float = 1.0) -> DataFrame:
    """Extinction values of the energy's minima among shapes: (image_id, node_id, extinction)."""

    def run(g: Grid):
        t = Tree(g)
        x = tree_extinction(t, _energy(t, g["v"], g.mask, length_weight))
        return g.rows(node_id=t.ids, extinction=[float(x[i]) for i in t.ids])

    return per_image(px, run, "image_id long, node_id long, extinction double")


def detect_objects(px: DataFrame, least: int = 3, length_weight: float = 1.0) -> DataFrame:
    """Keeps the shapes that are bottoms of minima of the closed energy; pixels take the level of the nearest kept one."""

    def run(g: Grid):
        t = Tree(g)
        _, keep = close_attribute(t, _energy(t, g["v"], g.mask, length_weight), least)
        return g.pixels(v=t.paint(t.kept_level(lambda i: i in keep)).reshape(g.mask.shape))

    return per_image(px, run, f"{SITE}, v int")


def simplify_bottom_up(px: DataFrame, radius: int = 1, area: int = 4, factor: float = 0.5) -> DataFrame:
    """From the leaves: a node switches off those between it and the smallest shape that holds it with a band of
    ``radius`` around, as long as their area times ``factor`` is below its own; nodes smaller than ``area`` go, too."""

    def run(g: Grid):
        t = Tree(g)
        near = k.adjacency(g.mask, tuple(o for o in nb.ball(radius) if o != (0, 0)))
        enc = {i: i for i in t.ids}
        for p in np.nonzero(t.node >= 0)[0].tolist():  # the smallest node that holds each pixel's ball
            own = int(t.node[p])
            top = own
            for q in near[p]:
                top = t.lca(top, int(t.node[q]))
            enc[own] = t.lca(enc[own], top)
        for i in reversed(t.ids):
            if t.up[i] >= 0:
                enc[t.up[i]] = t.lca(enc[t.up[i]], enc[i])
        active = {i: t.area[i] >= area for i in t.ids}
        for i in reversed(t.ids):
            if t.up[i] < 0 or not active[i] or enc[i] == i:
                continue
            p = t.up[i]
            while p != enc[i] and p >= 0 and t.area[p] * factor < t.area[i]:
                active[p] = False
                p = t.up[p]
        return g.pixels(v=t.paint(t.kept_level(lambda i: active[i])).reshape(g.mask.shape))

    return per_image(px, run, f"{SITE}, v int")


def simplify_top_down(px: DataFrame, step: int = 2) -> DataFrame:
    """From the root: a node stays if its level is at least ``step`` away from the nearest kept one above."""

    def run(g: Grid):
        t = Tree(g)
        last: dict[int, int] = {}
        for i in t.ids:
            u = t.up[i]
            last[i] = t.level[i] if u < 0 or abs(t.level[i] - last[u]) >= step else last[u]
        return g.pixels(v=t.paint(last).reshape(g.mask.shape))

    return per_image(px, run, f"{SITE}, v int")


def _shapes_of(t: Tree, size: int) -> dict[int, frozenset[int]]:
    own: dict[int, set[int]] = {i: set() for i in t.ids}
    for p in range(size):
        if t.node[p] >= 0:
            own[int(t.node[p])].add(p)
    for i in reversed(t.ids):
        if t.up[i] >= 0:
            own[t.up[i]] |= own[i]
    return {i: frozenset(s) for i, s in own.items()}


def graph_of_shapes(g: Grid, channels: list[str]) -> tuple[list[frozenset[int]], list[tuple[int, int]]]:
    """Shapes of several channels' trees, equal ones once, by falling size; and the covering pairs (below, above) of inclusion."""
    found: set[frozenset[int]] = set()
    for c in channels:
        found |= set(_shapes_of(Tree(g, "tos", c), g.mask.size).values())
    shapes = sorted(found, key=lambda s: (-len(s), sorted(s)))
    covers: list[tuple[int, int]] = []
    for i, s in enumerate(shapes):
        above = [j for j in range(i) if len(shapes[j]) > len(s) and s < shapes[j]]
        for j in above:
            if not any(shapes[m] < shapes[j] for m in above if m != j):
                covers.append((i, j))
    return shapes, covers


def _depth_image(g: Grid, channels: list[str]) -> np.ndarray:
    shapes, covers = graph_of_shapes(g, channels)
    depth = [0] * len(shapes)
    for i, j in covers:  # shapes above come first
        depth[i] = max(depth[i], depth[j] + 1)
    out = np.zeros(g.mask.size, int)
    for s, d in zip(shapes, depth):
        for p in s:
            out[p] = max(out[p], d)
    return out.reshape(g.mask.shape)


def shape_graph(px: DataFrame, channels: list[str] = ["r", "g", "b"]) -> DataFrame:
    """Covering pairs of the graph of shapes: (image_id, below, above, size), shapes numbered by falling size."""

    def run(g: Grid):
        shapes, covers = graph_of_shapes(g, channels)
        return g.rows(below=[c[0] for c in covers], above=[c[1] for c in covers], size=[len(shapes[c[0]]) for c in covers])

    return per_image(px, run, "image_id long, below long, above long, size long", channels)


def depth_image(px: DataFrame, channels: list[str] = ["r", "g", "b"]) -> DataFrame:
    """Each pixel's longest chain of shapes over all channels."""
    return per_image(px, lambda g: g.pixels(v=_depth_image(g, channels)), f"{SITE}, v int", channels)


def multivariate_tree(px: DataFrame, channels: list[str] = ["r", "g", "b"]) -> DataFrame:
    """The multivariate tree of shapes: the max-tree of the depth image with holes filled, as node_map: (image_id, y, x, node_id, parent_id, level, area, depth)."""

    def run(g: Grid):
        g.data["v"] = _depth_image(g, channels)
        t = Tree(g, "max")
        sets = _shapes_of(t, g.mask.size)
        filled = np.zeros(g.mask.size, int)
        for i in t.ids:  # saturated, parents first
            on = np.zeros(g.mask.size, bool)
            on[list(sets[i])] = True
            s = k.saturate(on.reshape(g.mask.shape), g.mask, k.C8).ravel()
            filled[s] = np.maximum(filled[s], t.level[i])
        g.data["v"] = filled.reshape(g.mask.shape)
        t = Tree(g, "max")
        n = [int(x) for x in t.node[g.mask.ravel()]]
        y, x = np.nonzero(g.mask)
        return g.rows(y=y + g.y0, x=x + g.x0, node_id=n, parent_id=[None if t.up[i] < 0 else t.up[i] for i in n], level=[t.level[i] for i in n], area=[t.area[i] for i in n], depth=[t.depth[i] for i in n])

    return per_image(px, run, "image_id long, y int, x int, node_id long, parent_id long, level int, area long, depth int", channels)


def marginal_grain_filter(px: DataFrame, area: int, channels: list[str] = ["r", "g", "b"]) -> DataFrame:
    """The grain filter of each channel by itself."""

    def run(g: Grid):
        out = {}
        for c in channels:
            t = Tree(g, "tos", c)
            out[c] = t.paint(t.kept_level(lambda i: t.area[i] >= area)).reshape(g.mask.shape)  # noqa: B023
        return g.pixels(**out)

    return per_image(px, run, f"{SITE}, " + ", ".join(f"{c} int" for c in channels), channels)


def marginal_area_by_gradient(px: DataFrame, channels: list[str] = ["r", "g", "b"]) -> DataFrame:
    """Each pixel's area of its node in the channel whose 3x3 gradient is largest there; ties to the first channel."""

    def run(g: Grid):
        area, grad = [], []
        for c in channels:
            t = Tree(g, "tos", c)
            area.append(t.paint(t.area).reshape(g.mask.shape))
            f = np.pad(g[c], 1, mode="edge")
            win = np.stack([f[a : a + g[c].shape[0], b : b + g[c].shape[1]] for a in range(3) for b in range(3)])
            grad.append(win.max(0) - win.min(0))
        best = np.argmax(np.stack(grad), 0)
        return g.pixels(v=np.take_along_axis(np.stack(area), best[None], 0)[0])

    return per_image(px, run, f"{SITE}, v int", channels)


def hierarchical_segmentation(px: DataFrame) -> DataFrame:
    """px(v, mark), v a saliency map: marks go up the min-tree where all marks below agree, then down to unmarked nodes
    from the nearest marked ancestor; 0 where none is."""

    def run(g: Grid):
        t = Tree(g, "min")
        mine: dict[int, set[int]] = {i: set() for i in t.ids}
        for n, m in zip(t.node.tolist(), g["mark"].ravel().tolist()):
            if n >= 0 and m > 0:
                mine[n].add(int(m))
        for i in reversed(t.ids):
            if t.up[i] >= 0:
                mine[t.up[i]] |= mine[i]
        tag: dict[int, int] = {}
        for i in t.ids:
            tag[i] = next(iter(mine[i])) if len(mine[i]) == 1 else tag[t.up[i]] if not mine[i] and t.up[i] >= 0 else 0
        return g.pixels(label=t.paint(tag).reshape(g.mask.shape))

    return per_image(px, run, f"{SITE}, label int", ["v", "mark"])


def path_region(px: DataFrame, start: tuple[int, int], goal: tuple[int, int]) -> DataFrame:
    """Region of interest between two pixels: the nodes on the tree path between them, dilated by 3x3, less the path itself.
    An image that lacks one of the pixels has no path: its region is empty."""

    def run(g: Grid):
        h, w = g.mask.shape
        ends = [(p[0] - g.y0, p[1] - g.x0) for p in (start, goal)]
        if not all(0 <= y < h and 0 <= x < w and g.mask[y, x] for y, x in ends):
            return g.pixels(v=np.zeros((h, w), bool))
        t = Tree(g)
        a, b = (int(t.node[y * w + x]) for y, x in ends)
        top, on = t.lca(a, b), {t.lca(a, b)}
        for n in (a, b):
            while n != top:
                on.add(n)
                n = t.up[n]
        path = np.isin(t.node, list(on)).reshape(g.mask.shape)
        f = np.pad(path, 1)
        wide = np.stack([f[i : i + path.shape[0], j : j + path.shape[1]] for i in range(3) for j in range(3)]).any(0)
        return g.pixels(v=(wide & g.mask) ^ path)

    return per_image(px, run, f"{SITE}, v boolean")


def superpixel_graph(labels: DataFrame, px: DataFrame) -> DataFrame:
    """Edges (image_id, a < b, w) of adjacent superpixels: w the difference of their truncated means."""
    both = labels.join(px.select(*K, "v"), K)
    mean = both.groupBy("image_id", "label").agg(F.floor(F.avg("v")).cast("int").alias("m"))
    e = nb.edges(labels, nb.C8, ["label"]).where("label <> q_label").select("image_id", F.least("label", "q_label").alias("a"), F.greatest("label", "q_label").alias("b")).distinct()
    e = e.join(mean.select("image_id", F.col("label").alias("a"), F.col("m").alias("ma")), ["image_id", "a"]).join(mean.select("image_id", F.col("label").alias("b"), F.col("m").alias("mb")), ["image_id", "b"])
    return e.select("image_id", "a", "b", F.abs(F.col("ma") - F.col("mb")).alias("w"))


def superpixel_distance(px: DataFrame, step: int = 8) -> DataFrame:
    """Barrier distance on the graph of superpixels from those at the image's border: (image_id, label, d)."""
    import heapq

    def run(g: Grid):
        lab = k.superpixels(g["v"], step)
        n = int(lab.max()) + 1
        mean = (np.bincount(lab.ravel(), weights=g["v"].ravel()) // np.bincount(lab.ravel())).astype(int).tolist()
        near: list[set[int]] = [set() for _ in range(n)]
        p, q = k.edges(g.mask, k.C8)
        for a, b in zip(lab.ravel()[p].tolist(), lab.ravel()[q].tolist()):
            if a != b:
                near[a].add(b), near[b].add(a)
        rim = {*lab[0].tolist(), *lab[-1].tolist(), *lab[:, 0].tolist(), *lab[:, -1].tolist()}
        d = [-1] * n
        heap = [(0, i, mean[i], mean[i]) for i in sorted(rim)]
        while heap:
            x, i, hi, lo = heapq.heappop(heap)
            if d[i] >= 0:
                continue
            d[i] = x
            for j in near[i]:
                if d[j] < 0:
                    a, b = max(hi, mean[j]), min(lo, mean[j])
                    heapq.heappush(heap, (a - b, j, a, b))
        return g.rows(label=list(range(n)), d=d)

    return per_image(px, run, "image_id long, label long, d int")
