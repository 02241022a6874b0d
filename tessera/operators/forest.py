"""Trees of nodes as arrays: work by image that is linear in nodes (times the logarithm of the depth for paths).

A node is told by its position in the table that it came with; ``up`` holds the parent's position, -1 for roots. Walks
over the whole tree go by depth, all nodes of one depth at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ARROW = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "float": pa.float32(), "smallint": pa.int16(), "tinyint": pa.int8()}


class Forest:
    """The trees of one image, from columns node_id and parent_id (null: a root; a parent that is no node: a root, too)."""

    def __init__(self, table: pa.Table):
        self.table = table
        self.id = table.column("node_id").to_numpy(zero_copy_only=False).astype(np.int64)
        self._sorted = np.argsort(self.id, kind="stable")
        self.up = self.at(table.column("parent_id"))
        self.depth, p = (self.up >= 0).astype(np.int64), self.up.copy()
        while (p >= 0).any():
            go = p >= 0
            self.depth[go] += self.depth[p[go]]
            p[go] = p[p[go]]
        order = np.argsort(self.depth, kind="stable")
        self.layers = np.split(order, np.cumsum(np.bincount(self.depth))[:-1]) if len(order) else []

    def __len__(self) -> int:
        return len(self.id)

    def __getitem__(self, column: str) -> np.ndarray:
        return self.table.column(column).to_numpy(zero_copy_only=False)

    def at(self, ids: pa.ChunkedArray) -> np.ndarray:
        """Positions of node ids; -1 for nulls and for what is no node."""
        x = ids.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
        if not len(self.id):
            return np.full(len(x), -1)
        k = self._sorted[np.minimum(np.searchsorted(self.id, x, sorter=self._sorted), len(self.id) - 1)]
        return np.where(self.id[k] == x, k, -1)

    def down(self):
        """(nodes, their parents) from the roots' children to the deepest."""
        for n in self.layers[1:]:
            yield n, self.up[n]

    def rise(self):
        """(nodes, their parents) from the deepest to the roots' children."""
        for n in reversed(self.layers[1:]):
            yield n, self.up[n]

    def roll(self, value: np.ndarray, merge: np.ufunc) -> np.ndarray:
        """Each node's value merged with those of all below it."""
        out = value.copy()
        for n, u in self.rise():
            merge.at(out, u, out[n])
        return out

    def nearest(self, keep: np.ndarray) -> np.ndarray:
        """Position of the nearest kept node upwards, itself included; roots are always kept."""
        out = np.arange(len(self))
        for n, u in self.down():
            out[n] = np.where(keep[n], n, out[u])
        return out

    def preorder(self) -> np.ndarray:
        """Numbers from 0 by which a subtree's nodes follow one another."""
        size = self.roll(np.ones(len(self), np.int64), np.add)
        out = np.zeros(len(self), np.int64)
        for n in self.layers:
            u = self.up[n]
            by = np.argsort(u, kind="stable")
            n, u = n[by], u[by]
            before = np.cumsum(size[n]) - size[n]
            start = np.r_[True, u[1:] != u[:-1]]
            before -= np.repeat(before[start], np.diff(np.r_[np.nonzero(start)[0], len(u)])) if u[0] >= 0 else 0
            out[n] = np.where(u >= 0, out[u] + 1, 0) + before
        return out

    def ancestors(self, depth: int | None = None) -> list[np.ndarray]:
        """Positions 1, 2, 4, ... steps up; -1 beyond a root."""
        far, out = int(self.depth.max(initial=0)) if depth is None else depth, [self.up]
        while 1 << len(out) <= far:
            p = out[-1]
            out.append(np.where(p >= 0, p[p], -1))
        return out

    def spread(self, v: np.ndarray, ups: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Least and largest value on the 1, 2, 4, ... nodes above each; of no meaning where there are fewer."""
        lo, hi = [v[ups[0]]], [v[ups[0]]]
        for p in ups[:-1]:
            lo.append(np.minimum(lo[-1], lo[-1][p])), hi.append(np.maximum(hi[-1], hi[-1][p]))
        return lo, hi

    def lca(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least common ancestors of positions; -1 if either is -1 or they are of different trees."""
        if not len(self):
            return np.full(len(a), -1)
        ups = self.ancestors()
        ok = (a >= 0) & (b >= 0)
        a, b = np.where(ok, a, 0), np.where(ok, b, 0)
        gap = self.depth[a] - self.depth[b]
        for k, p in enumerate(ups):
            a = np.where((np.maximum(gap, 0) >> k) & 1, p[a], a)
            b = np.where((np.maximum(-gap, 0) >> k) & 1, p[b], b)
        for p in reversed(ups):
            go = p[a] != p[b]
            a, b = np.where(go, p[a], a), np.where(go, p[b], b)
        return np.where(ok, np.where(a == b, a, self.up[a]), -1)

    def span(self, a: np.ndarray, steps: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest value from ``a`` to ``steps`` above it, both ends included."""
        ups = self.ancestors()
        lo, hi = self.spread(v, ups)
        least, most = v[a], v[a]
        for k, p in enumerate(ups):
            go = ((steps >> k) & 1).astype(bool)
            least, most = np.where(go, np.minimum(least, lo[k][a]), least), np.where(go, np.maximum(most, hi[k][a]), most)
            a = np.where(go, p[a], a)
        return least, most

    def first_far(self, v: np.ndarray, eps: float) -> np.ndarray:
        """The first node upwards, itself included, whose value is ``eps`` or more away; the root if there is none."""
        out = np.arange(len(self))
        if eps <= 0 or not len(self):
            return out
        ups = self.ancestors()
        lo, hi = self.spread(v, ups)
        for k in reversed(range(len(ups))):
            go = (ups[k][out] >= 0) & (lo[k][out] > v - eps) & (hi[k][out] < v + eps)
            out = np.where(go, ups[k][out], out)
        return np.where(self.up[out] >= 0, self.up[out], out)


def _out(key: tuple, keys: list[str], got: dict, fields: list[tuple[str, str]]) -> pa.Table:
    n = len(next(iter(got.values())))
    known = {k: pa.array([x.as_py()] * n) for k, x in zip(keys, key)}
    return pa.table({c: (known[c] if c in known else got[c] if isinstance(got[c], pa.Array) else pa.array(got[c])).cast(ARROW[t]) for c, t in fields})


def _fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(f.strip().rsplit(" ", 1)) for f in schema.split(",")]


def by_tree(nodes: DataFrame, run: Callable[[Forest], dict], schema: str, keys: list[str] = ["image_id"]) -> DataFrame:
    """``run`` on the forest of each image; it returns the columns of ``schema`` beside the keys."""
    fields = _fields(schema)
    return nodes.groupBy(*keys).applyInArrow(lambda key, t: _out(key, keys, run(Forest(t)), fields), schema)


def with_tree(nodes: DataFrame, rows: DataFrame, run: Callable[[Forest, pa.Table], dict], schema: str) -> DataFrame:
    """``run`` on the forest of each image and the rows that belong to it."""
    fields = _fields(schema)

    def both(key, t, r):
        return _out(key, ["image_id"], run(Forest(t), r), fields)

    rows = rows.toDF(*rows.columns)  # columns of its own: pairs often come from the nodes
    return nodes.groupBy("image_id").cogroup(rows.groupBy("image_id")).applyInArrow(both, schema)
