"""Walks over trees against the plain definition by lists of ancestors."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import distance, rasterwise, shapespace, trees
from tessera.operators.forest import Forest

NODES = "image_id long, node_id long, parent_id long, level int, area long, depth int"


def random_trees(rng, images=3, n=60):
    """Rows of NODES; image 1 is a path, image 2 has two roots. Ids are no positions."""
    rows = []
    for i in range(images):
        ids = (rng.permutation(n) * 7 + 3).tolist()
        up = [None] + [ids[k - 1] if i == 1 else ids[rng.integers(k)] for k in range(1, n)]
        if i == 2:
            up[1] = None
        rows += [(i, a, b, int(rng.integers(9)), int(rng.integers(1, 50)), 0) for a, b in zip(ids, up)]
    return [rows[k] for k in rng.permutation(len(rows))]


@pytest.fixture(scope="module")
def tree(spark):
    rows = random_trees(np.random.default_rng(5))
    by = {(r[0], r[1]): r for r in rows}

    def ups(i, a):
        out = [a]
        while by[i, out[-1]][2] is not None:
            out.append(by[i, out[-1]][2])
        return out

    return rasterwise.stored(spark.createDataFrame(rows, NODES)), by, {k: ups(*k) for k in by}


def test_filters(tree):
    nodes, by, ups = tree
    ok = lambda i, a: by[i, a][4] % 3 != 0 or by[i, a][2] is None
    low = {(i, a) for (i, a) in by if any(ok(i, b) and a in ups[i, b] for (j, b) in by if j == i)}
    alive = {"direct": {k for k in by if ok(*k)}, "min": {k for k in by if all(ok(k[0], u) for u in ups[k])}, "max": low}
    for how, f in (("direct", trees.filter_direct), ("min", trees.filter_min), ("max", trees.filter_max)):
        got = {(r.image_id, r.node_id): r.level for r in f(nodes, F.expr("area % 3 <> 0")).collect()}
        assert got == {k: next(by[k[0], u][3] for u in ups[k] if (k[0], u) in alive[how]) for k in by}
    parents = {(r.image_id, r.node_id): r.parent_id for r in trees.parents_after(nodes, F.expr("area % 3 <> 0")).collect()}
    assert parents == {k: next((u for u in ups[k][1:] if ok(k[0], u)), None) for k in by if ok(*k)}
    cut = {(r.image_id, r.node_id): r.level for r in trees.cut(nodes, F.expr("area < 20")).collect()}
    assert cut == {k: next(by[k[0], u][3] for u, p in zip(ups[k], [*ups[k][1:], None]) if p is None or by[k[0], p][4] >= 20) for k in by}
    none = trees.filter_direct(nodes, F.lit(None).cast("boolean"))
    assert {(r.image_id, r.node_id): r.level for r in none.collect()} == {k: by[k[0], ups[k][-1]][3] for k in by}


def test_paths_and_stability(tree):
    nodes, by, ups = tree
    rng = np.random.default_rng(6)
    ids = {i: [a for j, a in by if j == i] for i in range(3)}
    pairs = [(i, int(rng.choice(ids[i])), int(rng.choice(ids[i]))) for i in ids for _ in range(80)]
    pairs += [pairs[0], (0, None, ids[0][0]), (0, ids[0][0], 10**9)]
    df = nodes.sparkSession.createDataFrame(pairs, "image_id long, a long, b long")
    want, span = {}, {}
    for i, a, b in pairs[:-2]:
        top = next((u for u in ups[i, a] if u in ups[i, b]), None)
        if top is not None:
            da, db = ups[i, a].index(top), ups[i, b].index(top)
            want[i, a, b] = (top, da, db)
            on = [by[i, u][3] for u in ups[i, a][: da + 1] + ups[i, b][: db + 1]]
            span[i, a, b] = max(on) - min(on)
    got = trees.lca(nodes, df).collect()
    assert len(got) == len(want) and {tuple(r[:3]): tuple(r[3:]) for r in got} == want
    assert {tuple(r[:3]): r.d for r in distance.dahu_pairs(nodes, df).collect()} == span
    path = sorted((*k, s, u) for k, (_, da, db) in want.items() for s, end, n in ((True, k[1], da), (False, k[2], db)) for u in ups[k[0], end][:n])
    assert sorted(map(tuple, trees.paths(nodes, df).collect())) == path
    for eps in (0, 3, 7):
        hit = {k: next((u for u in ups[k] if abs(by[k[0], u][3] - by[k][3]) >= eps), ups[k][-1]) for k in by}
        minus = {}
        for (i, a), u in hit.items():
            minus[i, u] = max(minus.get((i, u), 0), by[i, a][4])
        got = {(r.image_id, r.node_id): r.mser for r in trees.mser(nodes, eps).collect()}
        assert got == {k: by[k[0], hit[k]][4] - minus.get(k, 0) for k in by}
    jumps = {k: sorted((abs(by[k[0], a][3] - by[k[0], b][3]) for a, b in zip(ups[k], ups[k][1:])), reverse=True) for k in by}
    assert {(r.image_id, r.node_id): r.d for r in distance.k_max_distance(nodes, 4).collect()} == {k: sum(j[:4]) for k, j in jumps.items() if by[k][2] is not None}
    assert {(r.image_id, r.node_id): r.height for r in trees.heights(nodes).collect()} == {k: sum(j) for k, j in jumps.items()}
    assert {(r.image_id, r.node_id): r.depth for r in trees.depths(nodes).collect()} == {k: len(u) - 1 for k, u in ups.items()}


def test_dahu_ranges(tree):
    """With one seed, the ranges are those of the path to it; trees without a seed have -1."""
    nodes, by, ups = tree
    seed = {i: min(a for j, a in by if j == i) for i in range(3)}
    marked = nodes.withColumn("one", F.col("node_id").isin(list(seed.values())) & F.expr(" or ".join(f"(image_id = {i} and node_id = {a})" for i, a in seed.items()))).withColumn("r", F.col("level")).withColumn("g", F.col("area").cast("int"))
    got = {(r.image_id, r.node_id): (r.one_r, r.one_g) for r in distance.dahu_ranges(marked, ["one"], ["r", "g"]).collect()}
    for (i, a), d in got.items():
        u, w = ups[i, a], ups[i, seed[i]]
        top = next((x for x in u if x in w), None)
        on = [] if top is None else u[: u.index(top) + 1] + w[: w.index(top) + 1]
        assert d == tuple(max(v) - min(v) if v else -1 for v in ([by[i, x][c] for x in on] for c in (3, 4)))


def test_roll_up_with_nulls(tree):
    nodes, by, ups = tree
    s = nodes.sparkSession
    px = [(i, 0, n, a, None if n % 5 == 0 else n - 30) for n, (i, a) in enumerate(by) if n % 2]
    pmap = s.createDataFrame([p[:4] for p in px], "image_id long, y int, x int, node_id long")
    val = s.createDataFrame([(*p[:3], p[4]) for p in px], "image_id long, y int, x int, v int")
    got = {(r.image_id, r.node_id): tuple(r[2:]) for r in trees.rolled_up(pmap, val, {"n": (F.count("v"), "sum"), "s": (F.sum("v"), "sum"), "lo": (F.min("v"), "min"), "m": (F.max(F.col("v") / 2), "max")}, nodes).collect()}
    want = {}
    for i, _, _, a, v in px:
        for u in ups[i, a]:
            want.setdefault((i, u), []).append(v)
    num = {k: [x for x in v if x is not None] for k, v in want.items()}
    assert got == {k: (len(v), sum(v) if v else None, min(v, default=None), max(v) / 2 if v else None) for k, v in num.items()}


def test_preorder(tree):
    nodes, by, ups = tree
    n = {(r.image_id, r.node_id): r.n for r in trees.preorder(nodes).collect()}
    for i in range(3):
        assert sorted(v for k, v in n.items() if k[0] == i) == list(range(60))
    for k in by:
        below = sorted(n[j] for j in by if j[0] == k[0] and k[1] in ups[j])
        assert below == list(range(n[k], n[k] + len(below)))


def test_thicken(spark):
    """Against recursion over explicit sets of pixels; a ramp keeps every line, steep steps lose those that touch."""
    rng = np.random.default_rng(8)
    img = [rng.integers(0, 6, (7, 7)).tolist() for _ in range(4)] + [[[9, 9, 9, 9, 9], [9, 3, 1, 3, 9], [9, 9, 9, 9, 9]]]
    px = spark.createDataFrame([(i, y, x, v) for i, f in enumerate(img) for y, r in enumerate(f) for x, v in enumerate(r)], "image_id long, y int, x int, v int")
    pmap = rasterwise.stored(trees.node_map(px, "tos"))
    nodes = trees.nodes_of(pmap)
    got = {(r.image_id, r.node_id): r.depth for r in shapespace.thicken(pmap, nodes).collect()}
    for i in range(len(img)):
        at = {(r.y, r.x): r.node_id for r in pmap.where(F.col("image_id") == i).collect()}
        up = {r.node_id: r.parent_id for r in nodes.where(F.col("image_id") == i).collect()}
        chain = {a: [a] for a in up}
        for c in chain.values():
            while up[c[-1]] is not None:
                c.append(up[c[-1]])
        depth = {a: len(c) - 1 for a, c in chain.items()}

        def bound(a):  # what the kept lines inside reach; and whether a itself is kept
            got = [line(b) if kept(b) else bound(b) for b in up if up[b] == a]
            return min(got, default=99)

        def kept(a):
            return depth[a] <= bound(a)

        def line(a):
            inside = [p for p, n in at.items() if a in chain[n]]
            return min(depth[at[q]] for y, x in inside for q in ((y, x), (y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)) if q in at)

        want = {(i, a): depth[next(b for b in c if kept(b))] for a, c in chain.items()}
        assert {k: d for k, d in got.items() if k[0] == i} == want
    assert sorted(d for k, d in got.items() if k[0] == 4) == [0, 0, 2]


def test_empty_and_single(spark):
    none = spark.createDataFrame([], NODES)
    pairs = spark.createDataFrame([(0, 1, 1)], "image_id long, a long, b long")
    assert trees.filter_direct(none, F.lit(True)).count() == trees.mser(none, 1).count() == trees.lca(none, pairs).count() == trees.preorder(none).count() == 0
    one = spark.createDataFrame([(0, 1, None, 4, 1, 0)], NODES)
    assert [tuple(r) for r in trees.lca(one, pairs).collect()] == [(0, 1, 1, 1, 0, 0)]
    assert trees.mser(one, 3).first().mser == 0 and distance.k_max_distance(one).count() == 0
    f = Forest(pa.table({"node_id": pa.array([], pa.int64()), "parent_id": pa.array([], pa.int64())}))
    assert len(f) == 0 and f.layers == [] and len(f.preorder()) == 0
