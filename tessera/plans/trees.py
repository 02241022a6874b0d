"""Component trees and what is computed on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import trees
from tessera.operators.rasterwise import stored
from tessera.plans.fixtures import MAX_TREE, P16, ZONES, cc, px16
from tessera.plans.registry import query
from tessera.sources import pnm

S = "image_id y x v"


def _tree(s, d, kind: str = "max"):
    pmap = stored(trees.node_map(px16(s, d), kind))
    return pmap, trees.nodes_of(pmap)


def _nodes(s, d, kind: str = "max"):
    """The nodes alone, read once."""
    return trees.nodes_of(trees.node_map(px16(s, d), kind))


_NODES = "image_id node_id parent_id level area depth"


@query("max_tree_nodes", _NODES, f"{MAX_TREE} SELECT image_id, node_id, parent_id, level, area, depth FROM nodes")
def _(s, d):
    return _nodes(s, d)


@query("min_tree_nodes", _NODES, MAX_TREE.replace(P16, f"SELECT image_id, y, x, 7 - v AS v FROM ({P16})") + " SELECT image_id, node_id, parent_id, 7 - level AS level, area, depth FROM nodes")
def _(s, d):
    return _nodes(s, d, "min")


@query("max_tree_pixels", "image_id y x node_id", f"{MAX_TREE} SELECT image_id, y, x, node_id FROM pmap")
def _(s, d):
    return trees.node_map(px16(s, d))


@query("tree_of_shapes_nodes", _NODES)
def _(s, d):
    return _nodes(s, d, "tos")


@query("tree_closure", "image_id node_id anc dist", f"{MAX_TREE} SELECT image_id, node_id, anc, dist FROM up")
def _(s, d):
    return trees.closure(_tree(s, d)[1])


@query("tree_depth", "image_id node_id depth", f"{MAX_TREE} SELECT image_id, node_id, depth FROM nodes")
def _(s, d):
    return trees.depths(_nodes(s, d))


@query("tree_children_count", "image_id node_id n", f"{MAX_TREE} SELECT image_id, parent_id AS node_id, count(*) AS n FROM nodes WHERE parent_id IS NOT NULL GROUP BY ALL")
def _(s, d):
    return trees.children(_nodes(s, d)).groupBy("image_id", "node_id").agg(F.count("*").alias("n"))


@query("tree_neighbours", "image_id node_id near_id", f"{MAX_TREE}, e AS (SELECT image_id, node_id, parent_id FROM nodes WHERE parent_id IS NOT NULL) SELECT image_id, node_id, parent_id AS near_id FROM e UNION ALL SELECT image_id, parent_id, node_id FROM e")
def _(s, d):
    return trees.neighbours(_tree(s, d)[1])


@query("tree_accumulate", "image_id node_id n sy lo hi", f"{MAX_TREE} SELECT u.image_id, u.anc AS node_id, count(*) AS n, sum(p.y) AS sy, min(p.v) AS lo, max(p.v) AS hi FROM pmap p JOIN up u USING (image_id, node_id) GROUP BY ALL")
def _(s, d):
    pmap, nodes = _tree(s, d)
    aggs = {"n": (F.count("v"), "sum"), "sy": (F.sum("y"), "sum"), "lo": (F.min("v"), "min"), "hi": (F.max("v"), "max")}
    return trees.rolled_up(pmap, px16(s, d), aggs, nodes)


@query("tree_accumulate_proper", "image_id node_id n sx", f"{MAX_TREE} SELECT image_id, node_id, count(*) AS n, sum(x) AS sx FROM pmap GROUP BY ALL")
def _(s, d):
    return trees.proper(trees.node_map(px16(s, d)), px16(s, d), {"n": F.count("v"), "sx": F.sum("x")})


@query("tree_statistics", "image_id node_id area mean:d variance:d own own_mean:d", f"""{MAX_TREE}, s AS (SELECT u.image_id, u.anc AS node_id, count(*) AS area, avg(p.y) AS mean, var_pop(p.y) AS variance FROM pmap p JOIN up u USING (image_id, node_id) GROUP BY ALL),
o AS (SELECT image_id, node_id, count(*) AS own, avg(y) AS own_mean FROM pmap GROUP BY ALL) SELECT * FROM s JOIN o USING (image_id, node_id)""")
def _(s, d):
    pmap, nodes = _tree(s, d)
    g = px16(s, d).withColumn("g", F.col("y"))
    sums = {"n": (F.count("g"), "sum"), "s1": (F.sum("g"), "sum"), "s2": (F.sum(F.col("g") * F.col("g")), "sum")}
    t = trees.rolled_up(pmap, g.drop("y").withColumn("y", F.col("g")), sums, nodes)
    own = trees.proper(pmap, g, {"own": F.count("g"), "own_mean": F.avg("g")})
    mean = F.col("s1") / F.col("n")
    return t.join(own, ["image_id", "node_id"]).select("image_id", "node_id", F.col("n").alias("area"), mean.alias("mean"), (F.col("s2") / F.col("n") - mean * mean).alias("variance"), "own", "own_mean")


_KEEP = "area % 3 <> 0"
_KEEP_SQL = "area % 3 <> 0"
_ANC = "up u JOIN (SELECT image_id, node_id AS anc, level AS alevel, area AS aarea, parent_id AS aparent FROM nodes) a USING (image_id, anc)"
_ALIVE_DIRECT = f"SELECT image_id, node_id FROM nodes WHERE {_KEEP_SQL} OR parent_id IS NULL"
_RECON = "SELECT p.image_id, p.y, p.x, max(u.anc_level) AS v FROM pmap p JOIN up u USING (image_id, node_id) SEMI JOIN alive ON alive.image_id = u.image_id AND alive.node_id = u.anc GROUP BY p.image_id, p.y, p.x"


@query("filter_direct", S, f"{MAX_TREE}, alive AS ({_ALIVE_DIRECT}) {_RECON}")
def _(s, d):
    pmap, nodes = _tree(s, d)
    return trees.reconstruct(pmap, trees.filter_direct(nodes, F.expr(_KEEP)))


@query("filter_min", S, f"{MAX_TREE}, alive AS (SELECT image_id, node_id FROM {_ANC} GROUP BY ALL HAVING bool_and(aarea % 3 <> 0 OR aparent IS NULL)) {_RECON}")
def _(s, d):
    pmap, nodes = _tree(s, d)
    return trees.reconstruct(pmap, trees.filter_min(nodes, F.expr(_KEEP)))


@query("filter_max", S, f"{MAX_TREE}, alive AS (SELECT u.image_id, u.anc AS node_id FROM up u JOIN (SELECT image_id, node_id, area, parent_id FROM nodes) n USING (image_id, node_id) GROUP BY ALL HAVING bool_or(n.{_KEEP_SQL} OR n.parent_id IS NULL)) {_RECON}")
def _(s, d):
    pmap, nodes = _tree(s, d)
    return trees.reconstruct(pmap, trees.filter_max(nodes, F.expr(_KEEP)))


@query("cut_and_reconstruct", S, f"{MAX_TREE}, alive AS (SELECT n.image_id, n.node_id FROM nodes n LEFT JOIN nodes q ON q.image_id = n.image_id AND q.node_id = n.parent_id WHERE q.node_id IS NULL OR NOT q.area < 20) {_RECON}")
def _(s, d):
    pmap, nodes = _tree(s, d)
    return trees.reconstruct(pmap, trees.cut(nodes, F.col("area") < 20))


@query("filtered_parents", "image_id node_id parent_id", f"{MAX_TREE}, alive AS ({_ALIVE_DIRECT}) SELECT a.image_id, a.node_id, max_by(u.anc, u.anc_level) AS parent_id FROM alive a LEFT JOIN (SELECT * FROM up WHERE dist > 0) u ON u.image_id = a.image_id AND u.node_id = a.node_id AND (u.image_id, u.anc) IN (SELECT (image_id, node_id) FROM alive) GROUP BY a.image_id, a.node_id")
def _(s, d):
    return trees.parents_after(_nodes(s, d), F.expr(_KEEP))


@query("tree_lca", "image_id a b lca", f"{MAX_TREE}, pr AS (SELECT DISTINCT p.image_id, p.node_id AS a, q.node_id AS b FROM pmap p JOIN pmap q ON p.image_id = q.image_id AND p.y = q.x AND p.x = q.y) SELECT pr.image_id, a, b, max_by(u.anc, u.anc_level) AS lca FROM pr JOIN up u ON u.image_id = pr.image_id AND u.node_id = a JOIN up w ON w.image_id = pr.image_id AND w.node_id = b AND w.anc = u.anc GROUP BY ALL")
def _(s, d):
    pmap, nodes = _tree(s, d)
    m = pmap.select("image_id", "y", "x", "node_id")
    pairs = m.select("image_id", "y", "x", F.col("node_id").alias("a")).join(m.select("image_id", F.col("x").alias("y"), F.col("y").alias("x"), F.col("node_id").alias("b")), ["image_id", "y", "x"]).select("image_id", "a", "b").distinct()
    return trees.lca(nodes, pairs)


@query("smallest_enclosing_shape", "image_id node_id other_id")
def _(s, d):
    (a, nodes_a), (b, nodes_b) = _tree(s, d, "max"), _tree(s, d, "tos")
    return trees.smallest_enclosing(a, b, nodes_a, nodes_b)


@query("contour_length_and_gradient", "image_id node_id s n", f"""{MAX_TREE}, e AS (SELECT p.image_id, p.node_id AS a, q.node_id AS b, abs(p.v - q.v) AS e FROM pmap p JOIN (VALUES (0, 1), (1, 0)) o(dy, dx) ON true JOIN pmap q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx WHERE p.node_id <> q.node_id),
h AS (SELECT e.image_id, u.anc, e.e, e.a, e.b, 1 AS side FROM e JOIN up u ON u.image_id = e.image_id AND u.node_id = e.a ANTI JOIN up w ON w.image_id = e.image_id AND w.node_id = e.b AND w.anc = u.anc
UNION ALL SELECT e.image_id, u.anc, e.e, e.a, e.b, 2 FROM e JOIN up u ON u.image_id = e.image_id AND u.node_id = e.b ANTI JOIN up w ON w.image_id = e.image_id AND w.node_id = e.a AND w.anc = u.anc)
SELECT image_id, anc AS node_id, sum(e) AS s, count(*) AS n FROM h GROUP BY ALL""")
def _(s, d):
    from tessera.operators import neighbours as nb

    pmap, nodes = _tree(s, d)
    e = nb.edges(px16(s, d)).select("image_id", "y", "x", "qy", "qx", F.abs(F.col("v") - F.col("q_v")).alias("e"))
    return trees.on_contour(pmap, nodes, e)


@query("mser", "image_id node_id mser:d", f"""{MAX_TREE}, t AS (SELECT u.image_id, u.node_id, min_by(u.anc, u.dist) AS hit, min_by(u.anc_area, u.dist) AS plus, any_value(u.area) AS a FROM up u WHERE u.level - u.anc_level >= 2 OR u.anc IN (SELECT node_id FROM nodes n WHERE n.image_id = u.image_id AND n.parent_id IS NULL) GROUP BY u.image_id, u.node_id),
m AS (SELECT image_id, hit AS node_id, max(a) AS minus FROM t GROUP BY ALL) SELECT image_id, node_id, plus - coalesce(minus, 0) AS mser FROM t LEFT JOIN m USING (image_id, node_id)""")
def _(s, d):
    return trees.mser(_nodes(s, d), 2)


@query("grain_filter", S)
def _(s, d):
    pmap, nodes = _tree(s, d, "tos")
    return trees.reconstruct(pmap, trees.filter_direct(nodes, F.col("area") >= 6))


@query("mser_relative", "image_id node_id mser:d")
def _(s, d):
    return trees.mser(_nodes(s, d, "tos"), 2, "ratio", True)


@query("area_filter_mean", S, f"""{MAX_TREE}, mm AS (SELECT image_id, node_id AS anc, sum(v) // count(*) AS m FROM pmap GROUP BY ALL),
k AS (SELECT u.image_id, u.node_id, min_by(m, dist) AS m, min(dist) AS far FROM up u JOIN mm USING (image_id, anc) WHERE u.anc_area >= 6 OR (u.image_id, u.anc) IN (SELECT (image_id, node_id) FROM nodes WHERE parent_id IS NULL) GROUP BY u.image_id, u.node_id)
SELECT p.image_id, p.y, p.x, CASE WHEN far = 0 THEN v ELSE m END AS v FROM pmap p JOIN k USING (image_id, node_id)""")
def _(s, d):
    pmap, nodes = _tree(s, d)
    return trees.area_filter_mean(pmap, nodes, px16(s, d), 6)


@query("tree_of_shapes_sub_domain", _NODES)
def _(s, d):
    return trees.nodes_of(trees.node_map(px16(s, d).where("v < 6"), "tos"))


@query("attribute_profiles", "image_id area n", f"""{MAX_TREE}, f AS (SELECT k, p.image_id, p.y, p.x, coalesce(max(u.anc_level) FILTER (u.anc_area >= k), min(u.anc_level)) AS v FROM pmap p JOIN up u USING (image_id, node_id), (VALUES (2), (4), (8), (16)) t(k) GROUP BY k, p.image_id, p.y, p.x),
g AS (SELECT *, lag(v) OVER (PARTITION BY image_id, y, x ORDER BY k) AS before FROM f) SELECT image_id, k AS area, sum((v - before) ** 2) AS n FROM g WHERE before IS NOT NULL GROUP BY ALL""")
def _(s, d):
    from pyspark.sql import Window

    pmap, nodes = _tree(s, d)
    ks = F.explode(F.array(*map(F.lit, (2, 4, 8, 16)))).alias("k")
    v = trees.nearest(nodes.select("*", ks), F.col("area") >= F.col("k"), ["image_id", "k"]).withColumnRenamed("level", "v")
    step = F.lag("v").over(Window.partitionBy("image_id", "node_id").orderBy("k"))
    own = pmap.groupBy("image_id", "node_id").agg(F.count("*").alias("c"))
    moved = v.withColumn("before", step).where("before is not null").join(own, ["image_id", "node_id"])
    return moved.groupBy("image_id", F.col("k").alias("area")).agg(F.sum((F.col("v") - F.col("before")) * (F.col("v") - F.col("before")) * F.col("c")).alias("n"))


@query("alpha_tree_nodes", "image_id n top", f"""{ZONES}, m AS (SELECT c.image_id, c.lev, c.r, count(DISTINCT coalesce(b.r, c.y * 16 + c.x)) AS parts, count(*) AS size FROM cc c LEFT JOIN cc b ON b.image_id = c.image_id AND b.lev = c.lev - 1 AND b.y = c.y AND b.x = c.x GROUP BY ALL)
SELECT image_id, max(size) + count(*) FILTER (parts > 1) AS n, max(lev) FILTER (parts > 1) AS top FROM m GROUP BY ALL""")
def _(s, d):
    t = trees.alpha_tree(px16(s, d))
    return t.groupBy("image_id").agg(F.count("*").alias("n"), F.max("alpha").alias("top"))


@query("alpha_zones", "image_id y x label", f"{ZONES} SELECT image_id, y, x, dense_rank() OVER (PARTITION BY image_id ORDER BY r) AS label FROM cc WHERE lev = 1")
def _(s, d):
    return trees.alpha_zones(px16(s, d), 1)


@query("mumford_shah_simplify", S)
def _(s, d):
    return trees.simplify_energy(px16(s, d), 2.0)


@query("tree_graphviz", "image_id line:s", f"{MAX_TREE} SELECT image_id, node_id || ' [label=\"' || level || '\"];' AS line FROM nodes UNION ALL SELECT image_id, node_id || ' -> ' || parent_id || ';' FROM nodes WHERE parent_id IS NOT NULL")
def _(s, d):
    return pnm.graphviz(_nodes(s, d))


@query("tree_check_order", "image_id ok:b", f"SELECT DISTINCT image_id, true AS ok FROM ({P16})")
def _(s, d):
    nodes = _tree(s, d)[1]
    up = nodes.select("image_id", F.col("node_id").alias("parent_id"), F.col("level").alias("pl"), F.col("area").alias("pa"), F.col("depth").alias("pd"))
    j = nodes.join(up, ["image_id", "parent_id"], "left")
    ok = F.col("parent_id").isNull() | ((F.col("pl") < F.col("level")) & (F.col("pa") > F.col("area")) & (F.col("pd") == F.col("depth") - 1))
    return j.groupBy("image_id").agg(F.bool_and(ok).alias("ok"))


@query("saliency_map", S)
def _(s, d):
    """Largest area of a contour through each pixel's edges: for each edge, over nodes that hold one end only."""
    from tessera.operators import neighbours as nb

    pmap, nodes = _tree(s, d, "tos")
    m = pmap.select("image_id", "y", "x", "node_id")
    e = nb.edges(px16(s, d)).select("image_id", "y", "x", "qy", "qx")
    e = e.join(m.withColumnRenamed("node_id", "a"), ["image_id", "y", "x"]).join(m.select("image_id", F.col("y").alias("qy"), F.col("x").alias("qx"), F.col("node_id").alias("b")), ["image_id", "qy", "qx"]).where("a <> b")
    path = trees.paths(nodes, e.select("image_id", "a", "b").distinct()).withColumnRenamed("node_id", "anc")
    most = path.join(nodes.select("image_id", F.col("node_id").alias("anc"), "area"), ["image_id", "anc"]).groupBy("image_id", "a", "b").agg(F.max("area").alias("v"))
    return e.join(most, ["image_id", "a", "b"]).groupBy("image_id", "y", "x").agg(F.max("v").alias("v"))


del cc
