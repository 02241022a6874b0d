"""Shape space, multivariate trees and pipelines made of several operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import connected, distance, trees
from tessera.operators import neighbours as nb
from tessera.operators import shapespace as sh
from tessera.operators.rasterwise import stored
from tessera.plans.connected import recon
from tessera.plans.fixtures import MAX_TREE, P16, ZONES, mask16, px16, rgb
from tessera.plans.registry import query

S = "image_id y x v"


def _tree(s, d, kind: str = "max"):
    pmap = stored(trees.node_map(px16(s, d), kind))
    return pmap, trees.nodes_of(pmap)


def _rgb16(s, d):
    """Colour rasters of 4 levels, cut into tiles of 16 x 7."""
    tile = F.col("image_id") * 12 + F.floor(F.col("y") / 16) * 3 + F.floor(F.col("x") / 7)
    return rgb(s, d).select(tile.alias("image_id"), F.col("y") % 16, F.col("x") % 7, *[F.floor(F.col(c) / 64).cast("int").alias(c) for c in "rgb"]).toDF("image_id", "y", "x", "r", "g", "b")


_CONTOUR = """e AS (SELECT p.image_id, p.node_id AS a, q.node_id AS b, abs(p.v - q.v) AS e FROM pmap p JOIN (VALUES (0, 1), (1, 0)) o(dy, dx) ON true JOIN pmap q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx WHERE p.node_id <> q.node_id),
h AS (SELECT e.image_id, u.anc, e.e FROM e JOIN up u ON u.image_id = e.image_id AND u.node_id = e.a ANTI JOIN up w ON w.image_id = e.image_id AND w.node_id = e.b AND w.anc = u.anc
UNION ALL SELECT e.image_id, u.anc, e.e FROM e JOIN up u ON u.image_id = e.image_id AND u.node_id = e.b ANTI JOIN up w ON w.image_id = e.image_id AND w.node_id = e.a AND w.anc = u.anc),
gm AS (SELECT n.image_id, n.node_id, n.area, coalesce(avg(1 - h.e / 7.0::DOUBLE), 1) AS a FROM nodes n LEFT JOIN h ON h.image_id = n.image_id AND h.anc = n.node_id GROUP BY ALL)"""


@query("gradient_magnitude_attribute", "image_id node_id a:d", f"{MAX_TREE}, {_CONTOUR} SELECT image_id, node_id, a FROM gm")
def _(s, d):
    pmap, nodes = _tree(s, d)
    return sh.gradient_magnitude(px16(s, d), pmap, nodes, 8)


@query("pattern_spectrum", "image_id bin n area", f"{MAX_TREE}, {_CONTOUR} SELECT image_id, floor(a / 0.1::DOUBLE + 1e-9) AS bin, count(*) AS n, sum(area) AS area FROM gm GROUP BY ALL")
def _(s, d):
    pmap, nodes = _tree(s, d)
    return sh.pattern_spectrum(nodes, sh.gradient_magnitude(px16(s, d), pmap, nodes, 8))


@query("collapse_zero_nodes", S, f"{MAX_TREE}, alive AS (SELECT n.image_id, n.node_id FROM nodes n JOIN (SELECT u.image_id, u.anc AS node_id, max(p.v) - min(p.v) AS s FROM pmap p JOIN up u USING (image_id, node_id) GROUP BY ALL) a USING (image_id, node_id) WHERE s <> 0 OR parent_id IS NULL) SELECT p.image_id, p.y, p.x, max(u.anc_level) AS v FROM pmap p JOIN up u USING (image_id, node_id) SEMI JOIN alive ON alive.image_id = u.image_id AND alive.node_id = u.anc GROUP BY p.image_id, p.y, p.x")
def _(s, d):
    pmap, nodes = _tree(s, d)
    span = trees.rolled_up(pmap, px16(s, d), {"lo": (F.min("v"), "min"), "hi": (F.max("v"), "max")}, nodes)
    return trees.reconstruct(pmap, trees.filter_direct(nodes.join(span, ["image_id", "node_id"]), F.col("hi") != F.col("lo")))


_MEAN = "SELECT p.image_id, p.y, p.x, floor(m) AS v FROM pmap p JOIN m USING (image_id, node_id)"


@query("mean_on_components", S, f"{MAX_TREE}, m AS (SELECT u.image_id, u.anc AS node_id, sum(p.v) // count(*) AS m FROM pmap p JOIN up u USING (image_id, node_id) GROUP BY ALL) {_MEAN}")
def _(s, d):
    pmap, nodes = _tree(s, d)
    return sh.mean_on_nodes(px16(s, d), pmap, nodes)


@query("mean_on_own_pixels", S, f"{MAX_TREE}, m AS (SELECT image_id, node_id, sum(v) // count(*) AS m FROM pmap GROUP BY ALL) {_MEAN}")
def _(s, d):
    pmap, nodes = _tree(s, d)
    return sh.mean_on_nodes(px16(s, d), pmap, nodes, False)


@query("meaningfulness", "image_id node_id internal:d external:d total:d", f"""{MAX_TREE}, pr AS (SELECT p.image_id, p.y, p.x, p.v, p.node_id AS a, q.node_id AS b FROM pmap p JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx) ON true JOIN pmap q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx WHERE p.node_id <> q.node_id),
s AS (SELECT DISTINCT pr.image_id, pr.y, pr.x, pr.v, u.anc AS node_id, true AS inside FROM pr JOIN up u ON u.image_id = pr.image_id AND u.node_id = pr.a ANTI JOIN up w ON w.image_id = pr.image_id AND w.node_id = pr.b AND w.anc = u.anc
UNION SELECT DISTINCT pr.image_id, pr.y, pr.x, pr.v, u.anc, false FROM pr JOIN up u ON u.image_id = pr.image_id AND u.node_id = pr.b ANTI JOIN up w ON w.image_id = pr.image_id AND w.node_id = pr.a AND w.anc = u.anc)
SELECT image_id, node_id, coalesce(var_pop(v) FILTER (inside), 0) AS internal, coalesce(var_pop(v) FILTER (NOT inside), 0) AS external, var_pop(v) AS total FROM s GROUP BY ALL""")
def _(s, d):
    pmap, nodes = _tree(s, d)
    return sh.regional_energy(px16(s, d), pmap, nodes)


@query("label_coverage", "image_id label jaccard:d", f"{MAX_TREE}, l AS (SELECT image_id, y, x, y // 8 AS label FROM px), i AS (SELECT l.image_id, label, u.anc AS node_id, any_value(u.anc_area) AS area, count(*) AS n FROM l JOIN pmap p USING (image_id, y, x) JOIN up u USING (image_id, node_id) GROUP BY ALL), z AS (SELECT image_id, label, count(*) AS size FROM l GROUP BY ALL) SELECT image_id, label, max(n / (size + area - n)) AS jaccard FROM i JOIN z USING (image_id, label) GROUP BY ALL".replace("any_value(u.anc_area)", "max(u.anc_area)"))
def _(s, d):
    pmap, nodes = _tree(s, d)
    return sh.coverage(px16(s, d).select("image_id", "y", "x", F.floor(F.col("y") / 8).alias("label")), pmap, nodes)


@query("thicken", S)
def _(s, d):
    """Pixels take the depth of the nearest kept level line of the tree of shapes."""
    pmap, nodes = _tree(s, d, "tos")
    return trees.reconstruct(pmap, sh.thicken(pmap, nodes), "depth")


@query("shape_energy", "image_id node_id energy:d")
def _(s, d):
    return sh.shape_energy(px16(s, d))


@query("shape_extinction", "image_id node_id extinction:d")
def _(s, d):
    return sh.shape_extinction(px16(s, d))


@query("object_detection", S)
def _(s, d):
    return sh.detect_objects(px16(s, d))


@query("simplify_bottom_up", S)
def _(s, d):
    return sh.simplify_bottom_up(px16(s, d))


@query("simplify_top_down", S)
def _(s, d):
    return sh.simplify_top_down(px16(s, d))


@query("graph_of_shapes", "image_id below above size")
def _(s, d):
    return sh.shape_graph(_rgb16(s, d))


@query("multivariate_depth", S)
def _(s, d):
    return sh.depth_image(_rgb16(s, d))


@query("multivariate_tree_nodes", "image_id node_id parent_id level area depth")
def _(s, d):
    return trees.nodes_of(sh.multivariate_tree(_rgb16(s, d)))


@query("marginal_grain_filter", "image_id y x r g b")
def _(s, d):
    return sh.marginal_grain_filter(_rgb16(s, d), 6)


@query("area_by_channel_gradient", S)
def _(s, d):
    return sh.marginal_area_by_gradient(_rgb16(s, d))


@query("hierarchical_segmentation", "image_id y x label")
def _(s, d):
    grad = nb.gradient(px16(s, d), nb.rectangle(3, 3))
    mark = F.when((F.col("y") < 2) & (F.col("x") < 2), 1).when((F.col("y") > 13) & (F.col("x") > 13), 2).otherwise(0)
    return sh.hierarchical_segmentation(grad.withColumn("mark", mark))


@query("path_region", "image_id y x v:b")
def _(s, d):
    return sh.path_region(px16(s, d), (0, 0), (3, 15))


@query("superpixel_graph", "image_id a b w")
def _(s, d):
    p = px16(s, d)
    return sh.superpixel_graph(connected.superpixels(p, 4), p)


@query("superpixel_distance", "image_id label d")
def _(s, d):
    return sh.superpixel_distance(px16(s, d), 4)


@query("form_marks", "image_id label n", f"""WITH RECURSIVE src AS MATERIALIZED ({P16}), off(dy, dx) AS (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)),
e AS (SELECT p.image_id, p.y, p.x, bool_and(q.v >= 2) AS v FROM src p, off o, src q WHERE q.image_id = p.image_id AND q.y = p.y + o.dy AND q.x = p.x + o.dx GROUP BY ALL),
op AS MATERIALIZED (SELECT p.image_id, p.y, p.x, bool_or(q.v) AS v FROM e p, off o, e q WHERE q.image_id = p.image_id AND q.y = p.y + o.dy AND q.x = p.x + o.dx GROUP BY ALL),
cc(image_id, y, x, r) USING KEY (image_id, y, x) AS (SELECT image_id, y, x, (y * 16 + x)::BIGINT FROM op WHERE v UNION SELECT n.image_id, n.y, n.x, min(f.r) AS r FROM cc f, off o, recurring.cc n WHERE n.image_id = f.image_id AND n.y = f.y + o.dy AND n.x = f.x + o.dx AND f.r < n.r GROUP BY ALL)
SELECT image_id, label, count(*) AS n FROM (SELECT image_id, dense_rank() OVER (PARTITION BY image_id ORDER BY r) AS label FROM cc) GROUP BY ALL""")
def _(s, d):
    """Binarise, open, label, measure: the steps of reading marks from a form."""
    on = px16(s, d).withColumn("v", F.col("v") >= 2)
    lab = connected.blobs(nb.opening(on, nb.WINC4))
    return lab.where("label > 0").groupBy("image_id", "label").agg(F.count("*").alias("n"))


@query("alpha_tree_cut", "image_id y x label", f"""{ZONES}, c AS MATERIALIZED (SELECT cc.*, v FROM cc JOIN px USING (image_id, y, x)), z AS (SELECT image_id, lev, r FROM c GROUP BY ALL HAVING max(v) - min(v) < 3),
b AS (SELECT image_id, y, x, max_by(r, lev) AS r FROM c SEMI JOIN z USING (image_id, lev, r) GROUP BY ALL) SELECT image_id, y, x, dense_rank() OVER (PARTITION BY image_id ORDER BY r) AS label FROM b""")
def _(s, d):
    """Cut of the α-tree into the largest zones whose values lie less than 3 apart."""
    return trees.alpha_cut(px16(s, d), 3)


@query("seeded_segmentation_colour", S)
def _(s, d):
    p = _rgb16(s, d)
    return distance.nearest_seed(distance.colour(p, "l"), distance.colour(p, "r"))


def _colour_tree(s, d):
    p = _rgb16(s, d)
    pmap = stored(sh.multivariate_tree(p))
    return pmap, distance.node_colours(pmap, p)


@query("dahu_colour_map", "image_id y x dr dg db d")
def _(s, d):
    """Dahu distance to the border on the multivariate tree of shapes; d: the sum of integer thirds."""
    got = distance.dahu_by_sides(*_colour_tree(s, d), {"rim": "tblr"}, ["r", "g", "b"])
    return got.toDF("image_id", "y", "x", "dr", "dg", "db").withColumn("d", distance.path_cost("dr", "dg", "db", "thirds"))


@query("dahu_four_borders", "image_id y x t b l r")
def _(s, d):
    """The same to each side by itself, from one tree."""
    got = distance.dahu_by_sides(*_colour_tree(s, d), {f"on_{c}": c for c in "tblr"}, ["r", "g", "b"])
    return got.select("image_id", "y", "x", *[distance.path_cost(f"on_{c}_r", f"on_{c}_g", f"on_{c}_b", "thirds").alias(c) for c in "tblr"])


@query("dahu_colour_pairs", "image_id a b d_r d_g d_b")
def _(s, d):
    pmap, nodes = _colour_tree(s, d)
    m = pmap.select("image_id", "y", "x", "node_id")
    pairs = m.withColumnRenamed("node_id", "a").join(m.select("image_id", "y", (6 - F.col("x")).alias("x"), F.col("node_id").alias("b")), ["image_id", "y", "x"])
    return distance.path_ranges(nodes, pairs, ["r", "g", "b"])


@query("marker_reconstruction", S, recon(f"SELECT *, CASE WHEN v >= 4 THEN 7 ELSE v END AS marker FROM ({P16})"))
def _(s, d):
    """Closing by reconstruction from a mask's complement: fills what the mask doesn't reach."""
    p = px16(s, d).join(mask16(s, d).withColumnRenamed("v", "m"), ["image_id", "y", "x"])
    return connected.closing_by_reconstruction(p.withColumn("marker", F.when(F.col("m"), F.lit(7)).otherwise(F.col("v"))))
