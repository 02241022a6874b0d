"""Distances, paths and segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import distance as dis
from tessera.operators import trees
from tessera.operators.rasterwise import stored
from tessera.plans.fixtures import MAX_TREE, P16, ZONES, mask16, px16, px64, rgb
from tessera.plans.registry import query

D = "image_id y x d"


@query("mbd_raster_scan", D)
def _(s, d):
    return dis.fast_mbd(px64(s, d))


@query("mbd_waterflow", D)
def _(s, d):
    return dis.waterflow_mbd(px64(s, d))


#: For each lower bound, the least upper bound of a path above it from the border.
_EXACT = f"""WITH RECURSIVE px AS MATERIALIZED ({P16}), mm(image_id, low, y, x, top) USING KEY (image_id, low, y, x) AS (
SELECT image_id, low, y, x, CASE WHEN y IN (0, h) OR x IN (0, 15) THEN v ELSE 99 END FROM px JOIN (SELECT image_id, max(y) AS h FROM px GROUP BY ALL) USING (image_id) JOIN (SELECT unnest(range(0, 8)) AS low) ON v >= low UNION
SELECT n.image_id, n.low, n.y, n.x, min(greatest(f.top, q.v)) AS top FROM mm f, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx), px q, recurring.mm n WHERE f.top < 99 AND q.image_id = f.image_id AND q.y = f.y + dy AND q.x = f.x + dx
AND n.image_id = q.image_id AND n.low = f.low AND n.y = q.y AND n.x = q.x AND greatest(f.top, q.v) < n.top GROUP BY ALL) SELECT image_id, y, x, min(top - low) AS d FROM mm WHERE top < 99 GROUP BY ALL"""


@query("mbd_exact", D, _EXACT)
def _(s, d):
    return dis.exact_mbd(px16(s, d))


@query("mbd_colour", "image_id y x dr dg db d")
def _(s, d):
    return dis.colour(rgb(s, d))


@query("mbd_colour_raster_scan", "image_id y x dr dg db d")
def _(s, d):
    return dis.colour(rgb(s, d), how="scan")


@query("mbd_four_borders", "image_id y x t b l r")
def _(s, d):
    p = px16(s, d)
    out = None
    for side in "tblr":
        one = dis.waterflow_mbd(p, side).withColumnRenamed("d", side)
        out = one if out is None else out.join(one, ["image_id", "y", "x"])
    return out


@query("mbd_spanning_tree", D)
def _(s, d):
    return dis.mst_mbd(px16(s, d))


@query("spanning_tree_weight", "image_id n total", f"{ZONES}, c AS (SELECT image_id, lev, count(*) - 1 AS n, count(DISTINCT r) AS c FROM cc GROUP BY ALL) SELECT image_id, any_value(n) AS n, sum(c - 1) AS total FROM c GROUP BY ALL")
def _(s, d):
    return dis.mst(px16(s, d)).groupBy("image_id").agg(F.count("*").alias("n"), F.sum("w").alias("total"))


@query("dahu_map", D)
def _(s, d):
    return dis.dahu(px16(s, d))


def _pairs(s, d):
    pmap = stored(trees.node_map(px16(s, d)))
    nodes = trees.nodes_of(pmap)
    m = pmap.select("image_id", "y", "x", "node_id")
    pairs = m.select("image_id", "y", "x", F.col("node_id").alias("a")).join(m.select("image_id", F.col("x").alias("y"), F.col("y").alias("x"), F.col("node_id").alias("b")), ["image_id", "y", "x"]).select("image_id", "a", "b").distinct()
    return nodes, pairs


@query("dahu_pairs", "image_id a b d", f"""{MAX_TREE}, pr AS (SELECT DISTINCT p.image_id, p.node_id AS a, q.node_id AS b FROM pmap p JOIN pmap q ON p.image_id = q.image_id AND p.y = q.x AND p.x = q.y),
l AS (SELECT pr.image_id, a, b, max(u.anc_level) AS low FROM pr JOIN up u ON u.image_id = pr.image_id AND u.node_id = a JOIN up w ON w.image_id = pr.image_id AND w.node_id = b AND w.anc = u.anc GROUP BY ALL)
SELECT l.image_id, a, b, greatest(na.level, nb.level) - low AS d FROM l JOIN nodes na ON na.image_id = l.image_id AND na.node_id = a JOIN nodes nb ON nb.image_id = l.image_id AND nb.node_id = b""")
def _(s, d):
    return dis.dahu_pairs(*_pairs(s, d))


@query("k_max_distance", "image_id node_id d", f"{MAX_TREE}, j AS (SELECT n.image_id, n.node_id AS anc, n.level - q.level AS jump FROM nodes n JOIN nodes q ON q.image_id = n.image_id AND q.node_id = n.parent_id), r AS (SELECT u.image_id, u.node_id, jump, row_number() OVER (PARTITION BY u.image_id, u.node_id ORDER BY jump DESC) AS k FROM up u JOIN j USING (image_id, anc)) SELECT image_id, node_id, sum(jump) AS d FROM r WHERE k <= 3 GROUP BY ALL")
def _(s, d):
    return dis.k_max_distance(trees.nodes_of(trees.node_map(px16(s, d))), 3)


@query("tree_marker_segmentation", "image_id y x label cost:d")
def _(s, d):
    p = px16(s, d).withColumn("mark", F.when((F.col("y") == 0) & (F.col("x") < 4), 1).when((F.col("y") == 12) & (F.col("x") > 10), 2).otherwise(0))
    return dis.tree_dijkstra(p)


@query("image_dijkstra", D, f"""WITH RECURSIVE px AS MATERIALIZED ({P16}), dj(image_id, y, x, d) USING KEY (image_id, y, x) AS (SELECT image_id, y, x, CASE WHEN y = 0 AND x = 0 THEN 0 ELSE 1000000 END AS d FROM px UNION
SELECT n.image_id, n.y, n.x, min(f.d + abs(p.v - q.v) + 1) AS d FROM dj f, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx), px p, px q, recurring.dj n WHERE f.d < 1000000 AND p.image_id = f.image_id AND p.y = f.y AND p.x = f.x AND q.image_id = f.image_id AND q.y = f.y + dy AND q.x = f.x + dx
AND n.image_id = q.image_id AND n.y = q.y AND n.x = q.x AND f.d + abs(p.v - q.v) + 1 < n.d GROUP BY ALL) SELECT image_id, y, x, d FROM dj""")
def _(s, d):
    return dis.image_dijkstra(px16(s, d).withColumn("seed", (F.col("y") == 0) & (F.col("x") == 0)))


@query("a_star_steps", "image_id n", f"""WITH RECURSIVE px AS MATERIALIZED (SELECT image_id, y, x FROM ({P16}) WHERE v >= 4 OR y = x), dj(image_id, y, x, d, n) USING KEY (image_id, y, x) AS (
SELECT image_id, y, x, CASE WHEN y = 0 AND x = 0 THEN 0 ELSE 1e9 END::DOUBLE, 1::BIGINT FROM px UNION
SELECT q.image_id, q.y, q.x, min(f.d + sqrt(dy * dy + dx * dx)) AS d, min_by(f.n + 1, f.d + sqrt(dy * dy + dx * dx)) AS n FROM dj f, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (1, -1), (-1, 1), (-1, -1)) o(dy, dx), recurring.dj q
WHERE f.d < 1e9 AND q.image_id = f.image_id AND q.y = f.y + dy AND q.x = f.x + dx AND f.d + sqrt(dy * dy + dx * dx) < q.d - 1e-9 GROUP BY ALL) SELECT image_id, n FROM dj WHERE y = 15 AND x = 15 AND d < 1e9""")
def _(s, d):
    return dis.a_star(mask16(s, d).withColumn("v", F.col("v") | (F.col("y") == F.col("x"))), (0, 0), (15, 15)).groupBy("image_id").agg(F.count("*").alias("n"))


@query("two_class_segmentation", "image_id y x v")
def _(s, d):
    p = px16(s, d)
    return dis.nearest_seed(dis.waterflow_mbd(p, "l"), dis.waterflow_mbd(p, "r"))


@query("bordered_dahu", D)
def _(s, d):
    from tessera.operators import khalimsky

    return dis.dahu(khalimsky.add_border(px16(s, d)))


@query("interval_dahu", D)
def _(s, d):
    return dis.interval_dahu(px64(s, d))
