"""Connected operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import connected as con
from tessera.operators.kernels import C4, C8
from tessera.plans.fixtures import MAX_TREE, P16, cc, mask16, px16, px64
from tessera.plans.registry import query
from tessera.sources.rasters import from_embeddings

S = "image_id y x v"
_ON = "SELECT image_id, 0 AS lev, y, x FROM px WHERE v >= 4"


def _blobs_sql(nb) -> str:
    return f"""WITH RECURSIVE px AS MATERIALIZED ({P16}), {cc(_ON, nb)}
SELECT px.image_id, px.y, px.x, coalesce(label, 0) AS label FROM px LEFT JOIN (SELECT image_id, y, x, dense_rank() OVER (PARTITION BY image_id ORDER BY r) AS label FROM cc) c USING (image_id, y, x)"""


@query("blobs_c4", "image_id y x label", _blobs_sql(C4))
def _(s, d):
    return con.blobs(mask16(s, d))


@query("blobs_c8", "image_id y x label", _blobs_sql(C8))
def _(s, d):
    return con.blobs(mask16(s, d), "c8")


@query("blobs_tiled", "image_id y x label", _blobs_sql(C4))
def _(s, d):
    return con.blobs_tiled(mask16(s, d), "c4", 8)


@query("blob_sizes", "image_id label count", f"WITH b AS ({_blobs_sql(C4)}) SELECT image_id, label, count(*) AS count FROM b GROUP BY ALL UNION ALL SELECT image_id, 0, 0 FROM b GROUP BY image_id HAVING min(label) > 0")
def _(s, d):
    from tessera.functions import accumulators as acc

    return acc.by_label(con.blobs(mask16(s, d)), acc.count, ["label"])


@query("saturate", "image_id y x v:b", f"""WITH RECURSIVE px AS MATERIALIZED ({P16}), {cc("SELECT image_id, 0 AS lev, y, x FROM px WHERE v < 4", C4)},
o AS (SELECT px.image_id, px.v >= 4 AS inside, r FROM px LEFT JOIN cc USING (image_id, y, x) WHERE px.y = 0 AND px.x = 0)
SELECT px.image_id, px.y, px.x, inside OR cc.r IS NULL OR cc.r <> o.r AS v FROM px JOIN o USING (image_id) LEFT JOIN cc USING (image_id, y, x)""")
def _(s, d):
    return con.saturate(mask16(s, d))


@query("area_opening", S, f"""{MAX_TREE}, root AS (SELECT image_id, min(v) AS low FROM px GROUP BY 1)
SELECT p.image_id, p.y, p.x, max(CASE WHEN u.anc_area >= 9 THEN u.anc_level ELSE low END) AS v FROM pmap p JOIN up u USING (image_id, node_id) JOIN root USING (image_id) GROUP BY p.image_id, p.y, p.x""")
def _(s, d):
    return con.area_opening(px16(s, d), 9)


@query("area_closing", S, f"""{MAX_TREE.replace(P16, f"SELECT image_id, y, x, 7 - v AS v FROM ({P16})")}, root AS (SELECT image_id, min(v) AS low FROM px GROUP BY 1)
SELECT p.image_id, p.y, p.x, 7 - max(CASE WHEN u.anc_area >= 9 THEN u.anc_level ELSE low END) AS v FROM pmap p JOIN up u USING (image_id, node_id) JOIN root USING (image_id) GROUP BY p.image_id, p.y, p.x""")
def _(s, d):
    return con.area_closing(px16(s, d), 9)


def _marked(s, d):
    return px16(s, d).withColumn("marker", F.least(F.lit(7), F.col("v") + (F.col("y") * 5 + F.col("x") * 3) % 4))


_MARKED = f"SELECT *, least(7, v + (y * 5 + x * 3) % 4) AS marker FROM ({P16})"


def recon(src: str, offsets=C4) -> str:
    """SQL of the closing by reconstruction of (image_id, y, x, v, marker), 8 levels."""
    return f"""WITH RECURSIVE px AS MATERIALIZED ({src}),
{cc("SELECT image_id, lev, y, x FROM px JOIN (SELECT unnest(range(0, 8)) AS lev) ON v <= lev", offsets)},
c AS MATERIALIZED (SELECT * FROM cc),
comp AS (SELECT image_id, lev, r, max(v) AS top, min(marker) AS low FROM c JOIN px USING (image_id, y, x) GROUP BY ALL),
hi AS (SELECT image_id, max(v) AS root FROM px GROUP BY 1)
SELECT c.image_id, c.y, c.x, coalesce(min(c.lev) FILTER (comp.top = c.lev AND comp.low <= c.lev), any_value(root)) AS v FROM c JOIN comp USING (image_id, lev, r) JOIN hi USING (image_id) GROUP BY c.image_id, c.y, c.x"""


@query("closing_by_reconstruction", S, recon(_MARKED))
def _(s, d):
    return con.closing_by_reconstruction(_marked(s, d))


_UP = recon(_MARKED.replace("SELECT *, least", "SELECT image_id, y, x, v, greatest(v, least").replace(" AS marker", ") AS marker"))
_DOWN = f"SELECT u.image_id, u.y, u.x, 7 - u.v AS v, 7 - least(u.v, m.marker) AS marker FROM ({_UP}) u JOIN ({_MARKED}) m USING (image_id, y, x)"


@query("leveling", S, f"SELECT image_id, y, x, 7 - v AS v FROM ({recon(_DOWN, C8)})")
def _(s, d):
    return con.leveling(_marked(s, d))


def _chamfer_sql(dist: str) -> str:
    return f"""WITH px AS MATERIALIZED ({P16}), e AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM px GROUP BY 1)
SELECT p.image_id, p.y, p.x, least(coalesce(min({dist}) FILTER (q.v < 4), 99), least(p.y + 1, p.x + 1, any_value(h) - p.y, any_value(w) - p.x) * (CASE WHEN p.v >= 4 THEN 1 ELSE 0 END)) AS v
FROM px p JOIN e USING (image_id) JOIN px q USING (image_id) GROUP BY p.image_id, p.y, p.x, p.v"""


@query("chamfer_c4", S, _chamfer_sql("abs(p.y - q.y) + abs(p.x - q.x)"))
def _(s, d):
    return con.chamfer(mask16(s, d))


@query("chamfer_c8", S, _chamfer_sql("greatest(abs(p.y - q.y), abs(p.x - q.x))"))
def _(s, d):
    return con.chamfer(mask16(s, d), "c8")


@query("flat_zones", "image_id n", f"""WITH RECURSIVE px AS MATERIALIZED ({P16}), {cc("SELECT image_id, v AS lev, y, x FROM px", C4)} SELECT image_id, count(DISTINCT (lev, r)) AS n FROM cc GROUP BY 1""")
def _(s, d):
    return con.flat_zones(px16(s, d)).groupBy("image_id").agg(F.max("label").alias("n"))


#: A minimum is a component whose pixels all have its level; it goes at the first level where its component holds a lower
#: one, of two equals the first in scan order.
@query("extinction", S, f"""WITH RECURSIVE px AS MATERIALIZED ({P16}), {cc("SELECT image_id, lev, y, x FROM px JOIN (SELECT unnest(range(0, 8)) AS lev) ON v <= lev", C4)},
c AS MATERIALIZED (SELECT cc.image_id, lev, y, x, r, v FROM cc JOIN px USING (image_id, y, x)),
comp AS (SELECT image_id, lev, r, min(v * 256 + y * 16 + x) AS best, min(v) AS low FROM c GROUP BY ALL),
m AS (SELECT image_id, lev, r, lev * 256 + r AS me FROM comp WHERE low = lev),
span AS (SELECT image_id, max(v) - min(v) AS span FROM px GROUP BY 1),
dyn AS (SELECT m.image_id, m.lev, m.r, coalesce(min(c.lev) FILTER (k.best < m.me) - m.lev, any_value(span)) AS d FROM m JOIN span USING (image_id) JOIN c ON c.image_id = m.image_id AND c.y * 16 + c.x = m.r AND c.lev >= m.lev JOIN comp k ON k.image_id = c.image_id AND k.lev = c.lev AND k.r = c.r GROUP BY m.image_id, m.lev, m.r)
SELECT px.image_id, px.y, px.x, coalesce(d, 0) AS v FROM px JOIN c ON c.image_id = px.image_id AND c.y = px.y AND c.x = px.x AND c.lev = px.v LEFT JOIN dyn ON dyn.image_id = c.image_id AND dyn.lev = c.lev AND dyn.r = c.r""")
def _(s, d):
    return con.extinction(px16(s, d))


@query("influence_zones", "image_id y x label")
def _(s, d):
    return con.influence_zones(px16(s, d).withColumn("v", F.col("v") >= 6))


@query("region_adjacency", "image_id a b")
def _(s, d):
    return con.rag(px16(s, d).withColumn("v", F.col("v") >= 6))


@query("graph_cut", "image_id y x label energy:d")
def _(s, d):
    return con.graph_cut(px16(s, d), 1.0, 1.0, 6.0)


@query("mean_shift", "image_id y x v:d")
def _(s, d):
    return con.mean_shift(px16(s, d), 3.0, 2.0)


@query("superpixels", "image_id y x label")
def _(s, d):
    return con.superpixels(px64(s, d), 8)


@query("convex_hull", "image_id corner y x")
def _(s, d):
    return con.convex_hull(px64(s, d).withColumn("v", F.col("v") > 200))


@query("shape_lattice", "image_id below above")
def _(s, d):
    return con.inclusion(con.shapes(from_embeddings(s, d, 8, 4)))


@query("marker_overlay", S, f"SELECT image_id, y, x, CASE WHEN v >= 6 THEN 255 ELSE v END AS v FROM ({P16})")
def _(s, d):
    p = px16(s, d)
    mark = p.where("v >= 6").select("image_id", "y", "x", F.lit(255).alias("m"))
    return p.join(mark, ["image_id", "y", "x"], "left").select("image_id", "y", "x", F.coalesce("m", "v").alias("v"))
