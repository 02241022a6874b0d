"""Rasters that the queries run on, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import rasters


def px64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 x 64 pixels of 256 levels."""
    return rasters.from_embeddings(spark, sf_dir)


def px16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 x 16 pixels of 8 levels."""
    return rasters.from_embeddings(spark, sf_dir, 16, 8)


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.colour_from_embeddings(spark, sf_dir)


def mask16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px16(spark, sf_dir).withColumn("v", F.col("v") >= 4)


def _sql(side: int, levels: int) -> str:
    return f"""SELECT ((vec_id // {side}) * {64 // side} + c // {side})::BIGINT AS image_id, (vec_id % {side})::INT AS y, (c % {side})::INT AS x,
  (greatest(0, least(255, floor(e::DOUBLE * 640 + 128)))::INT // {256 // levels})::INT AS v
  FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS c, unnest(embedding) AS e FROM embeddings WHERE vec_id IS NOT NULL)"""


P64, P16 = _sql(64, 256), _sql(16, 8)
RGB = f"""SELECT image_id, y, (x // 3)::INT AS x, max(v) FILTER (x % 3 = 0) AS r, max(v) FILTER (x % 3 = 1) AS g, max(v) FILTER (x % 3 = 2) AS b FROM ({P64}) WHERE x < 63 GROUP BY image_id, y, x // 3"""


def off(offsets) -> str:
    """A table of offsets."""
    return f"off(dy, dx) AS (VALUES {', '.join(f'({y}, {x})' for y, x in offsets)})"


def cc(start: str, offsets) -> str:
    """CTEs (after ``WITH RECURSIVE``) that label sites of ``start`` (image_id, lev, y, x): cc(image_id, lev, y, x, r), r the smallest flat index of the component."""
    return f"""{off(offsets)}, base AS MATERIALIZED (SELECT image_id, lev, y, x, (y * 16 + x)::BIGINT AS r FROM ({start})),
cc(image_id, lev, y, x, r) USING KEY (image_id, lev, y, x) AS (
  SELECT * FROM base UNION
  SELECT n.image_id, n.lev, n.y, n.x, min(f.r) AS r FROM cc f, off o, recurring.cc n
  WHERE n.image_id = f.image_id AND n.lev = f.lev AND n.y = f.y + o.dy AND n.x = f.x + o.dx AND f.r < n.r GROUP BY ALL)"""


#: The max-tree of px16 by level-set components: nodes, pixel map, ancestors.
MAX_TREE = f"""WITH RECURSIVE px AS MATERIALIZED ({P16}), {cc("SELECT image_id, lev, y, x FROM px JOIN (SELECT unnest(range(0, 8)) AS lev) ON v >= lev", ((-1, 0), (0, -1), (0, 1), (1, 0)))},
c AS MATERIALIZED (SELECT * FROM cc),
nd AS (SELECT image_id, lev, r, min(y * 16 + x) AS node_id FROM c JOIN px USING (image_id, y, x) WHERE v = lev GROUP BY ALL),
ar AS (SELECT image_id, lev, r, count(*) AS area FROM c GROUP BY ALL),
nodes0 AS MATERIALIZED (SELECT image_id, lev, r, node_id, area FROM nd JOIN ar USING (image_id, lev, r)),
pmap AS MATERIALIZED (SELECT px.image_id, px.y, px.x, px.v, node_id, area FROM px JOIN c ON c.image_id = px.image_id AND c.y = px.y AND c.x = px.x AND c.lev = px.v JOIN nodes0 n ON n.image_id = c.image_id AND n.lev = c.lev AND n.r = c.r),
up AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY image_id, node_id ORDER BY anc_level DESC) - 1 AS dist FROM (
  SELECT DISTINCT p.image_id, p.node_id, p.v AS level, p.area AS area, n.node_id AS anc, n.lev AS anc_level, n.area AS anc_area
  FROM pmap p JOIN c USING (image_id, y, x) JOIN nodes0 n USING (image_id, lev, r))),
nodes AS MATERIALIZED (SELECT image_id, node_id, any_value(level) AS level, any_value(area) AS area, max(dist) AS depth, max(anc) FILTER (dist = 1) AS parent_id FROM up GROUP BY ALL)
"""


#: Zones of px16 linked by steps of at most ``lev``: cc(image_id, lev, y, x, r), r the smallest flat index.
ZONES = f"""WITH RECURSIVE px AS MATERIALIZED ({P16}), {off(((-1, 0), (0, -1), (0, 1), (1, 0)))},
e AS MATERIALIZED (SELECT p.image_id, p.y, p.x, q.y AS qy, q.x AS qx, abs(p.v - q.v) AS w FROM px p, off o, px q WHERE q.image_id = p.image_id AND q.y = p.y + o.dy AND q.x = p.x + o.dx),
cc(image_id, lev, y, x, r) USING KEY (image_id, lev, y, x) AS (
  SELECT image_id, lev, y, x, (y * 16 + x)::BIGINT FROM px, (SELECT unnest(range(0, 8)) AS lev) UNION
  SELECT n.image_id, n.lev, n.y, n.x, min(f.r) AS r FROM cc f, e, recurring.cc n
  WHERE e.image_id = f.image_id AND e.y = f.y AND e.x = f.x AND e.w <= f.lev AND n.image_id = f.image_id AND n.lev = f.lev AND n.y = e.qy AND n.x = e.qx AND f.r < n.r GROUP BY ALL)"""
