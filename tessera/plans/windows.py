"""Neighbourhood aggregates, kernels and structural morphology."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import neighbours as nb
from tessera.plans.fixtures import P16, P64, RGB, off, px16, px64, rgb
from tessera.plans.registry import query

S = "image_id y x v"
RECT = nb.rectangle(3, 3)


def _window(p: str, offsets, agg: str, out: str = "v") -> str:
    """SQL of an aggregate over the window of each site."""
    return f"""SELECT p.image_id, p.y, p.x, {agg} AS {out} FROM p, off o, p q WHERE q.image_id = p.image_id AND q.y = p.y + o.dy AND q.x = p.x + o.dx GROUP BY p.image_id, p.y, p.x"""


def _with(src: str, offsets) -> str:
    return f"WITH p AS MATERIALIZED ({src}), {off(offsets)} "


def _morph(src: str, *steps: tuple[str, tuple]) -> str:
    """SQL of window minima and maxima one after the other, the last as v."""
    out = f"WITH s0 AS MATERIALIZED ({src})"
    for k, (f, se) in enumerate(steps):
        out += f", o{k}(dy, dx) AS (VALUES {', '.join(f'({y}, {x})' for y, x in se)}), s{k + 1} AS MATERIALIZED (SELECT p.image_id, p.y, p.x, {f}(q.v) AS v FROM s{k} p, o{k} o, s{k} q WHERE q.image_id = p.image_id AND q.y = p.y + o.dy AND q.x = p.x + o.dx GROUP BY p.image_id, p.y, p.x)"
    return out


@query("gradient_beucher", S, _morph(P64, ("max", RECT)) + f", m AS (SELECT * FROM s1), lo AS (SELECT p.image_id, p.y, p.x, min(q.v) AS v FROM s0 p, o0 o, s0 q WHERE q.image_id = p.image_id AND q.y = p.y + o.dy AND q.x = p.x + o.dx GROUP BY p.image_id, p.y, p.x) SELECT m.image_id, m.y, m.x, m.v - lo.v AS v FROM m JOIN lo USING (image_id, y, x)")
def _(s, d):
    return nb.gradient(px64(s, d), RECT)


@query("gradient_external", S, _morph(P64, ("max", RECT)) + " SELECT image_id, y, x, s1.v - s0.v AS v FROM s1 JOIN s0 USING (image_id, y, x)")
def _(s, d):
    return nb.external_gradient(px64(s, d), RECT)


for _name, _se in (("rectangle_3x3", RECT), ("rectangle_5x7", nb.rectangle(5, 7)), ("ball_2", nb.ball(2)), ("c4", nb.C4), ("c8", nb.C8), ("winc4", nb.WINC4), ("winc8", nb.WINC8), ("line_v", nb.WINC2_V), ("line_h", nb.WINC2_H)):
    query(f"dilate_{_name}", S, _morph(P64, ("max", _se)) + " SELECT * FROM s1")(lambda s, d, se=_se: nb.dilate(px64(s, d), se))

for _name, _se in (("rectangle_3x3", RECT), ("ball_2", nb.ball(2))):
    query(f"erode_{_name}", S, _morph(P64, ("min", _se)) + " SELECT * FROM s1")(lambda s, d, se=_se: nb.erode(px64(s, d), se))
    query(f"opening_{_name}", S, _morph(P64, ("min", _se), ("max", _se)) + " SELECT * FROM s2")(lambda s, d, se=_se: nb.opening(px64(s, d), se))
    query(f"closing_{_name}", S, _morph(P64, ("max", _se), ("min", _se)) + " SELECT * FROM s2")(lambda s, d, se=_se: nb.closing(px64(s, d), se))


_WIDE = "max(v) OVER (PARTITION BY image_id, {} ORDER BY {} RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS v"


@query("dilate_rectangle_15x15", S, f"SELECT image_id, y, x, {_WIDE.format('x', 'y')} FROM (SELECT image_id, y, x, {_WIDE.format('y', 'x')} FROM ({P64}))")
def _(s, d):
    return nb.dilate(px64(s, d), nb.rectangle(15, 15))


@query("dilate_binary", "image_id y x v:b", _morph(f"SELECT image_id, y, x, v > 220 AS v FROM ({P64})", ("bool_or", nb.ball(1))) + " SELECT * FROM s1")
def _(s, d):
    return nb.dilate(px64(s, d).withColumn("v", F.col("v") > 220), nb.ball(1))


@query("dilate_under_mask", S, _morph(f"SELECT * FROM ({P64}) WHERE (y + x) % 3 > 0", ("max", nb.C8)) + " SELECT s0.image_id, s0.y, s0.x, s1.v FROM s0 LEFT JOIN s1 USING (image_id, y, x)")
def _(s, d):
    return nb.dilate(px64(s, d).where((F.col("y") + F.col("x")) % 3 > 0), nb.C8)


@query("dilate_reversed_order", S, _morph(P64, ("min", nb.C8)) + " SELECT * FROM s1")
def _(s, d):
    return nb.dilate(px64(s, d), nb.C8, order="greater")


@query("dilate_rgb", "image_id y x r g b", f"WITH p AS MATERIALIZED ({RGB}), {off(RECT)} SELECT p.image_id, p.y, p.x, max(q.r) AS r, max(q.g) AS g, max(q.b) AS b FROM p, off o, p q WHERE q.image_id = p.image_id AND q.y = p.y + o.dy AND q.x = p.x + o.dx GROUP BY p.image_id, p.y, p.x")
def _(s, d):
    return nb.dilate(rgb(s, d), RECT, ["r", "g", "b"])


@query("window_sum_count", "image_id y x total n", _with(P64, nb.ball(2)) + "SELECT p.image_id, p.y, p.x, sum(q.v) AS total, count(*) AS n FROM p, off o, p q WHERE q.image_id = p.image_id AND q.y = p.y + o.dy AND q.x = p.x + o.dx GROUP BY p.image_id, p.y, p.x")
def _(s, d):
    return nb.window(px64(s, d), nb.ball(2), {"total": F.sum("v"), "n": F.count("v")})


@query("kernel_max_difference", S, _with(P64, nb.C4) + "SELECT p.image_id, p.y, p.x, max(abs(q.v - p.v)) AS v FROM p, off o, p q WHERE q.image_id = p.image_id AND q.y = p.y + o.dy AND q.x = p.x + o.dx GROUP BY p.image_id, p.y, p.x")
def _(s, d):
    return nb.Kernel(F.max, lambda p, n: F.abs(n["v"] - p["v"])).execute(px64(s, d), nb.C4)


@query("kernel_weighted_sum", S, _with(f"SELECT *, (y + x)::INT AS w FROM ({P64})", nb.C8) + "SELECT p.image_id, p.y, p.x, sum(q.v * q.w - p.v) AS v FROM p, off o, p q WHERE q.image_id = p.image_id AND q.y = p.y + o.dy AND q.x = p.x + o.dx GROUP BY p.image_id, p.y, p.x")
def _(s, d):
    return nb.Kernel(F.sum, lambda p, n: n["v"] * n["w"] - p["v"]).execute(px64(s, d).withColumn("w", F.col("y") + F.col("x")), nb.C8)


@query("grid_edges", "image_id y x qy qx w", f"WITH p AS ({P64}) SELECT p.image_id, p.y, p.x, q.y AS qy, q.x AS qx, abs(p.v - q.v) AS w FROM p JOIN (VALUES (0, 1), (1, 0)) o(dy, dx) ON true JOIN p q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx")
def _(s, d):
    return nb.edges(px64(s, d)).select("image_id", "y", "x", "qy", "qx", F.abs(F.col("v") - F.col("q_v")).alias("w"))


@query("curvature", "image_id y x v:d", f"""WITH p AS ({P64}), n AS (SELECT p.image_id, p.y, p.x, p.v, max(q.v) FILTER (dy = -1 AND dx = 0) AS u, max(q.v) FILTER (dy = 1 AND dx = 0) AS d, max(q.v) FILTER (dy = 0 AND dx = -1) AS l, max(q.v) FILTER (dy = 0 AND dx = 1) AS r,
max(q.v) FILTER (dy = -1 AND dx = -1) AS ul, max(q.v) FILTER (dy = -1 AND dx = 1) AS ur, max(q.v) FILTER (dy = 1 AND dx = -1) AS dl, max(q.v) FILTER (dy = 1 AND dx = 1) AS dr
FROM p, (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) o(dy, dx), p q WHERE q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY ALL),
g AS (SELECT image_id, y, x, (r - l) / 2.0::DOUBLE AS ux, (d - u) / 2.0::DOUBLE AS uy, (r + l - 2 * v)::DOUBLE AS uxx, (d + u - 2 * v)::DOUBLE AS uyy, (dr + ul - dl - ur) / 4.0::DOUBLE AS uxy FROM n WHERE u IS NOT NULL AND d IS NOT NULL AND l IS NOT NULL AND r IS NOT NULL AND ul IS NOT NULL AND ur IS NOT NULL AND dl IS NOT NULL AND dr IS NOT NULL)
SELECT image_id, y, x, CASE WHEN ux * ux + uy * uy > 0 THEN abs(uxx * uy * uy - 2 * uxy * ux * uy + uyy * ux * ux) / (sqrt(ux * ux + uy * uy) * (ux * ux + uy * uy)) ELSE 0 END AS v FROM g""")
def _(s, d):
    far = nb.scatter(px64(s, d), nb.C8, ["v"])
    at = lambda dy, dx: F.max(F.when((F.col("dy") == dy) & (F.col("dx") == dx), F.col("v")))
    names = {"u": (-1, 0), "d": (1, 0), "l": (0, -1), "r": (0, 1), "ul": (-1, -1), "ur": (-1, 1), "dl": (1, -1), "dr": (1, 1)}
    n = far.groupBy("image_id", "y", "x").agg(*[at(*o).alias(k) for k, o in names.items()]).dropna().join(px64(s, d), ["image_id", "y", "x"])
    c = F.col
    ux, uy = (c("r") - c("l")) / 2.0, (c("d") - c("u")) / 2.0
    uxx, uyy, uxy = (c("r") + c("l") - 2 * c("v")).cast("double"), (c("d") + c("u") - 2 * c("v")).cast("double"), (c("dr") + c("ul") - c("dl") - c("ur")) / 4.0
    den = ux * ux + uy * uy
    return n.select("image_id", "y", "x", F.when(den > 0, F.abs(uxx * uy * uy - 2 * uxy * ux * uy + uyy * ux * ux) / (F.sqrt(den) * den)).otherwise(0.0).alias("v"))


@query("opening_top_hat_count", "image_id n", _morph(P16, ("min", nb.WINC4), ("max", nb.WINC4)) + " SELECT s0.image_id, count(*) FILTER (s0.v > s2.v) AS n FROM s0 JOIN s2 USING (image_id, y, x) GROUP BY 1")
def _(s, d):
    p = px16(s, d)
    o = nb.opening(p, nb.WINC4).withColumnRenamed("v", "o")
    return p.join(o, ["image_id", "y", "x"]).groupBy("image_id").agg(F.count_if(F.col("v") > F.col("o")).alias("n"))
