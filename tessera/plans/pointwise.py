"""Projections, views, filters, joins, set operations, sorts and colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import values as val
from tessera.operators import views
from tessera.plans.fixtures import P16, P64, RGB, px16, px64, rgb
from tessera.plans.registry import query
from tessera.sources import rasters

S = "image_id y x v"


@query("image_from_table", S, P64)
def _(s, d):
    return px64(s, d)


@query("image_from_buffer", S, P64)
def _(s, d):
    rows = px64(s, d).groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda r: r["v"]).alias("buf"))
    return rasters.from_buffer(rows.withColumn("ncols", F.lit(64)), "buf")


@query("constant_image", S, f"SELECT image_id, y, x, 7 AS v FROM ({P64})")
def _(s, d):
    return rasters.constant(px64(s, d), 7)


@query("iota", S, f"SELECT image_id, y, x, row_number() OVER (PARTITION BY image_id ORDER BY y, x) + 4 AS v FROM ({P64})")
def _(s, d):
    return rasters.iota(px64(s, d), 5)


@query("imprint", "image_id y line:s", f"""WITH p AS ({P16}), w AS (SELECT image_id, max(length(v::VARCHAR)) AS w FROM p GROUP BY 1)
SELECT image_id, y, string_agg(lpad(v::VARCHAR, w::INT, ' '), ' ' ORDER BY x) AS line FROM p JOIN w USING (image_id) GROUP BY ALL""")
def _(s, d):
    return rasters.imprint(px16(s, d))


@query("bounds", "image_id y0 x0 y1 x1", f"SELECT image_id, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1 FROM ({P64}) GROUP BY 1")
def _(s, d):
    return rasters.bounds(px64(s, d))


@query("transform_square", S, f"SELECT image_id, y, x, v * v AS v FROM ({P64})")
def _(s, d):
    return views.transform(px64(s, d), val.sqr)


@query("unary_minus_not", "image_id y x m n:b", f"SELECT image_id, y, x, -v AS m, NOT (v >= 128) AS n FROM ({P64})")
def _(s, d):
    return px64(s, d).select("image_id", "y", "x", (-F.col("v")).alias("m"), (~(F.col("v") >= 128)).alias("n"))


@query("binary_arithmetic", "image_id y x a s m q r", f"""WITH p AS ({P64}), z AS (SELECT p.image_id, p.y, p.x, p.v AS u, t.v AS w FROM p JOIN p t ON p.image_id = t.image_id AND p.y = t.x AND p.x = t.y)
SELECT image_id, y, x, (u + w) % 256 AS a, u - w AS s, u * w AS m, trunc((u - 128) / (w + 1))::BIGINT AS q, (u - 128) % (w + 1) AS r FROM z""")
def _(s, d):
    p = px64(s, d)
    z = views.zip_images(p, views.transpose(p))
    u, w = F.col("v0"), F.col("v1")
    return z.select("image_id", "y", "x", val.wrap(u + w, val.UINT8).alias("a"), (u - w).alias("s"), (u * w).alias("m"), val.int_div(u - 128, w + 1).alias("q"), val.int_mod(u - 128, w + 1).alias("r"))


@query("comparisons", "image_id y x lt:b le:b eq:b ne:b", f"""WITH p AS ({P64}) SELECT p.image_id, p.y, p.x, p.v < t.v AS lt, p.v <= t.v AS le, p.v = t.v AS eq, p.v <> t.v AS ne FROM p JOIN p t ON p.image_id = t.image_id AND p.y = t.x AND p.x = t.y""")
def _(s, d):
    p = px64(s, d)
    u, w = F.col("v0"), F.col("v1")
    return views.zip_images(p, views.transpose(p)).select("image_id", "y", "x", (u < w).alias("lt"), (u <= w).alias("le"), (u == w).alias("eq"), (u != w).alias("ne"))


@query("min_max_inf_sup", "image_id y x lo hi i0 s0", f"""WITH p AS ({RGB}) SELECT image_id, y, x, least(r, g, b) AS lo, greatest(r, g, b) AS hi, least(r, 100) AS i0, greatest(g, 100) AS s0 FROM p""")
def _(s, d):
    return rgb(s, d).select("image_id", "y", "x", val.vmin(["r", "g", "b"]).alias("lo"), val.vmax(["r", "g", "b"]).alias("hi"), F.least("r", F.lit(100)).alias("i0"), F.greatest("g", F.lit(100)).alias("s0"))


@query("logical_and_or", "image_id y x a:b o:b", f"SELECT image_id, y, x, (v > 100) AND (v < 200) AS a, (v <= 100) OR (v >= 200) AS o FROM ({P64})")
def _(s, d):
    v = F.col("v")
    return px64(s, d).select("image_id", "y", "x", ((v > 100) & (v < 200)).alias("a"), ((v <= 100) | (v >= 200)).alias("o"))


@query("vector_norms", "image_id y x l0 l1 l2:d l2s linf l3:d total product", f"""SELECT image_id, y, x, least(abs(r - 128), abs(g - 128), abs(b - 128)) AS l0, abs(r - 128) + abs(g - 128) + abs(b - 128) AS l1,
sqrt((r - 128) ** 2 + (g - 128) ** 2 + (b - 128) ** 2) AS l2, (r - 128) * (r - 128) + (g - 128) * (g - 128) + (b - 128) * (b - 128) AS l2s, greatest(abs(r - 128), abs(g - 128), abs(b - 128)) AS linf,
(abs(r - 128) ** 3.0 + abs(g - 128) ** 3.0 + abs(b - 128) ** 3.0) ** (1 / 3.0) AS l3, r + g + b AS total, r * g * b AS product FROM ({RGB})""")
def _(s, d):
    x = [F.col(c) - 128 for c in "rgb"]
    return rgb(s, d).select("image_id", "y", "x", val.l0norm(x).alias("l0"), val.l1norm(x).alias("l1"), val.l2norm(x).alias("l2"), val.l2norm_sqr(x).alias("l2s"), val.linfnorm(x).alias("linf"), val.lpnorm(x, 3).alias("l3"), val.vsum(["r", "g", "b"]).alias("total"), val.vprod(["r", "g", "b"]).alias("product"))


@query("scalar_math", "image_id y x a s:d c:d p:d", f"SELECT image_id, y, x, abs(v - 128) AS a, sqrt(v) AS s, cbrt(v) AS c, pow(v, 1.5) AS p FROM ({P64})")
def _(s, d):
    v = F.col("v")
    return px64(s, d).select("image_id", "y", "x", F.abs(v - 128).alias("a"), F.sqrt(v).alias("s"), val.cbrt(v).alias("c"), F.pow(v, F.lit(1.5)).alias("p"))


@query("vector_distance", "image_id y x sq d:d", f"SELECT image_id, y, x, (r - 10) ** 2 + (g - 20) ** 2 + (b - 30) ** 2 AS sq, sqrt((r - 10) ** 2 + (g - 20) ** 2 + (b - 30) ** 2) AS d FROM ({RGB})")
def _(s, d):
    a, b = ["r", "g", "b"], [F.lit(10), F.lit(20), F.lit(30)]
    return rgb(s, d).select("image_id", "y", "x", val.l2dist_sqr(a, b).alias("sq"), val.l2dist(a, b).alias("d"))


@query("vector_orders", "image_id y x lex:b prod:b strict:b", f"""SELECT image_id, y, x, (r < 128) OR (r = 128 AND g < 128) OR (r = 128 AND g = 128 AND b < 128) AS lex, r <= 128 AND g <= 128 AND b <= 128 AS prod,
r <= 128 AND g <= 128 AND b <= 128 AND NOT (r = 128 AND g = 128 AND b = 128) AS strict FROM ({RGB})""")
def _(s, d):
    a, b = ["r", "g", "b"], [F.lit(128)] * 3
    return rgb(s, d).select("image_id", "y", "x", val.lex_less(a, b).alias("lex"), val.prod_less_equal(a, b).alias("prod"), val.prod_less(a, b).alias("strict"))


@query("cast_wrap", "image_id y x u s w", f"SELECT image_id, y, x, (v * 3) % 256 AS u, ((v * 3 + 128) % 256) - 128 AS s, (v * 1000) % 65536 AS w FROM ({P64})")
def _(s, d):
    v = F.col("v")
    return px64(s, d).select("image_id", "y", "x", val.wrap(v * 3, val.UINT8).alias("u"), val.wrap(v * 3, val.INT8).alias("s"), val.wrap(v * 1000, val.UINT16).alias("w"))


@query("channel_write", "image_id y x r g b", f"SELECT image_id, y, x, 0 AS r, g, b FROM ({RGB})")
def _(s, d):
    p = rgb(s, d).select("image_id", "y", "x", F.struct("r", "g", "b").alias("v"))
    return p.withColumn("v", F.col("v").withField("r", F.lit(0))).select("image_id", "y", "x", "v.*")


@query("decompose_channels", "image_id y x c v", f"SELECT image_id, y, x, unnest([0, 1, 2]) AS c, unnest([r, g, b]) AS v FROM ({RGB})")
def _(s, d):
    return rgb(s, d).select("image_id", "y", "x", F.posexplode(F.array("r", "g", "b")).alias("c", "v"))


@query("recompose_channels", "image_id y x r g b", RGB)
def _(s, d):
    long = rgb(s, d).select("image_id", "y", "x", F.posexplode(F.array("r", "g", "b")).alias("c", "v"))
    return long.groupBy("image_id", "y", "x").agg(*[F.max(F.when(F.col("c") == k, F.col("v"))).alias(n) for k, n in enumerate("rgb")])


@query("where_sites", "image_id y x", f"SELECT image_id, y, x FROM ({P64}) WHERE v > 200")
def _(s, d):
    return views.where(px64(s, d), F.col("v") > 200)


@query("filter_pixels", S, f"SELECT * FROM ({P64}) WHERE v % 2 = 0")
def _(s, d):
    return px64(s, d).where(F.col("v") % 2 == 0)


@query("sub_image_strided_box", S, f"SELECT * FROM ({P64}) WHERE y >= 2 AND y < 50 AND x >= 1 AND x < 60 AND (y - 2) % 2 = 0 AND (x - 1) % 3 = 0")
def _(s, d):
    return views.box(px64(s, d), 2, 1, 50, 60, 2, 3)


@query("sub_image_mask", S, f"WITH p AS ({P64}) SELECT * FROM p SEMI JOIN (SELECT image_id, x AS y, y AS x FROM p WHERE v > 128) m USING (image_id, y, x)")
def _(s, d):
    p = px64(s, d)
    return views.restrict(p, views.where(views.transpose(p), F.col("v") > 128))


@query("sub_image_complement", S, f"WITH p AS ({P64}) SELECT * FROM p ANTI JOIN (SELECT image_id, x AS y, y AS x FROM p WHERE v > 128) m USING (image_id, y, x)")
def _(s, d):
    p = px64(s, d)
    return views.exclude(p, views.where(views.transpose(p), F.col("v") > 128))


@query("extend_by_value", S, f"""WITH p AS ({P16}) SELECT i.image_id, yy AS y, xx AS x, coalesce(v, 9) AS v FROM (SELECT image_id, min(y) - 1 AS y0, max(y) + 1 AS y1, min(x) - 1 AS x0, max(x) + 1 AS x1 FROM p GROUP BY 1) i,
range(-1, 17) a(yy), range(-1, 17) b(xx) LEFT JOIN p ON p.image_id = i.image_id AND p.y = yy AND p.x = xx WHERE yy BETWEEN y0 AND y1 AND xx BETWEEN x0 AND x1""")
def _(s, d):
    return views.pad(px16(s, d), 1, "value", 9)


@query("extend_mirror", S, f"""WITH p AS ({P16}), i AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM p GROUP BY 1),
e AS (SELECT image_id, h, w, yy, xx, (yy + 4 * h) % (2 * h) AS qy, (xx + 4 * w) % (2 * w) AS qx FROM i, range(-3, 19) a(yy), range(-3, 19) b(xx) WHERE yy < h + 3 AND xx < w + 3)
SELECT e.image_id, yy AS y, xx AS x, v FROM e JOIN p ON p.image_id = e.image_id AND p.y = (CASE WHEN qy < h THEN qy ELSE 2 * h - 1 - qy END) AND p.x = (CASE WHEN qx < w THEN qx ELSE 2 * w - 1 - qx END)""")
def _(s, d):
    return views.pad(px16(s, d), 3, "mirror")


@query("fill_on_view", S, f"SELECT image_id, y, x, CASE WHEN v > 128 THEN 0 ELSE v END AS v FROM ({P64})")
def _(s, d):
    return views.fill(px64(s, d), 0, F.col("v") > 128)


@query("transpose", S, f"SELECT image_id, x AS y, y AS x, v FROM ({P64})")
def _(s, d):
    return views.transpose(px64(s, d))


@query("translate_domain", S, f"SELECT image_id, y + 3 AS y, x - 2 AS x, v FROM ({P64})")
def _(s, d):
    return views.translate(px64(s, d), 3, -2)


@query("line_of_sites", S, f"SELECT * FROM ({P64}) WHERE (y, x) IN ((0, 0), (1, 1), (1, 2), (2, 3), (3, 4), (3, 5), (4, 6))")
def _(s, d):
    return views.line(px64(s, d), 0, 0, 4, 6)


@query("stretch", S, f"""WITH p AS ({P16}), r AS (SELECT image_id, min(v) AS m, max(v) AS n FROM p GROUP BY 1)
SELECT image_id, y, x, CASE WHEN n > m THEN trunc((v - m) * (255.0::DOUBLE / (n - m)))::INT ELSE 0 END AS v FROM p JOIN r USING (image_id)""")
def _(s, d):
    return views.stretch(px16(s, d), 0, 255)


@query("range_adaptors", "image_id y evens total back dot", f"""WITH l AS (SELECT image_id, y, list(v ORDER BY x) AS a FROM ({P16}) GROUP BY ALL)
SELECT image_id, y, len(list_filter(a, lambda t: t % 2 = 0)) AS evens, list_sum(list_transform(a, lambda t: t + 1)) AS total, a[len(a)] AS back, list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i] * a[len(a) + 1 - i])) AS dot FROM l""")
def _(s, d):
    line = px16(s, d).groupBy("image_id", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda r: r["v"]).alias("a"))
    add = lambda acc, t: acc + t
    back = F.reverse("a")
    return line.select("image_id", "y", F.size(F.filter("a", lambda t: t % 2 == 0)).alias("evens"), F.aggregate(F.transform("a", lambda t: t + 1), F.lit(0), add).alias("total"), F.element_at(back, 1).alias("back"), F.aggregate(F.zip_with("a", back, lambda t, u: t * u), F.lit(0), add).alias("dot"))


@query("zip_three", "image_id y x v0 v1 v2", f"WITH p AS ({P64}) SELECT p.image_id, p.y, p.x, p.v AS v0, t.v AS v1, p.v * 2 AS v2 FROM p JOIN p t ON p.image_id = t.image_id AND p.y = t.x AND p.x = t.y")
def _(s, d):
    p = px64(s, d)
    return views.zip_images(p, views.transpose(p), views.transform(p, lambda v: v * 2))


@query("paste", S, f"WITH p AS ({P64}) SELECT image_id, y, x, CASE WHEN y < 20 AND x >= 10 THEN 255 - v ELSE v END AS v FROM p")
def _(s, d):
    p = px64(s, d)
    return views.paste(views.transform(views.box(p, 0, 10, 20, 64), lambda v: 255 - v), p)


@query("equal_images", "image_id equal:b", f"WITH p AS ({P16}) SELECT p.image_id, bool_and(coalesce(p.v = t.v, false)) AS equal FROM p FULL JOIN (SELECT image_id, x AS y, y AS x, v FROM p) t ON p.image_id = t.image_id AND p.y = t.y AND p.x = t.x WHERE p.image_id IS NOT NULL GROUP BY 1")
def _(s, d):
    p = px16(s, d)
    return views.equal(p, views.transpose(p))


@query("mask_set_operations", "image_id y x", f"WITH p AS ({P64}) (SELECT image_id, y, x FROM p WHERE v > 100 INTERSECT SELECT image_id, y, x FROM p WHERE v < 200) UNION (SELECT image_id, y, x FROM p WHERE v = 0 EXCEPT SELECT image_id, y, x FROM p WHERE x > 40)")
def _(s, d):
    p, v = px64(s, d), F.col("v")
    both = views.where(p, v > 100).intersect(views.where(p, v < 200))
    return both.unionByName(views.where(p, v == 0).subtract(views.where(p, F.col("x") > 40))).distinct()


@query("sort_sites", "image_id y x v rank", f"SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v, y, x) - 1 AS rank FROM ({P64})")
def _(s, d):
    return views.ranked(px64(s, d))


@query("sort_indexes_descending", "image_id y x v rank", f"SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v DESC, y, x) - 1 AS rank FROM ({P64})")
def _(s, d):
    return views.ranked(px64(s, d), True)


@query("k_largest", "image_id y k v", f"SELECT image_id, y, k, v FROM (SELECT image_id, y, v, row_number() OVER (PARTITION BY image_id, y ORDER BY v DESC) - 1 AS k FROM ({P64})) WHERE k < 5")
def _(s, d):
    return views.k_most(px64(s, d), ["image_id", "y"], "v", 5).select("image_id", "y", F.posexplode("most").alias("k", "v"))


@query("border_median", "image_id median", f"""WITH p AS ({P64}), e AS (SELECT image_id, max(y) AS y1, max(x) AS x1 FROM p GROUP BY 1), l AS (SELECT image_id, list_sort(list(v)) AS a FROM p JOIN e USING (image_id) WHERE y = 0 OR x = 0 OR y = y1 OR x = x1 GROUP BY 1)
SELECT image_id, (a[(len(a) + 1) // 2] + a[len(a) // 2 + 1]) // 2 AS median FROM l""")
def _(s, d):
    return views.border_median(px64(s, d))


@query("rgb_to_xyz", "image_id y x a:d b:d c:d", f"SELECT image_id, y, x, 0.4125::DOUBLE * r + 0.3576::DOUBLE * g + 0.1805::DOUBLE * b AS a, 0.2127::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS b, 0.0193::DOUBLE * r + 0.1192::DOUBLE * g + 0.9505::DOUBLE * b AS c FROM ({RGB})")
def _(s, d):
    p = rgb(s, d)
    return p.select("image_id", "y", "x", *[c.alias(n) for n, c in zip("abc", val.rgb_to_xyz("r", "g", "b"))])


_T = lambda row, w: f"(({row[0]}::DOUBLE * r + {row[1]}::DOUBLE * g + {row[2]}::DOUBLE * b) / ({w}::DOUBLE * 255))"
_F = lambda t: f"(CASE WHEN {t} > 0.008856::DOUBLE THEN cbrt({t}) ELSE {t} * 7.787::DOUBLE + 16.0::DOUBLE / 116 END)"
_X, _Y, _Z = (_F(_T(row, w)) for row, w in zip(val.XYZ, val.WHITE))


@query("rgb_to_lab", "image_id y x l:d a:d b:d", f"SELECT image_id, y, x, 116 * {_Y} - 16 AS l, 500 * ({_X} - {_Y}) AS a, 200 * ({_Y} - {_Z}) AS b FROM ({RGB})")
def _(s, d):
    p = rgb(s, d)
    return p.select("image_id", "y", "x", *[c.alias(n) for n, c in zip("lab", val.rgb_to_lab("r", "g", "b"))])


_LIN = ", ".join(f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045::DOUBLE THEN {c} / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow(({c} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END AS {c}" for c in "rgb")
_TG = lambda row, w: f"(({row[0]}::DOUBLE * r + {row[1]}::DOUBLE * g + {row[2]}::DOUBLE * b) / {w}::DOUBLE)"
_FG = lambda t: f"(CASE WHEN {t} > 0.008856::DOUBLE THEN cbrt({t}) ELSE ({t} * 903.3::DOUBLE + 16) / 116 END)"
_XG, _YG, _ZG = (_FG(_TG(row, w)) for row, w in zip(val.XYZ_LINEAR, val.WHITE_LINEAR))


@query("rgb_to_lab_gamma", "image_id y x l:d a:d b:d", f"SELECT image_id, y, x, 116 * {_YG} - 16 AS l, 500 * ({_XG} - {_YG}) AS a, 200 * ({_YG} - {_ZG}) AS b FROM (SELECT image_id, y, x, {_LIN} FROM ({RGB}))")
def _(s, d):
    return rgb(s, d).select("image_id", "y", "x", *[c.alias(n) for n, c in zip("lab", val.rgb_to_lab_gamma("r", "g", "b"))])


@query("lab_round_trip", "image_id y x r g b")
def _(s, d):
    p = rgb(s, d).select("image_id", "y", "x", *[c.alias(n) for n, c in zip("lab", val.rgb_to_lab("r", "g", "b"))])
    return p.select("image_id", "y", "x", *[c.alias(n) for n, c in zip("rgb", val.lab_to_rgb("l", "a", "b"))])


@query("rgb_to_lsh", "image_id y x l s h", f"""WITH p AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo, r + g + b - greatest(r, g, b) - least(r, g, b) AS med, (r + g + b) / 3.0::DOUBLE AS lum FROM ({RGB})),
q AS (SELECT *, CASE WHEN lum > med THEN hi - lum ELSE lum - lo END * 1.5::DOUBLE AS sat, CASE WHEN r < g THEN (CASE WHEN g < b THEN 3 WHEN b < r THEN 1 ELSE 2 END) WHEN b < g THEN 0 WHEN r < b THEN 4 ELSE 5 END AS k FROM p)
SELECT image_id, y, x, floor(lum) AS l, floor(sat) AS s, CASE WHEN hi > lo THEN floor((k + 0.5::DOUBLE - (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * (hi + lo - 2 * med) / (2 * sat)) * 42)::INT % 252 ELSE 0 END AS h FROM q""")
def _(s, d):
    return rgb(s, d).select("image_id", "y", "x", *[c.alias(n) for n, c in zip("lsh", val.rgb_to_lsh("r", "g", "b"))])


@query("rgb_to_grey", "image_id y x v m", f"SELECT image_id, y, x, floor(r * 0.2989::DOUBLE + g * 0.5870::DOUBLE + b * 0.1140::DOUBLE) AS v, (r + g + b) // 3 AS m FROM ({RGB})")
def _(s, d):
    return rgb(s, d).select("image_id", "y", "x", val.luma("r", "g", "b").alias("v"), val.luminance("r", "g", "b").alias("m"))


@query("path_costs", "image_id y x m e:d t c", f"""SELECT image_id, y, x, greatest(r, g, b) AS m, sqrt(r * r + g * g + b * b) AS e, r // 3 + g // 3 + b // 3 AS t,
CASE WHEN r <= 40 THEN 0 WHEN r >= 200 THEN 255 ELSE floor((r - 40) * 255.0::DOUBLE / 160) END AS c FROM ({RGB})""")
def _(s, d):
    from tessera.operators import distance

    return rgb(s, d).select("image_id", "y", "x", distance.path_cost(how="max").alias("m"), distance.path_cost(how="euclid").alias("e"), distance.path_cost(how="thirds").alias("t"), distance.contrast("r").alias("c"))


@query("faces_of_doubled_grid", "image_id face n", f"""WITH p AS ({P16}), e AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM p GROUP BY 1)
SELECT image_id, unnest([0, 1, 2]) AS face, unnest([(h - 1) * (w - 1), (h - 1) * w + h * (w - 1), h * w]) AS n FROM e""")
def _(s, d):
    from tessera.operators import khalimsky

    return khalimsky.immerse(px16(s, d)).groupBy("image_id", khalimsky.face().alias("face")).count().withColumnRenamed("count", "n")


@query("immersion_interval", "image_id y x lo hi", f"""WITH p AS ({P16}) SELECT image_id, y, x, min(v) AS lo, max(v) AS hi FROM (
SELECT image_id, 2 * y + dy AS y, 2 * x + dx AS x, v FROM p, range(-1, 2) a(dy), range(-1, 2) b(dx)) q JOIN (SELECT image_id, 2 * max(y) AS ym, 2 * max(x) AS xm FROM p GROUP BY 1) USING (image_id)
WHERE y BETWEEN 0 AND ym AND x BETWEEN 0 AND xm GROUP BY image_id, y, x""")
def _(s, d):
    from tessera.operators import khalimsky

    return khalimsky.immerse(px16(s, d))


@query("unimmerse", S, P16)
def _(s, d):
    from tessera.operators import khalimsky

    return khalimsky.unimmerse(khalimsky.immerse(px16(s, d)).select("image_id", "y", "x", F.col("lo").alias("v")))
