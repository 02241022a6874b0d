"""Accumulators over images, labels and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import accumulators as acc
from tessera.operators import views
from tessera.plans.fixtures import P16, P64, RGB, px16, px64, rgb
from tessera.plans.registry import query


@query("accumulate_count_sum_mean", "image_id count sum mean", f"SELECT image_id, count(*) AS count, sum(v) AS sum, sum(v) // count(*) AS mean FROM ({P64}) GROUP BY 1")
def _(s, d):
    return acc.accumulate(px64(s, d), acc.count & acc.sum_ & acc.mean_int)


@query("accumulate_min_max", "image_id min max", f"SELECT image_id, min(v) AS min, max(v) AS max FROM ({P64}) GROUP BY 1")
def _(s, d):
    return acc.accumulate(px64(s, d), acc.minmax)


@query("accumulate_vector_lexicographic", "image_id r g b", f"SELECT image_id, m.r AS r, m.g AS g, m.b AS b FROM (SELECT image_id, max({{'r': r, 'g': g, 'b': b}}) AS m FROM ({RGB}) GROUP BY 1)")
def _(s, d):
    return acc.accumulate(rgb(s, d), acc.max_, values=["r", "g", "b"]).select("image_id", "max.*")


@query("accumulate_inf_sup", "image_id i0 i1 s0 s1", f"SELECT image_id, min(y) AS i0, min(x) AS i1, max(y) AS s0, max(x) AS s1 FROM ({P64}) WHERE v > 250 GROUP BY 1")
def _(s, d):
    got = acc.accumulate(px64(s, d).where("v > 250"), acc.infsup, values=["y", "x"])
    return got.select("image_id", F.col("inf.c0").alias("i0"), F.col("inf.c1").alias("i1"), F.col("sup.c0").alias("s0"), F.col("sup.c1").alias("s1"))


@query("accumulate_all_any", "image_id all:b any:b", f"SELECT image_id, bool_and(v < 255) AS all, bool_or(v = 0) AS any FROM ({P64}) GROUP BY 1".replace("AS all", 'AS "all"').replace("AS any", 'AS "any"'))
def _(s, d):
    p = px64(s, d).select("image_id", (F.col("v") < 255).alias("p"), (F.col("v") == 0).alias("q"))
    return p.groupBy("image_id").agg(*acc.all_.columns(["p"]), *acc.any_.columns(["q"]))


@query("minimal_elements", "image_id r g", f"WITH p AS (SELECT DISTINCT image_id, r, g FROM ({RGB})) SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.image_id = p.image_id AND o.r <= p.r AND o.g <= p.g AND (o.r <> p.r OR o.g <> p.g))")
def _(s, d):
    return acc.skyline(rgb(s, d), ["image_id"], ["r", "g"])


@query("maximal_elements", "image_id r g b", f"WITH p AS (SELECT DISTINCT image_id, r, g, b FROM ({RGB})) SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.image_id = p.image_id AND o.r >= p.r AND o.g >= p.g AND o.b >= p.b AND (o.r <> p.r OR o.g <> p.g OR o.b <> p.b))")
def _(s, d):
    return acc.skyline(rgb(s, d), ["image_id"], ["r", "g", "b"], False)


@query("variance", "image_id variance:d", f"SELECT image_id, var_pop(v) AS variance FROM ({P64}) GROUP BY 1")
def _(s, d):
    return acc.accumulate(px64(s, d), acc.variance)


@query("vector_variance", "image_id variance:d", f"SELECT image_id, var_pop(r) + var_pop(g) + var_pop(b) AS variance FROM ({RGB}) GROUP BY 1")
def _(s, d):
    return acc.accumulate(rgb(s, d), acc.variance, values=["r", "g", "b"])


@query("covariance", "image_id rr:d rg:d gb:d", f"SELECT image_id, covar_pop(r, r) AS rr, covar_pop(r, g) AS rg, covar_pop(g, b) AS gb FROM ({RGB}) GROUP BY 1")
def _(s, d):
    c = acc.accumulate(rgb(s, d), acc.covariance, values=["r", "g", "b"])
    return c.select("image_id", F.col("covariance")[0][0].alias("rr"), F.col("covariance")[0][1].alias("rg"), F.col("covariance")[1][2].alias("gb"))


@query("moment_of_inertia", "image_id inertia:d", f"""SELECT image_id, (sum(y * y) - sum(y) * sum(y) / count(*)::DOUBLE + sum(x * x) - sum(x) * sum(x) / count(*)::DOUBLE) / (count(*) * count(*)) AS inertia FROM ({P64}) WHERE v > 128 GROUP BY 1""")
def _(s, d):
    return acc.accumulate(px64(s, d).where("v > 128"), acc.moment_of_inertia, values=["y", "x"])


@query("point_list", "image_id n first last", f"SELECT image_id, count(*) AS n, min(y * 64 + x) AS first, max(y * 64 + x) AS last FROM ({P64}) WHERE v > 250 GROUP BY 1")
def _(s, d):
    p = acc.accumulate(px64(s, d).where("v > 250"), acc.points, values=["y", "x"])
    at = lambda k: F.element_at("points", k)["y"] * 64 + F.element_at("points", k)["x"]
    return p.select("image_id", F.size("points").alias("n"), at(1).alias("first"), at(-1).alias("last"))


@query("accumulate_if", "image_id count sum", f"SELECT image_id, count(*) FILTER (v > 100) AS count, sum(v) FILTER (v > 100) AS sum FROM ({P64}) GROUP BY 1")
def _(s, d):
    return acc.accumulate(px64(s, d), acc.only(acc.count & acc.sum_, F.col("v") > 100))


@query("accumulator_state", "image_id n s1 s2", f"SELECT image_id, count(*) AS n, sum(v) AS s1, sum(v * v) AS s2 FROM ({P64}) GROUP BY 1")
def _(s, d):
    return acc.accumulate(px64(s, d), acc.state)


@query("fold_in_scan_order", "image_id acc", f"WITH l AS (SELECT image_id, list(v ORDER BY y, x) AS a FROM ({P16}) GROUP BY 1) SELECT image_id, list_reduce(a, lambda p, t: (p * 31 + t) % 65521, 7) AS acc FROM l")
def _(s, d):
    return acc.fold(px16(s, d), F.lit(7).cast("bigint"), lambda a, v: (a * 31 + v) % 65521)


@query("accumulate_by_label", "image_id label count sum", f"""WITH p AS (SELECT image_id, CASE WHEN v = 3 THEN 0 ELSE v END AS label, y + x AS v FROM ({P16})), m AS (SELECT image_id, max(label) AS n FROM p GROUP BY 1)
SELECT e.image_id, e.label, count(p.v) AS count, coalesce(sum(p.v), 0) AS sum FROM (SELECT image_id, unnest(range(0, n + 1)) AS label FROM m) e LEFT JOIN p USING (image_id, label) GROUP BY ALL""")
def _(s, d):
    p = px16(s, d).select("image_id", F.when(F.col("v") == 3, 0).otherwise(F.col("v")).cast("long").alias("label"), (F.col("y") + F.col("x")).alias("v"))
    return acc.by_label(p, acc.count & acc.sum_)


@query("sliding_infimum", "image_id y x inf", f"SELECT image_id, y, x, min(v) OVER (PARTITION BY image_id, y ORDER BY x RANGE BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS inf FROM ({P64})")
def _(s, d):
    return acc.sliding(px64(s, d), acc.inf, 2, 3)


@query("psnr", "image_id mse:d psnr:d", f"""WITH p AS ({RGB}), m AS (SELECT image_id, sum((r - r // 16 * 16) ** 2 + (g - g // 16 * 16) ** 2 + (b - b // 16 * 16) ** 2) / (3.0 * count(*)) AS mse FROM p GROUP BY 1)
SELECT image_id, mse, 20 * log10(255) - 10 * log10(mse) AS psnr FROM m""")
def _(s, d):
    p = rgb(s, d)
    q = p.select("image_id", "y", "x", *[(F.floor(F.col(c) / 16) * 16).cast("int").alias(c) for c in "rgb"])
    return acc.psnr(p, q, ["r", "g", "b"])


@query("histogram", "image_id v n", f"SELECT image_id, v, count(*) AS n FROM ({P64}) GROUP BY ALL")
def _(s, d):
    return px64(s, d).groupBy("image_id", "v").agg(F.count("*").alias("n"))


@query("class_distances", "same:b n mean:d", f"""WITH p AS (SELECT image_id, y, x, v, v // 86 AS label FROM ({P64}))
SELECT p.label = t.label AS same, count(*) AS n, avg(abs(p.v - t.v)) AS mean FROM p JOIN p t ON p.image_id = t.image_id AND p.y = t.x AND p.x = t.y WHERE p.y < p.x GROUP BY 1""")
def _(s, d):
    p = px64(s, d)
    z = views.zip_images(p, views.transpose(p)).where("y < x")
    lab = lambda c: F.floor(F.col(c) / 86)
    return z.groupBy((lab("v0") == lab("v1")).alias("same")).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("v0") - F.col("v1"))).alias("mean"))
