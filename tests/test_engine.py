"""Every query against its SQL on the small tables, and operators on odd inputs."""

import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import accumulators as acc
from tessera.functions import values as val
from tessera.operators import connected, khalimsky, neighbours, shapespace, trees, views
from tessera.plans import registry
from tessera.sources import pnm, rasters

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def norm(v):
    return f"{v:.4f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = sorted(tuple(map(norm, r)) for r in df.collect())
    assert rows
    if name in registry.SQL:
        got = duck.sql(registry.SQL[name])
        assert got.columns == df.columns
        assert sorted(tuple(map(norm, r)) for r in got.fetchall()) == rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def grid(df):
    rows = {}
    for r in df.collect():
        rows.setdefault(r.y, {})[r.x] = r[-1]
    return [[rows[y][x] for x in sorted(rows[y])] for y in sorted(rows)]


def test_wrap_and_division(spark):
    df = spark.createDataFrame([(300, -7, 2), (-1, 7, -2), (128, -8, 3)], "a int, p int, q int")
    got = df.select(val.wrap("a", val.UINT8), val.wrap("a", val.INT8), val.int_div("p", "q"), val.int_mod("p", "q")).collect()
    assert [tuple(r) for r in got] == [(44, 44, -3, -1), (255, -1, -3, 1), (128, -128, -2, -2)]
    assert val.UINT8.inf("greater") == 255 and val.INT16.min == -32768 and val.UINT64.spark == "decimal(20,0)"


def test_integer_mean_truncates(spark):
    px = rasters.from_rows(spark, [[10, 20, 40]])
    assert acc.accumulate(px, acc.mean_int).first().mean == 23


def test_empty_groups_and_tables(spark):
    none = rasters.from_rows(spark, [])
    assert acc.accumulate(none, acc.count & acc.sum_).count() == 0
    assert neighbours.dilate(none, neighbours.C8).count() == 0
    assert neighbours.gradient(none, neighbours.rectangle(3, 3)).count() == 0
    assert connected.blobs(none.withColumn("v", F.col("v") > 0)).count() == 0
    assert connected.blobs_tiled(none.withColumn("v", F.col("v") > 0)).count() == 0
    assert trees.closure(trees.nodes_of(trees.node_map(none))).count() == 0
    assert views.pad(none, 2, "mirror").count() == 0


def test_masked_domain(spark):
    px = rasters.from_rows(spark, [[1, 9, 1], [1, 1, 1]]).where("not (y = 0 and x = 1)")
    assert {(r.y, r.x): r.v for r in neighbours.dilate(px, neighbours.rectangle(3, 3)).collect()} == {(0, 0): 1, (0, 2): 1, (1, 0): 1, (1, 1): 1, (1, 2): 1}


def test_duality_and_order(spark):
    px = rasters.from_embeddings(spark, SF)
    for se in (neighbours.rectangle(3, 5), neighbours.ball(2)):
        inv = views.transform(px, lambda v: 255 - v)
        a = neighbours.dilate(inv, se)
        b = views.transform(neighbours.erode(px, se), lambda v: 255 - v)
        assert views.equal(a, b).where("not equal").count() == 0
        o = neighbours.opening(px, se).withColumnRenamed("v", "o")
        assert px.join(o, rasters.K).where("o > v").count() == 0
        assert views.equal(neighbours.opening(neighbours.opening(px, se), se), o.withColumnRenamed("o", "v")).where("not equal").count() == 0


def test_rectangle_needs_no_join(spark):
    plan = neighbours.dilate(rasters.from_embeddings(spark, SF), neighbours.rectangle(3, 3))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Window") >= 2


def test_kernel_reads_only_what_it_names(spark):
    px = rasters.from_embeddings(spark, SF).withColumn("unused", F.lit(1))
    kern = neighbours.Kernel(F.max, lambda p, n: n["v"])
    assert kern.point.used == [] and kern.near.used == ["v"]
    assert kern.execute(px, neighbours.C4).count() == px.count()


def test_blobs_tiled_spiral(spark):
    rows = ["1111111111", "0000000001", "1111111101", "1000000101", "1011110101", "1010010101", "1011010101", "1000010101", "1111110101", "0000000111"]
    px = rasters.from_rows(spark, [[c == "1" for c in r] for r in rows])
    for nb in ("c4", "c8"):
        assert sorted(connected.blobs_tiled(px, nb, 3).collect()) == sorted(connected.blobs(px, nb).collect())


def test_blobs_tiled_of_wide_images(spark):
    """Names of parts don't clash in columns beyond 2^20, and labels go on from one row of tiles to the next."""
    far = 1 << 20
    px = spark.createDataFrame([(0, y, x, True) for y, x in ((0, far + 5), (1, 5), (4, 5), (4, 7), (5, 7), (6, 7))], "image_id long, y int, x int, v boolean")
    got = {(r.y, r.x): r.label for r in connected.blobs_tiled(px, "c4", 3).collect()}
    assert got == {(0, far + 5): 1, (1, 5): 2, (4, 5): 3, (4, 7): 4, (5, 7): 4, (6, 7): 4}


def test_closure_of_a_ramp(spark):
    px = rasters.from_rows(spark, [list(range(40))])
    nodes = trees.nodes_of(trees.node_map(px))
    up = trees.closure(nodes)
    assert up.count() == 40 * 41 // 2 and up.agg(F.max("dist")).first()[0] == 39


def test_golden_pnm(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pgm").write_text("P2\n# c\n5 5\n255\n" + " ".join(map(str, range(1, 26))))
    (tmp_path / "in/b.ppm").write_bytes(b"P6\n2 1\n255\n" + bytes([1, 2, 3, 4, 5, 6]))
    (tmp_path / "in/c.pbm").write_bytes(b"P4\n3 1\n" + bytes([0b10100000]))
    px = pnm.imread(spark, f"{tmp_path}/in")
    assert px.where("path like '%a.pgm'").agg(F.sum("v")).first()[0] == 325
    assert [r.v for r in px.where("path like '%b.ppm'").orderBy("y", "x", "c").collect()] == [1, 2, 3, 4, 5, 6]
    assert [r.v for r in px.where("path like '%c.pbm'").orderBy("x").collect()] == [1, 0, 1]
    (tmp_path / "in/d.pgm").write_text("nonsense")
    assert pnm.imread(spark, f"{tmp_path}/in", True).count() == px.where("path not like '%d.pgm'").count()
    with pytest.raises(Exception, match="not a Netpbm"):
        pnm.imread(spark, f"{tmp_path}/in/d.pgm").count()


def test_saved_images_and_trees(spark, tmp_path):
    px = rasters.from_embeddings(spark, SF)
    pnm.imsave(px, f"{tmp_path}/out")
    back = pnm.load_saved(spark, f"{tmp_path}/out").drop("c")
    assert views.equal(px, back).where("not equal").count() == 0
    small = rasters.from_embeddings(spark, SF, 16, 8)
    pmap = trees.node_map(small)
    pnm.save_tree(trees.nodes_of(pmap), pmap, f"{tmp_path}/tree")
    nodes, again = pnm.load_tree(spark, f"{tmp_path}/tree")
    assert nodes.count() == trees.nodes_of(pmap).count()
    assert views.equal(trees.reconstruct(again, nodes), small).where("not equal").count() == 0


def test_border_and_faces(spark):
    px = rasters.from_rows(spark, [[1, 2], [3, 4]])
    assert grid(khalimsky.add_border(px)) == [[2, 2, 2, 2], [2, 1, 2, 2], [2, 3, 4, 2], [2, 2, 2, 2]]
    assert khalimsky.immerse(px).count() == 9


def test_streamed_frames(spark, tmp_path):
    from tessera.streaming import frames

    px = rasters.from_embeddings(spark, SF, 16, 8).select("image_id", "y", "x", "v")
    px.repartition(3, "image_id").write.parquet(f"{tmp_path}/in")
    q = frames.each_batch(frames.read_frames(spark, f"{tmp_path}/in", 1), lambda df: neighbours.gradient(df, neighbours.rectangle(3, 3)), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    assert views.equal(got, neighbours.gradient(px, neighbours.rectangle(3, 3))).where("not equal").count() == 0


def test_path_region_of_images_without_its_ends(spark):
    """An image without one of the two pixels (too low, too narrow, starting below, a hole) has an empty region and keeps all its sites."""
    whole = [[0, 0, 0, 5], [0, 0, 0, 5], [0, 0, 0, 0], [0, 0, 0, 0]]
    px = rasters.from_rows(spark, whole, 0)
    for i, rows in enumerate(([[0, 5, 0, 5]], [[0, 5], [0, 0], [0, 5], [0, 0], [0, 0]])):
        px = px.unionByName(rasters.from_rows(spark, rows, 1 + i))
    px = px.unionByName(rasters.from_rows(spark, whole, 3).withColumn("y", F.col("y") + 1)).unionByName(rasters.from_rows(spark, whole, 4).where("y <> 1 or x <> 3"))
    got = shapespace.path_region(px, (0, 0), (1, 3))
    assert grid(got.where("image_id = 0")) == [[False] * 4] * 4  # the path has all pixels
    assert sorted(got.select(*rasters.K).collect()) == sorted(px.select(*rasters.K).collect())
    assert got.where("v and image_id in (1, 2, 3, 4)").isEmpty()
    inner = rasters.from_rows(spark, [[5, 5, 0], [0, 0, 0], [0, 0, 7]])
    assert grid(shapespace.path_region(inner, (0, 0), (0, 1))) == [[False, False, True], [True, True, True], [False, False, False]]


def test_superpixel_distance_of_low_images(spark):
    """An image lower than half the step, beside a whole one: every superpixel has a row, all lie on the border."""
    low = rasters.from_rows(spark, [[0] * 8 + [200] * 8] * 2, 1)
    px = rasters.from_rows(spark, [[(3 * y + 5 * x) % 8 for x in range(16)] for y in range(16)], 0).unionByName(low)
    got = shapespace.superpixel_distance(px, 4)
    labels = connected.superpixels(px, 4).select("image_id", "label").distinct()
    assert sorted(got.select("image_id", "label").collect()) == sorted(labels.collect())
    assert got.where("image_id = 1 and d <> 0").isEmpty() and got.where("image_id = 1").count() > 1


def test_superpixel_graph_of_low_images(spark):
    """An image lower than half the step, beside a whole one: edges of its superpixels as counted from its labels."""
    low = rasters.from_rows(spark, [[0] * 8 + [200] * 8] * 2, 1)
    px = rasters.from_rows(spark, [[(3 * y + 5 * x) % 8 for x in range(16)] for y in range(16)], 0).unionByName(low)
    labels = connected.superpixels(px, 4)
    got = shapespace.superpixel_graph(labels, px)
    lab, v = grid(labels.where("image_id = 1")), grid(low)
    mean = {i: sum(b for r, s in zip(lab, v) for a, b in zip(r, s) if a == i) // sum(r.count(i) for r in lab) for i in {a for r in lab for a in r}}
    near = {(min(p, q), max(p, q)) for y in range(2) for x in range(15) for p, q in ((lab[y][x], lab[y][x + 1]), (lab[y][x], lab[1 - y][x + 1]), (lab[0][x], lab[1][x]), (lab[0][x + 1], lab[1][x + 1])) if p != q}
    assert {(r.a, r.b, r.w) for r in got.where("image_id = 1").collect()} == {(a, b, abs(mean[a] - mean[b])) for a, b in near}
    assert near and not got.where("image_id = 0").isEmpty()


def test_superpixel_graph_from_another_folder(tmp_path):
    """Workers import the package though neither the working folder nor PYTHONPATH leads to it."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from tessera.operators import connected, shapespace
from tessera.sources import rasters
px = rasters.from_rows(spark, [[(3 * y + 5 * x) % 8 for x in range(16)] for y in range(16)])
assert shapespace.superpixel_graph(connected.superpixels(px, 4), px).count()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith(("SPARK_", "PYSPARK_"))}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
