"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

A rotation of the centred vectors is learned so that their signs make balanced binary codes (iterative quantisation:
signs for a rotation, then the orthogonal rotation that fits these signs best, in turn). Equal vectors are one class
first. Codes are cut into ``TABLES`` substrings, each with a table for every set of ``PLACES`` bits left out: codes that
agree in a substring but for that many bits meet. All codes up to TABLES * (PLACES + 1) - 1 bits apart do, and most that
are further. Codes that meet and are at most RADIUS bits apart are candidates; no others are ever compared by their
vectors than those that such candidates connect. A table entry emits a spanning forest of its candidates and never the
pairs. The vectors of each connected group of candidates are reranked in double precision by blocks of ``BLOCK``, which
count links and emit a spanning forest of them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Sieve, Workspace, components, read, ship

#: Vectors that the rotation is fitted on at most, those with the smallest hash of their id; all are coded and searched.
FIT_ROWS = 20_000
ROUNDS = 30
TABLES = 4
PLACES = 1
RADIUS = 10
BLOCK = 512
COSINE = 0.95
#: Codes of a table entry that are compared side by side with others' at most; larger entries by themselves.
SMALL = 64
#: Codes of a table entry that one task takes, about; larger entries are dealt into blocks of half as many, and each two
#: blocks meet, so that all codes of an entry do.
SPLIT = 65_536


def fit_itq(x: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (columns: bits) of unit vectors, by principal components and iterative quantisation."""
    mean = x.mean(0)
    _, _, vt = np.linalg.svd(x - mean, full_matrices=False)
    w = vt[:bits].T
    v = (x - mean) @ w
    rot = np.linalg.qr(np.random.default_rng(seed).normal(size=(w.shape[1], w.shape[1])))[0]
    for _ in range(rounds):
        u, _, t = np.linalg.svd(np.where(v @ rot >= 0, 1.0, -1.0).T @ v)
        rot = (u @ t).T
    return mean, w @ rot


def unit(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of ``n`` components in double precision, and which rows have one; rows of another length have none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten()
    if not column.null_count and not flat.null_count and (sizes == n).all():
        out, ok = flat.to_numpy().astype(float).reshape(len(column), n), np.ones(len(column), bool)
    else:
        out, ok = np.zeros((len(column), n)), np.zeros(len(column), bool)
        for k, r in enumerate(column.to_pylist()):
            if r and len(r) == n and None not in r:
                out[k], ok[k] = r, True
    ok &= np.isfinite(out).all(1)
    out[~ok] = 0
    top = np.abs(out).max(1, initial=0)
    ok &= top > 0
    out[ok] /= top[ok, None]
    out[ok] /= np.sqrt((out[ok] ** 2).sum(1))[:, None]
    return out + 0.0, ok


def _prints(x: np.ndarray) -> list[bytes]:
    return [xxhash.xxh3_128_digest(r.tobytes()) for r in x]


def _code(sent):
    """mapInArrow function over (vec_id, embedding): vec_id, print and code of the rows that have a unit vector."""

    def run(batches):
        mean, w = sent.value
        for b in batches:
            x, ok = unit(b.column(1), len(mean))
            x = x[ok]
            bits = (x - mean) @ w >= 0
            code = (bits.astype(np.uint64) << np.arange(w.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array(_prints(x), pa.binary()), pa.array(code.view(np.int64))], names=["vec_id", "print", "code"])

    return run


def _vectors(n: int):
    """mapInArrow function over (vec_id, embedding): vec_id, print and the unit vector as bytes."""

    def run(batches):
        for b in batches:
            x, ok = unit(b.column(1), n)
            x = x[ok]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array(_prints(x), pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "print", "unit"])

    return run


def masks(bits: int, tables: int, places: int) -> list[int]:
    """For each substring and each set of that many of its places: the other bits, which must agree."""
    out, cuts = [], np.linspace(0, bits, tables + 1).astype(int)
    for lo, hi in zip(cuts, cuts[1:]):
        whole = sum(1 << b for b in range(lo, hi))
        for gone in combinations(range(lo, hi), min(places, max(0, hi - lo - 1))):
            out.append(whole & ~sum(1 << b for b in gone))
    return out


def span(codes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the codes at most ``radius`` bits apart: what is reached is taken out of what is left to reach."""
    out: list[tuple[int, int]] = []
    rest = codes
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            p = todo.pop()
            near = np.bitwise_count(rest ^ p) <= radius
            if near.any():
                new = rest[near]
                rest = rest[~near]
                out += [(int(p), x) for x in new.tolist()]
                todo += list(new)
    return out


def _meet(radius: int):
    """mapInArrow function over rows (key, code) sorted by key, codes different within a key: edges (a, b) of a forest of
    the codes that share a key within the radius. Memory: the codes of one key, which ``meetings`` bounds."""

    def run(batches):
        up: dict[int, int] = {}  # over all that this task has met: an edge is emitted if it joins what wasn't joined

        def find(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def joined(pairs):
            out = []
            for x, y in pairs:
                p, q = find(x), find(y)
                if p != q:
                    up[max(p, q)] = min(p, q)
                    out.append((x, y))
            if len(up) > 1_000_000:
                up.clear()
            return out

        def edges(keys, codes):
            """Of whole keys."""
            found = []
            starts = np.nonzero(np.append(True, keys[1:] != keys[:-1]))[0]
            size = np.diff(np.append(starts, len(keys)))
            for k in np.nonzero(size > SMALL)[0].tolist():
                found += span(codes[starts[k] : starts[k] + size[k]], radius)
            small = np.repeat(size <= SMALL, size)
            keys, codes = keys[small], codes[small]
            for s in range(1, int(size[size <= SMALL].max(initial=1))):
                at = np.nonzero((keys[s:] == keys[:-s]) & (np.bitwise_count(codes[s:] ^ codes[:-s]) <= radius))[0]
                found += zip(codes[at].tolist(), codes[at + s].tolist())
            found = joined(found)
            return pa.RecordBatch.from_arrays([pa.array(np.array([e[k] for e in found], np.uint64).view(np.int64)) for k in (0, 1)], names=["a", "b"])

        keys, codes = [], []
        for b in batches:
            if not b.num_rows:
                continue
            keys.append(b.column(0).to_numpy()), codes.append(b.column(1).to_numpy().view(np.uint64))
            if keys[0][0] == keys[-1][-1]:
                continue
            k, c = np.concatenate(keys), np.concatenate(codes)
            whole = int(np.nonzero(k != k[-1])[0][-1]) + 1
            yield edges(k[:whole], c[:whole])
            keys, codes = [k[whole:]], [c[whole:]]
        if keys:
            yield edges(np.concatenate(keys), np.concatenate(codes))

    return run


def meetings(codes: DataFrame, bits: int, ws: Workspace) -> DataFrame:
    """Edges (a, b) of different ``codes`` (code) that join all those that meet in a table within RADIUS."""
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("code").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64)))) for k, m in enumerate(masks(bits, TABLES, PLACES))])
    rows = codes.select(F.explode(keys).alias("key"), "code")
    large = ws.put(rows.groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") > SPLIT), "large")
    if not large.isEmpty():
        # a code meets its own block along with any other, of which there are two at least
        blocks = F.ceil(F.col("many") * 2 / SPLIT)
        others = F.array_except(F.sequence(F.lit(0).cast("long"), blocks - 1), F.array("block"))
        rows = rows.join(large, "key", "left").withColumn("block", F.pmod(F.xxhash64("code"), blocks))
        rows = rows.withColumn("other", F.explode(F.when(F.col("many").isNull(), F.array(F.lit(None).cast("long"))).otherwise(others)))
        pair = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
        rows = rows.withColumn("key", F.when(F.col("many").isNull(), F.col("key")).otherwise(pair))
    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("key", "code").repartition(parts, "key").sortWithinPartitions("key", "code").mapInArrow(_meet(RADIUS), "a long, b long").distinct()


def forest(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows ``a`` and columns ``b`` (row numbers; the same for a block against
    itself), breadth first: each row is looked at once, the links themselves are never listed."""
    one = len(a) == len(b) and bool((a == b).all())
    sides = [near] if one else [near, near.T]
    names = [a] if one else [a, b]
    unseen = [np.ones(len(x), bool) for x in names]
    out: list[tuple[int, int]] = []
    for start in np.nonzero(near.any(1))[0].tolist():
        if not unseen[0][start]:
            continue
        unseen[0][start] = False
        todo = [(0, start)]
        while todo:
            s, p = todo.pop()
            t = 0 if one else 1 - s
            new = np.nonzero(sides[s][p] & unseen[t])[0].tolist()
            unseen[t][new] = False
            out += [(int(names[s][p]), int(names[t][q])) for q in new]
            todo += [(t, q) for q in new]
    return out


def _rerank(cosine: float):
    """applyInArrow over rows (g, i, j, block, vec_id, n, unit): for both blocks the vectors that each links with, counted
    with their copies, and a forest of the links."""

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        ids, block, n = (table.column(c).to_numpy() for c in ("vec_id", "block", "n"))
        order = np.argsort(ids, kind="stable")
        ids, block, n = ids[order], block[order], n[order].astype(float)
        x = np.frombuffer(b"".join(table.column("unit").take(pa.array(order)).to_pylist()), float).reshape(len(ids), -1)
        a, b = np.nonzero(block == i)[0], np.nonzero(block == j)[0]
        near = x[a] @ x[b].T >= cosine
        if i == j:
            np.fill_diagonal(near, False)
        links = np.zeros(len(ids))
        links[a] += near @ n[b]
        if i != j:
            links[b] += n[a] @ near
        edges = forest(near, ids[a], ids[b])
        some = np.nonzero(links)[0]
        return pa.table({
            "a": pa.array([*ids[some].tolist(), *(e[0] for e in edges)], pa.int64()),
            "b": pa.array([None] * len(some) + [e[1] for e in edges], pa.int64()),
            "n": pa.array([*links[some].astype(np.int64).tolist(), *[None] * len(edges)], pa.int64()),
        })

    return run


def cluster(vectors: DataFrame, ws: Workspace, cosine: float = COSINE, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept (vec_id = component_id).

    Vectors that are null, empty, zero, of another length than the commonest (of equally common lengths: the greatest),
    or hold null or non-finite components link with nothing and change no other's links; so do rows with a null vec_id.
    Rows repeated with equal vec_id and vector count as one vector; of rows with equal vec_id and different vectors the
    one whose hash is smallest stands for all. Equal vectors under different ids are linked. An empty table gives no
    rows; further columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    given = vectors.where("vec_id is not null and embedding is not null")
    length = given.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    x = np.zeros((0, 1))
    if length:
        taken = given.where(F.size("embedding") == length[0]).orderBy(F.xxhash64(F.col("vec_id").cast("string")), "vec_id").limit(fit_rows)
        x, ok = unit(taken.toArrow().column("embedding"), length[0])
        x = x[ok]
    if not len(x):
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    bits = min(64, x.shape[1], max(1, len(x)))
    sent = spark.sparkContext.broadcast(fit_itq(x, bits))
    given = given.where(F.size("embedding") == length[0])
    coded = given.mapInArrow(_code(sent), "vec_id long, print binary, code long").groupBy("vec_id").agg(F.min(F.struct("print", "code")).alias("x"))
    coded = ws.put(coded.select("vec_id", "x.print", "x.code"), "coded")
    classes = ws.put(coded.groupBy("print").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("code").alias("code")), "classes")
    codes = classes.select("code").distinct()
    groups = components(ws, meetings(codes, bits, ws), "codes")
    # groups of candidates, by blocks
    named = classes.join(groups.withColumnRenamed("node", "code"), "code", "left").select("vec_id", "print", "n", F.coalesce("root", "code").alias("g"))
    size = named.groupBy("g").agg(F.count("*").alias("count")).where("count > 1")
    dealt = named.join(size, "g").withColumn("blocks", F.ceil(F.col("count") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    dealt = ws.put(dealt.drop("count"), "dealt")
    wanted = Sieve(ws, dealt.select(F.xxhash64("vec_id")), "wanted")
    loaded = given.where(wanted.may_hold(F.xxhash64("vec_id"))).mapInArrow(_vectors(length[0]), "vec_id long, print binary, unit binary")
    held = ws.put(loaded.join(dealt, ["vec_id", "print"]).dropDuplicates(["vec_id"]).select("g", "block", "blocks", "vec_id", "n", "unit"), "held")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    paired = held.withColumn("other", other).select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "vec_id", "n", "unit")
    found = ws.put(paired.groupBy("g", "i", "j").applyInArrow(_rerank(cosine), "a long, b long, n long"), "found")
    counts = found.where("b is null").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("links"))
    roots = components(ws, found.where("b is not null").select("a", "b"), "links")
    # copies of a vector link with one another and with what it links with
    of_class = classes.join(counts, "vec_id", "left").join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    of_class = of_class.select("print", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "vec_id").alias("root"))
    known = ws.put(coded.select("vec_id", "print").join(of_class, "print").select("vec_id", "links", "root"), "known")
    out = vectors.select("vec_id").join(known, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    ws.free("held", "dealt", "coded", "classes", "found", "large")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op6_itq_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings"), Workspace(spark, "op6"))


#: All pairs.
SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, list_transform(e, lambda x: x / len) AS u FROM (
    SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS len FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL)
  ) WHERE len > 0 AND isfinite(len)
), link AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id WHERE list_inner_product(p.u, q.u) >= 0.95::DOUBLE),
c(id, r) USING KEY (id) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, min(f.r) FROM c f JOIN link l ON l.a = f.id JOIN recurring.c o ON o.id = l.b WHERE f.r < o.r GROUP BY l.b
), n AS (SELECT a, count(*) AS n FROM link GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, r AS component_id, vec_id = r AS kept FROM embeddings LEFT JOIN n ON a = vec_id JOIN c ON c.id = vec_id
"""
