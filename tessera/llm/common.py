"""Shared parts of the training-data operators: the working folder, iterative joins, byte helpers."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.rasterwise import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_memories: dict = {}
_owner: list = [None]


def remembers(name: str, forget) -> None:
    """Declares what an operator's Python workers keep between tasks, and how to drop it."""
    _memories[name] = forget


def take_over(name: str) -> None:
    """Called by a worker's task: drops what other operators kept in this worker, which outlives their stages."""
    if _owner[0] != name:
        for other, forget in _memories.items():
            if other != name:
                forget()
        _owner[0] = name
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def give_back() -> None:
    """Called by a worker at the end of a task: memory that is free goes back to the machine, as workers outlive their stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Workspace:
    """Intermediate tables as Parquet in the shared folder. They cut lineage: a lost executor costs no recomputation
    beyond its own tasks. ``free`` deletes those that the result doesn't read."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.at = spark, f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.at}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.get(name, df.schema)

    def get(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def free(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)


class Sieve:
    """Three bits for each of a set of keys (a Bloom filter), so that rows whose key isn't in the set are told from the
    rest where they are read, without moving them. No key of the set is ever missed; of other keys about one in 500
    passes, more where the set outgrows MOST bits, so what passes is joined exactly or does no harm. MOST bounds what is sent.
    """

    LEAST, MOST = 1 << 16, 1 << 27

    def __init__(self, ws: Workspace, keys: DataFrame, name: str):
        """``keys``: one column of longs that are hashes already, so that their own bits say where. Null keys are left out."""
        keys = keys.toDF("key")
        self.size = min(self.MOST, max(self.LEAST, 1 << (16 * keys.count()).bit_length()))
        words = keys.where("key is not null").select(F.explode(F.array(*self._places(F.col("key")))).alias("h"))
        words = words.select(F.shiftright("h", 6).alias("id"), (F.col("h") % 64).cast("int").alias("bit"))
        words = words.groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("v"))
        all_ = ws.spark.range(self.size // 64).join(words, "id", "left").select("id", F.coalesce("v", F.lit(0)).alias("v"))
        rows = all_.groupBy(F.shiftright("id", 9).alias("o")).agg(F.array_sort(F.collect_list(F.struct("id", "v")))["v"].alias("v"))
        self.table = ws.put(rows.agg(F.array_sort(F.collect_list(F.struct("o", "v")))["v"].alias("v")).select(F.flatten("v").alias("v")), name)

    def _places(self, key: Column) -> list[Column]:
        return [F.shiftright(key, k).bitwiseAND(F.lit(self.size - 1)) for k in (0, 19, 37)]

    def may_hold(self, key: Column) -> Column:
        """Whether the key may be in the set; false for null. Not for use within a function of array elements."""
        out = key.isNotNull()
        for h in self._places(key):
            out &= F.getbit(F.get(self.table.scalar(), F.shiftright(h, 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1
        return out


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(ws: Workspace, edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of ``edges`` (a, b long): rows (node, root), root the smallest node reachable.

    Each round hooks every node to its smallest smaller neighbour, follows these pointers to their ends by doubling,
    and rewrites the edges between the ends reached, so that edges shrink by the round. Rounds and doublings grow
    with the logarithm of the longest path. Null ends and loops are ignored; no edges give no rows.
    """
    live = edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    live = ws.put(live, f"{tag}-live-0")
    roots, step = None, 0
    while not live.isEmpty():
        step += 1
        hook = ws.put(live.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("up")), f"{tag}-hook-{step}-0")
        turn = 0
        while True:
            turn += 1
            far = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            nxt = ws.put(hook.join(far, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), f"{tag}-hook-{step}-{turn}")
            moved = not nxt.where("moved").isEmpty()
            ws.free(f"{tag}-hook-{step}-{turn - 1}")
            hook = nxt.select("node", "up")
            if not moved:
                break
        lo = hook.select(F.col("node").alias("lo"), F.col("up").alias("lo_up"))
        hi = hook.select(F.col("node").alias("hi"), F.col("up").alias("hi_up"))
        ends = live.join(lo, "lo", "left").join(hi, "hi", "left").select(F.coalesce("lo_up", "lo").alias("p"), F.coalesce("hi_up", "hi").alias("q"))
        nxt = ws.put(ends.where("p <> q").select(F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi")).distinct(), f"{tag}-live-{step}")
        if roots is None:
            merged = hook
        else:
            r = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            merged = roots.join(r, "up", "left").select("node", F.coalesce("top", "up").alias("up")).unionByName(hook)
        merged = ws.put(merged, f"{tag}-roots-{step}")
        ws.free(f"{tag}-live-{step - 1}", f"{tag}-hook-{step}-{turn}", f"{tag}-roots-{step - 1}")
        live, roots = nxt, merged
    if roots is None:
        return ws.put(live.select(F.col("lo").alias("node"), F.col("hi").alias("root")), f"{tag}-done")
    ends = roots.select(F.col("up").alias("node"), F.col("up").alias("root"))
    return ws.put(roots.select("node", F.col("up").alias("root")).unionByName(ends).distinct(), f"{tag}-done")


def crc_text(column: str):
    """crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def crc_of(i: int) -> int:
    return zlib.crc32(str(i).encode())


def split_mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words, so that every output bit hangs on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Forest:
    """Union-find over row numbers of one block; the smallest member is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
