"""Token-ID files: ORC with integer run-length encoding, row indexes and Bloom filters on document ids.

``write`` deals the texts out by ranges of doc_id, encodes each range in its task and writes it as one sorted ORC file:
columns part, doc_id, ids. ORC writes integers by its run-length encoding (version 2), keeps minimum and maximum by
stripe and by row group of ``ROW_GROUP`` rows, and Bloom filters on doc_id, so that a look-up by doc_id skips stripes
and row groups by metadata and a full read splits files by stripe. The ids of all documents before a document are a
sum over parts (a row each) and a running sum within its part, so no task sees more than its part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import Workspace, read, ship

ROW_GROUP = 1000
SCHEMA = "part int, doc_id long, ids array<int>"
ORC = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": str(ROW_GROUP),
    "orc.encoding.strategy": "SPEED",
    "orc.stripe.size": str(32 << 20),
    "compression": "snappy",
}


def write(docs: DataFrame, path: str, tokenizer: str = tokens.BYTE_BPE, end: int = 0) -> None:
    """Encodes ``docs`` (doc_id, text) and writes them to ``path`` in ascending doc_id order.

    Null text counts as empty: the end id alone. Texts are whole whatever their length; rows with a doc_id of null come
    first; repeated rows are each written (equal ids side by side, in any order); other columns are ignored. An empty
    table gives a folder without rows.
    """
    ship(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # bounds of the ranges from the ids alone: a range partitioning would read all texts twice
    bounds = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    part = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]).cast("array<bigint>"), lambda b: b <= F.coalesce("doc_id", F.lit(-(1 << 63)))))
    dealt = docs.withColumn("part", part).repartitionById(parts, "part").sortWithinPartitions("doc_id")
    out = dealt.select("doc_id", "text").mapInArrow(tokens.encode_batches(tokenizer, end), "doc_id long, ids array<int>").select(F.spark_partition_id().alias("part"), "doc_id", "ids")
    out.write.mode("overwrite").options(**ORC).orc(path)


def load(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of a written store. ``doc_ids``: these only; the filter is pushed down to stripes, row groups and Bloom filters."""
    df = spark.read.schema(SCHEMA).orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))


def _digest(batches):
    for b in batches:
        ids = b.column(2)
        at, flat = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False))
        view = memoryview(flat).cast("B")
        crc = [zlib.crc32(view[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "doc_id", "n_tokens", "ids_crc32"])


def digest(spark: SparkSession, path: str, ws: Workspace) -> DataFrame:
    """Per document of a store, read from its files: doc_id, start, n_tokens, ids_crc32."""
    df = load(spark, path)
    got = ws.put(df.mapInArrow(_digest, "part int, doc_id long, n_tokens long, ids_crc32 long"), "digest")
    sums = got.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    base = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    run = Window.partitionBy("part").orderBy(F.asc_nulls_first("doc_id"), "ids_crc32").rowsBetween(Window.unboundedPreceding, 0)
    return got.withColumn("upto", F.sum("n_tokens").over(run)).join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "op2")
    write(read(spark, sf_dir, "documents"), ws.path("store"))
    return digest(spark, ws.path("store"), ws)
