"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a text is a blob, named by its SHA-256. A ledger keeps, for each pair of blob and rule version that
was ever scanned, the findings and the run that scanned it. A run reads the hashes of what it is given, takes the pairs
that the ledger doesn't have, scans each such blob once, appends its findings to the ledger, and joins the ledger back to
all paths (here: documents and versions) that hold the blob. Texts of unseen blobs alone move; a sieve tells them from the
rest where the texts are read.

Spark has no function for the places of all matches. They follow from the pieces between matches and the matches
themselves: the lengths of both, added up in turn, are the starts and ends, in code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Sieve, Workspace, read, ship

#: Kind, pattern of a match, group that must be long enough (0: the match), its least length, in the
#: order in which equal starts are listed; version of the whole. A new pattern or length takes a new version.
RULES = [
    ("assign", "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "(?:.|\\n)*?[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)$", 12),
    ("access", "AKIA[A-Z0-9]+", None, 18),
    ("hex", "[0-9a-f]{16,}", None, 16),
]
VERSION = "1"
#: A text without a match of this holds no finding. It only keeps the scan cheap.
HINT = "(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{16}"
LEDGER = "blob string, version string, run int, findings array<struct<start:int,kind_no:int,`end`:int>>"


def _spans(text: Column, no: int, kind: str, pattern: str, tail: str | None, least: int) -> Column:
    """array<struct<start, kind_no, end>> of a rule's leftmost non-overlapping matches that are long enough."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"), m.alias("t")))

    def step(acc, x):
        start = acc["upto"] + x["g"]
        long = F.length(F.regexp_extract(x["t"], tail, 1)) if tail else x["m"]
        one = F.struct(start.alias("start"), F.lit(no).alias("kind_no"), (start + x["m"]).alias("end"))
        keep = x["t"].isNotNull() & (long >= least)
        return F.struct((start + F.coalesce(x["m"], F.lit(0))).alias("upto"), F.when(keep, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    empty = F.array().cast("array<struct<start:int,kind_no:int,end:int>>")
    return F.aggregate(lengths, F.struct(F.lit(0).alias("upto"), empty.alias("out")), step, lambda acc: acc["out"])


def scan(text: Column) -> Column:
    """All findings of a text by start, then kind."""
    return F.array_sort(reduce(F.concat, [_spans(text, k, *rule) for k, rule in enumerate(RULES)]))


def update_ledger(blobs: DataFrame, ledger: str, ws: Workspace, version: str = VERSION, run: int = 1) -> int:
    """Scans what is new of ``blobs`` (blob string, text) and appends it to ``ledger`` (a folder). Returns how many blobs were scanned.

    However many rows share a blob, it is scanned once; a blob once in the ledger under this version is never scanned again.
    """
    spark = blobs.sparkSession
    done = spark.read.schema(LEDGER).parquet(ledger).where(F.col("version") == version).select("blob")
    unseen = ws.put(blobs.select("blob").distinct().join(done, "blob", "left_anti"), f"unseen-{version}-{run}")
    n = unseen.count()
    if not n:
        return 0
    bits = Sieve(ws, unseen.select(F.xxhash64("blob")), f"unseen-bits-{version}-{run}")
    texts = blobs.where(bits.may_hold(F.xxhash64("blob"))).select("blob", "text").dropDuplicates(["blob"]).join(unseen, "blob", "left_semi")
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int>>")
    found = texts.select("blob", F.lit(version).alias("version"), F.lit(run).alias("run"), F.when(F.col("text").rlike(HINT), scan(F.col("text"))).otherwise(none).alias("findings"))
    found.write.mode("append").parquet(ledger)
    return n


def find(docs: DataFrame, ledger: str, ws: Workspace, version: str = VERSION, run: int = 1) -> DataFrame:
    """``docs`` (doc_id, text, any others) with blob (its SHA-256), findings: array of (start, kind, end), code points, end
    exclusive, by start, then kind, and scanned_in, the number of the run that scanned the blob; ``run``: that of this one.

    Null text counts as empty and has no findings. Texts are whole; rows that repeat a text share one scan; an empty
    table adds nothing to the ledger; columns of the input named blob, findings or scanned_in are replaced, all others stay.
    """
    spark = docs.sparkSession
    ship(spark)
    fs = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
        spark.createDataFrame([], LEDGER).write.parquet(ledger)
    docs = docs.drop("blob", "findings", "scanned_in")
    named = docs.withColumn("blob", F.sha2(F.coalesce("text", F.lit("")), 256))
    update_ledger(named.select("blob", F.coalesce("text", F.lit("")).alias("text")), ledger, ws, version, run)
    kinds = F.array(*[F.lit(k) for k, *_ in RULES])
    known = spark.read.schema(LEDGER).parquet(ledger).where(F.col("version") == version)
    known = known.select("blob", F.transform("findings", lambda x: F.struct(x["start"].alias("start"), F.get(kinds, x["kind_no"]).alias("kind"), x["end"].alias("end"))).alias("findings"), F.col("run").alias("scanned_in"))
    return named.join(known, "blob").select(*[F.col(f"`{c}`") for c in docs.columns], "blob", "findings", "scanned_in")


def op7_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a history of two states: the documents with even ids, then all of them. The second run scans only
    blobs that the first hasn't seen, and its ledger serves all documents; scanned_in tells which run scanned a document's blob."""
    ws = Workspace(spark, "op7")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    find(docs.where("doc_id % 2 = 0"), ws.path("ledger"), ws, run=1)
    out = find(docs, ws.path("ledger"), ws, run=2).select("doc_id", "findings", "scanned_in")
    n = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"), F.lit(VERSION).alias("rule_version"), "scanned_in")


def _sql() -> str:
    """Places of matches from the lengths of what stands between them, rule by rule."""
    parts = []
    for k, (_, pattern, tail, least) in enumerate(RULES):
        p = pattern.replace("'", "''")
        long = f"length(regexp_extract(x, '{p}', 2))" if tail else "length(x)"
        parts.append(f"""SELECT doc_id, {k} AS k, st, st + length(x) AS en FROM (
  SELECT doc_id, m[i] AS x, list_sum(list_transform(g[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:(i - 1)], lambda s: length(s))), 0) AS st
  FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d))) WHERE {long} >= {least}""")
    names = ", ".join(f"'{k}'" for k, *_ in RULES)
    counts = ", ".join(f"coalesce(count(k) FILTER (k = {n}), 0)::BIGINT AS n_{k}" for n, (k, *_) in enumerate(RULES))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(parts)}),
o AS (SELECT d.doc_id, {counts}, coalesce(string_agg([{names}][k + 1] || ':' || st::BIGINT || ':' || en::BIGINT, ',' ORDER BY st, k), '') AS spans FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id)
SELECT *, sha256(spans) AS base_sha256, '{VERSION}' AS rule_version, (SELECT CASE WHEN d.t IN (SELECT t FROM d WHERE doc_id % 2 = 0) THEN 1 ELSE 2 END FROM d WHERE d.doc_id = o.doc_id)::INTEGER AS scanned_in FROM o"""


SQL = _sql()
