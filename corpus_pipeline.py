"""Corpus pipeline: language ID, line dedup, MinHash near-dedup, benchmark decontamination, best-fit packing.

Each stage takes the documents that its predecessor kept and returns the columns of documents; the last returns the
packed pieces. ``run`` writes each stage's result to the shared folder and reads it back, so a lost executor never
costs more than the stage at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate as decontamination
from tessera.llm import langid, line_dedup, near_dup, packing
from tessera.llm.common import Workspace, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document's language must hold at least this share of its letters.
LEAST_SHARE = 0.4
#: Words that a packing worker keeps in each generation: about 300 bytes each, beside executors whose heap earlier stages grew.
WORDS = 100_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Labels every document and drops those without letters or without a language of LEAST_SHARE of its letters.
    ``lang`` becomes the label; given labels are only learned from."""
    model = langid.fit(docs)
    out = langid.label(docs.select(*COLUMNS), model, spans=False)
    out = out.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SHARE)) if model["langs"] else out
    return out.withColumn("lang", F.when(F.col("lang_pred") != "und", F.col("lang_pred")).otherwise(F.col("lang"))).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines; documents all of whose lines were repeats go, n_chars follows the text."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS), Workspace(spark, "stage5"), least=1)
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of each group linked by five-word shingles at 0.8 or more."""
    found = near_dup.cluster(docs, Workspace(spark, "stage3"), 5, 80, 100)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that leak a benchmark item."""
    out = decontamination.decontaminate(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"), Workspace(spark, "stage9"))
    return out.where(~F.col("leaked")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.place(packing.cut(docs, most=WORDS), Workspace(spark, "stage4"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: SQL can express neither the language model nor the packing; tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.put(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            ws.free(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
