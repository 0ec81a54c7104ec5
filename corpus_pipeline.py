"""The corpus pipeline: five stages over documents, each of which works on what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxweave.llm import decontamination, jaccard, lines, pieces, quality
from fluxweave.llm.common import saved


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with their own columns, whatever they are named."""
    own = {c: f"{c} of its own" for c in docs.columns if c.lower() in ("score", "predicted")}  # so a text goes to the workers once
    scored = quality.classify(docs.withColumnsRenamed(own), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 1").drop("score", "predicted").withColumnsRenamed({v: k for k, v in own.items()})


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in an earlier place; one whose lines all do so is gone with them. n_chars, if there, follows the text."""
    own = {"n_lines": "n_lines of its own", "n_removed": "n_removed of its own"}
    kept = lines.dedup(docs.withColumnsRenamed(own)).where("n_removed = 0 OR text RLIKE r'\\S'").drop(*own)
    kept = kept.withColumnsRenamed({v: k for k, v in own.items()})
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return kept.select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the least id, of each group whose sets of five-word shingles are linked by a similarity of 0.8 or more."""
    first = jaccard.join(docs.select("doc_id", "text"), k=5, percent=80).where("component_id IS NULL OR doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(first, docs.doc_id.eqNullSafe(first.kept_id), "left_semi")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark windows."""
    return decontamination.cut(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, the piece ids of the text, their number, and whether they decode to the text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    both = pieces.round_trip(docs, model)
    back = F.col("decoded").eqNullSafe(F.replace("text", F.lit(pieces.BLANK), F.lit(" ")))
    return both.select("doc_id", "lang", "source", "n_chars", "ids", F.size(F.coalesce("ids", F.array().cast("array<int>"))).cast("long").alias("n_ids"), back.alias("round_trip"))


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("jaccard", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", pieces_stage),
]

#: No stage but decontamination can be said in SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
