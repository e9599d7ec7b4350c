"""The corpus pipeline: five operators in a row, each on all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of documents. run()
writes each stage's result as Parquet in the shared folder and reads it as the
next stage's docs; what no stage reads any more is removed.

Defined cases are the operators': null and empty texts, repeated rows, empty
tables and columns beside those of documents pass every stage; a document whose
lines all go keeps its row and an empty text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, near_dups, pieces, quality_gam
from tessera.llm._shared import drop_folder, new_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose quality score is 0.5 or more."""
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_gam.score_column(model, F.col("text")) >= 0.5)


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars counts the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines of three-line windows that occurred before."""
    # the operator's own counts must not replace columns of that name
    held = {c: f"_tsr_held_{c}" for c in ("n_lines", "n_removed") if c in docs.columns}
    out = line_dedup.dedup_lines(docs.withColumnsRenamed(held)).drop("n_lines", "n_removed")
    return _measured(out.withColumnsRenamed({v: k for k, v in held.items()}).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of near duplicates: five-word shingles, a similarity of 0.8 or more."""
    return near_dups.drop_near_duplicates(docs, percent=80).select(*docs.columns)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes contaminated documents."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids): begin and end ids included."""
    out = pieces.encode_pieces(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("minhash_near_dedup", near_duplicates), ("benchmark_decontamination", contamination), ("sentencepiece", encode)]

#: SQL can't express the classifier; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_folder(spark, before)
        before = path
    return docs
