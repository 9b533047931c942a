"""The corpus pipeline: five stages from raw documents to token digests.

1. toxicity: documents scored 0.5 or more go.
2. line dedup: later repeated runs of lines go from the texts; n_chars follows. A document stays even if no line is left.
3. near-dedup: of each class of near-duplicates the document of smallest id stays.
4. decontamination: documents that leak a benchmark item go.
5. SentencePiece: every text left is encoded and decoded; one row of digests per document.

Every stage's result is written as Parquet and read again, so a lost executor
costs the rows of one stage at most. What nulls, empty texts, ties, repeated
rows and empty tables give is said in the operators; an empty table passes every
stage. Only `text` and `doc_id` are read; other columns pass.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm import decontam, lines, neardup, pieces, toxicity
from agora.llm.common import shared_folder, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.dedup(docs)
    if "n_chars" in docs.columns:
        removed = F.col(lines.free("n_removed", docs.columns)) > 0
        out = out.withColumn("n_chars", F.when(removed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.without_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, pieces.model_path())


STAGES = [
    ("toxicity", toxic),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece", encode),
]
#: Learned and tokenised stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, home = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{n}")
        docs = spark.read.parquet(f"{home}/{n}")
    return docs
