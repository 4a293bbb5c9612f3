"""A corpus pipeline of five stages over `documents`.

quality -> one of each group of near duplicates -> benchmark decontamination -> personal data -> subwords.
Each stage takes all rows that the one before kept; all but the last return the columns of `documents`.
Documents without labels still get a score; a document with a null text is scored as an empty one. Rows are judged one by
one: repeated rows stay together or go together, except that of near duplicates only those of the smallest id stay. Rows with a
null id link to nothing and stay unless another stage drops them. An empty table gives no rows, and without labels of both
classes nothing is rejected. Columns besides those of `documents`, whatever their names, are carried through the first four
stages. Very long texts are worked off whole, in slices where they meet Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, jaccard, pieces, pii, quality
from tidemark.llm.common import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, does not reject."""
    model = quality.train(quality.labelled(docs, table(spark, sf_dir, "labels"), "quality"))
    return quality.score(docs, model, keep=True).filter("score >= 0.5").select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of every component of near duplicates."""
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced and `n_chars` counted anew."""
    clean = pii.redact(docs)
    n = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", n).select(docs.columns)


def subword_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Subword ids of every document, their number, and the text decoded from them."""
    coded = pieces.encode_decode(docs)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", personal_data_stage),
    ("SentencePiece encoding and decoding", subword_stage),
]

#: The classifier cannot be expressed in SQL; tests compare the stages with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
