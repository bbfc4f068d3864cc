"""From raw documents to token ids: five stages over whole tables, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm import bpe, common, decontaminate, pii, quality, simhash


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below 0.3 go. Labels of held-out ids are not learnt from."""
    settings = quality.Settings()
    labels = common.read_table(spark, sf_dir, "labels").select("doc_id", "quality").where(common.id_remainder("doc_id", 5) != 0)
    return quality.score(docs, quality.fit(docs, labels, settings=settings), settings, "_quality").where("_quality >= 0.3").select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose five-word shingles are similar by 0.8 or more the one with the smallest id stays."""
    return simhash.keep_one_similar(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other numbers or names, go."""
    return decontaminate.drop_leaked(docs, common.read_table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows the new text."""
    clean = pii.annotate(docs, spans_col="_spans", redacted_col="_redacted")
    return clean.withColumn("text", F.col("_redacted")).withColumn("n_chars", F.length("_redacted").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (little-endian unsigned 32-bit integers) and their number; the decoded text must be the text."""
    out = bpe.encode(docs, bpe.tokenizer_path())
    return out.select("doc_id", "lang", "source", "n_chars", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("PII", personal_data_stage),
    ("BPE encoding and decoding", tokens_stage),
]

#: Trained models, fingerprints and token merges have no SQL form; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, f"stage-{k}")
    return docs
