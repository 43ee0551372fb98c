"""Training-corpus pipeline.

Five stages, each with one operator, work on all that the stage before has kept:

1. toxicity: documents that the classifier rejects go.
2. near_duplicates: of each group of near-duplicates (similarity of their sets of five
   words in a row 0.8 or more) one document stays.
3. decontamination: documents that hold a window of the benchmark go.
4. secrets: all secrets in texts are masked.
5. mixing: the words that the mix takes of each document.

All but the last return the columns of ``documents`` (``n_chars`` follows the
text). Rows that a stage has no reason to reject stay, nulls and empty texts too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import decontam, mixing, secrets, simhash, toxicity
from folioforge.llm.common import drop_tables, materialize, release, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under the threshold; learned from the labels of those that are here."""
    release(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, out=("__score", "__toxic")).filter("__toxic = 0").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates at similarity 0.8 of five-word shingles, the one with the least id."""
    release(spark)
    return simhash.keep_one(docs).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    release(spark)
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    release(spark)
    model = secrets.train(secrets.labelled_samples(docs))
    masked = secrets.redact(secrets.find_secrets(docs, model, out="__spans"), spans="__spans")
    return masked.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target and taken for all documents."""
    release(spark)
    return mixing.mix_report(mixing.mix_sources(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix),
]

#: Learned scores and XXH64 fingerprints have no SQL form; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages, one after the other, to ``documents``; each result is written before the next stage reads it.

    Tables that a stage has written for itself are deleted once its result is written.
    """
    since = written()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
            drop_tables(spark, since, keep=1)
    return docs
