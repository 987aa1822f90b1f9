"""The corpus pipeline: each stage works on all documents that the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. run() writes every
stage's result as Parquet in the shared folder and reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabveil.llm import decontaminate, mixing, ngram_join, pii, quality
from tabveil.llm.common import new_folder, read_table, scope, set_aside


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field does not predict to be bad. Null and empty texts are scored as one empty line; every
    row is judged by its text alone; without labels the field scores by its prior. All columns stay as they are."""
    field = quality.train(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality"))
    rows, columns = set_aside(docs, "quality_score")
    return quality.score_quality(rows, field).filter(F.col("quality_score") >= quality.THRESHOLD).select(*columns)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles with a similarity of 0.8 or more link: that of the smallest
    doc_id (null last), of rows that share it one. Null and word-less texts link with nothing and stay."""
    return ngram_join.keep_first(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in windows of test items. Null and word-less texts stay, and so do
    all without a hit; repeated rows are judged one by one."""
    rows, columns = set_aside(docs, *decontaminate.ADDED)
    found = decontaminate.contaminated(decontaminate.find_contamination(rows, read_table(spark, sf_dir, "benchmark")))
    return found.filter(~F.col("contaminated")).select(*columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets replaced by their kind. Null texts stay null; rows equal in id and text
    get the same spans."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with mix_reads: how often it reads each. Null sources are one source; texts without words
    are never read; rows that repeat an id count one by one. A column named mix_reads is replaced."""
    return mixing.mix_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_first_copies),
    ("benchmark decontamination", drop_contaminated),
    ("PII", redact_pii),
    ("mixing sources", mix_sources),
]

#: The classifier and the PII graph have no SQL form; tests/llm/test_pipeline.py holds stages and run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix. An empty table gives an empty result. Intermediate tables of a stage go once its result is written."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, "stage-" + name.replace(" ", "-"))
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
