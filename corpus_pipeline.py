"""The corpus pipeline: quality, line dedup, near-duplicates, source mix, tokens.

Each stage is (spark, docs, sf_dir) -> DataFrame; its result is written and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscale.llm import common, line_dedup, mixing, near_copies, passage_quality, pieces


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return passage_quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line that ten or more documents share stays in the first of them alone; every document stays."""
    kept = line_dedup.dedup_lines(docs, keep_first=True, counts=False)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group whose five-word shingles are alike by 0.8 or more."""
    return near_copies.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars and the token ids of every document."""
    return pieces.encode_documents(docs, pieces.read_model(pieces.default_model(spark)))


STAGES = [
    ("quality", keep_good_quality),
    ("line_dedup", drop_common_lines),
    ("near_duplicates", drop_near_duplicates),
    ("source_mix", mix),
    ("tokens", tokenize),
]

#: No SQL: the classifier and the tokenizer can't be written in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's result is written, and what it was made of is deleted, as the stage before it is."""
    docs, start = common.table(spark, sf_dir, "documents"), common.marked()
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = common.saved(docs, name)
            common.delete_since(spark, start, [docs])
    return docs
