"""A training corpus from ``documents``: quality rules, line dedup, near-dedup, secret masking, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. ``n_chars`` follows the text. Further
columns, whatever their names, pass through all but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm._common import materialize
from sessionloom.llm.line_dedup import line_dedup
from sessionloom.llm.packing import pack_documents
from sessionloom.llm.quality_rules import quality_filter
from sessionloom.llm.secret_scan import mask_secrets
from sessionloom.llm.simhash import similar_groups


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the certified quality rules keep; null, empty and blank texts fail the base rule, repeated rows each count, an empty table stays empty."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that five or more documents share, except where the largest id holds them.

    Null and empty texts stay; rows tied for the largest id all keep the line;
    a null id is smaller than any other; an empty table stays empty.
    """
    kept = line_dedup(docs)
    return _counted(kept.withColumn("text", F.col("kept_text")).select(*docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group that SimHash finds and a similarity of 0.8 of five-word shingles confirms.

    Rows that repeat that id are that document and stay. Null, empty and blank
    texts are one group; a null id is kept only in a group without others. An
    empty table stays empty.
    """
    grouped, _ = similar_groups(docs)
    return grouped.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every found secret replaced by its kind; null and empty texts stay, repeated rows are masked alike, an empty table stays empty."""
    return _counted(mask_secrets(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in packed sequences; a null or empty text is the end id alone, equal lengths are placed in any order, no documents give no rows."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("secrets", secrets), ("packing", packing)]

#: XXH64 and the tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
