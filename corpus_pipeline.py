"""The corpus pipeline: each stage reads what its predecessor kept.

Every stage takes whole tables. Nulls in any column, empty and very long texts, ties, repeated rows, empty tables
and other columns have the results that each stage's operator states; a stage returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.jaccard import one_of_each
from spanweave.llm.line_dedup import line_dedup
from spanweave.llm.mixing import mix
from spanweave.llm.packing import pack
from spanweave.llm.quality import quality_rules
from spanweave.llm.staging import discard, staged
from spanweave.llm.tokens import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A source's target proportion of the packed tokens is its share of all documents' characters to this power.
TEMPER = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that too many documents of their host share.

    A document with a null or empty text goes (it has under 50 words); each repeated row is judged by itself.
    """
    d = quality_rules(docs).where("kept").withColumn("text", F.col("text_left"))
    return d.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of lines that occur earlier; a document of which no word is left goes.

    Rows that agree in doc_id and text count as one and stay or go together; a null doc_id comes first in order.
    """
    d = line_dedup(docs).where((F.col("n_removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return d.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of similar ones; rows with a null doc_id and without words stay."""
    return one_of_each(docs).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents at the rates of their sources, in a global random order; a null source is ''."""
    return mix(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, whose windows hold the sources' target proportions.

    The targets come from the documents before the first stage, so that what the stages removed doesn't move them.
    A null text has one token, the end.
    """
    before = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("source").agg(F.sum("n_chars").alias("n"))
    targets = before.select("source", F.pow(F.coalesce("n", F.lit(0)).cast("double"), F.lit(TEMPER)).alias("weight"))
    return pack(docs, tokenizer_path(), weights=targets)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", packing)]

#: Token ids can't be had in SQL; the tests compare each stage with a brute-force version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage over the previous one's written result, from the documents on; that result goes when the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
