"""A corpus pipeline of four stages, each written as Parquet and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, packing, pii, simhash
from tidemark.llm.common import new_folder, remove

#: A document whose language has a lower probability than this is rejected, as are those without letters.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a probability of LEAST_SCORE or more, all columns as they are.

    Texts that are null or have no letter go, as does every document if none has a language to learn from. Each row is
    judged by its own text: repeated rows, rows with null ids and rows that share an id stay or go by themselves, and
    nulls elsewhere change nothing. An empty table gives no rows."""
    return langid.told(docs, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, all columns as they are: that with the least id.

    Null ids come last; of rows that share the id that of the least text hash stays, of equal rows one. So rows with
    null ids and rows that share an id but not a near text all stay. Null and wordless texts are one group. An empty
    table gives no rows."""
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind in brackets; n_chars follows the text (null for a null text).

    Null texts, null ids, repeated rows and all other columns stay as they are. An empty table gives no rows."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, n_words, bin_id, start, bin_words.

    Null and wordless texts are one piece of no words; null sources conflict with nothing; null ids are packed like any
    other; repeated rows are packed apart. Other columns are ignored. An empty table gives no rows."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packing_plan)]

#: The stages train a classifier, estimate labelers and pack greedily: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, with a table in the shared folder between two; a table goes when its stage is done."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        if k:
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
