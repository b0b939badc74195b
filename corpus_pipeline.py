"""A corpus pipeline of five training-data stages; each works on all that the stage before it kept.

Between stages the documents are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivar.llm.common import Scratch, table, unique_rows
from lexivar.llm.decontam import contained
from lexivar.llm.langid import UNKNOWN, identify, train
from lexivar.llm.linededup import line_dedup
from lexivar.llm.mixing import entropy_mix
from lexivar.llm.neardup import near_duplicates

#: Below this part of a text's n-grams known to its language, the text is rejected as in no known language.
MIN_COVERAGE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the model knows; texts that are null or without letters and those of too unlike letters go.

    The model counts all rows with a language. Repeated rows and ids are judged each by itself; without any language all rows go.
    """
    model = train(docs.where(F.col("lang").isNotNull()).select("lang", "text"))
    found = identify(docs.select(F.struct("*").alias("row"), "text"), model, id_col="row")
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("coverage") >= MIN_COVERAGE)).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that stood before; a document of which nothing but white space is left goes, one that lost no line stays as it is.

    Each row keeps its own text, repeated and null ids included; null texts stay.
    """
    out = line_dedup(docs, keep=tuple(c for c in docs.columns if c != "text")).where((F.col("n_removed") == 0) | F.col("clean_text").rlike(r"\S"))
    new = {"text": F.col("clean_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("clean_text").cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: that of the least id where ids are unique, else that which stands first in the table.

    Rows are told apart by a key of their own, so of rows that share an id only the copies go. Texts without words stay.
    """
    docs_ = unique_rows(Scratch(spark, "stage"), docs, "doc_id", "__row")
    gone = near_duplicates(docs_, id_col="__row").where("not kept").select("__row")
    return docs_.join(gone, "__row", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, by their own text: a repeated id loses only the rows that leak, and rows without an id are searched too."""
    docs_ = unique_rows(Scratch(spark, "stage"), docs, "doc_id", "__row")
    leaks = contained(docs_, table(spark, sf_dir, "benchmark"), id_col="__row").select("__row").distinct()
    return docs_.join(leaks, "__row", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document; those that it never takes go, as do those without words. Rows that share an id are taken each by itself."""
    return entropy_mix(docs).where("copies > 0")


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicate),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: Locality-sensitive and floating-point stages have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
