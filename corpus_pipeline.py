"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Language ID drops documents of no known language and names the language of all others; the Jaccard join leaves one document of each group of near copies;
repeat removal cuts byte strings that occur earlier; decontamination drops documents that hold a benchmark item;
packing lays the rest out in sequences.  Every stage works on all that the one before it kept.

Defined results, in every stage: rows that repeat a doc_id are documents of their own (where decisions go by doc_id, all
of them share the decision), a null doc_id is an id of its own, a null text is an empty one, other columns are carried
along whatever their names, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, jaccard, langid, packing, repeats
from graphloom.llm.common import Scratch, table
from graphloom.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A text without a letter, of a script that was not learned, or without a main language goes; a language is written to lang."""
    return langid.identified(docs, langid.fit(docs.where(~langid.held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked texts the row of least doc_id stays (a null id last); empty texts are linked with nothing and stay."""
    return jaccard.representatives(docs, Scratch(spark, "near"))


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; bytes of strings of 100 bytes that also start earlier are cut out of text, which may leave it empty."""
    return repeats.cleaned(docs, Scratch(spark, "repeats"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of a doc_id go if one of them holds a benchmark item; null and empty texts stay."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "leaks"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row; an empty or null text is a piece of the end id alone."""
    return packing.pack(docs, tokenizer_path(), 0, Scratch(spark, "packing"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeat_removal", repeat_removal),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit),
]

#: Viterbi paths, components and packing are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    last = None
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if last:  # no later stage reads it
            scratch.drop(last)
        last = name
    return docs
