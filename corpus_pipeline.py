"""A corpus made ready for training, in stages: language identification, near-duplicates, benchmark decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of documents.

What holds for every stage: columns are found by name, an exact one before one in another case, the first of several; other columns go through
as they are, whatever they are called. An empty table gives an empty one. Texts are read whole, however long. Rows are decided one by one: a
repeated row is a row of its own, except where a stage says otherwise. No stage sees what an earlier one dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import decontam, langid, minhash, mixing, tokens
from lumenfold.llm.common import cut, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay; those without letters, or too unlike any, go. A null or empty text has no letters and goes. A null
    lang is never learned from; a null doc_id counts as the text "". Repeated rows get one verdict. Of languages with one score the first by
    name wins. Without a labelled row there is no language to be in, and all rows go."""
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id: shingles of five words, similarity 0.8 or more. A text of fewer words is
    one shingle; a null or empty one, or one without words, is like no other and stays. Of repeated rows (one doc_id and text) one stays; different
    texts of one doc_id are documents of their own, the smaller that with the lesser hash. Null doc_ids come after all others."""
    return minhash.deduplicated(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark, ten words or a whole shorter item, go. A null or empty text holds none and stays; null or
    empty items match nothing; repeated items count once, repeated rows share their verdict."""
    return decontam.cleaned(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics meet their target weights. Null sources and languages are values of their own;
    a null or empty text has no tokens and weighs nothing. The draw is a hash of the doc_id, so repeated rows, and rows without id, share it."""
    return mixing.sampled(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what they say of each document: doc_id, start, n_tokens, ids_crc32, in ascending order of doc_id, nulls last, rows of one
    doc_id by their text's hash. A null or empty text has the end id alone."""
    return tokens.token_output(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

#: Stages of trained classifiers, hashing and tokenizers are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, each on the written table of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        # stored under plain names: a table cannot have two that differ in case only
        docs = cut(out.toDF(*[f"c{i}" for i in range(len(out.columns))]), name).toDF(*out.columns)
    return STAGES[-1][1](spark, docs, sf_dir)
