"""Corpus pipeline: quality classifier, line dedup, SimHash near-dedup, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Stages are written to the shared folder and read again in between. Empty tables pass
through; null texts count as empty; rows with a null doc_id are rows like others. The mixing stage
writes its rows in training order, which the last stage reads back as the column position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factorloom.llm import bpe, line_dedup, mixing, quality, simhash
from factorloom.llm.queries import tokenizer_file
from factorloom.session import Scratch, table

#: SQL can't express hashing trained features, prefix doubling or BPE; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the labelled ones among them, doesn't reject.

    Without a labelled document nothing is rejected; rows with equal texts share a fate.
    """
    return quality.select_quality(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs; documents that were nothing else go.

    The first copy is that of the smallest doc_id, nulls first; null and empty texts stay.
    """
    return line_dedup.without_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: similarity of 0.8 or more over 5-word shingles, as 256-bit fingerprints tell it.

    The smallest doc_id stays, nulls last; all texts without words are copies of each other.
    """
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order. Texts without words are never taken; null is a source."""
    return mixing.training_order(mixing.plan_mix(docs, keep=tuple(docs.columns)))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of decoded texts, a row for each document that the mix takes, sorted by position.

    position numbers the rows in the order in which docs was written; null where docs isn't read from files.
    """
    placed = mixing.with_place(docs.select("doc_id", "text"), "position")
    codes = bpe.bpe_codes(placed, tokenizer_file("word_bpe_49k.json"), carry={"position": "long"})
    return Scratch(spark, "bpe").keep(codes).orderBy("position")  # a sort looks at its input twice, texts are encoded once


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, last = scratch.keep(stage(spark, docs, sf_dir)), before
        before = docs
        if last is not None:
            scratch.drop(last)
    return STAGES[-1][1](spark, docs, sf_dir)
