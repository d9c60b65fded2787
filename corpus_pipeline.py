"""A training corpus from raw documents: five operators, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanledger.llm import mixing, packing, quality_rules, simhash, suffix_dedup
from spanledger.llm.common import stored, table
from spanledger.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.kept(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity of 0.8 or more) the document with the smallest id stays."""
    return simhash.survivors(docs, **simhash.STAGE)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each string of 200 bytes that starts more than once the first copy stays."""
    return suffix_dedup.cleaned(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as often as its source's target takes it."""
    return mixing.taken(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.packed(docs, tokenizer_path())


STAGES = [("quality rules", quality), ("simhash near-dedup", near_copies), ("suffix-array dedup", repeats), ("mixing to target weights", mix), ("packing", pack)]

#: Fingerprints, suffix arrays and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
