"""Corpus cleaning in five stages, each written as Parquet and read by the next.

1. language: documents whose language is rejected go.
2. near_duplicates: one document of each component of near copies (SimHash of five-word shingles, completed and
   verified at a similarity of 0.8) stays.
3. repeated_passages: words of passages of 50 words or more that occurred before go, and texts left empty.
4. decontamination: documents that hold ten consecutive words of a benchmark item go.
5. packing: what is left is packed into sequences of 1024 tokens.

A stage gets the rows that its predecessor kept and returns rows of the same columns; the
last returns pieces of sequences.  Columns beyond those of ``documents`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagweave.llm import common, decontaminate, language, near_copies, packing, suffixes


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.train(language.sample(docs))
    common.rested()  # the sample's memory goes back
    return language.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Learned models, fingerprints and token ids aren't within SQL; tests hold each stage's operator against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.stored(stage(spark, docs, sf_dir), name)
        common.dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
