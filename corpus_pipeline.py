"""The corpus pipeline: five stages over documents, from language filtering to packed sequences.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept, and returns a
DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import decontaminate, langid, packing, shingles, substring
from corpusmill.llm.common import materialize, pick, release, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the language classifier rejects."""
    found = langid.identify(pick(docs, *COLUMNS), langid.fit(docs))
    return found.where("not rejected").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group linked by a similarity of 5-word shingles of at least 0.8.

    Fingerprints select which documents are compared. A document without doc_id stays only where none of its group has one.
    """
    return shingles.one_of_each(pick(docs, *COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages that occur earlier; documents of which nothing is left go."""
    cleaned = substring.remove_repeated(pick(docs, *COLUMNS)).where("n_removed = 0 or n_removed < n_words")
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    found = decontaminate.decontaminate(pick(docs, *COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where("not contaminated").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents in sequences of 2048 tokens, one row per piece."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_free", benchmark_free),
    ("packed", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result but the last is written before the next stage reads it, and then its predecessor is deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Stages 1 and 5 can't be put in SQL (a learned model, a tokenizer), so run() has none; tests compare every stage with a version that is independent of it.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
