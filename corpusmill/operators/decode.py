"""Packed sequences back to readable text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.config import PADDING, SEP


def segments(tokens: DataFrame, *keys: str) -> DataFrame:
    """(keys, segment, kind, first_pos, n_tokens, text) of tokens(keys, pos, word, type_id).

    Runs of one type are a segment. A separator joins the completion that it closes and starts no segment of its
    own; one that directly follows another, or comes first, is left out. Padding is one segment without text.
    """
    order = Window.partitionBy(*keys).orderBy("pos")
    before = F.lag("type_id").over(order)
    rows = tokens.withColumn("before__", before).where((F.col("type_id") != SEP) | (F.col("before__").isNotNull() & (F.col("before__") != SEP)))
    starts = F.when(F.col("type_id") == SEP, 0).when(F.col("before__").isNull() | (F.col("before__") != F.col("type_id")), 1).otherwise(0)
    rows = rows.withColumn("segment", F.sum(starts).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    kind = F.max(F.when(F.col("type_id") != SEP, F.col("type_id")))
    made = rows.groupBy(*keys, "segment").agg(
        kind.alias("kind"), F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_tokens"), F.max((F.col("type_id") == SEP).cast("int")).alias("separated"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x.word), " ").alias("text"),
    )
    text = F.when(F.col("kind") == PADDING, F.lit("")).otherwise(F.col("text"))
    return made.select(*keys, F.col("segment").cast("bigint").alias("segment"), F.col("kind").cast("bigint").alias("kind"), F.col("first_pos").cast("bigint").alias("first_pos"), "n_tokens", F.col("separated").cast("bigint").alias("separated"), text.alias("text"))


def report(found: DataFrame, *keys: str) -> DataFrame:
    """(keys, report): one readable text per sequence."""
    names = F.when(F.col("kind") == 0, "PROMPT: ").when(F.col("kind") == 1, "COMPLETION: ").otherwise("PADDING TOKENS: ")
    body = F.when(F.col("kind") == PADDING, F.col("n_tokens").cast("string")).otherwise(F.col("text"))
    line = F.concat(names, body, F.when(F.col("separated") == 1, "\n---- attention boundary ----").otherwise(""))
    return found.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("segment", line.alias("line")))), lambda x: x.line), "\n").alias("report"))
