"""Counters over articles and sequences, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.config import COMPLETION, PADDING, PROMPT, SEP, PackingConfig
from corpusmill.operators.packing import dropped_by_packing, has_completion

COUNTERS = ("articles", "input_tokens", "output_tokens", "sequences", "prompt_tokens", "completion_tokens", "padding_tokens", "tokens_dropped_from_packing", "tokens_dropped_from_all_prompt")


def article_metrics(articles: DataFrame, config: PackingConfig, length: int, by: str = "dataset_type") -> DataFrame:
    """by, input_tokens, tokens_dropped_from_packing. Lengths n do for tokens."""
    n = (F.col("n") if "n" in articles.columns else F.size("tokens")).cast("bigint")
    return articles.groupBy(by).agg(F.sum(n).alias("input_tokens"), F.sum(dropped_by_packing(n, config, length)).alias("tokens_dropped_from_packing"))


def sequence_metrics(sequences: DataFrame, keep_prompt_only: bool = False, by: str = "dataset_type") -> DataFrame:
    """Counters over the packed sequences before the prompt-only filter; completions count together with separators."""
    size = F.size("tokens").cast("bigint")
    kept = F.lit(True) if keep_prompt_only else has_completion(F.col("tokens"))

    def count(*types: int) -> Column:
        return F.sum(F.when(kept, F.size(F.filter("tokens", lambda t: t.token_type.isin(*types)))).otherwise(0)).cast("bigint")

    return sequences.groupBy(by).agg(
        F.sum(F.when(kept, size).otherwise(0)).alias("output_tokens"), F.sum(kept.cast("bigint")).alias("sequences"), count(PROMPT).alias("prompt_tokens"), count(COMPLETION, SEP).alias("completion_tokens"),
        count(PADDING).alias("padding_tokens"), F.sum(F.when(kept, 0).otherwise(size)).cast("bigint").alias("tokens_dropped_from_all_prompt"),
    )


def all_metrics(lines: DataFrame, articles: DataFrame, sequences: DataFrame, config: PackingConfig, length: int, keep_prompt_only: bool = False, by: str = "dataset_type") -> DataFrame:
    """One row of COUNTERS per dataset type; articles counts lines, also malformed ones."""
    counted = lines.groupBy(by).agg(F.count(F.lit(1)).alias("articles"))
    joined = counted.join(article_metrics(articles, config, length, by), by, "left").join(sequence_metrics(sequences, keep_prompt_only, by), by, "left")
    return joined.select(by, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTERS])


def derived_metrics(metrics: DataFrame) -> DataFrame:
    """metrics with ratios; null where a denominator is zero."""
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    c = F.col
    return metrics.withColumns({
        "dropped_from_packing_percent": F.round(ratio(c("tokens_dropped_from_packing"), c("input_tokens")) * 100, 2),
        "dropped_from_all_prompt_percent": F.round(ratio(c("tokens_dropped_from_all_prompt"), c("input_tokens")) * 100, 2),
        "average_prompt_length": F.round(ratio(c("prompt_tokens"), c("articles")), 2), "average_completion_length": F.round(ratio(c("completion_tokens"), c("articles")), 2),
        "data_utilization_percent": F.round(ratio(c("output_tokens") - c("padding_tokens"), c("input_tokens")) * 100, 2),
        "sequence_utilization_percent": F.round(ratio(c("output_tokens") - c("padding_tokens"), c("output_tokens")) * 100, 2),
        "completion_utilization_percent": F.round(ratio(c("completion_tokens"), c("output_tokens")) * 100, 2),
    })


def recomputed_metadata(matrix: DataFrame, by: str = "dataset_type") -> DataFrame:
    """What a packed table says of itself: articles are its separators. matrix(dataset_type, shard_no, token_type_ids)."""
    count = lambda *types: F.sum(F.size(F.filter("token_type_ids", lambda t: t.isin(*types)))).cast("bigint")
    shards = matrix.groupBy(by, "shard_no").agg(
        F.count(F.lit(1)).alias("n"), count(SEP).alias("articles"), count(COMPLETION, SEP).alias("completion_tokens"), count(PROMPT).alias("prompt_tokens"), count(PADDING).alias("padding_tokens"),
        F.sum(F.size("token_type_ids")).cast("bigint").alias("output_tokens"),
    )
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("articles", "completion_tokens", "prompt_tokens", "padding_tokens", "output_tokens")]
    return shards.groupBy(by).agg(F.sum("n").cast("bigint").alias("sequences"), *sums, F.min("n").cast("bigint").alias("max_batch_size"), F.count(F.lit(1)).cast("bigint").alias("files"))


def sequence_counts(matrix: DataFrame, by: str = "dataset_type") -> DataFrame:
    return matrix.groupBy(by).agg(F.count(F.lit(1)).alias("sequences"))


def article_count(lines: DataFrame, text: str = "value") -> DataFrame:
    """Lines that aren't blank."""
    return lines.agg(F.coalesce(F.count_if(F.trim(F.regexp_replace(text, r"\s", " ")) != ""), F.lit(0)).cast("bigint").alias("articles"))


def estimated_article_count(lines: DataFrame, shard: str, sampled: int = 5) -> DataFrame:
    """Mean lines of the first `sampled` shards, times shards. Prefer article_count, which is exact."""
    sizes = lines.groupBy(shard).agg(F.count(F.lit(1)).alias("n"))
    first = sizes.orderBy(shard).limit(sampled).agg(F.avg("n").alias("mean"))
    return first.crossJoin(sizes.agg(F.count(F.lit(1)).alias("shards"))).select(F.round(F.col("mean") * F.col("shards")).cast("bigint").alias("articles"))  # two single rows


def audit_state(expected: Column, missing: Column) -> Column:
    """complete, nearly complete (within 0.1 %) or incomplete."""
    share = F.abs(F.try_divide(missing.cast("double"), expected.cast("double")))
    return F.when(missing == 0, "complete").when(F.coalesce(share, F.lit(0.0)) <= 0.001, "nearly complete").otherwise("incomplete")


def utilization_by(lines: DataFrame, skipped: DataFrame, articles: DataFrame, by: str = "dataset_type") -> DataFrame:
    """(by, expected, processed, missing, state): lines without those skipped, against lines of which there is an article. Lines have one line_no each."""
    counted = lines.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    out = counted.join(skipped.groupBy(by).agg(F.count(F.lit(1)).alias("s")), by, "left").join(articles.groupBy(by).agg(F.countDistinct("line_no").alias("p")), by, "left")
    out = out.select(by, (F.col("n") - F.coalesce("s", F.lit(0))).alias("expected"), F.coalesce("p", F.lit(0)).alias("processed")).withColumn("missing", F.col("expected") - F.col("processed"))
    return out.withColumn("state", audit_state(F.col("expected"), F.col("missing")))


def utilization_audit(counted: int, skipped: int, processed: int) -> dict:
    """How many of the articles that should have been processed were: complete, nearly (within 0.1 %) or incomplete."""
    expected = counted - skipped
    missing = expected - processed
    share = missing / expected if expected else 0.0
    state = "complete" if missing == 0 else "nearly complete" if abs(share) <= 0.001 else "incomplete"
    return {"expected": expected, "processed": processed, "missing": missing, "missing_share": share, "state": state}
