"""Shuffling lines and dealing them out to train, test and dev splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.indexing import with_row_index, with_running_total
from corpusmill.functions.planning import SplitCounts


def shuffle_key(column: str, seed: int = 0) -> Column:
    """A pseudo-random order that depends on the row's key and the seed only, not on the partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")))


def round_robin(lines: DataFrame, splits: int, order: str = "line_no") -> DataFrame:
    """lines with split_idx: the i-th line goes to split i modulo splits, order is kept inside."""
    return with_row_index(lines, order, name="row__").withColumn("split_idx", F.pmod(F.col("row__"), F.lit(splits)).cast("bigint")).drop("row__")


def shuffled_splits(lines: DataFrame, splits: int, order: str = "line_no", seed: int = 0) -> DataFrame:
    """lines in a seeded shuffle, cut in splits of equal size (the first ones larger by one), with split_idx and their place in it (pos)."""
    keyed = with_row_index(lines.withColumn("key__", shuffle_key(order, seed)), "key__", order, name="row__")
    n = keyed.count()
    each, more = divmod(n, splits)
    row, edge = F.col("row__"), more * (each + 1)
    tail = F.floor((row - edge) / max(1, each)) + more
    split = F.when(row < edge, F.floor(row / (each + 1))).otherwise(tail).cast("bigint")
    start = F.when(split < more, split * (each + 1)).otherwise(edge + (split - more) * each)
    return keyed.withColumn("split_idx", split).withColumn("pos", (row - start).cast("bigint")).drop("key__", "row__")


def bucket_shuffle(lines: DataFrame, buckets: int, order: str = "line_no", seed: int = 0) -> DataFrame:
    """Approximate shuffle: lines are dealt round robin to buckets, each bucket is shuffled; adds split_idx and pos."""
    dealt = with_row_index(lines, order, name="row__").withColumn("split_idx", F.pmod(F.col("row__"), F.lit(buckets)).cast("bigint"))
    keys = dealt.select("split_idx", shuffle_key(order, seed).alias("key__"), F.col(order).alias("order__"), "row__", F.lit(1).cast("bigint").alias("one__"))
    places = with_running_total(keys, "split_idx", "key__", "order__", "row__", size="one__", name="pos")
    return dealt.join(places.select("row__", "pos"), "row__").drop("row__")


def dataset_type(split_idx: Column, counts: SplitCounts) -> Column:
    """train, then test, then dev, in the order of splits."""
    return F.when(split_idx < counts.train, "train").when(split_idx < counts.train + counts.test, "test").otherwise("dev")


def with_labels(lines: DataFrame, counts: SplitCounts) -> DataFrame:
    """lines(split_idx) with dataset_type, shard_no (from 1) and the split's name."""
    kind, split = dataset_type(F.col("split_idx"), counts), F.col("split_idx")
    first = F.when(kind == "train", 0).when(kind == "test", counts.train).otherwise(counts.train + counts.test)
    of = F.when(kind == "train", counts.train).when(kind == "test", counts.test).otherwise(counts.dev)
    out = lines.withColumn("dataset_type", kind).withColumn("shard_no", (split - first + 1).cast("int"))
    return out.withColumn("split_name", F.concat_ws("_", "dataset_type", F.col("shard_no").cast("string"), F.lit("of"), of.cast("string")))


def require_lines(lines: DataFrame, splits: int) -> None:
    """ValueError if the input is empty or has fewer than splits + 2 lines."""
    n = lines.limit(splits + 2).count()
    if not n:
        raise ValueError("the input is empty")
    if n < splits + 2:
        raise ValueError(f"{n} lines are too few for {splits} splits")


def require_filled(labelled: DataFrame, counts: SplitCounts) -> None:
    """ValueError if a train or dev split has no line."""
    filled = labelled.where("dataset_type <> 'test'").select("split_idx").distinct().count()
    if filled < counts.train + counts.dev:
        raise ValueError(f"{counts.train + counts.dev - filled} train or dev splits are empty; use fewer splits")
