"""Equal row counts for the shards of a dataset type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rebalance(sequences: DataFrame, shards: DataFrame | None = None) -> DataFrame:
    """sequences(dataset_type, shard_no, seq, ...) with new shard_no and seq, so that shards of a type differ by one row at most.

    The first shards are the larger ones. Rows beyond a shard's target are taken from its end, in the order of shards,
    and fill up the shards that lack rows, in order. shards(dataset_type, shard_no) names shards that may be empty.
    Only counts per shard are summed up in order; rows stay where they are but for the surplus.
    """
    known = sequences.groupBy("dataset_type", "shard_no").agg(F.count(F.lit(1)).alias("n"))
    if shards is not None:
        known = shards.select("dataset_type", "shard_no").distinct().join(known, ["dataset_type", "shard_no"], "left").fillna({"n": 0})
    by_type = Window.partitionBy("dataset_type")
    ordered = by_type.orderBy("shard_no")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    plan = known.withColumn("rank", F.row_number().over(ordered) - 1).withColumn("k", F.count(F.lit(1)).over(by_type)).withColumn("total", F.sum("n").over(by_type))
    plan = plan.withColumn("target", F.expr("total div k") + (F.col("rank") < F.expr("total % k")).cast("bigint"))
    plan = plan.withColumn("give", F.greatest(F.col("n") - F.col("target"), F.lit(0))).withColumn("need", F.greatest(F.col("target") - F.col("n"), F.lit(0)))
    plan = plan.withColumn("give_from", F.coalesce(F.sum("give").over(before), F.lit(0))).withColumn("need_from", F.coalesce(F.sum("need").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("dataset_type", "shard_no").orderBy("seq")) - 1
    rows = sequences.withColumn("row__", place.cast("bigint")).join(plan.select("dataset_type", "shard_no", "target", "give_from"), ["dataset_type", "shard_no"])
    surplus = F.when(F.col("row__") >= F.col("target"), F.col("give_from") + F.col("row__") - F.col("target"))
    rows = rows.withColumn("surplus__", surplus)
    stay = rows.where("surplus__ is null").withColumn("seq", F.col("row__"))
    # one entry for every free place; there are as many as surplus rows
    places = plan.where("need > 0").select(F.col("dataset_type").alias("t__"), F.col("shard_no").alias("new__"), "n", F.posexplode(F.sequence(F.lit(1), F.col("need").cast("int"))).alias("i__", "x__"), "need_from")
    places = places.select("t__", "new__", (F.col("n") + F.col("i__")).cast("bigint").alias("seq__"), (F.col("need_from") + F.col("i__")).cast("bigint").alias("place__"))
    move = rows.where("surplus__ is not null").join(places, (F.col("dataset_type") == F.col("t__")) & (F.col("surplus__") == F.col("place__")))
    move = move.withColumn("shard_no", F.col("new__")).withColumn("seq", F.col("seq__"))
    return stay.select(*sequences.columns).unionByName(move.select(*sequences.columns))


def max_batch_size(sequences: DataFrame) -> DataFrame:
    """(dataset_type, max_batch_size): the least number of rows of a shard."""
    counts = sequences.groupBy("dataset_type", "shard_no").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("dataset_type").agg(F.min("n").alias("max_batch_size"))
