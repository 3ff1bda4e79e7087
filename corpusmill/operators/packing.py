"""Articles to sequences of fixed length, for each split on its own.

Input rows are (split_idx, line_no, art_no, tokens); output rows are (split_idx, seq, tokens) with
exactly max_seq_length tokens, padded at the end. The places of articles follow from their keys and lengths
alone (n, their tokens). Tokens may be bare ids (array<int>) as well as typed ones, which are ten times their size in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from corpusmill.config import COMPLETION, NO_CATEGORY, PADDING, PackingConfig
from corpusmill.functions.indexing import with_running_total
from corpusmill.functions.shipping import ship


def padded(tokens: Column, length: int, pad_id: int, bare: bool = False) -> Column:
    """bare: tokens are ids."""
    pad = F.lit(pad_id) if bare else F.struct(F.lit(pad_id).alias("token_id"), F.lit(PADDING).alias("token_type"), F.lit(NO_CATEGORY).alias("category_id"))
    return F.concat(tokens, F.array_repeat(pad, F.lit(length) - F.size(tokens)))


def truncated(tokens: Column, length: int, overflow: str) -> Column:
    """What is kept of an article for an empty sequence; null if nothing."""
    kept = {"drop": F.lit(None), "truncate_left": F.slice(tokens, -length, length), "truncate_right": F.slice(tokens, 1, length)}[overflow]
    return F.when(F.size(tokens) <= length, tokens).otherwise(kept)


_KEY = ["split_idx", "line_no", "art_no"]


def full_starts(keys: DataFrame) -> DataFrame:
    """keys(split_idx, line_no, art_no, n) of articles that have tokens, with start, the tokens of their split before them."""
    return with_running_total(keys.where("n > 0"), *_KEY, size="n", name="start")


def cut_full(rows: DataFrame, length: int, pad_id: int) -> DataFrame:
    """rows(split_idx, start, n, tokens) to sequences; tokens go straight to theirs."""
    rows = rows.withColumn("end", F.col("start") + F.col("n"))
    rows = rows.withColumn("seq", F.explode(F.sequence(F.expr(f"start div {length}"), F.expr(f"(end - 1) div {length}"))))
    first = F.greatest(F.col("seq") * length - F.col("start"), F.lit(0))
    size = F.least((F.col("seq") + 1) * length - F.col("start"), F.col("n")) - first
    pieces = rows.select("split_idx", "seq", F.col("start").alias("at"), F.slice("tokens", (first + 1).cast("int"), size.cast("int")).alias("piece"))
    return _assembled(pieces, length, pad_id)


def pack_full(articles: DataFrame, length: int, pad_id: int) -> DataFrame:
    """All tokens of a split in one stream, cut every length tokens.

    Only keys and lengths are sorted; tokens go straight to their sequences. articles is read twice: pass a written table.
    """
    rows = articles.where(F.size("tokens") > 0)
    starts = full_starts(rows.select(*_KEY, F.size("tokens").cast("bigint").alias("n")))
    return cut_full(rows.join(starts, _KEY), length, pad_id)


def _is_bare(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType.elementType, IntegerType)


def _assembled(pieces: DataFrame, length: int, pad_id: int) -> DataFrame:
    bare = _is_bare(pieces, "piece")
    listed = pieces.groupBy("split_idx", "seq").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("p"))
    return listed.select("split_idx", "seq", padded(F.flatten(F.col("p.piece")), length, pad_id, bare).alias("tokens"))


def single_numbers(keys: DataFrame) -> DataFrame:
    """keys(split_idx, line_no, art_no) with seq, their number in their split."""
    return with_running_total(keys.withColumn("one", F.lit(1).cast("bigint")), *_KEY, size="one", name="seq").drop("one")


def pack_single(articles: DataFrame, length: int, pad_id: int, overflow: str) -> DataFrame:
    """One article in each sequence. Only keys are sorted; articles is read twice: pass a written table."""
    rows = articles.where(F.size("tokens") > 0).withColumn("tokens", truncated(F.col("tokens"), length, overflow)).where("tokens is not null")
    numbers = single_numbers(rows.select(*_KEY))
    return rows.join(numbers, _KEY).select("split_idx", "seq", padded(F.col("tokens"), length, pad_id, _is_bare(rows, "tokens")).alias("tokens"))


def greedy_assignment(articles: DataFrame, length: int, overflow: str) -> DataFrame:
    """(split_idx, line_no, art_no, seq, at, kept): sequence, place in it and tokens kept of every article that keeps any. Keys with n do for articles.

    Next fit: an article that doesn't fit closes the sequence, also if it is then dropped. Only lengths pass
    through Python, sorted within splits and streamed, so memory doesn't grow with a split.
    """
    ship(articles.sparkSession)
    n = F.col("n") if "n" in articles.columns else F.size("tokens")
    lengths = articles.select("split_idx", "line_no", "art_no", n.cast("bigint").alias("n")).where("n > 0")
    ordered = lengths.repartition("split_idx").sortWithinPartitions("split_idx", "line_no", "art_no")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seq, used = None, 0, 0
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], [], []]
            for s, line, art, n in zip(*(c.to_pylist() for c in batch.columns)):
                if s != split:
                    split, seq, used = s, 0, 0
                if used + n > length:
                    seq, used = seq + (used > 0), 0
                    n = min(n, length) if overflow != "drop" or n <= length else 0
                if n:
                    for column, v in zip(out, (s, line, art, seq, used, n)):
                        column.append(v)
                    used += n
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["split_idx", "line_no", "art_no", "seq", "at", "kept"])

    return ordered.select(*[F.col(c).cast("bigint").alias(c) for c in ("split_idx", "line_no", "art_no", "n")]).mapInArrow(assign, "split_idx bigint, line_no bigint, art_no bigint, seq bigint, at bigint, kept bigint")


def pack_greedy(articles: DataFrame, length: int, pad_id: int, overflow: str) -> DataFrame:
    """Whole articles in order, as many as fit in each sequence."""
    placed = articles.join(greedy_assignment(articles, length, overflow), _KEY)
    return assembled_greedy(placed, length, pad_id, overflow)


def assembled_greedy(placed: DataFrame, length: int, pad_id: int, overflow: str) -> DataFrame:
    """placed(split_idx, seq, at, tokens) to sequences."""
    return _assembled(placed.select("split_idx", "seq", "at", truncated(F.col("tokens"), length, overflow).alias("piece")), length, pad_id)


def pack(articles: DataFrame, config: PackingConfig, length: int, pad_id: int) -> DataFrame:
    if config.style == "full":
        return pack_full(articles, length, pad_id)
    return (pack_single if config.style == "single" else pack_greedy)(articles, length, pad_id, config.overflow)


def has_completion(tokens: Column) -> Column:
    """Some token is a completion; separators don't count."""
    return F.exists(tokens, lambda t: t.token_type == COMPLETION)


def without_prompt_only(sequences: DataFrame) -> DataFrame:
    return sequences.where(has_completion(F.col("tokens")))


def dropped_by_packing(n: Column, config: PackingConfig, length: int) -> Column:
    """Tokens of an article of n tokens that packing loses."""
    if config.style == "full":
        return F.lit(0).cast("bigint")
    return F.when(n > length, n if config.overflow == "drop" else n - length).otherwise(0).cast("bigint")


def to_matrix(sequences: DataFrame, categories: bool = True) -> DataFrame:
    """Columns input_ids, token_type_ids and, if wanted, category_ids instead of tokens."""
    columns = [F.col("tokens.token_id").alias("input_ids"), F.col("tokens.token_type").alias("token_type_ids")]
    if categories:
        columns.append(F.col("tokens.category_id").alias("category_ids"))
    return sequences.select(*[c for c in sequences.columns if c != "tokens"], *columns)
