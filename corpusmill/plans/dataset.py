"""The whole preparation: lines in, packed sequences with metadata and manifest out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.config import PrepOptions
from corpusmill.functions import planning
from corpusmill.functions.storage import written
from corpusmill.functions.tokenizers import Tokenizer, padding_id
from corpusmill.operators import balance, metrics, packing, splits
from corpusmill.operators.articles import articles_from_pairs, articles_from_text, with_category_ids
from corpusmill.operators.chat import ChatTemplate, articles_from_chats
from corpusmill.sources import lines as src
from corpusmill.sources import outputs


@dataclass
class Prepared:
    """What a run made: lazy tables, and the metadata once written."""

    lines: DataFrame
    articles: DataFrame
    packed: DataFrame  # before the prompt-only filter
    sequences: DataFrame  # after it
    rejects: DataFrame


def prepare(lines: DataFrame, kind: str, tokenizer: Tokenizer, options: PrepOptions, categories: DataFrame | None = None, template: ChatTemplate | None = None) -> Prepared:
    """lines(split_idx, dataset_type, shard_no, line_no, value) to sequences(split_idx, dataset_type, shard_no, seq, tokens).

    Splits are packed each on its own.
    """
    keep = ("split_idx",)
    if kind == "jsonl":
        parsed = written(src.parse_lines(lines, options.completion_keyword))
        rejects = src.rejects(parsed)
        good = src.accepted(parsed) if options.ignore_format_errors else src.require_wellformed(parsed)
        pairs = src.pairs_of(good, options.prompt_keyword, options.completion_keyword, keep=keep)
        if template is not None:
            articles = articles_from_chats(pairs, template, tokenizer, options, keep)
        else:
            pairs = src.with_no_category(pairs) if categories is None else with_category_ids(pairs, categories)
            articles = articles_from_pairs(pairs, tokenizer, options, keep=keep)
    else:
        rejects = lines.where("false")
        articles = articles_from_text(lines, tokenizer, keep=keep)
    articles = written(articles)
    packed = written(packing.pack(articles, options.packing, options.max_seq_length, padding_id(tokenizer)))
    labels = lines.select("split_idx", "dataset_type", "shard_no").distinct()
    packed = packed.join(labels, "split_idx")
    kept = packed if options.keep_prompt_only_sequences else packing.without_prompt_only(packed)
    return Prepared(lines, articles.join(labels, "split_idx"), packed, kept, rejects)


def run_pipeline(spark: SparkSession, input_path: str, output_path: str, tokenizer: Tokenizer, options: PrepOptions, *, train: int | None = None, dev: int | None = None, test: int | None = None, dev_ratio: float | None = None, test_ratio: float | None = None,
                 shuffle: str = "False", seed: int = 0, category_path: str | None = None, template: ChatTemplate | None = None, keep_raw_splits: bool = False, overwrite: bool = False, rebalance: bool = True, model_type: str = "") -> dict:
    """Read, shuffle, split, tokenize, pack, balance and write; returns the metadata.

    output_path gets packed/ (Parquet by dataset type and shard), test_files/ (raw test splits), splits/ (with
    keep_raw_splits), rejects/, tokenizer/ (of tokenizers with files), metadata.yaml, category_to_id.json and sha256/.
    """
    outputs.require_input(spark, input_path)
    outputs.prepare_output(spark, output_path, overwrite)
    outputs.write_tokenizer(spark, f"{output_path}/tokenizer", tokenizer)
    kind = src.input_kind(spark, input_path)
    raw = src.read_lines(spark, input_path)
    size = raw.agg(F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0))).first()[0]
    counts = planning.split_counts(size / planning.GB, train, dev, test, dev_ratio, test_ratio)
    splits.require_lines(raw, counts.total)
    deal = {"False": splits.round_robin, "on_RAM": splits.shuffled_splits, "large_file": splits.bucket_shuffle}[shuffle]
    dealt = deal(raw, counts.total) if shuffle == "False" else deal(raw, counts.total, seed=seed).withColumn("line_no", (F.col("split_idx") * (1 << 40) + F.col("pos")).cast("bigint"))
    labelled = written(splits.with_labels(dealt, counts))
    splits.require_filled(labelled, counts)
    categories = src.read_categories(spark, category_path) if category_path else None
    made = prepare(labelled.where("dataset_type <> 'test'"), kind, tokenizer, options, categories, template)
    final = made.sequences
    if rebalance:
        final = balance.rebalance(final.select("dataset_type", "shard_no", "seq", "tokens"), labelled.where("dataset_type <> 'test'"))
    matrix = packing.to_matrix(final.select("dataset_type", "shard_no", "seq", "tokens"), categories=category_path is not None)
    outputs.write_packed(matrix, f"{output_path}/packed", options.max_seq_length)
    if counts.test:
        outputs.write_raw_splits(labelled.where("dataset_type = 'test'"), f"{output_path}/test_files")
    if keep_raw_splits:
        outputs.write_raw_splits(labelled.where("dataset_type <> 'test'"), f"{output_path}/splits")
    outputs.write_rejects(made.rejects, f"{output_path}/rejects")
    if categories is not None:
        outputs.write_categories(spark, f"{output_path}/category_to_id.json", categories)
    metadata = dataset_metadata(spark, made, f"{output_path}/packed", counts, tokenizer, options, model_type)
    outputs.write_metadata(spark, f"{output_path}/metadata.yaml", metadata)
    outputs.write_manifest(spark, output_path)
    return metadata


def dataset_metadata(spark: SparkSession, made: Prepared, packed_path: str, counts: planning.SplitCounts, tokenizer: Tokenizer, options: PrepOptions, model_type: str) -> dict:
    out: dict = {
        "max_seq_length": options.max_seq_length, "token_type_ids": True, "vocab_size": tokenizer.vocab_size, "tokenizer_model_type": model_type, "number_of_training_files": counts.train,
        "number_of_dev_files": counts.dev, "number_of_test_files": counts.test, "packing": str(options.packing), "max_batch_size_train": None, "max_batch_size_dev": None,
    }
    found = metrics.derived_metrics(metrics.all_metrics(made.lines, made.articles, made.packed, options.packing, options.max_seq_length, options.keep_prompt_only_sequences))
    for row in found.collect():
        if row["articles"]:
            out |= {f"{row['dataset_type']}_{k}": v for k, v in row.asDict().items() if k != "dataset_type"}
    shards = {"train": counts.train, "dev": counts.dev}
    for row in metrics.recomputed_metadata(outputs.read_packed(spark, packed_path)).collect():
        # a shard without rows has no folder, and limits the batch to nothing
        out[f"max_batch_size_{row['dataset_type']}"] = row["max_batch_size"] if row["files"] == shards[row["dataset_type"]] else 0
    return out


def prepare_file(spark: SparkSession, input_path: str, output_path: str, tokenizer: Tokenizer, options: PrepOptions, category_path: str | None = None, template: ChatTemplate | None = None, overwrite: bool = False) -> dict:
    """One input as one split in its own order, without shuffling or balancing; returns its metrics."""
    outputs.require_input(spark, input_path)
    outputs.prepare_output(spark, output_path, overwrite)
    outputs.write_tokenizer(spark, f"{output_path}/tokenizer", tokenizer)
    lines = src.read_lines(spark, input_path).withColumns({"split_idx": F.lit(0).cast("bigint"), "dataset_type": F.lit("train"), "shard_no": F.lit(1)})
    splits.require_lines(lines, 0)
    categories = src.read_categories(spark, category_path) if category_path else None
    made = prepare(written(lines), src.input_kind(spark, input_path), tokenizer, options, categories, template)
    matrix = packing.to_matrix(made.sequences.select("dataset_type", "shard_no", "seq", "tokens"), categories=category_path is not None)
    outputs.write_packed(matrix, f"{output_path}/packed", options.max_seq_length)
    outputs.write_rejects(made.rejects, f"{output_path}/rejects")
    return metrics.all_metrics(made.lines, made.articles, made.packed, options.packing, options.max_seq_length, options.keep_prompt_only_sequences).first().asDict()


@dataclass(frozen=True)
class TrainingArguments:
    """What a training run knows about itself."""

    batch_size: int
    workers: int
    accumulation: int = 1
    evaluate: bool = False
    dev_ratio: float = 0.1


def arguments_from_training(size_bytes: int, training: TrainingArguments, model_config: dict, tokenizer: Tokenizer) -> dict:
    """Arguments of run_pipeline for a training run: sequence length, shuffling and splits, with at least one batch in each split."""
    length = planning.sequence_length(model_config)
    if tokenizer.vocab_size > model_config.get("vocab_size", tokenizer.vocab_size):
        raise ValueError("the tokenizer has more tokens than the model's vocabulary")
    wanted = planning.adjust_splits(planning.default_training_splits(size_bytes / planning.GB), training.workers)
    train = planning.splits_for_one_batch(size_bytes, wanted, training.workers, training.batch_size, training.accumulation, length)
    out = {"options": PrepOptions(max_seq_length=length), "train": train, "shuffle": planning.shuffle_mode(size_bytes), "model_type": str(model_config.get("model_type", ""))}
    if training.evaluate:
        out |= {"dev_ratio": training.dev_ratio, "test_ratio": 0.0}
    return out


def run_with_training_arguments(spark: SparkSession, input_path: str, output_path: str, tokenizer: Tokenizer, training: TrainingArguments, model_config: dict, **more) -> dict:
    raw = src.read_lines(spark, input_path)
    size = raw.agg(F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0))).first()[0]
    return run_pipeline(spark, input_path, output_path, tokenizer, **(arguments_from_training(size, training, model_config, tokenizer) | more))
