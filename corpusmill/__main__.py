"""Command line: python -m corpusmill {pipeline|data_prep|decode|balance|convert_chat|check}."""

from __future__ import annotations

import argparse
import contextlib
import datetime
import importlib.metadata
import json
import logging
import platform
import subprocess
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusmill.config import BOUNDARIES, PackingConfig, PrepOptions
from corpusmill.functions.tokenizers import JsonTokenizer, WordHashTokenizer, parse_special_tokens
from corpusmill.operators import balance, chat, metrics
from corpusmill.plans import dataset
from corpusmill.sources import lines, outputs

log = logging.getLogger("corpusmill")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusmill")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("pipeline", "data_prep"):
        p = sub.add_parser(name)
        p.add_argument("--input_path", "--input_file_path", required=True)
        p.add_argument("--output_path", required=True)
        p.add_argument("--overwrite_output_path", action="store_true")
        p.add_argument("--tokenizer_json", "--pretrained_tokenizer", help="a tokenizer in the tokenizers library's JSON format, as a file or a folder; words by hash without it")
        p.add_argument("--special_tokens_dict", help="JSON object of special tokens by role, like eos_token")
        p.add_argument("--num_workers", type=int, help="partitions of shuffles; Spark's setting without it")
        p.add_argument("--log_file_path", help="where the run's log goes; logs.txt in the output without it")
        p.add_argument("--eos_token_id", type=int)
        p.add_argument("--max_seq_length", type=int, default=2048)
        p.add_argument("--input_packing_config", choices=PackingConfig.names(), default="full")
        p.add_argument("--packing_boundary", choices=BOUNDARIES, default="jsonl")
        p.add_argument("--attention_boundary", choices=BOUNDARIES, default="jsonl")
        p.add_argument("--prompt_keyword", default="prompt")
        p.add_argument("--completion_keyword", default="completion")
        p.add_argument("--prompt_prefix", default="")
        p.add_argument("--prompt_postfix", default="")
        p.add_argument("--disable_space_separator", action="store_true")
        p.add_argument("--keep_prompt_only_sequences", action="store_true")
        p.add_argument("--keep_empty_completions", action="store_true")
        p.add_argument("--ignore_input_format_error", action="store_true")
        p.add_argument("--categories_path")
        p.add_argument("--chat_template", help="JSON object with the template's texts")
        p.add_argument("--silent", action="store_true")
        if name == "pipeline":
            p.add_argument("--shuffle", choices=("False", "on_RAM", "large_file"), default="False")
            p.add_argument("--seed", type=int, default=0)
            for k in ("train", "dev", "test"):
                p.add_argument(f"--num_{'training' if k == 'train' else k}_splits", type=int, dest=k)
            p.add_argument("--dev_ratio", type=float)
            p.add_argument("--test_ratio", type=float)
            p.add_argument("--keep_split_jsonls", action="store_true")
            p.add_argument("--do_not_balance", "--do_not_balance_hdf5", action="store_true")
    for name, texts in (("decode", ("input_path", "output_path")), ("balance", ("input_path", "output_path")), ("describe", ("input_path",)), ("convert_chat", ("input_path", "output_path")), ("check", ("input_path",))):
        p = sub.add_parser(name)
        for t in texts:
            p.add_argument(f"--{t}", required=True)
    return top


def _options(args: argparse.Namespace) -> PrepOptions:
    return PrepOptions(
        args.max_seq_length, PackingConfig.parse(args.input_packing_config), args.packing_boundary, args.attention_boundary, args.prompt_keyword, args.completion_keyword, args.prompt_prefix,
        args.prompt_postfix, not args.disable_space_separator, args.keep_prompt_only_sequences, args.keep_empty_completions, ignore_format_errors=args.ignore_input_format_error,
    )


def run_log(args: argparse.Namespace, found: dict) -> list[str]:
    """What ran, when and on what, what it made, and what a training run has to keep to."""
    out = [f"{datetime.datetime.now(datetime.timezone.utc):%Y-%m-%d %H:%M:%S} UTC, python {platform.python_version()}"]
    for name in ("pyspark", "pyarrow", "pandas", "numpy", "tokenizers"):
        with contextlib.suppress(importlib.metadata.PackageNotFoundError):
            out.append(f"{name} {importlib.metadata.version(name)}")
    with contextlib.suppress(OSError, subprocess.CalledProcessError):
        commit = subprocess.run(["git", "rev-parse", "HEAD"], cwd=Path(__file__).parent, capture_output=True, text=True, check=True)
        out.append(f"commit {commit.stdout.strip()}")
    out += [f"argument {k} {v}" for k, v in sorted(vars(args).items())]
    out += [f"{k:<40} {v}" for k, v in found.items()]
    if found.get("max_batch_size_train") is not None:
        out.append(f"train with at most {found.get('number_of_training_files')} workers and a batch of at most {found['max_batch_size_train']} sequences for each")
    if found.get("max_batch_size_dev") is not None:
        out.append(f"evaluate with a batch of at most {found['max_batch_size_dev']} sequences for each worker")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.WARNING if getattr(args, "silent", False) else logging.INFO)
    spark = SparkSession.builder.appName("corpusmill").getOrCreate()
    if args.command in ("pipeline", "data_prep"):
        if args.num_workers:
            spark.conf.set("spark.sql.shuffle.partitions", str(args.num_workers))
        special = parse_special_tokens(args.special_tokens_dict)
        tokenizer = JsonTokenizer(args.tokenizer_json, args.eos_token_id, special_tokens=special) if args.tokenizer_json else WordHashTokenizer()
        template = chat.ChatTemplate(**json.loads(args.chat_template)) if args.chat_template else None
        shared = {"category_path": args.categories_path, "template": template, "overwrite": args.overwrite_output_path}
        if args.command == "data_prep":
            found = dataset.prepare_file(spark, args.input_path, args.output_path, tokenizer, _options(args), **shared)
        else:
            found = dataset.run_pipeline(spark, args.input_path, args.output_path, tokenizer, _options(args), train=args.train, dev=args.dev, test=args.test, dev_ratio=args.dev_ratio, test_ratio=args.test_ratio, shuffle=args.shuffle, seed=args.seed, keep_raw_splits=args.keep_split_jsonls, rebalance=not args.do_not_balance, **shared)
        report = run_log(args, found)
        for line in report:
            log.info("%s", line)
        outputs.write_text(spark, args.log_file_path or f"{args.output_path}/logs.txt", "\n".join(report) + "\n")
    elif args.command == "check":
        bad = outputs.manifest_violations(spark, args.input_path).collect()
        for row in bad:
            log.error("%s: %s", row["name"], row["problem"])
        return int(bool(bad))
    elif args.command == "convert_chat":
        turns = lines.read_lines(spark, args.input_path).select(F.col("line_no").alias("conv_id"), F.posexplode(F.from_json("value", "array<struct<role:string,content:string>>")).alias("turn", "t")).select("conv_id", "turn", "t.role", F.col("t.content").alias("text"))
        pairs = chat.turns_to_pairs(turns)
        chats = turns.select("conv_id").distinct().join(pairs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pair_no", "prompt", "completion"))).alias("p")), "conv_id", "left")
        items = F.transform(F.coalesce("p", F.array()), lambda x: F.struct(x.prompt.alias("prompt"), x.completion.alias("completion")))
        chats.sort("conv_id").select(F.to_json(items).alias("value")).write.text(args.output_path)
    else:
        packed = outputs.read_packed(spark, args.input_path)
        if args.command == "describe":
            for row in metrics.recomputed_metadata(packed).collect():
                log.info("%s", row.asDict())
        elif args.command == "balance":
            made = balance.rebalance(packed)
            made.repartition("dataset_type", "shard_no").sortWithinPartitions("dataset_type", "shard_no", "seq").write.partitionBy("dataset_type", "shard_no").parquet(args.output_path)
        else:
            from corpusmill.operators.decode import report, segments

            keys = ("dataset_type", "shard_no", "seq")
            tokens = packed.select(*keys, F.posexplode(F.arrays_zip("input_ids", "token_type_ids")).alias("pos", "t")).select(*keys, "pos", F.col("t.input_ids").cast("string").alias("word"), F.col("t.token_type_ids").alias("type_id"))
            found = report(segments(tokens, *keys), *keys)
            found.sort(*keys).select(F.concat_ws("\n", F.concat_ws(" ", F.lit("SEQUENCE"), *keys), "report", F.lit("")).alias("value")).write.text(args.output_path)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
