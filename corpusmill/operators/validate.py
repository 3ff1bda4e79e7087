"""Rules that a dataset's metadata has to keep at training time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = {"max_seq_length": int, "use_token_type_ids": bool, "number_of_workers": int, "vocab_size": int, "model_type": str, "eval": bool, "batch_size": int}


def check_context(context: dict) -> None:
    """TypeError if the training context lacks a value or one has the wrong type."""
    for name, kind in CONTEXT.items():
        if type(context.get(name)) is not kind:
            raise TypeError(f"context {name!r} has to be {kind.__name__}")


def _rules() -> list[tuple[str, Column, str]]:
    m, r = (lambda c: F.col(f"m_{c}")), (lambda c: F.col(f"r_{c}"))
    return [
        ("max_seq_length", m("max_seq_length") != r("max_seq_length"), "sequence length differs from the dataset's"),
        ("token_type_ids", r("use_token_type_ids") & ~m("token_type_ids"), "token type ids are needed and missing"),
        ("number_of_training_files", m("number_of_training_files") < r("number_of_workers"), "fewer training files than workers"),
        ("vocab_size", m("vocab_size") > r("vocab_size"), "the dataset's vocabulary is larger than the model's"),
        ("tokenizer_model_type", m("tokenizer_model_type") != r("model_type"), "model type differs from the dataset's"),
        ("number_of_dev_files", r("eval") & (m("number_of_dev_files") == 0), "evaluation needs dev files"),
        ("max_batch_size_train", r("batch_size") > m("max_batch_size_train"), "batch size exceeds the rows of a training file"),
        ("max_batch_size_dev", r("eval") & m("max_batch_size_dev").isNull(), "evaluation needs dev sequences"),
    ]


def violations(metadata: DataFrame, contexts: DataFrame, dataset: str = "dataset", context: str = "context") -> DataFrame:
    """(dataset, context, field, message) for every broken rule, for each dataset and context given. Every dataset is held against every context, of which there are a handful each."""
    left = metadata.select(*[F.col(c).alias(c if c == dataset else f"m_{c}") for c in metadata.columns])
    right = contexts.select(*[F.col(c).alias(c if c == context else f"r_{c}") for c in contexts.columns])
    found = F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"))) for field, broken, message in _rules()])
    return left.crossJoin(right).select(dataset, context, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select(dataset, context, "x.field", "x.message")
