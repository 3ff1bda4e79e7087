"""Tokenizers: objects that turn a text column into an array of token ids."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.shipping import ship


class Tokenizer(Protocol):
    """encode() gives array<int>, no special tokens added by the caller."""

    bos_id: int | None
    eos_id: int
    pad_id: int | None
    vocab_size: int

    def encode(self, text: Column) -> Column: ...


def padding_id(tokenizer: Tokenizer) -> int:
    """The padding token, or the end token where there is none."""
    return tokenizer.eos_id if tokenizer.pad_id is None else tokenizer.pad_id


WORD_PATTERN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"


@dataclass(frozen=True)
class WordHashTokenizer:
    """Words, numbers and single signs by the first 28 bits of their MD5; stays in Spark's generated code and needs no vocabulary."""

    bos_id: int | None = 1 << 28
    eos_id: int = (1 << 28) + 1
    pad_id: int | None = (1 << 28) + 2
    vocab_size: int = (1 << 28) + 3

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))

    def encode(self, text: Column) -> Column:
        return F.transform(self.words(text), lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int"))


@dataclass(frozen=True)
class SpaceTokenizer:
    """A given small vocabulary of words between spaces; unknown words are an error."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    bos_id: int | None = None
    eos_id: int = 0
    pad_id: int | None = 0

    @property
    def vocab_size(self) -> int:
        return max([self.eos_id, *self.vocabulary.values()]) + 1

    def encode(self, text: Column) -> Column:
        known = F.create_map(*[F.lit(x) for item in self.vocabulary.items() for x in item])
        words = F.filter(F.split(text, " ", -1), lambda w: w != "")
        unknown = lambda w: F.raise_error(F.concat(F.lit("unknown word: "), w)).cast("int")
        return F.transform(words, lambda w: F.coalesce(F.element_at(known, w), unknown(w)))


def parse_special_tokens(text: str | None) -> dict[str, str]:
    """A JSON object of roles and tokens; single quotes may stand for double ones."""
    if not text:
        return {}
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        found = json.loads(text.replace("'", '"'))
    if not isinstance(found, dict) or not all(isinstance(v, str) for v in found.values()):
        raise ValueError("special tokens have to be a JSON object of names and tokens")
    return found


def folder_roles(folder: str) -> dict[str, str]:
    """The special tokens by role that a tokenizer's folder names."""
    out: dict[str, str] = {}
    for name in ("tokenizer_config.json", "special_tokens_map.json"):
        path = os.path.join(folder, name)
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                found = json.load(f)
            for role, token in found.items():
                text = token.get("content") if isinstance(token, dict) else token
                if role in ("bos_token", "eos_token", "pad_token", "unk_token", "sep_token", "cls_token", "mask_token") and isinstance(text, str):
                    out[role] = text
    return out


_LIBRARY: dict[int, object] = {}


def _library(definition: str):
    """The tokenizer of a definition, parsed once in each worker."""
    from tokenizers import Tokenizer as Library

    key = hash(definition)
    if key not in _LIBRARY:
        _LIBRARY.clear()
        _LIBRARY[key] = Library.from_str(definition)
    return _LIBRARY[key]


class JsonTokenizer:
    """A tokenizer in the JSON format of the tokenizers library, in Arrow batches."""

    _shared = None

    def __init__(self, path: str, eos_id: int | None, bos_id: int | None = None, pad_id: int | None = None, special_tokens: dict[str, str] | None = None) -> None:
        """path: a JSON file, or a folder with tokenizer.json and maybe special_tokens_map.json and tokenizer_config.json.

        special_tokens names tokens by role, like {"pad_token": "<pad>"}; it goes before the folder's. Tokens that the
        tokenizer lacks are added with new ids. Ids that are given go before roles.
        """
        folder = path if os.path.isdir(path) else None
        with open(os.path.join(path, "tokenizer.json") if folder else path, encoding="utf-8") as f:
            spec = json.load(f)
        roles = (folder_roles(folder) if folder else {}) | (special_tokens or {})
        known = dict(spec["model"].get("vocab", {})) if isinstance(spec["model"].get("vocab", {}), dict) else {}
        known |= {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for token in roles.values():
            if token not in known:
                known[token] = max(known.values(), default=-1) + 1
                spec.setdefault("added_tokens", []).append({"id": known[token], "content": token, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
        ids = {role: known[token] for role, token in roles.items()}
        eos_id, bos_id, pad_id = (given if given is not None else ids.get(f"{name}_token") for given, name in ((eos_id, "eos"), (bos_id, "bos"), (pad_id, "pad")))
        if eos_id is None:
            raise ValueError("the tokenizer names no end token; give eos_id or an eos_token")
        self.roles, self.definition = roles, json.dumps(spec, ensure_ascii=False)
        sizes = [len(spec["model"].get("vocab", {})), *(t["id"] + 1 for t in spec.get("added_tokens", []))]
        self.bos_id, self.eos_id, self.pad_id, self.vocab_size = bos_id, eos_id, pad_id, max(sizes)

    def files(self) -> dict[str, str]:
        """Name and text of the files that this tokenizer can be loaded from again."""
        ids = {"eos_token_id": self.eos_id, "bos_token_id": self.bos_id, "pad_token_id": self.pad_id}
        return {"tokenizer.json": self.definition, "special_tokens_map.json": json.dumps(self.roles, ensure_ascii=False), "tokenizer_config.json": json.dumps({k: v for k, v in ids.items() if v is not None})}

    def encode(self, text: Column) -> Column:
        from pyspark.sql import SparkSession

        spark = SparkSession.active()
        ship(spark)
        if self._shared is None or self._shared[0] is not spark.sparkContext:
            self._shared = (spark.sparkContext, spark.sparkContext.broadcast(self.definition))
        shared = self._shared[1]

        def batch(texts: pd.Series) -> pd.Series:
            found = _library(shared.value).encode_batch(texts.fillna("").tolist(), add_special_tokens=False)
            return pd.Series([e.ids for e in found])

        return F.pandas_udf(batch, "array<int>")(text)


def build_vocabulary(texts: DataFrame, column: str = "text", first_id: int = 4) -> DataFrame:
    """(word, token_id): distinct words in binary order, dense ids from first_id; smaller ids stay free for special tokens."""
    from corpusmill.functions.indexing import with_row_index

    ship(texts.sparkSession)
    words = texts.select(F.explode(WordHashTokenizer().words(F.col(column))).alias("word")).distinct()
    return with_row_index(words, "word", name="token_id", start=first_id).select("word", "token_id")


def encode_with_vocabulary(texts: DataFrame, vocabulary: DataFrame, key: str, column: str = "text", unknown_id: int = 3) -> DataFrame:
    """(key, pos, token_id) of each word; words that the vocabulary lacks get unknown_id. An equi-join on the word, which Spark broadcasts only below its threshold."""
    words = texts.select(key, F.posexplode(WordHashTokenizer().words(F.col(column))).alias("pos", "word"))
    found = words.join(vocabulary, "word", "left")
    return found.select(key, "pos", F.coalesce("token_id", F.lit(unknown_id)).cast("bigint").alias("token_id"))
