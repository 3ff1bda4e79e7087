"""Lines and prompt/completion pairs to tokenized articles.

A token is a struct (token_id, token_type, category_id). Articles are rows
(line_no, art_no, tokens); their order is (line_no, art_no).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.config import COMPLETION, NO_CATEGORY, PROMPT, SEP, PrepOptions
from corpusmill.functions.text import affixed, space_separated
from corpusmill.functions.tokenizers import Tokenizer

TOKEN = "struct<token_id:int,token_type:int,category_id:int>"


def typed(ids: Column, token_type: int, category: Column) -> Column:
    return F.transform(ids, lambda i: F.struct(i.cast("int").alias("token_id"), F.lit(token_type).alias("token_type"), category.cast("int").alias("category_id")))


def _without_first(ids: Column, token: int | None, when: Column) -> Column:
    if token is None:
        return ids
    return F.when(when & (F.get(ids, F.lit(0)) == token), F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0)))).otherwise(ids)


def _without_last(ids: Column, token: int) -> Column:
    size = F.size(ids)
    return F.when(F.get(ids, size - 1) == token, F.slice(ids, 1, F.greatest(size - 1, F.lit(0)))).otherwise(ids)


def once(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it; columns that are named repeatedly may be computed each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _encoded(text: Column, tokenizer: Tokenizer) -> Column:
    return F.when(text == "", F.array().cast("array<int>")).otherwise(tokenizer.encode(text).cast("array<int>"))


def with_pair_tokens(pairs: DataFrame, tokenizer: Tokenizer, chat: bool = False) -> DataFrame:
    """pairs(prompt, completion, category_id, ...) with tokens: prompt tokens, completion tokens and one end token if there are any.

    An end token that the tokenizer put behind prompt or completion goes, and so does a begin token before a completion
    that follows a prompt; with chat also one before the prompt.
    """
    category = F.col("category_id")
    end = F.array(F.struct(F.lit(tokenizer.eos_id).alias("token_id"), F.lit(COMPLETION).alias("token_type"), category.cast("int").alias("category_id")))

    def both(ids: Column) -> Column:
        p = _without_first(_without_last(ids.p, tokenizer.eos_id), tokenizer.bos_id, F.lit(chat))
        c = _without_last(_without_first(ids.c, tokenizer.bos_id, F.col("prompt") != ""), tokenizer.eos_id)
        return F.concat(typed(p, PROMPT, category), typed(c, COMPLETION, category))

    ids = F.struct(_encoded(F.col("prompt"), tokenizer).alias("p"), _encoded(F.col("completion"), tokenizer).alias("c"))
    tokens = once(once(ids, both), lambda b: F.when(F.size(b) > 0, F.concat(b, end)).otherwise(b))
    return pairs.withColumn("tokens", tokens.cast(f"array<{TOKEN}>"))


def with_boundary(tokens: Column) -> Column:
    """The tokens with the last one as article separator; empty ones stay empty."""
    last = F.element_at(tokens, -1)
    sep = F.array(F.struct(last.token_id.alias("token_id"), F.lit(SEP).alias("token_type"), last.category_id.alias("category_id")))
    return F.when(F.size(tokens) > 0, F.concat(F.slice(tokens, 1, F.size(tokens) - 1), sep)).otherwise(tokens)


def prepare_pairs(pairs: DataFrame, options: PrepOptions) -> DataFrame:
    """pairs(line_no, pair_no, n_pairs, prompt, completion[, category_id]) as they are tokenized.

    Pairs with an empty completion go unless prompt-only sequences are kept; spaces and affixes are put in order.
    """
    out = pairs.withColumn("prompt", F.coalesce("prompt", F.lit("")))
    if "category_id" not in out.columns:
        out = out.withColumn("category_id", F.lit(NO_CATEGORY))
    if not (options.keep_prompt_only_sequences or options.keep_empty_completions):
        out = out.where("completion <> ''")
    if options.space_separator:
        prompt, completion = space_separated(F.col("prompt"), F.col("completion"))
        out = out.withColumns({"prompt": prompt, "completion": completion})
    return out.withColumn("prompt", affixed(F.col("prompt"), options.prompt_prefix, options.prompt_postfix))


def articles_from_pairs(pairs: DataFrame, tokenizer: Tokenizer, options: PrepOptions, chat: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Articles of pairs(line_no, pair_no, n_pairs, prompt, completion[, category_id]), which are complete lines.

    Packing by line makes one article of a line, packing by pair one of each pair. The attention
    boundary is the last token of each pair, or the last one of the line; if pairs are packed and the last pair was
    skipped, the line has none. keep names columns of the line, like its split, that go along.
    """
    made = with_pair_tokens(pairs if chat else prepare_pairs(pairs, options), tokenizer, chat)
    by_pair = options.packing_boundary == "prompt_completion_pair"
    if options.attention_boundary == "prompt_completion_pair":
        made = made.withColumn("tokens", with_boundary(F.col("tokens")))
    elif by_pair:
        made = made.withColumn("tokens", F.when(F.col("pair_no") == F.col("n_pairs") - 1, with_boundary(F.col("tokens"))).otherwise(F.col("tokens")))
    if by_pair:
        return made.select("line_no", *keep, F.col("pair_no").cast("bigint").alias("art_no"), "tokens")
    listed = made.groupBy("line_no", *keep).agg(F.sort_array(F.collect_list(F.struct("pair_no", "tokens"))).alias("t"))
    return listed.select("line_no", *keep, F.lit(0).cast("bigint").alias("art_no"), with_boundary(F.flatten(F.col("t.tokens"))).alias("tokens"))


def articles_from_text(lines: DataFrame, tokenizer: Tokenizer, text: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """One article of each line(line_no, value): all completion, separator at the end. keep names columns that go along."""
    last = lambda ids: lambda i, at: F.struct(i.alias("token_id"), F.when(at == F.size(ids) - 1, SEP).otherwise(COMPLETION).alias("token_type"), F.lit(NO_CATEGORY).alias("category_id"))
    tokens = once(text_ids(F.col(text), tokenizer), lambda ids: F.transform(ids, last(ids)))
    return lines.select("line_no", *keep, F.lit(0).cast("bigint").alias("art_no"), tokens.cast(f"array<{TOKEN}>").alias("tokens"))


def text_ids(text: Column, tokenizer: Tokenizer) -> Column:
    """The bare ids of articles_from_text(): a tenth of the bytes of typed tokens. One end token, the separator, is last; none where there is no other token."""

    def ended(ids: Column) -> Column:
        own = F.get(ids, F.size(ids) - 1) == tokenizer.eos_id
        return F.when(own & (F.size(ids) == 1), F.slice(ids, 1, 0)).when((F.size(ids) == 0) | own, ids).otherwise(F.concat(ids, F.array(F.lit(tokenizer.eos_id))))

    return once(_encoded(F.coalesce(text, F.lit("")), tokenizer), ended)


def exploded(array: Column, pos: str, name: str) -> Column:
    """posexplode; drop the rows without pos. A plain posexplode has Spark filter by the array's size first, which computes the array once more."""
    return F.posexplode_outer(array).alias(pos, name)


def flat_tokens(articles: DataFrame, *keys: str) -> DataFrame:
    """One row per token: keys, pos, token_id, type_id, category_id."""
    rows = articles.select(*keys, exploded(F.col("tokens"), "pos", "t")).where("pos is not null")
    return rows.select(*keys, F.col("pos").cast("bigint").alias("pos"), F.col("t.token_id").cast("bigint").alias("token_id"), F.col("t.token_type").cast("bigint").alias("type_id"), F.col("t.category_id").cast("bigint").alias("category_id"))


def with_category_ids(pairs: DataFrame, categories: DataFrame, column: str = "category", strict: bool = True) -> DataFrame:
    """pairs with category_id from categories(category, category_id): -1 without a category; unknown ones are an error, or -1."""
    named = categories.select(F.col("category").alias("known__"), F.col("category_id").alias("id__"))
    out = pairs.join(named, F.col(column) == F.col("known__"), "left")
    unknown = F.raise_error(F.concat(F.lit("unknown category: "), F.col(column))).cast("int") if strict else F.lit(NO_CATEGORY)
    category = F.when(F.col(column).isNull(), NO_CATEGORY).when(F.col("id__").isNull(), unknown).otherwise(F.col("id__"))
    return out.withColumn("category_id", category.cast("int")).drop("known__", "id__")
