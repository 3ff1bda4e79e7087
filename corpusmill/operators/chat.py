"""Chat turns to prompt/completion pairs, and chat templates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.config import NO_CATEGORY, PrepOptions
from corpusmill.functions.tokenizers import Tokenizer
from corpusmill.operators.articles import articles_from_pairs


def turns_to_pairs(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text", user: str = "user", assistant: str = "assistant") -> DataFrame:
    """(conversation, pair_no, prompt, completion): each assistant turn with the last user turn since the one before, else an empty prompt.

    Other roles and user turns without an answer go.
    """
    order = Window.partitionBy(conversation).orderBy(turn)
    earlier = F.coalesce(F.sum((F.col(role) == assistant).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = turns.withColumn("pair_no", earlier.cast("bigint")).groupBy(conversation, "pair_no")
    said = lambda who: F.max_by(F.when(F.col(role) == who, F.col(content)), F.when(F.col(role) == who, F.col(turn)))
    pairs = grouped.agg(said(user).alias("prompt"), said(assistant).alias("completion"), F.max((F.col(role) == assistant).cast("int")).alias("answered"))
    return pairs.where("answered = 1").select(conversation, "pair_no", F.coalesce("prompt", F.lit("")).alias("prompt"), F.coalesce("completion", F.lit("")).alias("completion"))


@dataclass(frozen=True)
class ChatTemplate:
    """Text around the turns of a chat."""

    bos: str = ""
    system_head: str = ""
    user_open: str = "<user>"
    user_close: str = "</user>"
    assistant_open: str = "<assistant>"
    assistant_close: str = "</assistant>"

    def __post_init__(self) -> None:
        if not self.prefix:
            raise ValueError("a template needs text before the first prompt, by which turns are told apart")

    @property
    def prefix(self) -> str:
        return self.bos + self.system_head + self.user_open

    @property
    def between(self) -> str:
        """Text from the end of an answer to the next prompt."""
        return self.assistant_close + self.user_open

    @property
    def repeats(self) -> bool:
        """Pairs can be told apart: the text between them ends with all that stands before the first prompt."""
        return self.between.endswith(self.prefix)

    def render(self, pairs: Column) -> Column:
        """The whole chat of an array of (prompt, completion)."""
        turn = lambda p: F.concat(F.lit(self.user_open), p.prompt, F.lit(self.user_close + self.assistant_open), p.completion, F.lit(self.assistant_close))
        return F.concat(F.lit(self.bos + self.system_head), F.array_join(F.transform(pairs, turn), ""))


def rendered_chats(pairs: DataFrame, template: ChatTemplate, line: str = "line_no") -> DataFrame:
    """(line, chat) of pairs(line, pair_no, prompt, completion)."""
    listed = pairs.groupBy(line).agg(F.sort_array(F.collect_list(F.struct("pair_no", "prompt", "completion"))).alias("p"))
    return listed.select(line, template.render(F.col("p")).alias("chat"))


def templated_pairs(pairs: DataFrame, template: ChatTemplate, line: str = "line_no", keep: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with the template's text: (line, pair_no, n_pairs, prompt, completion, category_id).

    A pair's completion runs up to the first occurrence of the prefix in the text before the next prompt, and that prompt starts
    with the prefix. If the template doesn't repeat its prefix, a line is one pair: all prompts in the
    prompt, all answers and the text around them in the completion. Categories, space separators and empty completions play no part.
    """
    order = Window.partitionBy(line).orderBy("pair_no")
    whole = Window.partitionBy(line)
    rows = pairs.withColumn("i__", F.row_number().over(order) - 1).withColumn("n__", F.count(F.lit(1)).over(whole))
    last = F.col("i__") == F.col("n__") - 1
    prompt = F.concat(F.lit(template.prefix), F.col("prompt"), F.lit(template.user_close + template.assistant_open))
    if template.repeats:
        tail = F.when(last, F.lit(template.assistant_close)).otherwise(template.between.split(template.prefix)[0])
        return rows.select(line, *keep, F.col("i__").cast("bigint").alias("pair_no"), F.col("n__").alias("n_pairs"), prompt.alias("prompt"), F.concat("completion", tail).alias("completion"), F.lit(NO_CATEGORY).alias("category_id"))
    # state machine of a template that can't be split: after the first answer markup belongs to the completion
    tail = F.when(last, F.lit(template.assistant_close)).otherwise(template.between + template.user_close + template.assistant_open)
    head = F.when(F.col("i__") == 0, prompt).otherwise(F.col("prompt"))
    parts = rows.select(line, *keep, F.struct("i__", head.alias("p"), F.concat("completion", tail).alias("c")).alias("s"))
    joined = parts.groupBy(line, *keep).agg(F.sort_array(F.collect_list("s")).alias("s"))
    return joined.select(line, *keep, F.lit(0).cast("bigint").alias("pair_no"), F.lit(1).cast("bigint").alias("n_pairs"), F.array_join(F.col("s.p"), "").alias("prompt"), F.array_join(F.col("s.c"), "").alias("completion"), F.lit(NO_CATEGORY).alias("category_id"))


def articles_from_chats(pairs: DataFrame, template: ChatTemplate, tokenizer: Tokenizer, options: PrepOptions, keep: tuple[str, ...] = ()) -> DataFrame:
    """Articles of pairs(line_no, pair_no, prompt, completion) in the template's form."""
    return articles_from_pairs(templated_pairs(pairs, template, keep=keep), tokenizer, options, chat=True, keep=keep)
