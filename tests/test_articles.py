from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusmill.config import PackingConfig, PrepOptions
from corpusmill.functions.text import space_separated
from corpusmill.functions.tokenizers import SpaceTokenizer
from corpusmill.operators import articles as art
from corpusmill.operators import chat, packing

TOKENIZER = SpaceTokenizer({"hi": 1, "bye": 2, "test": 3, "<human>": 4, "<bot>": 5})
P, C, PAD, SEP = 0, 1, 2, 3
LENGTH = 6


def pairs(spark, *lines: list[tuple]):
    rows = [(line, i, len(ps), p, c, -1) for line, ps in enumerate(lines) for i, (p, c) in enumerate(ps)]
    return spark.createDataFrame(rows, "line_no bigint, pair_no bigint, n_pairs bigint, prompt string, completion string, category_id int")


def tokens_of(rows) -> list[tuple[list[int], list[int]]]:
    return [([t.token_id for t in r["tokens"]], [t.token_type for t in r["tokens"]]) for r in rows]


@pytest.mark.parametrize("prompt, completion, prefix, postfix, ids, types", [
    ("", "", "", "", [], []), ("", "bye", "", "", [2, 0], [C, C]), ("hi", "", "", "", [1, 0], [P, C]), ("hi test", "bye test", "", "", [1, 3, 2, 3, 0], [P, P, C, C, C]),
    ("hi test", "bye test", "<human> ", " <bot>", [4, 1, 3, 5, 2, 3, 0], [P, P, P, P, C, C, C]), ("", "bye", "<human> ", " <bot>", [2, 0], [C, C]),
])
def test_tokenize(spark, prompt, completion, prefix, postfix, ids, types):
    options = PrepOptions(prompt_prefix=prefix, prompt_postfix=postfix, keep_empty_completions=True)
    made = art.with_pair_tokens(art.prepare_pairs(pairs(spark, [(prompt, completion)]), options), TOKENIZER)
    assert tokens_of(made.collect()) == [(ids, types)]


@pytest.mark.parametrize("packing_boundary, attention, expected", [
    ("jsonl", "jsonl", [([1, 2, 0, 3, 3, 0], [P, C, C, P, C, SEP])]), ("jsonl", "prompt_completion_pair", [([1, 2, 0, 3, 3, 0], [P, C, SEP, P, C, SEP])]),
    ("prompt_completion_pair", "jsonl", [([1, 2, 0], [P, C, C]), ([3, 3, 0], [P, C, SEP])]), ("prompt_completion_pair", "prompt_completion_pair", [([1, 2, 0], [P, C, SEP]), ([3, 3, 0], [P, C, SEP])]),
])
def test_boundaries(spark, packing_boundary, attention, expected):
    options = PrepOptions(packing_boundary=packing_boundary, attention_boundary=attention)
    made = art.articles_from_pairs(pairs(spark, [("hi", "bye"), ("test", "test")]), TOKENIZER, options)
    assert tokens_of(made.orderBy("line_no", "art_no").collect()) == expected


def test_a_skipped_last_pair_leaves_its_line_without_separator(spark):
    options = PrepOptions(packing_boundary="prompt_completion_pair")
    made = art.articles_from_pairs(pairs(spark, [("hi", "bye"), ("test", "")]), TOKENIZER, options)
    assert tokens_of(made.collect()) == [([1, 2, 0], [P, C, C])]


@pytest.mark.parametrize("text, expected", [("hi bye test", ([1, 2, 3, 0], [C, C, C, SEP])), ("", ([], [])), (None, ([], []))])
def test_text_lines(spark, text, expected):
    lines = spark.createDataFrame([(0, text)], "line_no bigint, value string")
    assert tokens_of(art.articles_from_text(lines, TOKENIZER).collect()) == [expected]


def sequences(spark, line: list[tuple], keep: bool):
    options = PrepOptions(max_seq_length=LENGTH, keep_prompt_only_sequences=keep)
    made = art.articles_from_pairs(pairs(spark, line), TOKENIZER, options).withColumn("split_idx", F.lit(0))
    out = packing.pack(made, PackingConfig(), LENGTH, 0)
    return tokens_of((out if keep else packing.without_prompt_only(out)).orderBy("seq").collect())


def test_prompt_only_sequences(spark):
    line = [("hi " * 8, "bye")]
    tail = ([1, 1, 2, 0, 0, 0], [P, P, C, SEP, PAD, PAD])
    assert sequences(spark, line, False) == [tail]
    assert sequences(spark, line, True) == [([1] * 6, [P] * 6), tail]


@pytest.mark.parametrize("given, expected", [
    (("hi", "bye"), ("hi", " bye")), ((" hi", "bye"), (" hi", " bye")), (("hi ", "bye"), ("hi", " bye")), (("hi", " bye"), ("hi", " bye")), (("hi", "bye "), ("hi", " bye ")), (("hi ", " bye"), ("hi", " bye")), ((" h i ", " b y e "), (" h i", " b y e ")),
    (("a\t", "\tb"), ("a\t", " \tb")), (("a", ""), ("a", "")),
])
def test_space_separator(spark, given, expected):
    row = spark.createDataFrame([given], "p string, c string").select(*space_separated(F.col("p"), F.col("c"))).first()
    assert tuple(row) == expected


def test_unknown_words_and_categories_are_errors(spark):
    with pytest.raises(Exception, match="unknown word"):
        art.articles_from_text(spark.createDataFrame([(0, "what")], "line_no bigint, value string"), TOKENIZER).collect()
    known = spark.createDataFrame([("a", 0)], "category string, category_id int")
    rows = spark.createDataFrame([(1, "a"), (2, None)], "line_no int, category string")
    assert {r["line_no"]: r["category_id"] for r in art.with_category_ids(rows, known).collect()} == {1: 0, 2: -1}
    with pytest.raises(Exception, match="unknown category"):
        art.with_category_ids(spark.createDataFrame([(1, "b")], "line_no int, category string"), known).collect()


def test_categories_reach_the_end_token_but_not_the_padding(spark):
    df = pairs(spark, [("hi", "bye")]).withColumn("category_id", F.lit(2))
    made = art.articles_from_pairs(df, TOKENIZER, PrepOptions()).withColumn("split_idx", F.lit(0))
    assert [t.category_id for t in packing.pack(made, PackingConfig(), 5, 0).first()["tokens"]] == [2, 2, 2, -1, -1]


class Marked(SpaceTokenizer):
    """Puts its begin and end tokens around every text."""

    def encode(self, text):
        return F.concat(F.array(F.lit(9)), super().encode(text), F.array(F.lit(self.eos_id)))


def test_begin_and_end_tokens_of_the_tokenizer_go(spark):
    own = Marked(TOKENIZER.vocabulary, bos_id=9)
    run = lambda chat_: tokens_of(art.with_pair_tokens(pairs(spark, [("hi", "bye")], [("", "bye")]), own, chat_).orderBy("line_no").collect())
    assert run(False) == [([9, 1, 2, 0], [P, P, C, C]), ([9, 2, 0], [C, C, C])]
    assert run(True) == [([1, 2, 0], [P, C, C]), ([9, 2, 0], [C, C, C])]


def test_turns_to_pairs(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c"), (1, 4, "assistant", "d"), (1, 5, "user", "e"), (2, 0, "user", "f"), (3, 0, "assistant", "g")]
    found = chat.turns_to_pairs(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))
    assert sorted(map(tuple, found.collect())) == [(1, 0, "b", "c"), (1, 1, "", "d"), (3, 0, "", "g")]


def test_templates_that_repeat_their_prefix(spark):
    template = chat.ChatTemplate("", "", "<u>", "</u>", "<a>", "</a>")
    assert template.repeats
    found = chat.templated_pairs(pairs(spark, [("x", "y"), ("z", "w")]), template).orderBy("pair_no").collect()
    assert [(r["prompt"], r["completion"]) for r in found] == [("<u>x</u><a>", "y</a>"), ("<u>z</u><a>", "w</a>")]
    assert chat.rendered_chats(pairs(spark, [("x", "y"), ("z", "w")]), template).first()["chat"] == "<u>x</u><a>y</a><u>z</u><a>w</a>"


def test_templates_with_a_head_of_their_own_make_one_pair(spark):
    template = chat.ChatTemplate("<s>", "sys ", "<u>", "</u>", "<a>", "</a>")
    assert not template.repeats
    row = chat.templated_pairs(pairs(spark, [("x", "y"), ("z", "w")]), template).first()
    assert row["n_pairs"] == 1 and row["prompt"].startswith("<s>sys <u>x</u><a>") and row["prompt"].endswith("z") and row["completion"].startswith("y") and row["completion"].endswith("w</a>")
    with pytest.raises(ValueError):
        chat.ChatTemplate("", "", "")


@pytest.mark.parametrize("name", ["tokenize_documents", "tokenize_pairs"])
def test_each_text_is_tokenized_once(spark, small, name):
    from corpusmill.plans.queries import QUERIES

    plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == {"tokenize_documents": 1, "tokenize_pairs": 2}[name]


def test_ends_and_separators_of_texts(spark):
    tokenizer = SpaceTokenizer({"a": 5, "b": 6, "end": 9}, eos_id=9)
    texts = ["a b", "end", "a end", "end end", "", None, "end a"]
    want = [[5, 6, 9], [], [5, 9], [9, 9], [], [], [9, 5, 9]]
    lines = spark.createDataFrame(list(enumerate(texts)), "line_no bigint, value string")
    made = {r["line_no"]: r["tokens"] for r in art.articles_from_text(lines, tokenizer).collect()}
    assert [[t.token_id for t in made[i]] for i in range(len(texts))] == want
    assert all([t.token_type for t in made[i]] == [1] * (len(made[i]) - 1) + [3] * bool(made[i]) and all(t.category_id == -1 for t in made[i]) for i in made)
