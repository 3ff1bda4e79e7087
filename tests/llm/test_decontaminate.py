from __future__ import annotations

import random

import numpy as np
import pytest

from corpusmill.llm import decontaminate as dc
from tests.llm import helpers

QUESTION = "A train leaves the old station with 240 passengers and after 3 hours it has travelled 180 km while Maria counts 12 bridges along the way to the sea"
CHANGED = "a train leaves the old station with 310 passengers and after 5 hours it has travelled 95 miles while Peter counts 7 bridges along the way to the sea"
OTHER = "The committee met in spring and it discussed the harvest of olives near the river before anyone had thought about the price of salt or wool"


def found(spark, docs: list, items: list, **more) -> dict:
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    return {r["doc_id"]: r for r in dc.decontaminate(d, b, **more).collect()}


def test_copies_and_changed_parameters_are_found(spark):
    rng = random.Random(1)
    around = lambda t: f"{helpers.letters(rng, 50)} {t} {helpers.letters(rng, 50)}"
    docs = [(1, around(QUESTION)), (2, around(QUESTION.upper())), (3, around(CHANGED)), (4, around(OTHER)), (5, around("")), (6, None), (7, "")]
    got = found(spark, docs, [("q", QUESTION), ("o", "Nothing of this sort was ever written down by people who live on the coast of a warm and shallow sea")])
    assert {i for i, r in got.items() if r["contaminated"]} == {1, 2, 3}
    assert all(got[i]["item_id"] == "q" and got[i]["n_items"] == 1 and got[i]["coverage"] >= dc.COVERAGE for i in (1, 2, 3))
    assert got[4]["item_id"] is None and got[4]["coverage"] == 0 and got[4]["n_items"] == 0


def test_slots_have_to_be_consistent(spark):
    item = "take 10 apples and add 20 pears to the box then count 10 apples and 20 pears again before you take 10 apples and 20 pears out of the box once more"
    same = item.replace("10", "77").replace("20", "5")
    mixed = "take 1 apples and add 2 pears to the box then count 3 apples and 4 pears again before you take 5 apples and 6 pears out of the box once more"
    got = found(spark, [(1, same), (2, mixed)], [("q", item)])
    assert got[1]["contaminated"] and got[1]["coverage"] == 1.0
    assert not got[2]["contaminated"]


def test_blocks_of_the_benchmark_give_the_same_rows(spark):
    rng = random.Random(2)
    items = [(f"i{k:02d}", helpers.letters(rng, 30, 10**6)) for k in range(40)]
    docs = [(k, f"{helpers.letters(rng, 40)} {items[k % 60 % 40][1] if k % 3 == 0 else ''} {items[(k * 7) % 40][1] if k % 5 == 0 else ''}") for k in range(60)]
    one, many = found(spark, docs, items), found(spark, docs, items, block_bytes=900)
    assert one == many
    assert {k for k, r in one.items() if r["contaminated"]} == {k for k in range(60) if k % 3 == 0 or k % 5 == 0}


def test_query_finds_the_planted_passages(spark, small):
    docs = {r[0]: r[1] or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in dc.op5_decontaminate(spark, small).collect()}
    assert set(got) == set(docs)
    flat = {i: " ".join(helpers.words(helpers.lower(t))) for i, t in docs.items()}
    held = {i for i, t in flat.items() if any(" ".join(helpers.words(helpers.lower(x))) in t for x in items)}
    assert held and held <= {i for i, r in got.items() if r["contaminated"]}
    # whoever is flagged without an exact copy holds at least a run of words of an item
    runs = {tuple(w[k : k + 6]) for x in items for w in [helpers.words(helpers.lower(x))] for k in range(len(w) - 5)}
    for i, r in got.items():
        if r["contaminated"] and i not in held:
            w = flat[i].split(" ")
            assert any(tuple(w[k : k + 6]) in runs for k in range(len(w) - 5)), i


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, QUESTION, "x", 3), (1, QUESTION, "y", 4), (None, None, None, None)], "doc_id bigint, text string, Coverage string, TEXT bigint")
    items = spark.createDataFrame([("q", QUESTION), ("q", QUESTION), (None, OTHER), ("e", None), ("f", ""), ("s", "too short now")], "item_id string, text string")
    got = dc.decontaminate(docs, items)
    assert got.columns == ["doc_id", "text", "contaminated", "n_items", "item_id", "coverage"]
    assert sorted((r["doc_id"] or 0, r["contaminated"]) for r in got.collect()) == [(0, False), (1, True), (1, True)]
    assert dc.decontaminate(docs.where("false"), items).collect() == []
    assert not any(r["contaminated"] for r in dc.decontaminate(docs, items.where("false")).collect())


@pytest.mark.parametrize("text, kinds", [("costs 12 dollars now", [0, 1, 2, 0]), ("we saw Anna Maria there", [0, 0, 3, 0]), ("12 34 x", [1, 0]), ("x. Next day", [0, 0, 0])])
def test_placeholders(text, kinds):
    data = np.frombuffer(text.encode(), np.uint8)
    assert dc.canonical(data, np.array([0, len(data)])).kind.tolist() == kinds


def test_items_of_numbers_are_found_word_by_word(spark):
    digits = " ".join("3 1 4 1 5 9 2 6 5 3 5 8 9 7 9 3 2 3 8 4 6")
    rng = random.Random(3)
    docs = [(1, f"{helpers.letters(rng, 20)} {digits} {helpers.letters(rng, 20)}"), (2, " ".join(str(rng.randrange(10)) for _ in range(500)) + " 7 7 7 7 7"), (3, digits[:15])]
    got = found(spark, docs, [("pi", digits), ("q", QUESTION)])
    assert {i for i, r in got.items() if r["contaminated"]} == {1}


def test_inserted_and_deleted_words_do_not_split_an_item(spark):
    rng = random.Random(4)
    w = helpers.letters(rng, 40, 10**6).split(" ")
    fill = lambda n: helpers.letters(rng, n, 10**6).split(" ")
    inserted, deleted = [*w[:20], "word", *w[20:]], [*w[:20], *w[21:]]
    twice = [*w[:13], "word", *w[13:27], "more", "words", *w[27:]]
    apart, swapped = [*w[:20], *fill(300), *w[20:]], [*w[20:], *w[:20]]
    docs = [(k, " ".join([*fill(30), *d, *fill(30)])) for k, d in enumerate([inserted, deleted, twice, apart, swapped])]
    got = found(spark, docs, [("q", " ".join(w))])
    assert {k: r["coverage"] for k, r in got.items()} == {0: 1.0, 1: 39 / 40, 2: 1.0, 3: 0.5, 4: 0.5}
    assert {k for k, r in got.items() if r["contaminated"]} == {0, 1, 2}


def test_slots_have_to_agree_across_an_inserted_word(spark):
    item = "take 10 apples and put them in the large wooden box near the door then count all of the 10 apples in the box and go home before dark"
    same = item.replace("10", "77").replace("door then", "door quickly then")
    mixed = item.replace("10", "77", 1).replace("door then", "door quickly then")
    got = found(spark, [(1, same), (2, mixed)], [("q", item)])
    assert got[1]["coverage"] == 1.0
    assert got[2]["coverage"] < 1.0


@pytest.mark.parametrize("item, text, hit", [
    ("What is two plus?", "So it began. What is two plus? Nobody knew.", True), ("What is two plus?", "what is two plus", True), ("What is two plus?", "Say what is two plus and go", False), ("Yes", "yes and no", False),
    ("A farmer keeps twelve cows and sells seven of them at the market before the cold winter starts", "A farmer keeps ninety cows and sells 31 of them at the market before the cold winter starts", True),
    ("Alice walks along the quiet river and meets an old friend who carries 5 stones in a small bag", "Gertrude walks along the quiet river and meets an old friend who carries 8 stones in a small bag", True),
    ("take 10 red stones then take 20 blue stones and put the 10 red and the 20 blue stones away", "take 7 red stones then take 7 blue stones and put the 7 red and the 7 blue stones away", False),
])
def test_short_spelled_and_opening(spark, item, text, hit):
    assert found(spark, [(1, f"{text}\n")], [("q", item)])[1]["contaminated"] == hit


def test_items_of_one_template_are_looked_for_once(spark):
    items = [(f"i{k:03d}", f"a shop sells {k} books for {2 * k + 1} dollars and then {k} pens for less than that on a rainy day in the old town") for k in range(300)]
    index = dc.Index(items)
    assert len(index.members) == 1
    got = found(spark, [(1, items[7][1]), (2, items[7][1].replace("7", "8", 1))], items)
    assert (got[1]["n_items"], got[1]["item_id"], got[1]["coverage"]) == (300, "i000", 1.0)
    assert got[2]["coverage"] < 1.0


def test_single_shift_equals_brute_force(spark):
    """Items whose words are changed in place: covered are the tokens of windows without a changed word."""
    rng = random.Random(9)
    items = [(f"i{k}", helpers.letters(rng, rng.choice([6, 9, 15, 30]), 10**6)) for k in range(12)]
    docs, want = [], {}
    for k in range(80):
        name, text = rng.choice(items)
        w = text.split(" ")
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "changed"
        docs.append((k, f"{helpers.letters(rng, 12, 10**6)} {' '.join(w)} {helpers.letters(rng, 12, 10**6)}"))
        old, width = text.split(" "), min(10, len(w))
        covered = {p + j for p in range(len(w) - width + 1) if w[p : p + width] == old[p : p + width] for j in range(width)}
        want[k] = len(covered) / len(w)
    got = found(spark, docs, items)
    for k in want:
        assert got[k]["coverage"] == want[k] and got[k]["contaminated"] == (want[k] >= dc.COVERAGE), k
