from __future__ import annotations

import itertools
import random

import pytest

from corpusmill.llm import licenses as lic
from tests.llm import helpers


def longest(a: list, b: list) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def scan(spark, docs: list, **more) -> dict:
    return {r["doc_id"]: r for r in lic.scan_licenses(spark.createDataFrame(docs, "doc_id bigint, text string"), **more).collect()}


def test_all_templates_are_found_whole_and_changed(spark):
    rng = random.Random(1)
    docs, names = [], list(lic.TEMPLATES)
    for k, name in enumerate(names):
        text = lic.TEMPLATES[name]
        docs.append((k, f"{helpers.prose(rng, 40)} {text} {helpers.prose(rng, 40)}"))
        w = text.split()
        for j in range(0, len(w), 12):  # fewer than a fifth of the words are others
            w[j] = f"zz{j}"
        docs.append((100 + k, f"{helpers.prose(rng, 400)}\n# {chr(10).join(w)}") if len(w) >= 30 else (100 + k, text.upper()))
    got = scan(spark, docs)
    for k, name in enumerate(names):
        assert name in got[k]["licenses"].split(",") and got[k]["coverage"] == 1.0
        assert name in got[100 + k]["licenses"].split(","), name


def test_texts_without_license(spark):
    rng = random.Random(2)
    docs = [(0, None), (1, ""), (2, "the license of the and version work"), (3, helpers.prose(rng, 5000)), (4, " ".join(rng.sample(lic.words(lic.TEMPLATES["MIT"]) * 30, 2000)))]
    got = scan(spark, docs)
    assert all(got[i]["license"] is None and got[i]["licenses"] == "" and got[i]["coverage"] == 0 for i in (0, 1, 2, 3))


def test_range_and_choice_of_the_best(spark):
    text = "one two three " + lic.TEMPLATES["Apache-2.0"] + " four"
    row = scan(spark, [(1, text)])[1]
    n = len(lic.words(lic.TEMPLATES["Apache-2.0"]))
    assert (row["license"], row["first_word"], row["last_word"]) == ("Apache-2.0", 3, 3 + n - 1)
    assert set(row["licenses"].split(",")) >= {"Apache-2.0", "Apache-2.0-notice"}


def test_patience_is_a_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randrange(14))] for _ in range(2))
        pairs = lic.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p < q and r < s for (p, r), (q, s) in itertools.pairwise(pairs))
        assert len(pairs) <= longest(a, b)
        assert len(lic.patience(a, a)) == len(a)


def test_the_prefilter_loses_nothing(spark):
    """Every text whose best stretch reaches the coverage by alignment of the whole text is found."""
    rng = random.Random(4)
    name = "CC0-1.0"
    template = lic.words(lic.TEMPLATES[name])
    docs = []
    for k in range(120):
        w = [x for x in template if rng.random() > k / 400]
        for _ in range(rng.randrange(6)):
            w.insert(rng.randrange(len(w)), f"x{k}")
        docs.append((k, " ".join([f"y{k}"] * 30 + w + [f"z{k}"] * 30)))
    got = scan(spark, docs, templates={name: lic.TEMPLATES[name]})
    for k, text in docs:
        share = len(lic.patience(lic.words(text), template)) / len(template)
        assert (got[k]["license"] == name) == (share >= lic.COVERAGE), (k, share)


def test_increasing_is_longest():
    rng = random.Random(5)
    for _ in range(100):
        values = [(i, v) for i, v in enumerate(rng.sample(range(9), rng.randrange(9)))]
        best = max((len(c) for n in range(len(values) + 1) for c in itertools.combinations(values, n) if all(x[1] < y[1] for x, y in itertools.pairwise(c))), default=0)
        assert len(lic.increasing(values)) == best


def test_repeated_rows_extra_columns_and_no_rows(spark):
    docs = spark.createDataFrame([(1, lic.TEMPLATES["ISC"], "x"), (1, lic.TEMPLATES["ISC"], "x"), (None, "no", "y")], "doc_id bigint, text string, License string")
    assert sorted(str(r["license"]) for r in lic.scan_licenses(docs).collect()) == ["ISC", "ISC", "None"]
    assert lic.scan_licenses(docs.where("false")).collect() == []
    with pytest.raises(ValueError):
        lic.Scanner({str(i): "a b c" for i in range(65)})


def test_query(spark, small):
    rows = lic.op8_licenses(spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    texts = {r[0]: " ".join(lic.words(r[1] or "")) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    for r in rows:
        whole = {n for n, t in lic.TEMPLATES.items() if " ".join(lic.words(t)) in texts[r["doc_id"]]}
        assert whole <= set(r["licenses"].split(","))


@pytest.mark.parametrize("text, found", [
    ("Some this and that. This work is licensed under the GNU General Public License, version 3. And more of this.", "GPL-3.0-notice"),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0-notice"),
    ("This work is licensed under the GNU General Public License, version 7.", ""), ("Released under the Foo License.", ""),
    ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"), ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("See the terms. Released under the MIT License. Released under the MIT License. " + "ten other words stand here that belong to no license text", "MIT-notice"),
    ("Released under the MIT License. " + "x " * 300 + "Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0,MIT-notice"),
])
def test_one_license_for_one_notice(spark, text, found):
    assert scan(spark, [(1, text)])[1]["licenses"] == found


def test_notices_equal_brute_force(spark, small):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect() if r[1] and len(r[1]) < 20000]
    rng = random.Random(6)
    notices = [n for n in lic.TEMPLATES if len(lic.words(lic.TEMPLATES[n])) < 16]
    for k in range(60):  # notices with words changed, dropped and added among the words of others
        w = f"{lic.TEMPLATES[rng.choice(notices)]} {rng.choice(['', 'the of license', 'public version 3'])}".split()
        w = [x for x in w if rng.random() > 0.08] + ["under", "the", "license"][: rng.randrange(4)]
        docs.append((10**6 + k, helpers.prose(rng, 30) + " " + " ".join(w) + " " + helpers.prose(rng, 30)))
    got = scan(spark, docs, templates={n: lic.TEMPLATES[n] for n in notices})
    for i, text in docs:
        w = lic.words(text)
        reached = set()
        for n in notices:
            t = lic.words(lic.TEMPLATES[n])
            required, excluded = set(lic.REQUIRED.get(n, "").split()), set(lic.EXCLUDED.get(n, "").split())
            if not required <= set(w):
                continue
            for a in (k for k, x in enumerate(w) if x in t):
                part = w[a : a + 2 * len(t)]
                if longest(part, t) >= lic.COVERAGE * len(t) and required <= set(part):
                    ends = [e for e in range(1, len(part) + 1) if longest(part[:e], t) >= lic.COVERAGE * len(t) and required <= set(part[:e])]
                    if ends and not excluded & set(part[: ends[0]]):
                        reached.add(n)
                        break
        listed = set(got[i]["licenses"].split(",")) - {""}
        assert listed <= reached, (i, listed, reached)
        assert bool(listed) == bool(reached), (i, listed, reached)


def test_more_templates_than_one_scanner_takes(spark):
    rng = random.Random(8)
    templates = {f"t{k:03d}": helpers.letters(rng, 12, 10**6) for k in range(150)}
    got = scan(spark, [(k, f"a b {t} c") for k, t in enumerate(templates.values())], templates=templates)
    assert all(got[k]["license"] == f"t{k:03d}" for k in range(150))
