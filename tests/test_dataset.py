from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from corpusmill.__main__ import main
from corpusmill.config import PackingConfig, PrepOptions
from corpusmill.functions.tokenizers import JsonTokenizer, SpaceTokenizer, WordHashTokenizer, build_vocabulary, encode_with_vocabulary
from corpusmill.operators import decode, metrics, validate
from corpusmill.plans import dataset
from corpusmill.sources import lines as src
from corpusmill.sources import outputs
from corpusmill.streaming import ingest

WORDS = {f"w{i}": i + 10 for i in range(50)}


def write(path, rows) -> str:
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def pair(i: int, n: int = 3) -> dict:
    return {"prompt": f"w{i % 50} w1", "completion": " ".join(f"w{(i + k) % 50}" for k in range(n))}


@pytest.fixture
def jsonl(tmp_path):
    return write(tmp_path / "in.jsonl", [pair(i, 1 + i % 7) if i % 3 else [pair(i), pair(i + 1)] for i in range(90)])


@pytest.mark.parametrize("shuffle", ["False", "on_RAM", "large_file"])
def test_pipeline(spark, tmp_path, jsonl, shuffle):
    out = str(tmp_path / "out")
    found = dataset.run_pipeline(spark, jsonl, out, WordHashTokenizer(), PrepOptions(max_seq_length=16), train=4, dev=2, test=1, shuffle=shuffle, keep_raw_splits=True)
    packed = outputs.read_packed(spark, f"{out}/packed")
    assert packed.where("size(input_ids) <> 16 OR size(token_type_ids) <> 16").count() == 0
    sizes = {(r["dataset_type"], r["shard_no"]): r["count"] for r in packed.groupBy("dataset_type", "shard_no").count().collect()}
    for kind in ("train", "dev"):
        own = [n for (k, _), n in sizes.items() if k == kind]
        assert max(own) - min(own) <= 1
        assert found[f"{kind}_output_tokens"] == 16 * sum(own) == found[f"{kind}_prompt_tokens"] + found[f"{kind}_completion_tokens"] + found[f"{kind}_padding_tokens"]
        assert found[f"{kind}_sequences"] == sum(own) and found[f"max_batch_size_{kind}"] == min(own)
        dropped = found[f"{kind}_tokens_dropped_from_packing"] + found[f"{kind}_tokens_dropped_from_all_prompt"]
        assert found[f"{kind}_input_tokens"] <= found[f"{kind}_output_tokens"] - found[f"{kind}_padding_tokens"] + dropped
    assert found["train_articles"] + found["dev_articles"] + spark.read.text(f"{out}/test_files").count() == 90
    assert spark.read.text(f"{out}/splits").select("value").union(spark.read.text(f"{out}/test_files").select("value")).distinct().count() == spark.read.text(jsonl).distinct().count()
    assert outputs.read_metadata(spark, f"{out}/metadata.yaml") == found
    assert outputs.manifest_is_valid(spark, out)


def test_manifest_notices_changes(spark, tmp_path, jsonl):
    out = str(tmp_path / "out")
    dataset.run_pipeline(spark, jsonl, out, WordHashTokenizer(), PrepOptions(max_seq_length=16), train=2, dev=0, test=0)
    (tmp_path / "out" / "metadata.yaml").write_text("changed: true\n")
    (tmp_path / "out" / ".metadata.yaml.crc").unlink()
    (tmp_path / "out" / "new.txt").write_text("new")
    assert {r["name"]: r["problem"] for r in outputs.manifest_violations(spark, out).collect()} == {"metadata.yaml": "hash differs", "new.txt": "not in the manifest"}
    assert main(["check", "--input_path", out]) == 1


def test_malformed_lines(spark, tmp_path):
    bad = ['{"prompt": "w1"}', '{"prompt": "w1", "completion": ', "", '"text"', '[{"completion": "w1"}, {"prompt": "w2"}]', "[1, 2]"]
    path = write(tmp_path / "in.jsonl", [*bad, *[pair(i) for i in range(20)]])
    out = str(tmp_path / "out")
    with pytest.raises(Exception, match="malformed line"):
        dataset.prepare_file(spark, path, str(tmp_path / "no"), WordHashTokenizer(), PrepOptions(max_seq_length=8))
    found = dataset.prepare_file(spark, path, out, WordHashTokenizer(), PrepOptions(max_seq_length=8, ignore_format_errors=True))
    assert sorted(r["value"] for r in spark.read.text(f"{out}/rejects").collect()) == sorted(bad)
    assert found["articles"] == 26


def test_tokens_are_conserved(spark, tmp_path, jsonl):
    for name in PackingConfig.names():
        out = str(tmp_path / name.replace(":", "_"))
        options = PrepOptions(max_seq_length=8, packing=PackingConfig.parse(name), keep_prompt_only_sequences=True, packing_boundary="prompt_completion_pair")
        m = dataset.prepare_file(spark, jsonl, out, WordHashTokenizer(), options)
        assert m["input_tokens"] == m["prompt_tokens"] + m["completion_tokens"] + m["tokens_dropped_from_packing"], name
        assert m["output_tokens"] == 8 * m["sequences"]


def test_text_input_directories_and_guards(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "b.txt", ["w3", "w4"])
    write(folder / "a.txt", ["w1", "w2"])
    (folder / "empty.jsonl").write_text("")
    assert src.input_kind(spark, str(folder)) == "txt"
    assert [r["value"] for r in src.read_lines(spark, str(folder)).orderBy("line_no").collect()] == ["w1", "w2", "w3", "w4"]
    found = dataset.prepare_file(spark, str(folder), str(tmp_path / "out"), SpaceTokenizer(WORDS), PrepOptions(max_seq_length=4))
    assert (found["articles"], found["input_tokens"], found["sequences"]) == (4, 8, 2)
    row = outputs.read_packed(spark, str(tmp_path / "out/packed")).orderBy("seq").first()
    assert (row["input_ids"], row["token_type_ids"]) == ([11, 0, 12, 0], [1, 3, 1, 3])
    with pytest.raises(FileExistsError):
        dataset.prepare_file(spark, str(folder), str(tmp_path / "out"), SpaceTokenizer(WORDS), PrepOptions())
    write(folder / "c.jsonl", [pair(1)])
    assert src.input_kind(spark, str(folder)) == "jsonl"
    for bad in (str(tmp_path / "x.csv"), str(tmp_path / "none")):
        with pytest.raises(ValueError):
            src.input_kind(spark, bad)
    with pytest.raises(ValueError):
        dataset.run_pipeline(spark, write(tmp_path / "s.jsonl", [pair(i) for i in range(10)]), str(tmp_path / "o2"), WordHashTokenizer(), PrepOptions(), train=128, dev=0, test=0)


def test_bytes_that_are_not_text(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"ok\nbad \xff byte\n")
    assert [r["value"] for r in src.read_lines(spark, str(tmp_path / "x.txt")).orderBy("line_no").collect()] == ["ok", "bad � byte"]


def test_categories(spark, tmp_path):
    path = write(tmp_path / "in.jsonl", [pair(i) | {"category": "b" if i % 2 else "a"} for i in range(8)])
    names = tmp_path / "names.json"
    names.write_text(json.dumps(["a", "x", "b", "a"]))
    out = str(tmp_path / "out")
    dataset.prepare_file(spark, path, out, SpaceTokenizer(WORDS), PrepOptions(max_seq_length=8, packing=PackingConfig.parse("single::drop")), category_path=str(names))
    assert {c for r in outputs.read_packed(spark, f"{out}/packed").select("category_ids").collect() for c in r[0]} == {3, 2, -1}
    with pytest.raises(ValueError):
        src.read_categories(spark, "names.txt")


def test_other_keywords(spark, tmp_path):
    path = write(tmp_path / "in.jsonl", [{"q": "w1", "a": "w2"}, {"a": "w3"}])
    parsed = src.parse_lines(src.read_lines(spark, path), "a")
    assert sorted((r["prompt"], r["completion"]) for r in src.pairs_of(src.accepted(parsed), "q", "a").collect()) == [("", "w3"), ("w1", "w2")]


def test_decoding(spark):
    words = [("a", 0), ("b", 0), ("c", 1), ("d", 1), ("e", 3), ("f", 3), ("g", 0), ("h", 1), ("p", 2), ("p", 2)]
    df = spark.createDataFrame([(0, i, w, t) for i, (w, t) in enumerate(words)], "seq int, pos bigint, word string, type_id bigint")
    found = decode.segments(df, "seq")
    assert [(r["kind"], r["text"], r["separated"], r["n_tokens"]) for r in found.orderBy("segment").collect()] == [(0, "a b", 0, 2), (1, "c d e", 1, 3), (0, "g", 0, 1), (1, "h", 0, 1), (2, "", 0, 2)]
    report = decode.report(found, "seq").first()["report"]
    assert report.startswith("PROMPT: a b\nCOMPLETION: c d e\n") and report.endswith("PADDING TOKENS: 2")


def test_metadata_rules(spark):
    good = dict(max_seq_length=8, token_type_ids=True, number_of_training_files=4, vocab_size=10, tokenizer_model_type="m", number_of_dev_files=1, max_batch_size_train=3, max_batch_size_dev=2)
    context = dict(max_seq_length=8, use_token_type_ids=True, number_of_workers=4, vocab_size=10, model_type="m", eval=True, batch_size=3)
    validate.check_context(context)
    for k in context:
        with pytest.raises(TypeError):
            validate.check_context(context | {k: None})

    def broken(meta: dict, run: dict) -> set[str]:
        m = spark.createDataFrame([("d", *(good | meta).values())], "dataset string, max_seq_length int, token_type_ids boolean, number_of_training_files int, vocab_size int, tokenizer_model_type string, number_of_dev_files int, max_batch_size_train int, max_batch_size_dev int")
        r = spark.createDataFrame([("c", *(context | run).values())], "context string, max_seq_length int, use_token_type_ids boolean, number_of_workers int, vocab_size int, model_type string, eval boolean, batch_size int")
        return {x["field"] for x in validate.violations(m, r).collect()}

    assert broken({}, {}) == set()
    assert broken({}, {"model_type": "n", "vocab_size": 9}) == {"vocab_size", "tokenizer_model_type"}
    assert broken({"token_type_ids": False, "number_of_training_files": 3}, {"max_seq_length": 9, "batch_size": 4}) == {"max_seq_length", "token_type_ids", "number_of_training_files", "max_batch_size_train"}
    assert broken({"number_of_dev_files": 0, "max_batch_size_dev": None}, {}) == {"number_of_dev_files", "max_batch_size_dev"}
    assert broken({"number_of_dev_files": 0, "max_batch_size_dev": None}, {"eval": False}) == set()


def test_audit_and_counts(spark):
    assert metrics.utilization_audit(100, 10, 90)["state"] == "complete"
    assert metrics.utilization_audit(10000, 0, 9995)["state"] == "nearly complete"
    assert metrics.utilization_audit(100, 0, 90)["state"] == "incomplete"
    df = spark.createDataFrame([("a", "x"), ("a", " "), ("b", "y"), ("b", None)], "shard string, value string")
    assert metrics.article_count(df).first()[0] == 2
    assert metrics.estimated_article_count(df, "shard").first()[0] == 4


def test_derived_metrics_without_rows(spark):
    row = metrics.derived_metrics(spark.createDataFrame([("train", *[0] * len(metrics.COUNTERS))], "dataset_type string, " + ", ".join(f"{c} bigint" for c in metrics.COUNTERS))).first()
    assert row["data_utilization_percent"] is None


def test_tokenizers(spark):
    df = spark.createDataFrame([(1, "It's 12 été!"), (2, ""), (3, "it it")], "id int, text string")
    ids = {r["id"]: r["t"] for r in df.select("id", WordHashTokenizer().encode(F.col("text")).alias("t")).collect()}
    assert [len(ids[i]) for i in (1, 2, 3)] == [6, 0, 2] and ids[3][0] == ids[3][1] and all(0 <= t < 1 << 28 for t in ids[1])
    known = build_vocabulary(df)
    assert [r["word"] for r in known.orderBy("token_id").collect()] == sorted(["It", "'", "s", "12", "été", "!", "it"], key=lambda w: w.encode())
    rows = encode_with_vocabulary(spark.createDataFrame([(1, "it zzz")], "id int, text string"), known, "id").orderBy("pos").collect()
    assert rows[0]["token_id"] >= 4 and rows[1]["token_id"] == 3


def test_json_tokenizer(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no vocabulary files here")
    from tokenizers import Tokenizer

    df = spark.createDataFrame([("Hello  wörld",)], "text string")
    assert df.select(JsonTokenizer(path, 1).encode(F.col("text"))).first()[0] == Tokenizer.from_file(path).encode("Hello  wörld", add_special_tokens=False).ids


def test_arguments_from_training():
    args = dataset.arguments_from_training(10**9, dataset.TrainingArguments(batch_size=2, workers=5, evaluate=True), {"n_positions": 64, "model_type": "m"}, WordHashTokenizer())
    assert args["train"] == 35 and args["shuffle"] == "on_RAM" and args["options"].max_seq_length == 64 and args["dev_ratio"] == 0.1
    with pytest.raises(ValueError):
        dataset.arguments_from_training(10**9, dataset.TrainingArguments(2, 5), {"n_positions": 64, "vocab_size": 5}, WordHashTokenizer())


def test_command_line(spark, tmp_path, jsonl):
    out = str(tmp_path / "cli")
    assert main(["pipeline", "--input_file_path", jsonl, "--output_path", out, "--max_seq_length", "16", "--num_training_splits", "3", "--dev_ratio", "0.25", "--shuffle", "on_RAM", "--silent"]) == 0
    assert main(["check", "--input_path", out]) == 0
    assert main(["describe", "--input_path", f"{out}/packed"]) == 0
    assert main(["decode", "--input_path", f"{out}/packed", "--output_path", str(tmp_path / "text")]) == 0
    assert spark.read.text(str(tmp_path / "text")).where("value LIKE 'SEQUENCE train%'").count() == spark.read.parquet(f"{out}/packed").where("dataset_type = 'train'").count()
    assert main(["balance", "--input_path", f"{out}/packed", "--output_path", str(tmp_path / "balanced")]) == 0
    chats = write(tmp_path / "chats.jsonl", [[{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], [{"role": "user", "content": "c"}]])
    assert main(["convert_chat", "--input_path", chats, "--output_path", str(tmp_path / "pairs")]) == 0
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "pairs")).collect()) == ["[]", '[{"prompt":"a","completion":"b"}]']
    assert main(["data_prep", "--input_path", jsonl, "--output_path", str(tmp_path / "one"), "--input_packing_config", "greedy::drop", "--max_seq_length", "16", "--chat_template", '{"user_open": "<u> ", "assistant_open": " <a> "}', "--silent"]) == 0


def test_streaming_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "1.jsonl", [pair(i) for i in range(10)] + ["broken"])
    out = str(tmp_path / "out")
    options = PrepOptions(max_seq_length=8)
    for _ in range(2):
        ingest.pack_stream(ingest.stream_lines(spark, str(folder)), out, str(tmp_path / "ck"), SpaceTokenizer(WORDS), options).awaitTermination()
    first = spark.read.parquet(out).count()
    assert first == -(-10 * 6 // 8)
    assert [r["value"] for r in spark.read.text(f"{out}_rejects").collect()] == ["broken"]
    write(folder / "2.jsonl", [pair(i) for i in range(4)])
    ingest.pack_stream(ingest.stream_lines(spark, str(folder)), out, str(tmp_path / "ck"), SpaceTokenizer(WORDS), options).awaitTermination()
    assert spark.read.parquet(out).count() == first + 3


def test_hdf5_sink(spark, tmp_path):
    h5py = pytest.importorskip("h5py")
    rows = [("train", 1, 0, [1, 2], [1, 1]), ("train", 1, 1, [3, 4], [1, 2])]
    df = spark.createDataFrame(rows, "dataset_type string, shard_no int, seq bigint, input_ids array<int>, token_type_ids array<int>")
    (row,) = outputs.write_hdf5(df, str(tmp_path)).collect()
    with h5py.File(row["file"]) as f:
        assert f["input_ids"][:].tolist() == [[1, 2], [3, 4]]


def test_datasets_without_sequences(spark, tmp_path):
    path = write(tmp_path / "in.jsonl", [pair(i) for i in range(10)])
    out = str(tmp_path / "out")
    found = dataset.run_pipeline(spark, path, out, WordHashTokenizer(), PrepOptions(max_seq_length=2, packing=PackingConfig.parse("single::drop")), train=2, dev=0, test=0)
    assert found["train_sequences"] == 0 and found["train_tokens_dropped_from_packing"] == found["train_input_tokens"] > 0
    assert outputs.read_packed(spark, f"{out}/packed").collect() == []


def test_tokenizer_folders_and_special_tokens(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from corpusmill.functions.tokenizers import parse_special_tokens

    made = Tokenizer(models.WordLevel({"[UNK]": 0, "a": 1, "b": 2, "</s>": 3}, unk_token="[UNK]"))
    made.pre_tokenizer = pre_tokenizers.Whitespace()
    folder = tmp_path / "tok"
    folder.mkdir()
    made.save(str(folder / "tokenizer.json"))
    (folder / "special_tokens_map.json").write_text('{"eos_token": {"content": "</s>"}}')
    assert parse_special_tokens("{'pad_token': '<pad>'}") == {"pad_token": "<pad>"}
    found = JsonTokenizer(str(folder), None, special_tokens={"pad_token": "<pad>"})
    assert (found.eos_id, found.pad_id, found.bos_id, found.vocab_size) == (3, 4, None, 5)
    outputs.write_tokenizer(spark, str(tmp_path / "saved"), found)
    again = JsonTokenizer(str(tmp_path / "saved"), None)
    assert (again.eos_id, again.pad_id, again.vocab_size) == (3, 4, 5)
    df = spark.createDataFrame([("a b <pad> c",)], "text string")
    assert df.select(again.encode(F.col("text"))).first()[0] == [1, 2, 4, 0]
    with pytest.raises(ValueError):
        JsonTokenizer(str(folder / "tokenizer.json"), None)


def test_inputs_and_large_files(spark, tmp_path, monkeypatch):
    with pytest.raises(FileNotFoundError):
        outputs.require_input(spark, str(tmp_path / "none"))
    data = tmp_path / "data"
    data.mkdir()
    for name, size in (("small", 10), ("large", 5000)):
        (data / name).write_bytes(bytes(range(256)) * size)
    want = {r["name"]: r["sha256"] for r in outputs.manifest(spark, str(data)).collect()}
    monkeypatch.setattr(outputs, "HASHED_WHOLE", 3000)
    assert {r["name"]: r["sha256"] for r in outputs.manifest(spark, str(data)).collect()} == want and len(want) == 2


def test_run_log_names_arguments_and_limits():
    from corpusmill.__main__ import parser, run_log

    args = parser().parse_args(["pipeline", "--input_path", "in.jsonl", "--output_path", "out", "--keep_empty_completions"])
    lines = run_log(args, {"number_of_training_files": 4, "max_batch_size_train": 7})
    assert any("argument input_path in.jsonl" in x for x in lines) and any("at most 4 workers" in x and "at most 7" in x for x in lines)
    assert any(x.startswith("pyspark ") for x in lines)


def test_a_shard_of_many_files_keeps_its_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(outputs, "FILE_BYTES", 8 * 4 * 10)
    rows = spark.range(95).select(F.lit("train").alias("dataset_type"), F.lit(1).alias("shard_no"), F.col("id").alias("seq"), F.array_repeat(F.col("id").cast("int"), 4).alias("input_ids"), F.array_repeat(F.lit(1), 4).alias("token_type_ids"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        outputs.write_packed(rows, str(tmp_path / "packed"), 4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = outputs.read_packed(spark, str(tmp_path / "packed"))
    assert sorted(r["seq"] for r in got.collect()) == list(range(95)) and got.select("_metadata.file_path").distinct().count() > 1


def test_large_files_are_hashed_without_bringing_them_to_python(spark, tmp_path, monkeypatch):
    import hashlib

    client, seen = spark._jvm._gateway_client, []
    monkeypatch.setattr(client, "send_command", lambda *a, send=client.send_command, **k: (seen.append(send(*a, **k)), seen[-1])[1])
    for n in (0, 1, 8191, 3_000_001):
        (tmp_path / f"f{n}").write_bytes(bytes(range(251)) * (n // 251) + b"x" * (n % 251))
        assert outputs.stream_sha256(spark, str(tmp_path / f"f{n}")) == hashlib.sha256((tmp_path / f"f{n}").read_bytes()).hexdigest()
    assert seen and sum(len(str(x)) for x in seen) < 100_000
