"""Writing datasets: packed tables, raw splits, rejects, metadata, manifests."""

from __future__ import annotations

import hashlib
import json
import uuid
from concurrent.futures import ThreadPoolExecutor

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _path(spark, path)
    return fs.exists(jpath)


def prepare_output(spark: SparkSession, path: str, overwrite: bool) -> None:
    """Make the output folder; an old one is an error, or with overwrite is emptied but for names with cache."""
    fs, jpath = _path(spark, path)
    if fs.exists(jpath):
        if not overwrite:
            raise FileExistsError(f"{path} exists; use overwrite to replace it")
        for status in fs.listStatus(jpath):
            if "cache" not in status.getPath().getName():
                fs.delete(status.getPath(), True)
    if not fs.mkdirs(jpath):
        raise PermissionError(f"{path} can't be made")
    probe = spark._jvm.org.apache.hadoop.fs.Path(jpath, f".probe-{uuid.uuid4().hex}")
    fs.create(probe, True).close()  # fails where the folder isn't writable
    fs.delete(probe, False)


def require_input(spark: SparkSession, path: str) -> None:
    """FileNotFoundError if there is no such input; an unreadable one fails here, before anything is written."""
    fs, jpath = _path(spark, path)
    if not fs.exists(jpath):
        raise FileNotFoundError(f"{path} does not exist")
    if fs.getFileStatus(jpath).isFile():
        fs.open(jpath).close()
    else:
        fs.listStatus(jpath)


def write_tokenizer(spark: SparkSession, folder: str, tokenizer) -> None:
    """The files of a tokenizer that has some, so that the dataset can be decoded without the place it came from."""
    for name, text in getattr(tokenizer, "files", dict)().items():
        write_text(spark, f"{folder}/{name}", text)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, jpath = _path(spark, path)
    stream = fs.create(jpath, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, jpath = _path(spark, path)
    stream = fs.open(jpath)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


#: Size of packed files before compression.
FILE_BYTES = 128 << 20


def write_packed(matrix: DataFrame, path: str, length: int) -> None:
    """matrix(dataset_type, shard_no, seq, input_ids, token_type_ids[, category_ids]) as Parquet, one folder per shard, with files of about FILE_BYTES, each by one task. A row of other length fails the job."""
    wrong = F.raise_error(F.concat(F.lit("sequence of length "), F.size("input_ids").cast("string"))).cast("array<int>")
    checked = matrix.withColumn("input_ids", F.when(F.size("input_ids") == length, F.col("input_ids")).otherwise(wrong))
    part = F.expr(f"seq div {max(1, FILE_BYTES // (8 * length))}")
    by_shard = checked.repartition("dataset_type", "shard_no", part).sortWithinPartitions("dataset_type", "shard_no", "seq")
    by_shard.write.option("compression", "zstd").partitionBy("dataset_type", "shard_no").parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """What write_packed() wrote; a dataset without sequences gives no rows."""
    fs, jpath = _path(spark, path)
    if not any(s.isDirectory() for s in fs.listStatus(jpath)):
        return spark.createDataFrame([], "seq bigint, input_ids array<int>, token_type_ids array<int>, dataset_type string, shard_no int")
    return spark.read.parquet(path)


def write_hdf5(matrix: DataFrame, folder: str, chunk_bytes: int = 1 << 20) -> DataFrame:
    """(dataset_type, shard_no, file, sequences): one HDF5 file per shard, with the int32 matrices of the columns.

    For consumers that need such files; wants h5py on the executors and a folder that they share. Rows stream
    through in order, sorted by shard and place.
    """
    names = [c for c in ("input_ids", "token_type_ids", "category_ids") if c in matrix.columns]

    def dump(batches):
        import h5py
        import numpy as np
        import pyarrow as pa

        target, key, count = None, None, 0

        def done():
            target.close()
            return pa.RecordBatch.from_pydict({"dataset_type": [key[0]], "shard_no": [key[1]], "file": [f"{folder}/{key[0]}_{key[1]}.hdf5"], "sequences": [count]})

        for batch in batches:
            for row in batch.to_pylist():
                if key != (row["dataset_type"], row["shard_no"]):
                    if target is not None:
                        yield done()
                    key, count = (row["dataset_type"], row["shard_no"]), 0
                    target = h5py.File(f"{folder}/{key[0]}_{key[1]}.hdf5", "w")
                    width = len(row["input_ids"])
                    for n in names:
                        target.create_dataset(n, (0, width), "i4", maxshape=(None, width), chunks=(max(1, chunk_bytes // (4 * width)), width), compression="gzip")
                for n in names:
                    target[n].resize(count + 1, axis=0)
                    target[n][count] = np.array(row[n], "i4")
                count += 1
        if target is not None:
            yield done()

    ordered = matrix.select("dataset_type", "shard_no", "seq", *names).repartition("dataset_type", "shard_no").sortWithinPartitions("dataset_type", "shard_no", "seq")
    return ordered.mapInArrow(dump, "dataset_type string, shard_no int, file string, sequences bigint")


def write_raw_splits(labelled: DataFrame, path: str) -> None:
    """The lines of labelled(split_name, value, line_no) as text, one folder per split; its files follow each other in the order of their names."""
    labelled.repartitionByRange("split_name", "line_no").sortWithinPartitions("split_name", "line_no").select("split_name", "value").write.partitionBy("split_name").text(path)


def write_rejects(bad: DataFrame, path: str) -> None:
    bad.select("value").write.text(path)


def write_metadata(spark: SparkSession, path: str, metadata: dict) -> None:
    write_text(spark, path, yaml.safe_dump(metadata, sort_keys=True))


def read_metadata(spark: SparkSession, path: str) -> dict:
    return yaml.safe_load(read_text(spark, path))


def write_categories(spark: SparkSession, path: str, categories: DataFrame) -> None:
    """The small category dictionary as JSON."""
    write_text(spark, path, json.dumps({r["category"]: r["category_id"] for r in categories.orderBy("category_id").collect()}))


#: Largest file that is hashed in one piece.
HASHED_WHOLE = 256 << 20


def stream_sha256(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file of any size, streamed inside the driver's JVM: no byte of it comes to Python, and a small buffer is all it takes."""
    fs, jpath = _path(spark, path)
    found = spark._jvm.java.security.MessageDigest.getInstance("SHA-256")
    stream = spark._jvm.java.security.DigestInputStream(fs.open(jpath), found)
    try:
        stream.transferTo(spark._jvm.java.io.OutputStream.nullOutputStream())
    finally:
        stream.close()
    return bytes(found.digest()).hex()


#: Large files that the driver hashes at a time.
HASHED_AT_ONCE = 8


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(name, sha256, size, modified_time) of every file below a folder but those of the manifest itself and logs.

    Files of HASHED_WHOLE bytes and less are hashed by Spark, each in a task's memory. Larger ones are streamed
    through the driver's JVM, HASHED_AT_ONCE together: a task has no file system of Hadoop's at hand in Python.
    """
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    large = [r["path"] for r in every.where(F.col("length") > HASHED_WHOLE).select("path").collect()]
    with ThreadPoolExecutor(HASHED_AT_ONCE) as pool:
        hashes = list(pool.map(lambda p: stream_sha256(spark, p), large))
    known = F.create_map(*[F.lit(x) for pair in zip(large, hashes) for x in pair]) if large else None
    files = every.where(F.col("length") <= HASHED_WHOLE).withColumn("sha256", F.sha2("content", 256)).drop("content")
    if known is not None:
        files = files.unionByName(every.where(F.col("length") > HASHED_WHOLE).drop("content").withColumn("sha256", F.element_at(known, F.col("path"))))
    root = _path(spark, folder)[1].makeQualified(_path(spark, folder)[0].getUri(), _path(spark, folder)[0].getWorkingDirectory()).toString()
    name = F.expr(f"substring(path, {len(root) + 2})")
    rows = files.select(F.regexp_replace(name, "/", "_").alias("name"), "sha256", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified_time"))
    return rows.where("not startswith(name, 'sha256_') and not contains(name, 'logs')")


def write_manifest(spark: SparkSession, folder: str) -> None:
    """Replace folder/sha256 by a fresh manifest."""
    fs, jpath = _path(spark, f"{folder}/sha256")
    fs.delete(jpath, True)
    manifest(spark, folder).coalesce(1).write.json(f"{folder}/sha256")


def manifest_violations(spark: SparkSession, folder: str) -> DataFrame:
    """(name, problem): files that the manifest lacks or whose hash differs; hashes count only where size or time differ. Deleted files go unnoticed.

    Where the file system keeps checksums of its own, as Hadoop does for local files, reading a file changed behind its back fails instead.
    """
    known = spark.read.schema("name string, sha256 string, size bigint, modified_time bigint").json(f"{folder}/sha256").select("name", F.col("sha256").alias("old__"), F.col("size").alias("size__"), F.col("modified_time").alias("time__"))
    now = manifest(spark, folder).join(known, "name", "left")
    touched = (F.col("size") != F.col("size__")) | (F.col("modified_time") != F.col("time__"))
    problem = F.when(F.col("old__").isNull(), "not in the manifest").when(touched & (F.col("sha256") != F.col("old__")), "hash differs")
    return now.select("name", problem.alias("problem")).where("problem is not null")


def manifest_is_valid(spark: SparkSession, folder: str) -> bool:
    return not manifest_violations(spark, folder).limit(1).count()


def text_sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
