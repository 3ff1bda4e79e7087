"""Line-oriented inputs: files and directories of .jsonl or .txt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.config import NO_CATEGORY
from corpusmill.functions.indexing import with_row_index

KINDS = ("jsonl", "txt")


def input_kind(spark: SparkSession, path: str) -> str:
    """jsonl or txt: by a file's extension; of a directory jsonl if it holds any such file, else txt. ValueError for anything else."""
    for kind in KINDS:
        if path.endswith(f".{kind}"):
            return kind
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(jpath) and fs.getFileStatus(jpath).isDirectory():
        names = [s.getPath().getName() for s in fs.listStatus(jpath) if s.getLen()]
        for kind in KINDS:
            if any(n.endswith(f".{kind}") for n in names):
                return kind
    raise ValueError(f"{path} is neither a .jsonl or .txt file nor a directory with some")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value, file): the lines of a file or of all files of a directory, in the order of file names.

    Bytes that aren't UTF-8 become replacement characters.
    """
    kind = input_kind(spark, path)
    reader = spark.read if path.endswith(f".{kind}") else spark.read.option("pathGlobFilter", f"*.{kind}")
    raw = reader.text(path).select(F.make_valid_utf8("value").alias("value"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block__"), F.monotonically_increasing_id().alias("id__"))
    return with_row_index(raw, "file", "block__", "id__").select("line_no", "value", "file")


def _wrapped(value: Column) -> Column:
    """A JSON array of objects as text, from a line that holds an array or one object; null for other lines."""
    text = F.trim(F.regexp_replace(value, r"^\s+|\s+$", ""))
    valid = F.try_parse_json(text).isNotNull()
    return F.when(valid & text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).when(valid & text.startswith("["), text)


def parse_lines(lines: DataFrame, completion_keyword: str = "completion") -> DataFrame:
    """lines with items, the array of their objects as maps of strings; null for malformed lines.

    Malformed are lines that aren't JSON, that hold anything but objects, and those where an object has no completion.
    """
    items = F.from_json(_wrapped(F.col("value")), "array<map<string,string>>")
    found = lines.withColumn("items__", items)
    good = F.forall("items__", lambda m: F.coalesce(F.element_at(m, completion_keyword).isNotNull(), F.lit(False)))
    return found.withColumn("items", F.when(good, F.col("items__"))).drop("items__")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where("items is not null")


def rejects(parsed: DataFrame) -> DataFrame:
    """The malformed lines as they stood."""
    return parsed.where("items is null").select(*[c for c in parsed.columns if c != "items"])


def require_wellformed(parsed: DataFrame) -> DataFrame:
    """The accepted lines; a malformed one fails the query that reads it, with the line in the message."""
    message = F.concat(F.lit("malformed line: "), F.col("value"))
    return parsed.withColumn("items", F.when(F.col("items").isNull(), F.raise_error(message).cast("array<map<string,string>>")).otherwise(F.col("items")))


def pairs_of(good: DataFrame, prompt_keyword: str = "prompt", completion_keyword: str = "completion", category_keyword: str = "category", keep: tuple[str, ...] = ()) -> DataFrame:
    """(line_no, pair_no, n_pairs, prompt, completion, category) of parsed lines; an absent prompt is empty."""
    rows = good.select("line_no", *keep, F.size("items").cast("bigint").alias("n_pairs"), F.posexplode("items").alias("pair_no", "m"))
    get = lambda k: F.element_at("m", k)
    return rows.select("line_no", *keep, F.col("pair_no").cast("bigint").alias("pair_no"), "n_pairs", F.coalesce(get(prompt_keyword), F.lit("")).alias("prompt"), get(completion_keyword).alias("completion"), get(category_keyword).alias("category"))


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """(category, category_id) of a JSON list of names; of names that occur twice the last place counts."""
    if not path.endswith(".json"):
        raise ValueError("categories have to be a .json file with a list of names")
    text = spark.read.option("wholetext", True).text(path)
    return category_ids(text.select(F.from_json("value", "array<string>").alias("names")))


def category_ids(lists: DataFrame) -> DataFrame:
    return lists.select(F.posexplode("names").alias("pos", "category")).groupBy("category").agg(F.max("pos").cast("int").alias("category_id"))


def with_no_category(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("category_id", F.lit(NO_CATEGORY))
