"""Lines that arrive as files, parsed, tokenized and packed as they come.

An extension of the batch pipeline: every micro-batch is one split that is packed on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.config import PrepOptions
from corpusmill.functions.indexing import with_row_index
from corpusmill.functions.tokenizers import Tokenizer, padding_id
from corpusmill.operators import packing
from corpusmill.operators.articles import articles_from_pairs
from corpusmill.sources import lines as src


def stream_lines(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    return spark.readStream.option("pathGlobFilter", pattern).text(folder)


def pack_stream(lines: DataFrame, output_path: str, checkpoint: str, tokenizer: Tokenizer, options: PrepOptions) -> StreamingQuery:
    """Append the packed sequences of each micro-batch to output_path/batch=N, and its malformed lines to output_path_rejects.

    A batch that is run again after a failure replaces its own folder, so results are written exactly once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        parsed = src.parse_lines(with_row_index(rows, "value"), options.completion_keyword)
        pairs = src.with_no_category(src.pairs_of(src.accepted(parsed), options.prompt_keyword, options.completion_keyword))
        articles = articles_from_pairs(pairs, tokenizer, options).withColumn("split_idx", F.lit(number).cast("bigint"))
        packed = packing.pack(articles, options.packing, options.max_seq_length, padding_id(tokenizer))
        kept = packed if options.keep_prompt_only_sequences else packing.without_prompt_only(packed)
        packing.to_matrix(kept).write.mode("overwrite").parquet(f"{output_path}/batch={number}")
        src.rejects(parsed).select("value").write.mode("overwrite").text(f"{output_path}_rejects/batch={number}")

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
