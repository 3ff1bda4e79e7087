"""Compare registered queries with their SQL in DuckDB: python -m tests.oracle SF_DIR [NAME...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if pd.api.types.is_float_dtype(frame[c]):
            frame[c] = frame[c].round(9)
    return frame.sort_values(list(frame.columns), ignore_index=True, na_position="last")


def compare(spark, sf_dir: str, name: str) -> str | None:
    """What differs, or None."""
    import __spark_entry__ as entry

    got = normal(entry.queries()[name](spark, sf_dir).toPandas())
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    db.execute(entry.oracle_sql()[name])
    want = normal(db.fetch_df() if hasattr(db, "fetch_df") else db.df())
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} for {list(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows for {len(want)}"
    for c in got.columns:
        left, right = got[c], want[c]
        same = (left == right) | (left.isna() & right.isna())
        if not same.all():
            i = (~same).idxmax()
            return f"column {c}: {got.iloc[i].to_dict()} for {want.iloc[i].to_dict()}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for name in sys.argv[2:] or entry.oracle_sql():
        began = time.time()
        try:
            found = compare(spark, sys.argv[1], name)
        except Exception as e:  # noqa: BLE001
            found = str(e)[:600]
        print(f"{name:32s} {time.time() - began:6.1f} s  {'ok' if found is None else found}", flush=True)
