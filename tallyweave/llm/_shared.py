"""Small helpers that the corpus operators share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-llm-")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a temporary one where it is unset on one machine, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return (shared or _own_folder()).rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/llm-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Delete what ``stored`` wrote; nothing may read ``table`` any more."""
    folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0].rpartition("/")[0])
    folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that a task holds few texts as Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sample_by_hash(df: DataFrame, key: str, rows: int, total: int, slack: float = 2.0) -> DataFrame:
    """At most ``rows`` rows, those of smallest hash: the same ones in every run, from anywhere in the table.

    Of ``total`` rows only the share that gives ``slack`` times as many is ordered at all, so what meets in one task does not
    grow with the table.
    """
    h = F.xxhash64(key)
    below = F.pmod(h, F.lit(1 << 30)) < int(min(1.0, slack * rows / max(1, total)) * (1 << 30))
    return df.where(below).orderBy(F.pmod(h, F.lit(1 << 30)), h, F.col(key)).limit(rows)
