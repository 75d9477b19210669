"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.tables import BROADCAST_ROWS, alone, delete, dropped, fresh, made, mark, reused, scratch, shared_dir, small, written  # noqa: F401  (for the operators)

#: White space that separates words: space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that a Python worker gets at a time; a batch ends with the row that reaches it.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what Python workers and their executor hold of texts at a time, unless the session's bound is lower.

    The session's own limit is 64 MB, which each worker then holds several times over. The bound
    stays set for the session, as plans are lazy: it is read when a query runs, after this returns.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    text = str(spark.conf.get(key)).lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(text[-1:], 0)
    now = int(text.rstrip("kmg") or 0) << unit
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def text_bytes(column: str = "text") -> Column:
    """The UTF-8 bytes of a text; Python then decodes nothing that it does not need."""
    return text_or_empty(column).cast("binary")


def word_count(column: str = "text") -> Column:
    """Number of words of a text; null and empty texts have none."""
    return F.regexp_count(text_or_empty(column), F.lit(WORD_PATTERN)).cast("long")


def tasks(spark: SparkSession) -> int:
    """Number of partitions for work whose cost does not show in its bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
