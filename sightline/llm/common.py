"""Shared folder, scratch tables and small text helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.sources.scratch import shared_dir

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"

_scope: ContextVar[str] = ContextVar("scratch_scope", default="query")


@contextlib.contextmanager
def scratch_scope(name: str) -> Iterator[None]:
    """Scratch tables made inside go to the scope's own folder, so that ``release`` can drop them together."""
    token = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(token)


def _scope_path(spark: SparkSession, scope: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{scope}"


def release(spark: SparkSession, scope: str) -> None:
    """Drop a scope's scratch tables. Call it only when every frame built on them has been written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scope_path(spark, scope))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of rows that go to a Python worker at once, where the session doesn't say otherwise: rows may be very long.
BATCH_BYTES = 16 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session end at ``BATCH_BYTES``, besides Spark's limit of rows; a smaller setting stays."""
    now = spark.conf.get(_BATCH_SETTING).rstrip("b")
    if now.isdigit() and int(now) > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors, keeps columns prunable."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{_scope_path(spark, _scope.get())}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z alone, as ``bytes.lower`` does in Python."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def as_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts, limit: int) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of texts of about ``limit`` bytes; a longer text is a run of its own."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(size):
        upto = limit + (size[start - 1] if start else 0)
        end = max(start + 1, int(np.searchsorted(size, upto, "right")))
        yield start, end - start
        start = end


#: For queries' SQL: a table ``crc_table`` with the 256 remainders of CRC-32 as the list ``t``.
CRC_TABLE_SQL = """crc_table AS (
  SELECT list(r ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS r FROM range(256) AS x(i)))"""


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a string's UTF-8 bytes, where ``crc_table`` is joined."""
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(1, length({digits}), 2), lambda i: ('0x' || substring({digits}, i, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
