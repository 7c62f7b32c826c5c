"""Shared helpers: stored intermediate tables, column clean-up, batch access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeromart.session import shared_scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` under the session's shared checkpoint folder and read it
    back: lineage is cut, and a lost executor re-reads files, not stages.
    ``codec`` is a Parquet compression other than the session's."""
    spark = df.sparkSession
    path = shared_scratch_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """As ``stored``, bucketed by ``column``: joins on it leave this side where
    it is."""
    path = shared_scratch_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.option("path", path).bucketBy(buckets, column).saveAsTable(table)
    return df.sparkSession.table(table)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_bucket(column: str, modulus: int):
    """crc32 of the id as text, mod ``modulus`` (null id: its own remainder 0)."""
    return F.pmod(F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0)), F.lit(modulus))


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about ``limit`` text bytes.

    Yields (first row, row after the last, bytes, offsets): the UTF-8 bytes
    of the run's texts end to end, and where each row's text starts and
    ends in them.  Null texts have no bytes.  A longer text makes a run of
    its own.
    """
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
