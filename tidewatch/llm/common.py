"""Helpers shared by the operators of this subpackage: reading, scratch tables, and byte-level
access to text columns inside Arrow batches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import discard, discard_at_exit, ensure_checkpoint_dir

#: Words are runs of ``[^\x20\x09-\x0D]``: what bytes.split() gives.
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: A null id takes part in orderings as the largest id.
NULL_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_table(df: DataFrame, tag: str, replaces: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back: cuts the
    lineage with files that every executor sees. They go when the application ends; those of the
    path in ``replaces`` go at once, and it is set to this table's path."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    discard_at_exit(spark, path)
    if replaces is not None:
        for old in replaces:
            discard(spark, old)
        replaces[:] = [path]
    return spark.read.schema(df.schema).parquet(path)


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def utf8_rows(col: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each row of a string column, None for null, one at a time."""
    if not len(col):
        return
    width = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], dtype=width)[col.offset:col.offset + len(col) + 1].tolist()
    data = memoryview(col.buffers()[2]) if col.buffers()[2] is not None else memoryview(b"")
    valid = col.is_valid().to_pylist()
    for i, ok in enumerate(valid):
        yield bytes(data[offsets[i]:offsets[i + 1]]) if ok else None


def word_runs(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in order, as lists from about ``size`` bytes each, so that a very long
    text never stands in memory as one list of words."""
    at, end = 0, len(data)
    while at < end:
        stop = at + size
        if stop < end:
            found = _SPACE.search(data, stop)
            stop = found.start() if found else end
        else:
            stop = end
        yield data[at:stop].split()
        at = stop
