"""Shared helpers: the cluster's shared folder, materialised tables, Arrow streaming, byte-level words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.shared import materialize, new_dir, shared_dir  # noqa: F401

#: ASCII upper case to lower case, every other byte unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, and every ASCII byte that is neither letter nor digit becomes a space.
WORDS = bytes(
    b + 32 if 65 <= b <= 90 else (b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256)
)

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty); other columns never travel."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fold(id_col: str, k: int):
    """crc32 of the id as text, modulo k; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % k


def partitions_for(total: float, each: float, least: int = 1) -> int:
    return max(least, math.ceil(total / each))


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 128, chars: int = 1_000_000) -> Iterator[list[tuple]]:
    """Rows of Arrow batches in lists of bounded length and text, so that Python objects stay few."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows)
            n = part.num_rows
            while n > 1 and part.slice(0, n).nbytes > chars:
                n = max(1, n // 2)
            cols = [c.to_pylist() for c in part.slice(0, n).columns]
            yield list(zip(*cols))
            at += n


def rows_to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def filesystem(uri: str):
    """pyarrow file system and path of a URI of the shared folder (file:, hdfs:, s3: ...; a bare path is local)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else "file://" + uri)
