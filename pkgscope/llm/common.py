"""Small helpers the operators share.

Every operator first selects the columns it reads under private names, so
other columns of its input may have any name and type and are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD_SPACES = b" \t\n\v\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, as ``new=old``."""
    return df.select(*[df[old].alias(new) for new, old in columns.items()])


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` of a function from one batch to batches.  Spark bounds a
    batch by rows and by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``),
    so a worker holds one batch of texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's strings in UTF-8, without decoding them; null counts as empty."""
    col = batch.column(name)
    binary = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [t or b"" for t in col.cast(binary).to_pylist()]


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def spans_text(spans: Iterable[tuple[str, int, int]]) -> str:
    """``kind:start:end`` joined by commas, in the order given."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def same_rows(df: DataFrame, schema_like: DataFrame) -> DataFrame:
    """``df`` with exactly the columns of ``schema_like``, in its order."""
    return df.select(*[F.col(f"`{c}`") for c in schema_like.columns])
