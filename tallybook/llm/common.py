"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 4
HELD_OUT_FOLD = 2


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column) -> Column:
    """True for the fold that no model learns from: crc32 of the id as text, modulo 4, is 2. A null id
    counts as the empty text (crc32 0), so it is never held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    key = F.coalesce(column.cast("string"), F.lit(""))
    return F.crc32(F.encode(key, "UTF-8")) % FOLDS == HELD_OUT_FOLD


def text_slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut small enough that a slice of ordinary texts takes a few MB as Python objects."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")
