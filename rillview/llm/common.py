"""Helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillview.functions.folders import remove, scratch

#: Bytes of text that a Python worker holds at once (a single longer text is held alone).
CHUNK_BYTES = 4 << 20


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes the rows once to the shared folder and reads them back, so that a lost executor costs no recomputation. What discard() does not delete goes when the application ends."""
    spark = df.sparkSession
    path = scratch(spark, "rillview")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rillview_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    if df is not None and (path := getattr(df, "_rillview_path", None)):
        remove(df.sparkSession, path)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(batches: Iterator[pa.RecordBatch], text: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds at most `most` bytes in its column number `text`, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held + n > most and i > start:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
