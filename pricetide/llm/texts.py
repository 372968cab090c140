"""Texts compressed in Python tasks, for the joins that have to move them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm import arrays


def packed(docs: DataFrame) -> DataFrame:
    """``doc_id, blob``: each row's text compressed; null is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in arrays.slices(batches, "text"):
            blobs = [compress((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(blobs, pa.binary())], ["doc_id", "blob"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, blob binary")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of rows and their texts; a null blob has none."""
    for batch in arrays.slices(batches, "blob", arrays.SLICE_BYTES // 4):
        decompress = zstandard.ZstdDecompressor().decompress
        yield batch, [None if b is None else decompress(b) for b in batch.column("blob").to_pylist()]
