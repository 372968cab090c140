"""Keys for tables whose ids may be null or repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["__doc", "__text"]


def keyed(docs: DataFrame) -> DataFrame:
    """Id and text with a key that is never null: rows of one key are equal and so have equal results."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumns({
        "__doc": F.xxhash64("doc_id", F.col("doc_id").isNull()),
        "__text": F.xxhash64("text"),
    })
