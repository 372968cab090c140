"""Splits and bounded samples of labelled documents, shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FOLDS = 5


def fold(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(FOLDS))


def held_out(doc_id: str = "doc_id") -> Column:
    """Fold 0 is never learned from, and neither is a row without id."""
    return F.coalesce(fold(doc_id) == 0, F.lit(True))


#: so many labels at most are learned, the most frequent ones
LABELS = 256


def sample(rows: DataFrame, label: str, per_class: int, salt: str, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """About ``per_class`` rows of each label, chosen by a hash of ``by``: all rows where there are fewer.

    Sampling rates come from one count per label. Rows that are equal in ``by`` are drawn together, so a label gives no more
    than twice ``per_class`` rows, those of least hash; each task drops what is over that before anything is shuffled.
    """
    counts = rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), label).limit(LABELS).collect()
    draw = F.pmod(F.xxhash64(*by, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(0.0)
    for r in counts:
        rate = F.when(F.col(label) == r[label], F.lit(min(1.0, per_class / r["n"]))).otherwise(rate)
    nth = F.row_number().over(W.partitionBy(label).orderBy(draw, *by))
    return rows.filter(draw < rate).withColumn("__nth", nth).filter(F.col("__nth") <= 2 * per_class).drop("__nth")
