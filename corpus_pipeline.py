"""From raw documents to packed training windows, in five stages.

``STAGES`` lists them in order. Each takes the documents that the one before kept and returns documents with the same
columns, the last one packed pieces. Decisions about groups and overlaps name a row by a 64-bit hash of its id and whole
text, so rows without id are examined like all others, and different texts under one id are decided on their own. Of a
group the document of least id stays, a row without id only if none has one. Rows of one id and with equal words are one
document, whether there is an id or not; rows without words are like nothing and all stay.

Texts are read whole, whatever their length. Ties of a group go to the row with the least hash. Empty tables give no rows, empty
labels reject nothing, an empty benchmark leaves all documents; further columns, of any names that do not begin with two
underscores, pass through.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm import decontaminate, minhash, packing, pii, toxicity
from pricetide.llm.queries import TOKENIZER, read
from pricetide.sources.lineage import cut


#: near copies share five-word shingles with similarity 0.8 or more; so many bands miss a pair of exactly 0.8 with a chance under 1e-6
NEAR_LEAST, NEAR_BANDS = 80, 36


ROW = "__row"


def _named(docs: DataFrame) -> DataFrame:
    """All columns, and a key of id and text that is never null; without an id it is a key of the text."""
    return docs.withColumn(ROW, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))


def _examined(docs: DataFrame) -> DataFrame:
    """What the operators read, the key in place of the id."""
    return docs.select(F.col(ROW).alias("doc_id"), "text")


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows whose key is not among the rejected."""
    return docs.join(rejected.select(ROW).distinct(), ROW, "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.scored(docs, read(spark, sf_dir, "labels"))
    return scored.filter(F.col("__toxicity") < 0.5).drop("__toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = _named(docs)
    keys = cut(named.groupBy(ROW).agg(F.first(F.col("doc_id").cast("long")).alias("id"), F.count("*").alias("copies")))
    once, repeated = named, keys.filter("copies > 1")
    if not repeated.isEmpty():  # equal rows are examined once
        firsts = cut(named.join(repeated, ROW, "left_semi").dropDuplicates([ROW]))
        once = _without(named, repeated).unionByName(firsts)
    groups = cut(minhash.near_duplicates(_examined(once), NEAR_LEAST, NEAR_BANDS).withColumnRenamed("doc_id", ROW).join(keys, ROW))
    kept = groups.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", ROW))[ROW].alias(ROW))
    rejected = _without(groups, kept).select(ROW)
    copies = groups.filter("copies > 1 and n_shingles > 0").select(ROW)
    out = _without(named, rejected.union(copies))
    if not repeated.isEmpty():
        out = out.unionByName(_without(firsts.join(copies, ROW, "left_semi"), rejected))
    return out.select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = _named(docs)
    found = decontaminate.overlaps(_examined(named), read(spark, sf_dir, "benchmark")).withColumnRenamed("doc_id", ROW)
    return _without(named, found).select(docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", replace_personal_data),
    ("packing", pack_windows),
]

#: the toxicity model, surrogates and tokens cannot be stated in SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one's result written to the shared checkpoint folder before the next."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = cut(docs)
    return docs
