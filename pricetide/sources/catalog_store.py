"""Catalog tables on storage: typed reads, versioned publishing, JDBC import, reference dimensions, clearing."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide import schemas as K
from pricetide.fixed_values import SEED_CATEGORIES, SEED_RETAILERS

ENUM_COLUMNS = {"listings": ["status"], "offers": ["status"], "runs": ["status"], "decisions": ["decision"]}
ALLOWED = {"listings": K.PRODUCT_STATUSES, "offers": K.PRODUCT_STATUSES, "runs": K.RUN_STATUSES, "decisions": K.DECISIONS}
# Tables emptied by clear_catalog; retailers, categories and runs stay.
VERSIONS = "version long, history_from long"
#: files that one day of one version is split into at most
DAY_FILES = 4
CLEARED = ("products", "listings", "offers", "observations", "decisions")


def normalize_enums(name: str, df: DataFrame) -> DataFrame:
    """Stored member names, upper or lower case, become the lower-case values queries use."""
    return df.withColumns({c: K.stored_value(F.col(c)) for c in ENUM_COLUMNS.get(name, [])})


def bad_enum_rows(name: str, df: DataFrame) -> DataFrame:
    keep: Column = F.lit(False)
    for c in ENUM_COLUMNS.get(name, []):
        keep = keep | ~K.has_allowed_value(F.col(c), ALLOWED[name])
    return df.filter(keep)


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    return normalize_enums(name, spark.read.schema(K.TABLE_SCHEMAS[name]).parquet(path))


def typed(name: str, rows: DataFrame) -> DataFrame:
    """Rows of a relational table in the types of the catalog table: JSON text becomes a map, ids take the catalog's type,
    columns that the source lacks are null."""
    have = {n.lower(): n for n in rows.columns}

    def column(field: T.StructField) -> Column:
        if field.name not in have:
            return F.lit(None).cast(field.dataType)
        value = F.col(f"`{have[field.name]}`")
        if isinstance(field.dataType, T.MapType) and isinstance(rows.schema[have[field.name]].dataType, T.StringType):
            return F.from_json(value, field.dataType)
        return value.cast(field.dataType)

    return rows.select(*[column(f).alias(f.name) for f in K.TABLE_SCHEMAS[name]])


def read_jdbc(
    spark: SparkSession, name: str, *, url: str, dbtable: str, partition_column: str, lower: int, upper: int,
    partitions: int, properties: dict[str, str] | None = None,
) -> DataFrame:
    """A catalog table from a relational database, split over ``partition_column``, in the table's own types."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=dbtable, partitionColumn=partition_column, lowerBound=lower, upperBound=upper,
        numPartitions=partitions, **(properties or {}),
    )
    return normalize_enums(name, typed(name, reader.load()))


def publish(cat: K.Catalog, base: str, version: int, *, new_observations: DataFrame, restart_history: bool = False) -> None:
    """Write the next catalog version and make it current.

    State tables go to a folder of their own version. Observations are append-only: each version writes only
    ``new_observations``, split by day; a version that changes no history passes an empty frame. ``restart_history`` makes
    this version the first whose observations count: a first version, which writes them all, or a cleared catalog. The row
    added to the version log last is the commit; a rerun of a failed attempt overwrites the same folders.
    """
    spark = cat.products.sparkSession
    for name, df in cat.items():
        if name != "observations":
            df.write.mode("overwrite").parquet(f"{base}/{name}/version={version}")
    # one shuffle by day first, so that a version has a few files a day and not one for every task
    fresh = new_observations.select(*K.OBSERVATIONS.names).withColumn("day", F.to_date("observed_at"))
    fresh.repartition("day", F.pmod(F.xxhash64("id"), F.lit(DAY_FILES))).write.mode("overwrite").partitionBy("day").parquet(
        f"{base}/observations/version={version}")
    starts = version if restart_history else None
    spark.createDataFrame([(version, starts)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{base}/versions")


def publish_first(cat: K.Catalog, base: str, version: int = 1) -> None:
    """Write a catalog with its whole history as the version that history starts at."""
    publish(cat, base, version, new_observations=cat.observations, restart_history=True)


def publish_cleared(cat: K.Catalog, base: str, version: int) -> None:
    """Write a cleared catalog; observations of earlier versions no longer count."""
    cleared = clear_catalog(cat)
    publish(cleared, base, version, new_observations=cleared.observations, restart_history=True)


def current_version(spark: SparkSession, base: str) -> int | None:
    return spark.read.schema(VERSIONS).parquet(f"{base}/versions").agg(F.max("version")).first()[0]


def load(spark: SparkSession, base: str, version: int | None = None, *, observed_from: date | None = None) -> K.Catalog:
    """The catalog as of a version, by default the last committed one.

    ``observed_from`` leaves out observations of earlier days; their folders are not opened. Trends over a lookback window
    need no more than its days.
    """
    at = current_version(spark, base) if version is None else version
    tables = {
        name: read_table(spark, name, f"{base}/{name}/version={at}")
        for name in K.TABLE_SCHEMAS if name != "observations"
    }
    stored = T.StructType([*K.OBSERVATIONS.fields, T.StructField("version", T.LongType()), T.StructField("day", T.DateType())])
    observations = spark.read.schema(stored).parquet(f"{base}/observations")
    log = spark.read.schema(VERSIONS).parquet(f"{base}/versions").filter(F.col("version") <= at)
    starts = log.agg(F.max("history_from")).first()[0] or 0
    committed = observations.filter(F.col("version").between(starts, at) & F.col("version").isin(
        [r["version"] for r in log.filter(F.col("version") >= starts).select("version").distinct().collect()]))
    if observed_from is not None:
        committed = committed.filter(F.col("day") >= F.lit(observed_from))
    tables["observations"] = committed.select(*K.OBSERVATIONS.names)
    return K.Catalog(**tables)


def clear_catalog(cat: K.Catalog) -> K.Catalog:
    spark = cat.products.sparkSession
    return cat.with_tables(**{n: spark.createDataFrame([], K.TABLE_SCHEMAS[n]) for n in CLEARED})


def upsert_retailers(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """By name: a known retailer only gets the new logo; an unknown one is added with the id it brings."""
    fresh = incoming.select("name", F.lit(True).alias("_in"), F.struct("id", "url", "logo_url").alias("n"))
    return existing.join(fresh, "name", "full").select(
        F.coalesce("id", "n.id").alias("id"), "name", F.coalesce("url", "n.url").alias("url"),
        F.when(F.col("_in"), F.col("n.logo_url")).otherwise(F.col("logo_url")).alias("logo_url"),
    )


def upsert_categories(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    fresh = incoming.select("name", F.col("id").alias("_id"))
    return existing.join(fresh, "name", "full").select(F.coalesce("id", "_id").alias("id"), "name")


def seed_retailers(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(SEED_RETAILERS, 1)]
    return spark.createDataFrame(rows, K.RETAILERS)


def seed_categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SEED_CATEGORIES, 1)), K.CATEGORIES)
