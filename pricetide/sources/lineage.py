"""Cut a plan's lineage through the cluster's shared checkpoint folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: rows of a stored frame that a join may carry whole through the driver
CARRIED_ROWS = 50_000

_open: list[list[DataFrame]] = []


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session has or names; there is no other, as a folder of one machine's own would be lost with it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the checkpoint folder; later readers, and lost executors, start from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if _open:
        _open[-1].append(out)
    return out


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once into compressed column files in the checkpoint folder.

    Where ``cut`` keeps whole uncompressed rows in their order, later readers here take only the columns they name, in any order.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if _open:
        _open[-1].append(out)
    return out


def grown(frame: DataFrame) -> DataFrame:
    """A stored frame for a join on its own key: dealt by the key where it has more rows than a join should carry whole.

    The size threshold goes by the files, and column files of ten megabytes can be a gigabyte of rows in the driver. The rows are
    counted from the files' footers.
    """
    return frame.hint("merge") if frame.count() > CARRIED_ROWS else frame


def _files(frame: DataFrame) -> str | None:
    if "_stored_at" in frame.__dict__:
        return frame._stored_at
    named = frame._jdf.queryExecution().logical().rdd().getCheckpointFile()
    return named.get() if named.isDefined() else None


def release(*frames: DataFrame) -> None:
    """Delete the files of frames that ``cut`` or ``stored`` returned, when nothing reads them any more."""
    for frame in frames:
        named = _files(frame)
        if named:
            path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(named)
            path.getFileSystem(frame.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def scratch() -> Iterator[None]:
    """What is cut inside is deleted at the end, but for what went through ``settled``."""
    _open.append([])
    try:
        yield
    finally:
        release(*_open.pop())


def settled(df: DataFrame, compute: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """``df`` computed into files that outlive the scope it is made in."""
    out = compute(df)
    if _open:
        _open[-1].pop()
        if len(_open) > 1:
            _open[-2].append(out)
    return out
