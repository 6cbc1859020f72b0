"""Tables written between stages, and the size check before a broadcast."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a fresh one where that is unset.

    The fallback is a machine-local folder, so it is only allowed when the master is local.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="spanloom-")
    spark.sparkContext.setCheckpointDir(folder)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage with files that outlive any executor. The table is removed by ``discard``, or when the driver ends. While it is written, Arrow batches have at most
    2,000 rows, which keeps Python's share of an executor's memory small where rows hold long texts.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_BATCH, None)
    if before is None or not 0 < int(before) <= 2000:
        spark.conf.set(_BATCH, "2000")
    try:
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_BATCH)
        else:
            spark.conf.set(_BATCH, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._spanloom_path = path
    return table


def scratch(spark: SparkSession, name: str) -> str:
    """A place of its own in the shared folder, removed when the driver ends; for tables and checkpoints that are written some other way."""
    path = f"{shared_dir(spark)}/spanloom-{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` gave and nothing reads any more."""
    for table in tables:
        for entry in [x for x in _written if x[1] == table._spanloom_path]:
            _written.remove(entry)
            _remove(*entry)


def drop_old_shuffles(spark: SparkSession) -> None:
    """Let executors drop the shuffle files of finished steps: they go once the driver has collected what referred to them, which it is asked to do here."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already
        pass


def _remove_all() -> None:
    for spark, path in _written:
        _remove(spark, path)


atexit.register(_remove_all)


def broadcast_if_small(df: DataFrame, max_rows: int, max_bytes: int = 64 << 20) -> DataFrame:
    """Hint a broadcast only after checking that ``df`` has at most ``max_rows`` rows of at most ``max_bytes`` together.

    The check stops one row past the bound and measures rows as JSON. Beyond it ``df`` itself comes back and the join stays a shuffle join.
    """
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))
    n, size = df.limit(max_rows + 1).agg(F.count("*"), size).first()
    return F.broadcast(df) if n <= max_rows and size <= max_bytes else df


def spread(df: DataFrame) -> DataFrame:
    """The rows over more partitions if the scan has fewer than there are cores, as with a single small file; else ``df`` itself, without a shuffle."""
    cores, has = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(min(cores, 8 * max(1, has))) if has < cores else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
