"""Session settings and the shared scratch area."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest table, measured in memory, that the library sends to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(cpus: int | str = "*", app: str = "seqloom", partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SEQLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by all executors, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="seqloom-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once and read it back: the lineage ends at files that outlive executors,
    and later plans see the real size of the table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def file_bytes(df: DataFrame) -> int:
    """Size of a table as the optimizer knows it: the bytes of its files. It starts no job, and
    as files are compressed it says how large a table is at least."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a table of scalars and arrays of numbers takes at most ``limit`` bytes in memory.

    Files above the limit answer at once; else rows, string bytes and array elements are counted.
    """
    if file_bytes(df) > limit:
        return False
    text = [F.octet_length(c.name) for c in df.schema.fields if isinstance(c.dataType, T.StringType)]
    arrays = [F.size(c.name) * 8 for c in df.schema.fields if isinstance(c.dataType, T.ArrayType)]
    sizes = [F.coalesce(F.sum(size), F.lit(0)) for size in text + arrays]
    row = df.agg(F.count(F.lit(1)), *sizes).first()
    return row[0] * (32 + 16 * len(df.columns)) + sum(row[1:]) <= limit


def spread_small(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over all cores when a table is too small to fill them by itself.

    Generators multiply rows, so a table of a few file splits would leave most cores idle. A
    table with a split for every core is left as it is, which bounds what this shuffles.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    split = 16 * 1024 * 1024
    return df.repartition(cores, *keys) if file_bytes(df) < cores * split else df
