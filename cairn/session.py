"""Session set-up and the few runtime facts that operators ask the session for."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType


def local_session(cpus: int = 8, name: str = "cairn") -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CAIRN_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset and driver
    and executors are one process (tests) a local folder is made.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not own.isDefined():
        if not path and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = path or tempfile.mkdtemp(prefix="cairn-shared-")
        spark.sparkContext.setCheckpointDir(path)
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return path or own.get()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder for what an operator writes on the way. All of an
    application's such paths lie in one folder, which goes when the application ends."""
    top = f"{shared_dir(spark)}/cairn-{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(top)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{top}/{label}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage through the shared folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


#: Rows and bytes up to which a side may be broadcast after having been measured.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def _width(kind: DataType, value: Column) -> Column:
    """About how many bytes a value takes in a row."""
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        each = F.aggregate(value, F.lit(0).cast("bigint"), lambda a, x: a + _width(kind.elementType, x).cast("bigint"))
        return F.coalesce(each, F.lit(0)) + 16
    if isinstance(kind, StructType):
        return sum((_width(f.dataType, value[f.name]) for f in kind.fields), F.lit(16))
    return F.lit(8)


def small_or_shuffled(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is measured to be within both bounds, else as it is.

    Meant for narrow rows. The measure stops at the bound. Beyond it the join is left to
    the shuffle joins of the planner.
    """
    width = sum((_width(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(8)).cast("bigint")
    n, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and size <= max_bytes else df
