"""Session settings and shared folders."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Broadcasts made by this library are allowed up to this many bytes of data.
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024

# Batches that go to Python workers: a task holds a few of them, there and in the executor.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 * 1024 * 1024


def build_session(app: str = "threadloom", cores: str = "*", **conf: str) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.driver.memory", conf.pop("driver_memory", "12g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on, and the size of the batches that Python workers hold. Naive dates
    mean UTC everywhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster. Only a local session may go without one and gets a
    folder of its own; elsewhere executors would each write to their own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, one per use."""
    return f"{shared_dir(spark).rstrip('/')}/threadloom/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, shortens the plan."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write a table to the shared folder, or to ``name`` if that is a path, and read it back with the same schema."""
    path = name if "/" in name else scratch_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured_bytes(df: DataFrame) -> int:
    """Size of all rows, measured as JSON text, which is no smaller than what is sent."""
    row = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    return df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> bool:
    """True when the rows of ``df`` are small enough to be sent to every task."""
    return measured_bytes(df) <= limit


def sent(df: DataFrame) -> DataFrame:
    """``df`` marked for a broadcast, if it is small enough."""
    return F.broadcast(df) if fits_broadcast(df) else df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per session, unless they run in this machine's
    folder anyway. Workers then import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_threadloom_shipped", False):
        return
    context._threadloom_shipped = True
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="threadloom-ship-")  # the driver's own; Spark copies it
    archive = os.path.join(folder, "threadloom_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for where, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(where, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
