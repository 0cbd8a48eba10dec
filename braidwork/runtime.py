"""Session helpers that every part of the engine may use."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()
_made: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors once per application.

    Python workers on other machines then import the same code, whatever their
    own PYTHONPATH is. The archive holds source files only.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(_ROOT.rglob("*.py")):
            z.write(path, path.relative_to(_ROOT.parent))
    folder = tempfile.mkdtemp(prefix="braidwork-")
    archive = os.path.join(folder, "braidwork_src.zip")
    Path(archive).write_bytes(buffer.getvalue())
    context.addPyFile(archive)  # served by the driver; executors fetch it
    _shipped.add(context.applicationId)


#: Rows that one Arrow batch carries; texts may be long, so it is far below Spark's default.
BATCH_ROWS = 1024


def prepare(spark: SparkSession) -> None:
    """Ship the code and keep Arrow batches small, unless the session says otherwise."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where it is unset (a local session, as in tests) a temporary folder of
    this machine is made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="braidwork-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def partitions(*inputs: DataFrame, each: int = 4 << 20) -> int:
    """A number of partitions that grows with the files read, one for `each` of their bytes; an unknown size counts as nothing."""
    n = 0
    for df in inputs:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
        n += sum(size for size in sizes if size < 1 << 60)
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-n // each))


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, in a folder of this application that goes when the driver ends."""
    context = spark.sparkContext
    folder = f"{shared_folder(spark)}/braidwork/{context.applicationId}"
    if folder not in _made:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(context._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _made.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
