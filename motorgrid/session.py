"""Session set-up and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR = "spark.checkpoint.dir"
_SHIPPED: set[str] = set()

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # No call-site capture for every column expression: plans here are long.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def build_session(app: str = "motorgrid", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the engine's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def shuffle_partitions(shuffle_bytes: int, target_bytes: int = 256 * 2**20) -> int:
    """Partition count for the largest shuffle of a job, at least 200.

    Give it as ``spark__sql__adaptive__coalescePartitions__initialPartitionNum``: AQE merges small
    partitions but never makes more than it started with.
    """
    return max(200, -(-shuffle_bytes // target_bytes))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, so tasks find it wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    # The driver serves the archive to the executors; the copy here is only its source.
    archive = Path(tempfile.mkdtemp(prefix=f"{root.name}-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def set_shared_dir(spark: SparkSession, path: str) -> None:
    """Name the shared folder where no cluster setting does."""
    spark.conf.set(SHARED_DIR, path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session's settings."""
    configured = spark.conf.get(SHARED_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        raise RuntimeError(f"set {SHARED_DIR} to a folder that every executor can reach")
    return configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, as a URI."""
    folder = shared_dir(spark).rstrip("/")
    if folder.startswith("/"):
        folder = f"file://{folder}"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, its size known, no lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so lost executors do not replay the loop."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
