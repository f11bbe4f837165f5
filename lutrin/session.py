"""Session for tests and benchmarks, and the places Spark needs to write to."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, partitions: int | None = None, memory: str = "12g") -> SparkSession:
    """A local session for tests and bench.py. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lutrin")
        .config("spark.driver.memory", os.environ.get("LUTRIN_DRIVER_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package's sources to the executors, once for each application, and returns ``spark``.

    Functions that run in Python workers are found by name there, wherever the driver was started. The archive is served by
    the driver like any added file; no executor reads the driver's folder.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="lutrin-"), f"{package.name}-sources.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        sc.addPyFile(archive)
        _shipped.add(sc.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables: spark.checkpoint.dir of the session, which a cluster shares.

    Only a local session may go without; it gets a temporary folder. On a cluster that would be lost, so it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lutrin-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """The name of a new folder below the shared one, for a table or text that is written and read again."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(table: DataFrame) -> DataFrame:
    """A stored table, over all cores: one whose files give fewer partitions than there are cores is dealt out, rows and results stay
    the same. A large table has more partitions than that and is read as it is, without a shuffle."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table._jdf.queryExecution().toRdd().getNumPartitions() < cores else table
