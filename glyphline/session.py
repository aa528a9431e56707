"""Session helpers shared by the bench, the tests and the driver entry point."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cpus: int | str = "*", app: str = "glyphline") -> SparkSession:
    """A local session with the settings the results rely on (UTC, AQE, Arrow)."""
    parts = str(cpus) if str(cpus).isdigit() else "8"
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint(df):
    """Cut lineage through a table written to the folder the cluster names.

    A written table also gives the optimizer true sizes, where estimates carried along a
    long chain of joins multiply without end. The folder is read from
    ``spark.checkpoint.dir``. Only a local-mode session with none set gets a scratch
    folder; a cluster without one is an error, because a machine-local folder would not
    survive the loss of an executor.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release(*tables) -> None:
    """Remove tables written by ``checkpoint``, or what is selected from them, that nothing will read again.

    Only for tables superseded by later ones that have been written already: a lost task of a plan still to run
    would look for them. What was not written by ``checkpoint`` is left alone.
    """
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path is not None:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for jobs that run Python there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "glyphline.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("glyphline", os.path.relpath(path, root)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)
