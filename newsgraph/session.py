"""Session settings, and the shared folder used to cut lineage and land files."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "newsgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # the JIT skips methods above 8000 bytes of code; wide parsing projections
        # run faster as separate generated projections than as one such method
        "spark.sql.codegen.hugeMethodLimit": "8000",
        # files of checkpoints go when their data are no longer referenced
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


#: Rows and bytes of one batch between Spark and a Python worker, where the session sets none: whole
#: texts travel in them, so the usual 10,000 rows may take hundreds of megabytes on both sides.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
           "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def ship_package(spark: SparkSession) -> None:
    """Make Spark send this package to its Python workers, once per application, and bound their batches.

    Workers then need neither an installed copy nor the driver's working directory.
    """
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    context = spark.sparkContext
    if getattr(context, "_newsgraph_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "newsgraph-package"), "zip",
                                  os.path.dirname(here), os.path.basename(here))
    context.addPyFile(archive)
    context._newsgraph_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    A local session without the setting uses a folder below the warehouse. A cluster
    session without it is refused: a folder on one machine would lose checkpoints
    together with that machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for files one job writes and reads back."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and return it with a one-step plan."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
