"""Session settings and the lineage-cutting helpers every plan shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = 8, app: str = "marginalia", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("MARGINALIA_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that setting is absent (a local session, as in tests) is a temporary folder
    used, because then driver and executors are one machine.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = getattr(checkpoint_dir, "_own", None)
        if not d:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            d = checkpoint_dir._own = tempfile.mkdtemp(prefix="marginalia-")
            atexit.register(shutil.rmtree, d, ignore_errors=True)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(d)
    return d


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared checkpoint folder and read it back.

    Cuts the lineage, keeps exact statistics for the planner and survives the loss of
    executors; each consumer then prunes columns of the stored table instead of
    recomputing the plan.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stage-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> int:
    """Removes the tables this application staged, once nothing reads them any more; returns their number. An own
    folder of a local session goes with the process."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/stage-{spark.sparkContext.applicationId}-*")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(bool(fs.delete(f.getPath(), True)) for f in fs.globStatus(path) or [])
