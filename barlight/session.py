"""Session helpers shared by tests, the benchmark and interactive use."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("barlight")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BARLIGHT_DRIVER_MEMORY", "8g"))
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for cut points and hand-over tables, as the session names it in spark.checkpoint.dir.

    A session on one machine that names none gets a temporary folder, which goes when the process ends; on a cluster that is an error,
    since executors could not read what the driver's machine holds.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="barlight-checkpoint-")
            atexit.register(shutil.rmtree, folder, True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def run_folder(spark: SparkSession) -> str:
    """Where this application keeps its hand-over tables."""
    return f"{checkpoint_folder(spark)}/barlight-{spark.sparkContext.applicationId}"


def end_run(spark: SparkSession) -> None:
    """Delete this application's hand-over tables and forget the plans that read them."""
    from barlight.plans import inputs

    inputs.forget()
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


COMPILED_METHOD_BYTES = 8000
"""The JVM never compiles a larger method; a step whose rows are so wide that whole-stage code would need one is quicker operator by operator."""


@contextmanager
def compiled_steps(spark: SparkSession):
    """Run what is written inside without generated methods that the JVM would only interpret; the session's own setting comes back afterwards."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), COMPILED_METHOD_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def durable(df: DataFrame) -> DataFrame:
    """Hand *df* over as a written table in the checkpoint folder.

    Lineage ends here, every later reader sees the same rows, columns are still pruned on read, and the planner knows
    the true size. A lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    with compiled_steps(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
