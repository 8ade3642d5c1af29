"""Session factory and the checkpoint helper shared by iterative operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "mnemoframe", cpus: int | str | None = None, partitions: int = 8) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster the caller brings its own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", 8)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEM", "12g"))
        .getOrCreate()
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint in the folder the cluster names in spark.checkpoint.dir.

    Reliable checkpoints survive the loss of executors. Only a local session, as in tests, gets a folder of its own where
    the setting is absent; on a cluster a folder of one machine would be read by none of the others.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="mnemoframe-cp-"))
    return df.checkpoint(eager=True)
