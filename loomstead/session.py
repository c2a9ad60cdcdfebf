"""Session builder and the lineage cut shared by all iterative operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators are written for: ANSI, AQE, UTC."""
    builder = (
        SparkSession.builder.appName("loomstead")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Only a local master without that setting gets a temporary folder; a cluster without it is an error,
    as a machine's own disk would not survive the loss of that machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="loomstead-shared-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def _cuts(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/loomstead-{spark.sparkContext.applicationId}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it from there on.

    The written table survives the loss of executors, and its statistics are those of its files: after
    checkpoint() a plan keeps the size estimates of everything before it, which multiply from round to
    round of an iteration. The tables of an application lie in one folder until it ends or calls clear_cuts.
    """
    spark = df.sparkSession
    path = f"{_cuts(spark)}/cut-{uuid.uuid4().hex}"
    if _cuts(spark) not in _cleared_at_exit:
        _cleared_at_exit.add(_cuts(spark))
        atexit.register(_clear_quietly, spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_cleared_at_exit: set[str] = set()


def clear_cuts(spark: SparkSession) -> None:
    """Delete what cut_lineage wrote for this application; results that were not written elsewhere are lost with it."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_cuts(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def _clear_quietly(spark: SparkSession) -> None:
    try:
        clear_cuts(spark)
    except Exception:  # noqa: BLE001 - the session has ended already; its folder stays for the cluster's own cleaning
        pass
