"""Session factory: adaptive execution, UTC, ANSI arithmetic."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "corvane", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings every operator of this library expects.

    `shuffle_partitions` is a floor for small inputs; adaptive execution merges what is too
    small, so on a cluster it should be set to two or three times the number of cores.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder; on a cluster there is none to fall back on.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if held.isDefined():
            return held.get()
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="corvane-checkpoint-")
    if not held.isDefined():
        context.setCheckpointDir(folder)
    return folder
