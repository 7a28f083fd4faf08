"""Session settings and the reliability helpers the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "assayflow", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; on a cluster the master comes from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, one beside the warehouse tables, on any master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return root.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder; a folder set on the context before stays."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages re-read files, so a lost executor costs nothing twice."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)
