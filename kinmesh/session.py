"""Session factory, table access and durable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "kinmesh", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's ``spark.checkpoint.dir``, else one of our own.

    Our own folder is machine-local, so it is only set in local mode; on a cluster without the setting this raises.
    """
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(shared)
        return shared
    if sc.getCheckpointDir() is None:
        if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kinmesh-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, which survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path for an intermediate table beside the checkpoints."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/kinmesh-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str = "stage", **options: str | int) -> DataFrame:
    """Writes a stage as a Parquet table in the shared folder, with these options of the writer, and reads it back: columns stay prunable, lineage ends."""
    path = shared_path(df.sparkSession, what)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_stages(spark: SparkSession) -> int:
    """Deletes the stored stages beside the checkpoints and says how many there were. Only for the end of a job: results that were not written yet read them."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("kinmesh-")] if files.exists(folder) else []
    for path in found:
        files.delete(path, True)
    return len(found)
