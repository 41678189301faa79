"""Session configuration and durable stage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings every job relies on. Partition counts are left to the
#: cluster; adaptive execution coalesces or splits them from real sizes.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(
    app: str = "chartweave", master: str | None = None, shuffle_partitions: int | None = None
) -> SparkSession:
    """Create (or reuse) a session with the engine's settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    return builder.getOrCreate()


#: Folders of local sessions that name none, by application id.
_OWN_FOLDERS: dict[str, str] = {}


def durable_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, with a part for this application.

    Only a local session may fall back to a folder of its own; on a cluster an
    unset folder is an error, since executors could not read each other's files.
    """
    app = spark.sparkContext.applicationId
    folder = spark.conf.get("spark.checkpoint.dir", None) or _OWN_FOLDERS.get(app)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{folder.rstrip('/')}/chartweave/{app}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written.

    Cuts lineage so that a lost executor costs one stage, lets several consumers
    share one computation, and gives later size checks a real byte count.
    """
    spark = df.sparkSession
    path = f"{durable_folder(spark)}/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialise` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.rsplit("/", 2)[-2] == df.sparkSession.sparkContext.applicationId:
            _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete every materialised table of this application; call it when its results are written."""
    _delete(spark, durable_folder(spark))
