"""Settings that operators read from the running session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: str = "8", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").config(map=SETTINGS)
    spark = (
        builder.config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Folders of local sessions that have no spark.checkpoint.dir, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only a local session may fall back to a folder of its own; on a cluster an unset folder is an error,
    since a machine-local one is lost together with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = spark.sparkContext.applicationId
    if own not in _LOCAL:
        _LOCAL[own] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[own]


def own_dir(spark: SparkSession) -> str:
    """This application's folder within the shared one; what is written there is removed when the application ends."""
    return f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}"


def _own_files(spark: SparkSession):
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def kept_until_end(spark: SparkSession) -> None:
    """Has this application's folder, which must exist, removed when the application ends."""
    path, files = _own_files(spark)
    files.deleteOnExit(path)


def clear_staged(spark: SparkSession) -> None:
    """Removes what this application has staged so far: for long sessions, once the results built on it are written."""
    path, files = _own_files(spark)
    files.delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: what follows neither recomputes it nor loses it."""
    path = f"{own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept_until_end(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)
