"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings that the results or the plans rely on.  All are runtime SQL settings, so
# they can also be put on a session somebody else has started.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A batch for Python is held in the JVM and the worker at once; rows may be whole documents.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, so that they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        name = Path(tempfile.mkdtemp(prefix="importflow-"), root.name)
        sc.addPyFile(shutil.make_archive(str(name), "zip", root.parent, root.name))
        _shipped.add(sc.applicationId)


def apply_settings(spark: SparkSession) -> SparkSession:
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def local_session(cores: str = "8", partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("importflow")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**SQL_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def workspace(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is only ever chosen for a local session, where the one
    machine is the whole cluster.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="importflow-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{workspace(spark)}/importflow-{name}-{uuid.uuid4().hex}"


def freeze(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from there."""
    workspace(df.sparkSession)
    return df.checkpoint(eager=True)


def pin(df: DataFrame) -> DataFrame:
    """``df`` with its partitions planned now, so that every use cuts the files alike.

    No rows are kept: a scan reads its splits anew each time, and so does a task that was lost.
    """
    session, frame = df.sparkSession, df._jdf
    return DataFrame(session._jsparkSession.createDataFrame(frame.javaRDD(), frame.schema()), session)


def store(df: DataFrame, name: str) -> DataFrame:
    """The same for large data whose partitions do not matter: a Parquet table."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
