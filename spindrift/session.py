"""Sessions: sensible settings, the package itself on every executor, tables in the shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Put this package on the path of the session's Python workers, once an application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spindrift-py-"), "spindrift.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, dirs, files in os.walk(home):
            dirs[:] = sorted(d for d in dirs if d != "__pycache__")
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("spindrift", os.path.relpath(path, home)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with adaptive plans, UTC and Arrow; on a cluster the submitter sets these."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spindrift")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read: ``spark.checkpoint.dir`` of the session.

    Only on a local master, where driver and executors are one process, may that setting be absent: a temporary folder
    is made then, once an application. Elsewhere its absence is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIRS:
            _OWN_DIRS[app] = tempfile.mkdtemp(prefix="spindrift-")
        folder = _OWN_DIRS[app]
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/spindrift-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``materialize``, with the folder, for callers that ``discard`` it when nothing reads it any more."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts the lineage, survives the loss of executors, and makes what was computed stable for later passes.
    """
    return stored(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Delete every table that this application left in the shared folder."""
    discard(spark, f"{shared_dir(spark)}/spindrift-{spark.sparkContext.applicationId}")
