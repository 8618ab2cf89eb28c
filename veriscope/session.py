"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str, master: str | None = None, **settings) -> SparkSession:
    """Session with the library's settings; `master` only for local runs."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per session, so that executors need no copy of it.

    The driver's own files go as one zip through Spark's file server. A package that already runs from a zip
    (`--py-files`) is left as it is.
    """
    sc = spark.sparkContext
    package = Path(__file__).parent
    if getattr(sc, "_veriscope_shipped", False) or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="veriscope-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, Path(package.name) / file.relative_to(package))
    sc.addPyFile(str(archive))
    sc._veriscope_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: `spark.checkpoint.dir` of the session.

    Only a local session may fall back to a folder of this machine; a cluster
    without the setting is an error, because its executors could not read it.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="veriscope-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """The rows of `df` as a table in the shared folder, computed once.

    Cuts the lineage like a checkpoint, and later steps read only the columns
    they need. Survives the loss of executors.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
