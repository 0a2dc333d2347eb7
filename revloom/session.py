"""The Spark session: one for tests and scripts, and what every query needs of a session that it is given."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ready: set[str] = set()


def local_session(cores: int | str = 8, name: str = "revloom", **conf: str) -> SparkSession:
    """A local session with UTC times, adaptive execution and a shuffle width that fits the cores."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Send this package to the executors and bound the Arrow batches, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _ready:
        _ready.add(app)
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="revloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(out := os.path.join(folder, "revloom_pkg.zip"), "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(Path(root.name) / p.relative_to(root)))
        spark.sparkContext.addPyFile(out)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors reach; one of our own only where it is unset and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="revloom-shared-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{made}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by Hadoop's file systems, wherever it is; one that isn't there is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run_folder(spark: SparkSession) -> str:
    """This application's own folder in the shared one, removed when the driver ends."""
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/revloom-{app}"
    if path not in _ready:
        _ready.add(path)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

        def clean() -> None:
            try:  # nothing is lost if the JVM has ended before
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(conf).delete(at, True)
            except Exception:
                return

        atexit.register(clean)
    return path
