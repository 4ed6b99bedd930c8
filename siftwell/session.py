"""Session defaults and the two helpers every iterative operator needs."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, shuffle_partitions: int = 8, app: str = "siftwell") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session that is given."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    memory = os.environ.get("SIFTWELL_DRIVER_MEMORY", "8g")
    builder = builder.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for name, value in DEFAULTS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the context's, else spark.checkpoint.dir; else a temporary one, where the master is local and
    every task sees it. On a cluster without the setting there is no shared folder, which is an error."""
    sc = spark.sparkContext
    now = sc.getCheckpointDir()
    if now:
        return now
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="siftwell-checkpoint-")
        atexit.register(shutil.rmtree, wanted, ignore_errors=True)
    sc.setCheckpointDir(wanted)
    return wanted


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _file_system(spark, path)
    return system.exists(place)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder for tables of this application, removed when the application ends."""
    path = f"{checkpoint_dir(spark)}/siftwell-{uuid.uuid4().hex}"
    system, place = _file_system(spark, path)
    system.mkdirs(place)
    system.deleteOnExit(place)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder and go on from that copy."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_lineage_in_place(df: DataFrame) -> DataFrame:
    """The same, but plans go on knowing how df is partitioned and sorted. They only do where it was planned as it stands, so this
    one step is planned in a copy of the session in which adaptive planning is off."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    dataset, plain = spark._jvm.org.apache.spark.sql.classic.Dataset, spark._jsparkSession.cloneSession()
    plain.conf().set("spark.sql.adaptive.enabled", "false")
    cut = dataset.ofRows(plain, df._jdf.queryExecution().analyzed()).checkpoint(True)
    return DataFrame(dataset.ofRows(spark._jsparkSession, cut.logicalPlan()), spark)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application; they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    if root.parent.is_dir():  # else the package already comes from an archive
        folder = tempfile.mkdtemp(prefix="siftwell-ship-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = os.path.join(folder, "siftwell-package.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
