"""Session defaults and the shared scratch area."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# UTC keeps date arithmetic stable; AQE coalesces small shuffles and splits skewed ones.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


# Where a local session without spark.checkpoint.dir remembers its scratch folder.
LOCAL_SCRATCH = "spark.drawlake.scratch"


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """Session for tests and the benchmark on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("drawlake")
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "12g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """New folder name below the shared folder that ``spark.checkpoint.dir`` names.

    On a cluster the setting is required, because executors cannot share a
    machine-local folder; only a local master may fall back to one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(LOCAL_SCRATCH, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="drawlake-")
        # Nobody else knows this folder: it goes with the process.
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set(LOCAL_SCRATCH, root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(frame: DataFrame, label: str) -> DataFrame:
    """A small step that several plans read: written below the shared folder once and read again."""
    path = scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def prepare(spark: SparkSession, root: str | None = None) -> None:
    """Session settings the operators rely on, and the package for remote workers.

    ``root`` is the folder that holds the package. Executors of a cluster get
    it as an archive, because their Arrow tasks import it.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if root is None or spark.conf.get("spark.drawlake.shipped", None):
        return
    archive = shutil.make_archive(
        f"{tempfile.mkdtemp(prefix='drawlake-')}/drawlake", "zip", root_dir=root, base_dir="drawlake"
    )
    spark.sparkContext.addPyFile(archive)
    spark.conf.set("spark.drawlake.shipped", "true")
