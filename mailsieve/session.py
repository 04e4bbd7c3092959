"""Session settings for tests, the benchmark and small machines; a cluster brings its own."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def local_session(cpus: int = 8, memory: str = "12g", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", partitions).config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", True).config("spark.ui.enabled", False).config("spark.ui.showConsoleProgress", False).config("spark.sql.execution.arrow.pyspark.enabled", True).getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python workers, once for an application, whether or not they could import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="package")).resolve()  # read by the driver's file server for as long as it lives
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(folder / "mailsieve.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(folder / "mailsieve.zip"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, names: list[str] = TABLES) -> None:
    """The tables as temporary views, for SQL text; made once for a session and folder."""
    if getattr(spark, "_mailsieve_views", None) == sf_dir:
        return
    spark._mailsieve_views = sf_dir
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the session's spark.checkpoint.dir; on one machine, where that may be unset, under a temporary one, which goes with the process."""
    return f"{shared_top(spark)}/{name}-{uuid.uuid4().hex}"


_local_top: list[str] = []


def shared_top(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Without it only a local master gets a folder of this machine; on a cluster its workers couldn't share it."""
    if top := spark.conf.get("spark.checkpoint.dir", None):
        return top
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_top:
        _local_top.append(tempfile.mkdtemp(prefix="shared"))
        atexit.register(shutil.rmtree, _local_top[0], True)
    return _local_top[0]
