"""Session building and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

R = TypeVar("R")


def build_session(name: str = "cohortloom", master: str | None = None, **conf: str) -> SparkSession:
    """ANSI mode, UTC and adaptive execution on; everything else is left to the cluster."""
    b = (
        SparkSession.builder.appName(name)
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Where that is unset, a folder inside the session's warehouse. A warehouse on a local disk is not
    shared unless the whole session runs on one machine, so a cluster without the setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.split(":")[0] in ("file", warehouse) and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse.rstrip('/')}/cohortloom-work"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for intermediate files in the shared folder."""
    return f"{shared_dir(spark)}/cohortloom/{name}-{uuid.uuid4().hex}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Workers need not start in the repository or have it on their path.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


#: Bytes of rows that a byte of a Parquet file may hold: staged tables repeat grids, names and keys, and a
#: column that is an array counts as one value in Spark's estimate.
ROWS_PER_FILE_BYTE = "40"


def size_files(spark: SparkSession) -> None:
    """Let Spark take files for larger than they are, so that only tables that are small as rows are broadcast unseen.

    A broadcast is built on the driver from rows. Joins of other tables begin as shuffles, and adaptive
    execution still broadcasts a side whose measured size is below the session's threshold. A factor that the
    session has set is kept.
    """
    key = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(key, "1.0")) == 1.0:
        spark.conf.set(key, ROWS_PER_FILE_BYTE)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to a new table in the shared folder and read it back.

    The result survives executor loss, is computed once, and the plan behind it is gone.
    """
    spark = df.sparkSession
    path = scratch(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, tasks: int | None) -> DataFrame:
    """Deal rows out to `tasks` tasks, for work that is heavy per row; None leaves them where they lie."""
    return df.repartition(tasks) if tasks else df


def together(spark: SparkSession, builds: list[Callable[[], R]], at_once: int = 8) -> list[R]:
    """Results of independent builds in their order, the jobs of up to `at_once` of them submitted side by side.

    Builds that are many short jobs leave most of a cluster idle when each waits for the one before. The
    threads only submit; rows stay in tasks, and no more tasks run than there are cores.
    """
    if len(builds) < 2:
        return [b() for b in builds]
    with ThreadPoolExecutor(min(len(builds), at_once)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(b)) for b in builds]
        return [r.result() for r in running]
