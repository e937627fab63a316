"""Session helpers: a tuned local session, and the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from kelpline.sources.fs import open_fs

_LOCAL_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_MADE: list[str] = []


def local_session(cpus: int | str = 8, app: str = "kelpline", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset and the master is local, a temporary folder is made, removed at exit. On a
    cluster a machine-local folder would not be seen by other executors, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="kelpline-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _LOCAL_DIRS[app] = f"file://{path}"
    return _LOCAL_DIRS[app]


def job_dir(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder, for what is needed as long as this process runs."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(clean_up)
    _MADE.append(path)
    return path


def clean_up() -> int:
    """Delete all paths that ``job_dir`` gave out in this process; done at its exit. A long session calls it when no result
    that was made so far will be read again."""
    gone = 0
    while _MADE:
        fs, path = open_fs(_MADE.pop())
        if fs.get_file_info(path).type.name == "Directory":
            fs.delete_dir(path)
            gone += 1
    return gone


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage is cut, and a lost
    executor costs nothing that is already written."""
    spark = df.sparkSession
    path = job_dir(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a session; Spark serves the archive from the driver."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="kelpline-", suffix=".zip")
    os.close(handle)
    atexit.register(lambda: Path(path).unlink(missing_ok=True))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
