"""Session helpers: table access and staging in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: str | None = None
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application, so that Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quillmill-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = f"{folder}/quillmill.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder of this machine is made, and removed when Python ends; that is for tests and one
    machine only, so with executors elsewhere it is an error.
    """
    global _LOCAL_DIR
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master or ""
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _LOCAL_DIR is None:
        _LOCAL_DIR = tempfile.mkdtemp(prefix="quillmill-")
        atexit.register(shutil.rmtree, _LOCAL_DIR, ignore_errors=True)
    return f"file://{_LOCAL_DIR}"


def stage(df: DataFrame, tag: str, compression: str = "snappy", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, as it is or in a part for each value of its last column.

    Cuts the lineage: a later stage reads the files, whichever executor was
    lost meanwhile. The files go when the application ends. The shuffle files that led
    to them are of no more use and go at once.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/quillmill-{tag}-{uuid.uuid4().hex}"
    settings = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.maxConcurrentOutputFileWriters": "16",  # no sort for the parts
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path, partitionBy=partition_by, compression=compression)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._quillmill_path = path
    return staged


def unstage(df: DataFrame) -> None:
    """Remove a staged table that nothing will read again."""
    path = getattr(df, "_quillmill_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
