"""The folder that the driver and all executors share, and tables written there.

A written table cuts lineage: when an executor is lost later, its partitions
are read again instead of being computed from the start.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session (tests) gets a temporary folder; on a
    cluster that would be a folder of one machine, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quernstone.shared.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="quernstone-")
    spark.conf.set("quernstone.shared.dir", made)
    return made


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quernstone-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in this application's part of the shared folder."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on any file system that Spark opens."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Delete all that this application's operators have written; results that are still to be read are lost."""
    delete(spark, _own_dir(spark))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed Parquet table in the shared folder, reread."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quernstone_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table that ``written`` made; nothing may read it later."""
    delete(df.sparkSession, df._quernstone_path)


def open_folder(uri: str):
    """A file system and the path in it, as a Python worker sees a folder of the shared one."""
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def lean_worker() -> None:
    """Have this Python worker give large freed arrays back to the system at once."""
    import ctypes

    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 256 << 10)  # M_MMAP_THRESHOLD: fixed, it would grow with use
        libc.malloc_trim(0)


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors' Python workers, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_quernstone_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    made = Path(tempfile.mkdtemp(prefix="quernstone-")) / "quernstone.zip"
    with zipfile.ZipFile(made, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(made))
    sc._quernstone_shipped = True
