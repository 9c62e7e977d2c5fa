"""Tables and files that a running query keeps in the folder shared by driver and executors.

``spark.checkpoint.dir`` names that folder. It is read from the session; only a local session
without it (tests, notebooks) gets a temporary folder of its own. A cluster session without it is an
error: executors could not see each other's files in a machine-local folder.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder's URI, without a slash at its end."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="corpuswright-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


_made: list[str] = []
_tables: list[tuple[SparkSession, str]] = []


def hold_table(spark: SparkSession, name: str) -> None:
    """Remember a catalog table that a plan needs: it is dropped by ``release``, or at the end of the driver's Python."""
    if not _tables:
        atexit.register(_drop_tables, 0)
    _tables.append((spark, name))


def _drop_tables(since: int) -> None:
    for spark, name in _tables[since:]:
        with contextlib.suppress(Exception):  # the session may be gone
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    del _tables[since:]


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and path for a Hadoop URI: local files, HDFS, S3, Google Cloud Storage and Azure."""
    scheme, mark, rest = uri.partition("://")
    names = {"s3a": "s3", "s3n": "s3", "abfss": "abfss", "abfs": "abfs", "gs": "gs", "s3": "s3", "hdfs": "hdfs", "viewfs": "viewfs", "file": "file"}
    if mark and scheme not in names:
        raise ValueError(f"{scheme}:// is not among {sorted(names)}")
    return pafs.FileSystem.from_uri(f"{names[scheme]}://{rest}" if mark else uri)


def new_folder(spark: SparkSession, label: str) -> str:
    """URI of a folder that does not exist yet, under the shared folder."""
    path = f"{shared_root(spark)}/corpuswright/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the plan above starts anew.

    The written table survives the loss of executors, unlike cached blocks.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpuswright_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that no plan needs any more."""
    for df in tables:
        path = getattr(df, "_corpuswright_path", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system API."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def mark() -> tuple[int, int]:
    """A point in time for ``release``."""
    return len(_made), len(_tables)


def release(spark: SparkSession, since: tuple[int, int]) -> None:
    """Delete the folders and tables made since the mark; only when no plan needs them any more."""
    _drop_tables(since[1])
    for path in _made[since[0] :]:
        remove(spark, path)
    del _made[since[0] :]


def fresh_name(label: str) -> str:
    """A name for a folder that nothing else has."""
    return f"{''.join(c if c.isalnum() else '-' for c in label)}-{uuid.uuid4().hex}"


def free_prefix(columns: list[str], base: str) -> str:
    """A prefix that none of the columns has, whatever its case."""
    while any(c.lower().startswith(base.lower()) for c in columns):
        base = f"_{base}"
    return base
