"""Tables between steps, in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder; only a local session without it (tests, notebooks) gets a temporary folder
of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast.
SMALL = 100_000


def root(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master  # executors of a local cluster have folders of their own
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="corpuswright-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


_made: list[str] = []


def mark() -> int:
    """A point in time for ``release``."""
    return len(_made)


def release(spark: SparkSession, since: int) -> None:
    """Delete the tables that ``cut`` made since the mark; only when no plan needs them any more."""
    for path in _made[since:]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del _made[since:]


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` and read it back: what follows starts from the table, also after executors are lost.

    Tables stay until they are released.
    """
    path = f"{root(df.sparkSession)}/corpuswright/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """Marked to be broadcast if it has few rows, which are counted; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """The rows of a table dealt evenly over a few tasks for each core: a small file of narrow rows would be one task, whatever is made of them."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def numbered(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """Adds each row's place in the order, from 0: places within ranges, and the rows of the ranges before, of which the driver holds one count each."""
    inner = F.monotonically_increasing_id()
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", inner.alias("__i")), "numbered")
    part, at = F.shiftright("__i", 33), F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))
    before, rows = [], 0
    for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        before.append((r["part"], rows))
        rows += r["n"]
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "__part long, __before long"))
    return ranged.withColumn("__part", part).join(offsets, "__part").withColumn(name, at + F.col("__before")).drop("__part", "__before", "__i")
