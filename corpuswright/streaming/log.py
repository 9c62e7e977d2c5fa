"""Streaming counterparts of the append-only log: resumable work, and the latest record of each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import ArrayType, IntegralType, LongType, StringType, StructField, StructType

from ..operators.evaluation import last_wins


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the JSON lines that are appended to a folder."""
    return spark.readStream.schema(schema).json(path)


def first_of_key(log: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Each key once; state is dropped after the delay that the watermark allows."""
    return log.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def append(records: DataFrame, path: str) -> None:
    """Appends records to a log as JSON lines; each job's files appear when it commits."""
    records.write.mode("append").json(path)


#: Keys share the states of so many buckets; fixed for a checkpoint.
BUCKETS = 1 << 12


class _Newest(StatefulProcessor):
    """Of each key of a bucket, the greatest order value seen; records beyond it are passed on."""

    def __init__(self, order: StructField, ttl_ms: int | None) -> None:
        self.order, self.ttl_ms = order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        lists = {"keys": StringType(), "newest": self.order.dataType, "at": LongType()}
        self.seen = handle.getValueState("seen", StructType([StructField(n, ArrayType(t)) for n, t in lists.items()]), self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        name, newest = self.order.name, None
        for part in rows:
            both = part if newest is None else pd.concat([newest, part])
            newest = both.sort_values(name, ascending=False, kind="stable").drop_duplicates("key__")
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms else 0
        known = {k: (v, at) for k, v, at in zip(*self.seen.get()) if not self.ttl_ms or now - at < self.ttl_ms} if self.seen.exists() else {}
        keys, values = newest["key__"].tolist(), newest[name].tolist()
        news = [k not in known or v > known[k][0] for k, v in zip(keys, values)]
        if any(news):
            known.update((k, (v, now)) for k, v, new in zip(keys, values, news) if new)
            self.seen.update((list(known), *map(list, zip(*known.values()))))
            yield newest[news].drop(columns=["key__", "bucket__"], errors="ignore")

    def close(self) -> None:
        pass


def changes(log: DataFrame, keys: list[str], order: str, ttl_ms: int | None = None) -> DataFrame:
    """A stream of the records that are newer than all before them of their key, the newest of a batch only.

    Each key keeps one value of ``order`` (null ones are passed over) in the state store. Keys are dealt over ``BUCKETS`` buckets, whose states
    a batch reads and writes if it has one of their keys: tasks in Python are called for a bucket, not for a key. With ``ttl_ms`` a key that
    has been quiet so long is forgotten, and its next record is news. Needs the RocksDB state store (``use_rocksdb``).
    """
    columns = [*keys, *(c for c in log.columns if c not in keys)]
    # whole numbers beside nulls would be floats in pandas; the order has no nulls. Names with an underscore in front would be lost on the way there
    sent = [StructField(c, StringType() if isinstance(log.schema[c].dataType, IntegralType) and c != order else log.schema[c].dataType) for c in columns]
    key, bucket = F.to_json(F.struct(*keys)).alias("key__"), F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("bucket__")
    rows = log.where(log[order].isNotNull()).select(bucket, key, *(F.col(f.name).cast(f.dataType) for f in sent))
    mode = "ProcessingTime" if ttl_ms else "None"
    made = rows.groupBy("bucket__").transformWithStateInPandas(statefulProcessor=_Newest(log.schema[order], ttl_ms), outputStructType=StructType(sent), outputMode="Append", timeMode=mode)
    return made.select(*(F.col(c).cast(log.schema[c].dataType) for c in columns))


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def keep_latest(log: DataFrame, keys: list[str], order: str, target: str, checkpoint: str, ttl_ms: int | None = None) -> StreamingQuery:
    """Appends each batch's changes to the Parquet table ``target``; ``latest`` reads it.

    Restarted on its checkpoint, it goes on where it was: state and sink know the batches they hold, so none counts twice.
    """
    use_rocksdb(log.sparkSession)
    made = changes(log, keys, order, ttl_ms)
    return made.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str, keys: list[str], order: str) -> DataFrame:
    """The latest record of each key in a table of changes."""
    return last_wins(spark.read.parquet(target), keys, order)
