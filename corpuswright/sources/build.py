"""One build, one commit: all outputs are staged, checked, and take their places together.

A build writes its tables to a folder of its own. Guards, foreign keys and unique keys are then checked against what was written, not
against plans that would be run again; any violation raises, names its rows, and leaves the version before in place. Only when everything has
passed is the manifest written, with a digest of every table that doesn't depend on its files, and the pointer to the current version
is replaced by one rename. A reader follows the pointer, so it sees the old version or the new one, never parts of both; a build
that dies leaves a folder that no pointer names, which ``sweep`` removes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import digest
from .files import write_json

#: Violations that an error names, at most; all are counted.
NAMED = 5


class BuildError(ValueError):
    """Checks of a build that failed: name and a few violations of each."""

    def __init__(self, faults: dict[str, list[str]]) -> None:
        self.faults = faults
        super().__init__("; ".join(f"{name}: {', '.join(rows)}" for name, rows in sorted(faults.items())))


@dataclass
class Build:
    """Tables of a build and what must hold for them.

    ``keys``: columns of each table that tell its rows apart. ``foreign``: (table, columns, other table, its columns); null
    references refer to nothing. ``guards``: from all tables as they were written to the rows that violate a rule.
    """

    spark: SparkSession
    path: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    keys: dict[str, list[str]] = field(default_factory=dict)
    foreign: list[tuple[str, list[str], str, list[str]]] = field(default_factory=list)
    guards: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = field(default_factory=dict)

    def _faults(self, written: dict[str, DataFrame]) -> dict[str, list[str]]:
        checks = {}
        for name, columns in self.keys.items():
            checks[f"{name}: repeated key"] = written[name].groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1").select(*columns)
        for name, columns, other, theirs in self.foreign:
            there = written[other].select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(theirs))).distinct()
            full = written[name].where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
            met = [F.col(c) == F.col(f"__{i}") for i, c in enumerate(columns)]
            checks[f"{name}: no such {other}"] = full.join(there, met, "left_anti").select(*columns)
        for name, guard in self.guards.items():
            checks[name] = guard(written)
        faults = {}
        for name, violations in checks.items():
            if rows := [json.dumps(r.asDict(), default=str, ensure_ascii=False) for r in violations.limit(NAMED).collect()]:
                faults[name] = rows
        return faults

    def commit(self, key_of: dict[str, str], extra: dict[str, object] | None = None) -> dict[str, object]:
        """Write, check and publish all tables; the manifest. ``key_of`` names each table's column for its digest's order."""
        version = f"v-{uuid.uuid4().hex}"
        written = {}
        for name, df in self.tables.items():
            df.write.parquet(f"{self.path}/{version}/{name}")
            written[name] = self.spark.read.schema(df.schema).parquet(f"{self.path}/{version}/{name}")
        if faults := self._faults(written):
            remove(self.spark, f"{self.path}/{version}")
            raise BuildError(faults)
        described = {name: {"rows": df.count(), "digest": digest.root(df, key_of[name])} for name, df in written.items()}
        manifest = {"version": version, "tables": described, **(extra or {})}
        write_json(self.spark, manifest, f"{self.path}/{version}/manifest.json")
        write_json(self.spark, {"version": version}, f"{self.path}/current.json")
        return manifest


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A small JSON file, or None if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def current(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """Tables and manifest of the version that was published last."""
    pointer = read_json(spark, f"{path}/current.json")
    if pointer is None:
        raise FileNotFoundError(f"nothing is published in {path}")
    manifest = read_json(spark, f"{path}/{pointer['version']}/manifest.json")
    return {name: spark.read.parquet(f"{path}/{pointer['version']}/{name}") for name in manifest["tables"]}, manifest


def verify(spark: SparkSession, path: str, key_of: dict[str, str]) -> None:
    """Raise unless the current version's tables have the digests of its manifest."""
    tables, manifest = current(spark, path)
    faults = {name: [f"{manifest['tables'][name]['digest']} expected"] for name, df in tables.items() if digest.root(df, key_of[name]) != manifest["tables"][name]["digest"]}
    if faults:
        raise BuildError(faults)


def sweep(spark: SparkSession, path: str) -> list[str]:
    """Remove versions that aren't current: older ones and what builds left that died. No build may run meanwhile."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    keep = (read_json(spark, f"{path}/current.json") or {}).get("version")
    names = [f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    gone = sorted(n for n in names if n.startswith("v-") and n != keep)
    for n in gone:
        remove(spark, f"{path}/{n}")
    return gone
