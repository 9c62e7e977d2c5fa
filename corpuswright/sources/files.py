"""Scans and sinks of the corpus builder: delimited, spreadsheet, YAML and JSON-lines sources; hashed, verified outputs.

Tables are read by Spark with explicit all-string schemas. Spreadsheets and YAML files, which Spark can't
read, are small by nature and are parsed on the driver.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import stable_int


def strings(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def expect_rows(df: DataFrame, rows: int | None, name: str) -> DataFrame:
    """Raise unless the table has exactly so many rows."""
    if rows is not None and (found := df.count()) != rows:
        raise ValueError(f"{name}: expected {rows} rows, found {found}")
    return df


def read_csv(spark: SparkSession, path: str, columns: list[str], rows: int | None = None) -> DataFrame:
    """A CSV file with a header, with or without a byte order mark; empty cells are empty strings."""
    df = spark.read.schema(strings(columns)).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True).csv(path)
    return expect_rows(df.fillna(""), rows, path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, also gzipped; blank lines are skipped, an empty file raises, and so does a malformed line."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if df.isEmpty():
        raise ValueError(f"{path} is empty")
    return df


def _cell(value: object) -> str:
    if value is None:
        return ""
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def read_sheet(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """The first sheet of an .xls or .xlsx file as strings; whole floats lose their point. Needs xlrd or openpyxl."""
    if path.endswith(".xls"):
        import xlrd

        sheet = xlrd.open_workbook(path).sheet_by_index(0)
        grid = [[c.value for c in sheet.row(i)] for i in range(sheet.nrows)]
    else:
        import openpyxl

        grid = [list(r) for r in openpyxl.load_workbook(path, read_only=True).active.iter_rows(values_only=True)]
    header = [str(c).strip() for c in grid[0]]
    return expect_rows(spark.createDataFrame([tuple(map(_cell, r)) for r in grid[1:]], strings(header)), rows, path)


def read_pairs(spark: SparkSession, path: str, count: int | None = None) -> DataFrame:
    """(place, question, answer) of a YAML file with ``pairs``; blank ones raise. Needs yaml."""
    import yaml

    with open(path, encoding="utf-8") as f:
        pairs = [(i, str(p["question"]).strip(), str(p["answer"]).strip()) for i, p in enumerate(yaml.safe_load(f)["pairs"], 1)]
    if any(not q or not a for _, q, a in pairs) or count is not None and len(pairs) != count:
        raise ValueError(f"{path}: {len(pairs)} pairs, or blank ones")
    return spark.createDataFrame(pairs, "place int, question string, answer string")


def write_ordered(df: DataFrame, path: str, split: str, id_: str) -> None:
    """Gzipped JSON lines in the order of a hash of the id: ordered within and across the part files."""
    order = stable_int("order", split, F.col(id_))
    df.withColumn("__o", order).repartitionByRange("__o", id_).sortWithinPartitions("__o", id_).drop("__o").write.option("compression", "gzip").json(path)


def _plain_bytes(content: bytes) -> bytes:
    import gzip

    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def content_hashes(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, sha256) of whole files, read in parallel; gzipped ones by what is in them, as headers may differ."""
    files = spark.read.format("binaryFile").load(pattern)

    @F.pandas_udf("string")
    def inside(content: pd.Series) -> pd.Series:
        return content.map(lambda c: hashlib.sha256(_plain_bytes(bytes(c))).hexdigest())

    name = F.element_at(F.split("path", "/"), -1)
    plain = files.where(~name.endswith(".gz")).select(name.alias("file"), F.sha2("content", 256).alias("sha256"))
    return plain.unionByName(files.where(name.endswith(".gz")).select(name.alias("file"), inside("content").alias("sha256")))


def resolve(spark: SparkSession, folder: str, name: str, sha256: str) -> str:
    """The path of the first file of that name below a folder, if its content has the hash; else this raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(folder)
    found = files.select("path", F.sha2("content", 256).alias("sha256")).orderBy("path").first()
    if found is None:
        raise FileNotFoundError(f"{name} not found below {folder}")
    if found.sha256 != sha256:
        raise ValueError(f"{name}: {found.sha256} instead of {sha256}")
    return found.path


def prompt_hash(prompt: str) -> str:
    return hashlib.sha256(prompt.encode()).hexdigest()


def manifest_faults(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(file, fault) of expected files (file, sha256) that are missing or differ."""
    both = expected.join(actual.withColumnRenamed("sha256", "found"), "file", "left")
    return both.where("found IS NULL OR found <> sha256").select("file", F.when(F.col("found").isNull(), "missing").otherwise("mismatch").alias("fault"))


def write_relational(tables: dict[str, DataFrame], keys: dict[str, list[str]], path: str, audit: dict[str, DataFrame] | None = None) -> None:
    """A Parquet folder for each table, replaced all at once after keys are unique and audits (tables of violations) are empty.

    Tables are written to a folder beside ``path``, which then takes its name.
    """
    for name, df in tables.items():
        if name in keys and not df.groupBy(*keys[name]).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            raise ValueError(f"{name}: repeated keys")
    for name, violations in (audit or {}).items():
        if not violations.isEmpty():
            raise ValueError(f"audit failed: {name}")
    if not tables:
        return
    spark = next(iter(tables.values())).sparkSession
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{staged}/{name}")
    _replace(spark, staged, path)


def _replace(spark: SparkSession, new: str, path: str) -> None:
    """Give a folder or file the place of another through Hadoop's file system; what stood there goes last."""
    jvm = spark._jvm
    to, made = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(new)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    old = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    had = fs.exists(to)
    if had and not fs.rename(to, old) or not fs.rename(made, to):
        raise OSError(f"can't replace {path}")
    if had:
        fs.delete(old, True)


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """One JSON file, keys sorted, that appears whole or not at all."""
    jvm, made = spark._jvm, f"{path}.{uuid.uuid4().hex}"
    at = jvm.org.apache.hadoop.fs.Path(made)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray((json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode()))
    finally:
        out.close()
    _replace(spark, made, path)


def write_cards(cards: DataFrame, path: str) -> None:
    """Cards (card_id, title, source, text) as JSON lines, keys sorted."""
    cards.select("card_id", "source", "text", "title").write.json(path)


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """Cards (card_id, title, source, text) of JSON lines with card_id or id; repeated ids raise."""
    raw = spark.read.schema("card_id string, id string, title string, source string, text string").option("mode", "FAILFAST").json(path)
    cards = raw.select(F.coalesce("card_id", "id").alias("card_id"), "title", "source", "text")
    if not cards.groupBy("card_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"{path}: repeated ids")
    return cards


def provenance(spark: SparkSession, records: list[dict[str, str]]) -> DataFrame:
    """(id, name, license, url, sha256, use) of the sources, one row each."""
    columns = ["id", "name", "license", "url", "sha256", "use"]
    if len({r["id"] for r in records}) != len(records):
        raise ValueError("repeated sources")
    return spark.createDataFrame([tuple(r.get(c, "") for c in columns) for r in records], strings(columns))


def manifest(inputs: dict[str, str], outputs: DataFrame, prompt: str) -> dict[str, object]:
    """Hashes of inputs, of output files (file, sha256: a few) and of the prompt."""
    return {"inputs": inputs, "outputs": {r.file: r.sha256 for r in outputs.collect()}, "system_prompt_sha256": prompt_hash(prompt)}


def verify_manifest(expected: dict, actual: DataFrame, prompt: str) -> None:
    """Raise for missing or differing files (file, sha256) and for another prompt."""
    want = actual.sparkSession.createDataFrame(sorted(expected["outputs"].items()), "file string, sha256 string")
    faults = [f"{r.file}: {r.fault}" for r in manifest_faults(want, actual).collect()]
    if expected["system_prompt_sha256"] != prompt_hash(prompt):
        faults.append("the system prompt differs")
    if faults:
        raise ValueError("; ".join(faults))


def run_fingerprint(config: dict, manifest_: dict, paths: tuple[tuple[str, ...], ...] = (("output_dir",), ("base_model", "local_dir"))) -> str:
    """16 digits that tell a configuration and its data, paths left out."""
    raw = json.loads(json.dumps(config))
    for *above, last in paths:
        at = raw
        for k in above:
            at = at.get(k, {})
        at.pop(last, None)
    return hashlib.sha256(json.dumps({"config": raw, "data": manifest_}, sort_keys=True).encode()).hexdigest()[:16]


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """(id, questions, answer, key_terms) of a YAML file with ``concepts``; each has five questions. Needs yaml."""
    import yaml

    with open(path, encoding="utf-8") as f:
        rows = [(c["id"], list(map(str, c["questions"])), str(c["answer"]), list(map(str, c["key_terms"]))) for c in yaml.safe_load(f)["concepts"]]
    if bad := [r[0] for r in rows if len(r[1]) != 5]:
        raise ValueError(f"{path}: {bad} without five questions")
    return spark.createDataFrame(rows, "id string, questions array<string>, answer string, key_terms array<string>")


def read_safety(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(split, kind, place, prompt) of a YAML file with ``train`` and ``test`` prompts, and the rest of the file. Needs yaml."""
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f)
    rows = [(s, k, i, str(x)) for s in ("train", "test") for k, listed in raw.pop(s).items() for i, x in enumerate(listed)]
    return spark.createDataFrame(rows, "split string, kind string, place int, prompt string"), raw


def read_templates(spark: SparkSession, path: str, slots: int = 7) -> DataFrame:
    """(kind, attribute, slot, text) of a YAML file {kind: {attribute: [text, ...]}}; every attribute has one text a slot. Needs yaml."""
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f)
    rows = [(k, a, i, str(t)) for k, attributes in raw.items() for a, texts in attributes.items() for i, t in enumerate(texts)]
    if bad := [a for attributes in raw.values() for a, texts in attributes.items() if len(texts) != slots]:
        raise ValueError(f"{path}: {bad} without {slots} texts")
    return spark.createDataFrame(rows, "kind string, attribute string, slot int, text string")


def read_config(path: str, overrides: dict[str, str] | None = None) -> dict:
    """A YAML file with some dotted keys set anew. Needs yaml."""
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f)
    for key, value in (overrides or {}).items():
        *above, last = key.split(".")
        at = raw
        for k in above:
            at = at.setdefault(k, {})
        at[last] = value
    return raw
