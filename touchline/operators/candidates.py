"""Candidates as tables in shared storage, behind a pointer that one rename commits.

A candidate is a folder of its own with its tables and a metadata file; nothing points to it until a small file beside the folders is replaced by renaming a finished
one over it, through Hadoop's file system, which is atomic on the stores that have renames. A writer that stops before that leaves the old pointer as it was. Candidates whose gate has not passed are refused.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.publish import canonical_json, sha256

POINTER, METADATA = "latest-candidate.json", "metadata.json"


@dataclass(frozen=True)
class Candidate:
    version: str
    report: dict
    tables: dict[str, DataFrame]


def _files(spark: SparkSession, root: str) -> tuple[Any, Any]:
    """Hadoop's file context for ``root``, and a maker of its paths."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = lambda *parts: hadoop.Path("/".join([root.rstrip("/"), *parts]))
    context = hadoop.FileContext.getFileContext(path().toUri(), spark.sparkContext._jsc.hadoopConfiguration()) if path().toUri().getScheme() else hadoop.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())
    return context, path


def _put(spark: SparkSession, path: Any, data: bytes) -> None:
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = system.create(path, False)
    try:
        out.write(data)
    finally:
        out.close()


def _get(spark: SparkSession, path: Any) -> bytes | None:
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return None
    stream = system.open(path)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def table_digest(table: DataFrame) -> str:
    """A digest that does not depend on the order of rows: their number and the sum of their hashes."""
    row = F.to_json(F.struct(*(F.col(c).cast("string") if t == "binary" else F.col(c) for c, t in sorted(table.dtypes))))
    found = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("total")).first()
    return sha256(f"{found.n}|{found.total}".encode())


def write_candidate(spark: SparkSession, root: str, version: str, report: dict, tables: dict[str, DataFrame]) -> str | None:
    """Writes the candidate and commits it; its folder, or None unless the report's gate has passed."""
    folder = stage_candidate(spark, root, version, report, tables)
    if folder is not None:
        commit_candidate(spark, root, folder)
    return folder


def stage_candidate(spark: SparkSession, root: str, version: str, report: dict, tables: dict[str, DataFrame]) -> str | None:
    """Writes tables and metadata to a new folder that nothing points to yet."""
    if not report.get("gate", {}).get("passed"):
        return None
    _, path = _files(spark, root)
    folder = f"{version}-{uuid.uuid4().hex}"
    digests = {}
    for name, table in tables.items():
        where = path(folder, f"{name}.parquet").toString()
        table.write.parquet(where)
        digests[name] = table_digest(spark.read.schema(table.schema).parquet(where))
    schemas = {name: json.loads(table.schema.json()) for name, table in tables.items()}
    _put(spark, path(folder, METADATA), canonical_json({"version": version, "report": report, "schemas": schemas, "digests": digests}))
    return folder


def commit_candidate(spark: SparkSession, root: str, folder: str) -> None:
    """Replaces the pointer by one rename."""
    context, path = _files(spark, root)
    metadata = _get(spark, path(folder, METADATA))
    if metadata is None:
        raise FileNotFoundError(f"{folder} is not a finished candidate")
    fresh = path(f".{POINTER}.{uuid.uuid4().hex}")
    _put(spark, fresh, canonical_json({"folder": folder, "sha256": sha256(metadata)}))
    rename = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(fresh, path(POINTER), options)


def read_candidate(spark: SparkSession, root: str) -> Candidate | None:
    """The committed candidate, or None if there is none; an error if it is not as it was written."""
    from pyspark.sql.types import StructType

    _, path = _files(spark, root)
    pointer = _get(spark, path(POINTER))
    if pointer is None:
        return None
    pointed = json.loads(pointer)
    data = _get(spark, path(pointed["folder"], METADATA))
    if data is None or sha256(data) != pointed["sha256"]:
        raise ValueError("the metadata is not what the pointer was made for")
    metadata = json.loads(data)
    tables = {name: spark.read.schema(StructType.fromJson(kind)).parquet(path(pointed["folder"], f"{name}.parquet").toString()) for name, kind in metadata["schemas"].items()}
    for name, table in tables.items():
        if table_digest(table) != metadata["digests"][name]:
            raise ValueError(f"{name} is not as it was written")
    return Candidate(metadata["version"], metadata["report"], tables)
