"""Tables that are replaced as a whole: versions beside each other, published by a manifest.

A version is written to a folder of its own and only then named in the manifest, to which Spark appends a file.
Readers take the newest version that the manifest names; what a writer that died has left is not named and never
read. Records that are not whole are skipped and counted.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_MANIFEST = "number long, folder string, meta string, broken string"


@dataclass
class Version:
    """A published table, what was noted with it, and how many records of the manifest were not whole."""

    rows: DataFrame
    meta: dict
    number: int
    skipped: int


def _records(spark: SparkSession, path: str, schema: str) -> list:
    """Records of JSON lines; lines that are not whole are in the column ``broken``. None where nothing was written."""
    try:
        found = spark.read.schema(schema).option("columnNameOfCorruptRecord", "broken").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return found.collect()


def _parsed(text: str | None) -> dict | None:
    try:
        out = json.loads(text or "")
    except ValueError:
        return None
    return out if isinstance(out, dict) else None


def publish(rows: DataFrame, path: str, meta: dict) -> int:
    """Write ``rows`` as the next version below ``path`` and name it; readers see all of it or the one before.

    Of two writers at once both versions are whole; the later to publish is read.
    """
    spark, folder = rows.sparkSession, f"version-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{folder}")
    number = max([r["number"] for r in _records(spark, f"{path}/manifest", _MANIFEST) if r["number"] is not None], default=0) + 1
    spark.createDataFrame([(number, folder, json.dumps(meta))], "number long, folder string, meta string").coalesce(1).write.mode("append").json(f"{path}/manifest")
    return number


def latest(spark: SparkSession, path: str) -> Version | None:
    """The newest version below ``path``, or none. A version whose folder is gone or whose record is broken is passed over."""
    records = _records(spark, f"{path}/manifest", _MANIFEST)
    whole = [(r["number"], r["folder"], _parsed(r["meta"])) for r in records if r["number"] is not None and r["folder"]]
    whole = [v for v in whole if v[2] is not None]
    for number, folder, meta in sorted(whole, key=lambda v: v[:2], reverse=True):
        try:
            return Version(spark.read.parquet(f"{path}/{folder}"), meta, number, len(records) - len(whole))
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    return None


def append(spark: SparkSession, path: str, run_id: str, record: dict) -> None:
    """Add a record of a run to a history of JSON lines."""
    spark.createDataFrame([(time.time_ns(), run_id, json.dumps(record))], "at long, run_id string, record string").coalesce(1).write.mode("append").json(path)


def history(spark: SparkSession, path: str, run_id: str) -> tuple[list[dict], int]:
    """A run's records in the order they were added, and how many records of the history were not whole.

    A history that does not exist yet is empty.
    """
    records = _records(spark, path, "at long, run_id string, record string, broken string")
    parsed = [(r["at"], r["run_id"], _parsed(r["record"])) for r in records]
    own = sorted(((at or 0, i) for i, (at, run, record) in enumerate(parsed) if run == run_id and record is not None))
    return [parsed[i][2] for _, i in own], sum(record is None for _, _, record in parsed)
