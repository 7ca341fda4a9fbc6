"""Results that are replaced or extended in one step, or not at all.

A result is a folder of versions and one manifest that names those which count. Rows are
written by Spark's committing writer into a version of its own: attempts that fail or are
repeated leave nothing behind in it. Only when the whole version is written does a new
manifest take the old one's place, by one rename. Until then, and for good if the job
fails, readers find the old result.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, types as T

from passagemill.sources.hadoop import Files

MANIFEST = "_manifest.json"


def _manifest(spark: SparkSession, path: str) -> dict | None:
    file = Files(spark, f"{path}/{MANIFEST}")
    return json.loads(file.read()) if file.exists() else None


def exists(spark: SparkSession, path: str) -> bool:
    return _manifest(spark, path) is not None


def load(spark: SparkSession, path: str) -> DataFrame:
    """The result as its manifest names it now."""
    told = _manifest(spark, path)
    if told is None:
        raise FileNotFoundError(path)
    return spark.read.format(told["format"]).schema(T.StructType.fromJson(told["schema"])).load(
        [f"{path}/{v}" for v in told["versions"]])


def _publish(df: DataFrame, path: str, kind: str, before: dict | None, keep: list[str], replace: bool) -> None:
    spark = df.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    try:
        df.write.format(kind).save(f"{path}/{version}")
        written = Files(spark, f"{path}/{version}").listed()
        draft = f"{path}/_draft-{uuid.uuid4().hex}.json"
        Files(spark, draft).write(json.dumps({
            "format": kind, "schema": json.loads(df.schema.json()), "versions": [*keep, version],
            "files": (before or {}).get("files", {}) | {version: dict(written)} if keep else {version: dict(written)}}))
        Files(spark, f"{path}/{MANIFEST}").replace_by(draft, replace)
    except BaseException:
        Files(spark, f"{path}/{version}").delete()
        raise
    for old in set((before or {}).get("versions", [])) - set(keep):
        Files(spark, f"{path}/{old}").delete()


def save(df: DataFrame, path: str, overwrite: bool = False, kind: str = "parquet") -> None:
    """Write a result; an existing one is an error unless `overwrite` (of two writers one fails).

    The versions before are deleted after the swap: who still reads one reads it again.
    """
    before = _manifest(df.sparkSession, path)
    if before is not None and not overwrite:
        raise FileExistsError(path)
    _publish(df, path, kind, before, [], overwrite)


def save_guarded(df: DataFrame, path: str, overwrite: bool = False, kind: str = "parquet") -> DataFrame:
    """Write a result unless one is there and must stay; returns the result that stands."""
    if overwrite or not exists(df.sparkSession, path):
        save(df, path, overwrite, kind)
    return load(df.sparkSession, path)


def extend(df: DataFrame, path: str) -> None:
    """Add rows of the same columns to a result, all or none. One writer at a time."""
    before = _manifest(df.sparkSession, path)
    if before is None:
        return save(df, path)
    if [(f["name"], f["type"]) for f in before["schema"]["fields"]] != [
            (f["name"], f["type"]) for f in json.loads(df.schema.json())["fields"]]:
        raise ValueError("the new rows have other columns")
    _publish(df, path, before["format"], before, before["versions"], True)
