"""Versioned store of fitted models, each a set of tables.

    path/versions/<version>/<table>/   the tables of one fit
    path/manifest/                     a row for each file of each complete version

The manifest is appended last, in one file: a fit whose write fails leaves no
manifest row, and readers go on with the version before it. Nothing is ever
overwritten; only files that the manifest names are read.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "number long, version string, table string, schema string, files array<string>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row for each table of each complete version; none where nothing was stored."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def write_version(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> str:
    """Store ``tables`` as the newest version and return its name."""
    version, rows = uuid.uuid4().hex, []
    number = 1 + (manifest(spark, path).agg(F.max("number")).first()[0] or 0)
    for name, df in tables.items():
        folder = f"{path.rstrip('/')}/versions/{version}/{name}"
        df.write.mode("errorifexists").parquet(folder)
        files = spark.read.schema(df.schema).parquet(folder).inputFiles()
        rows.append((number, version, name, df.schema.json(), sorted(files)))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/manifest")
    return version


def read_version(spark: SparkSession, path: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of ``version``, of the newest complete one if not named."""
    from pyspark.sql.types import StructType
    import json

    known = manifest(spark, path)
    if version is None:
        newest = known.agg(F.max(F.struct("number", "version")).alias("m")).select("m.version").first()
        version = newest["version"]
    rows = known.filter(F.col("version") == F.lit(version)).collect()
    if not rows:
        raise LookupError(f"no complete version {version or ''} below {path}")
    out = {}
    for r in rows:
        schema = StructType.fromJson(json.loads(r["schema"]))
        out[r["table"]] = spark.read.schema(schema).parquet(*r["files"]) if r["files"] else spark.createDataFrame([], schema)
    return out
