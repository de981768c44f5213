"""Cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from rentscope.session import ensure_checkpoint_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder.

    Used where one result feeds several jobs (model training, scoring and
    evaluation): later jobs read the checkpoint files, so losing an executor
    does not recompute the upstream joins, and the plan stays short.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table to a new folder beside the checkpoints, and read from there.

    Unlike a checkpoint it has file statistics and takes filters and column
    pruning, so joins with it are planned by its size.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
