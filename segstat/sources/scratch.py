"""Tables written to the shared folder to cut lineage between heavy steps."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import shared_folder


def scratch_path(spark, label: str) -> str:
    return f"{shared_folder(spark)}/segstat/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes the frame once and reads it back: later branches do not repeat the work,
    and a lost executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
