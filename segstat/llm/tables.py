"""Small helpers shared by the corpus operators: inputs, scratch tables, Arrow passes."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..sources.scratch import materialize

__all__ = ["read", "materialize", "text_of", "map_texts", "pieces", "parts"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text"):
    """The text column as a string; a missing text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds at most ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = _ends(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = start + 1
            while stop < batch.num_rows and offsets[stop + 1] - offsets[start] <= limit:
                stop += 1
            yield batch.slice(start, stop - start)
            start = stop


def _ends(texts: pa.Array) -> list[int]:
    import numpy as np

    wide = texts.cast(pa.large_binary())
    return np.frombuffer(wide.buffers()[1], np.int64)[wide.offset:wide.offset + len(wide) + 1].tolist()


def map_texts(df: DataFrame, keep: list[str], fields: list[T.StructField],
              run: Callable[[pa.StringArray], list], text: str = "text", limit: int = 1 << 20) -> DataFrame:
    """One Arrow pass over the texts: the kept columns plus what ``run`` gives for each text.

    ``run`` gets at most ``limit`` bytes of text (or one longer text) at a time, so a task's
    memory does not depend on how many rows a batch has. New columns replace kept ones of the same name.
    """
    names = [f.name for f in fields]
    keep = [c for c in keep if c not in names]
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_kept"), text_of(text).alias("_text"))
    schema = T.StructType([T.StructField("_kept", packed.schema["_kept"].dataType), *fields])
    arrow = [pa.field(f.name, _ARROW[f.dataType.typeName()]) for f in fields]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text", limit):
            made = run(batch.column(1))
            columns = [pa.array(x, type=f.type) if not isinstance(x, pa.Array) else x for x, f in zip(made, arrow, strict=True)]
            kept = batch.column(0)
            yield pa.RecordBatch.from_arrays([kept, *columns], schema=pa.schema([pa.field("_kept", kept.type), *arrow]))

    return packed.mapInArrow(over, schema).select("_kept.*", *names)


_ARROW = {"long": pa.int64(), "integer": pa.int32(), "double": pa.float64(), "string": pa.string(),
          "boolean": pa.bool_(), "binary": pa.binary()}
