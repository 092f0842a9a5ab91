"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.session import ensure_checkpoint_dir

#: Rows and text bytes that Python code of a task holds at a time (one longer text still comes whole).
SLICE_ROWS = 2_000
SLICE_BYTES = 8_000_000


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write what several later steps read to the shared checkpoint folder, once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a slice stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.array([0 if s is None else s for s in pc.binary_length(column).to_pylist()], dtype=np.int64)
        begin, held = 0, 0
        for i, size in enumerate(sizes):
            if i > begin and (i - begin >= SLICE_ROWS or held + size > most_bytes):
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += int(size)
        yield batch.slice(begin)


def as_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 of each text; a null is an empty text."""
    values = batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()
    return [v or b"" for v in values]


def as_text(batch: pa.RecordBatch, column: str) -> list[str]:
    return [v or "" for v in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def map_texts(
    df: DataFrame, make: Callable[[pa.RecordBatch], dict[str, object]], added: str, text: str = "text", drop: tuple[str, ...] = (),
    most_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Add the columns of the DDL string ``added`` to every row, computed from slices of rows.

    ``make`` returns a list or array per added column. An added name replaces a column of the same name; the
    columns in ``drop`` are not returned.
    """
    new = T._parse_datatype_string(added)
    names = {f.name.lower() for f in new.fields} | {d.lower() for d in drop}
    keep = [f for f in df.schema.fields if f.name.lower() not in names]
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in keep], *new.fields])
    kinds = {f.name: _arrow(f.dataType) for f in new.fields}
    kept = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, most_bytes):
            made = make(batch)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            arrays += [made[c] if isinstance(made[c], pa.Array) else pa.array(made[c], type=kind) for c, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *kinds])

    return df.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    simple = {"long": pa.int64(), "integer": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(),
              "boolean": pa.bool_(), "binary": pa.binary()}
    return simple[kind.typeName()]


def remainder(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def hex64(column: str) -> Column:
    """A long as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (a, b); the root is the smallest node of its component.

    Alternates two star contractions until nothing changes. Each aggregates before the shuffle and writes its edges to the
    shared folder. The smallest neighbours are written too, so that both sides of the join on a hub are plain shuffles, which AQE can split.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        # now holds u > v: the larger neighbour u of v moves to the smallest neighbour of v.
        large = now.select(F.col("v").alias("u"), F.col("u").alias("far")).join(low, "u").select(F.col("far").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large)
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = stored(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
