"""Helpers that several operators share: intermediate tables, ragged Arrow
columns and files in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Rows and bytes of text that a Python task works on at a time.
SLICE_ROWS, SLICE_BYTES = 1000, 4 << 20


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what is used twice
    is computed once, and a lost executor does not repeat it."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the folders that a ``stored`` table was read from."""
    spark = df.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of bounded size (one row may exceed it)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = _lengths(column)
        start = 0
        while start < batch.num_rows:
            ends = np.cumsum(sizes[start:start + SLICE_ROWS])
            rows = max(1, int(np.searchsorted(ends, most, "right")))
            yield batch.slice(start, rows)
            start += rows


def _lengths(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def ragged(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column of numpy arrays."""
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def row_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The batches' rows as tuples of Python values, one after the other."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def row_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows put into batches of at most ``most``."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _rows(held, schema)
            held = []
    if held:
        yield _rows(held, schema)


def _rows(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], by: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """Join with every key of ``left`` dealt over ``salts`` partitions by column ``by``; ``right``,
    the smaller side, is repeated for each. So no key, however frequent, fills one task."""
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    each = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return spread.join(each, [*on, "_salt"], how).drop("_salt")


def bounded_sample(rows: DataFrame, text: str, most: int, by: str | None = None) -> DataFrame:
    """At most ``most`` distinct texts, those with the smallest hashes; with ``by``, of each of its values (equal texts of
    a value are one; its nulls are left out). Only hashes below a first bound are ranked; texts move once chosen."""
    hashed = rows.withColumn("_hash", F.pmod(F.xxhash64(text), F.lit(1 << 62)))
    # three times the share that would do; with fewer texts than that, all
    room = F.when(F.col("_n") > 3 * most, (F.lit(float(1 << 62)) * (3 * most) / F.col("_n")).cast("long")).otherwise(F.lit(1 << 62))
    some = F.approx_count_distinct("_hash").alias("_n")
    if by is None:
        below = hashed.agg(some).select(room).first()[0]
        ends = hashed.where(F.col("_hash") < below).select("_hash").distinct().orderBy("_hash").limit(most)
        last = ends.agg(F.max("_hash")).first()[0]
        return hashed.where(F.col("_hash") <= F.lit(last).cast("long")).dropDuplicates(["_hash"]).drop("_hash")
    bounds = stored(hashed.groupBy(by).agg(some).select(by, room.alias("_below")), "sample-bounds")
    near = hashed.select(by, "_hash").join(bounds, by).where("_hash < _below").select(by, "_hash").distinct()
    rank = F.row_number().over(Window.partitionBy(by).orderBy("_hash"))
    ends = near.withColumn("_rank", rank).where(F.col("_rank") <= most).groupBy(by).agg(F.max("_hash").alias("_last"))
    return hashed.join(stored(ends, "sample-ends"), by).where("_hash <= _last").dropDuplicates([by, "_hash"]).drop("_hash", "_last")


@contextmanager
def new_file(folder: str, name: str) -> Iterator[tuple[pa.NativeFile, str]]:
    """A file to write in a shared folder, and its URI. The name is new in
    each attempt of a task, and only files that a finished attempt reports
    are read, so a lost or repeated task leaves nothing that counts."""
    system, path = shared_files(folder)
    system.create_dir(path, recursive=True)
    name = f"{name.partition('.')[0]}-{uuid.uuid4().hex}.{name.partition('.')[2]}"
    with system.open_output_stream(f"{path}/{name}", compression=None) as out:
        yield out, f"{folder}/{name}"


def shared_files(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder named by URI or absolute path."""
    return fs.FileSystem.from_uri(folder)


class ChunkTable(dict):
    """Ids of distinct chunks of text. Looking up an unseen chunk gives it the
    next index and puts it on ``new``; ``add`` then stores its ids."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.flat, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def __missing__(self, chunk: str) -> int:
        k = self[chunk] = len(self)
        self.new.append(chunk)
        return k

    def add(self, ids: list[list[int]]) -> None:
        """Ids of the chunks on ``new``, in their order."""
        self.size = np.concatenate([self.size, np.fromiter(map(len, ids), np.int64, len(ids))])
        self.flat = np.concatenate([self.flat, np.fromiter((i for own in ids for i in own), np.int32)])
        self.start = np.cumsum(self.size) - self.size
        self.new = []

    def gather(self, index: np.ndarray) -> np.ndarray:
        """The ids of the chunks at ``index``, one after the other."""
        size = self.size[index]
        ends = np.cumsum(size)
        shift = np.repeat(self.start[index] - ends + size, size)
        return self.flat[shift + np.arange(len(shift))]
