"""What the operators of this subpackage share: reading tables, shared scratch space, small helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import folder

#: Rows and bytes of text that the Python side handles at a time.
SLICE_ROWS, SLICE_BYTES = 256, 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a reliable checkpoint in the shared folder."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str, **options: int) -> DataFrame:
    """df written as Parquet to the shared folder and read again, so that its true size is known to the planner."""
    spark = df.sparkSession
    path = f"{folder(spark)}/narratum-{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, label: str, column: str) -> Iterator[DataFrame]:
    """df written to the shared folder in buckets by a column, as many as a shuffle has partitions, so that joins on the column leave
    its rows where they lie. It is a table of the session only inside the `with`; its files stay, as those of stored() do."""
    spark = df.sparkSession
    own = uuid.uuid4().hex
    name, path = f"narratum_{label}_{own}", f"{folder(spark)}/narratum-{label}-{own}"
    try:
        df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).options(path=path, compression="zstd").saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"drop table if exists {name}")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


_memory: dict[str, object] = {}


def remembered(owner: str, make: Callable[[], Any]) -> Any:
    """What an operator keeps in a worker process from batch to batch. Workers are used again by other operators: asking for
    another owner's memory drops the one before, so that a process never holds more than one."""
    if owner not in _memory:
        _memory.clear()
        pa.default_memory_pool().release_unused()
        _memory[owner] = make()
    return _memory[owner]


def pieces(batches: Iterator[pa.RecordBatch], rows: int, size: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Each Arrow batch in pieces of at most `rows` rows that end where their texts reach `size` bytes."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0).to_pylist()
        start = weight = 0
        for end, n in enumerate(sizes, 1):
            weight += n
            if end - start >= rows or weight >= size or end == len(sizes):
                yield batch.slice(start, end - start)
                start, weight = end, 0


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Each Arrow batch in pieces of bounded rows and bytes, with the text column as Python strings (null: empty)."""
    for part in pieces(batches, SLICE_ROWS, SLICE_BYTES, text):
        yield part, [x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()]


def read_cell(table: pa.Table, column: str) -> Any:
    """The first row's value of a column."""
    return table.column(column)[0].as_py()
