"""Tables in the folder that the driver and all executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one of this machine only where none is set and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir() or path
    return path


_open: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as Parquet there and returns the table: it is computed once and survives lost executors.

    The table stays until the cluster clears the folder, or goes at the end of the
    passing() that it was written in.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/ledgerloom-{name}-{uuid.uuid4().hex}"
    for paths in _open[-1:]:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables written() in it: for steps whose result has been written outside by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def keeping(df: DataFrame, name: str) -> DataFrame:
    """written(), but the table outlives the passing() around it."""
    _open.append([])
    try:
        return written(df, name)
    finally:
        _open.pop()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    """How many pieces an exchange keyed by this package has: Spark's own setting, 16 at least."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def _named(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def with_text(docs: DataFrame, text: str, out: str) -> DataFrame:
    """The columns of `docs` but `out`, then the text once more: the input of a pass that appends `out`."""
    return docs.select(*(_named(c) for c in docs.columns if c != out), _named(text).alias("_text_of_pass"))


def schema_with(docs: DataFrame, out: str, kind: str) -> StructType:
    """The columns of `docs` but `out`, then `out`."""
    return StructType([*(f for f in docs.schema if f.name != out), StructField(out, _parse_datatype_string(kind))])


def appended(batch: pa.RecordBatch, values: pa.Array, out: str) -> pa.RecordBatch:
    """A batch of with_text() with the values in place of the text."""
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], values], [*batch.schema.names[:-1], out])


def _release() -> None:
    """Gives memory that is free in this process back to the machine, where its allocators can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no such call in this C library
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass for mapInArrow after which the worker, which lives on, holds no memory of it."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _release()

    return passed


def lean_table(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """lean() for applyInArrow."""

    def passed(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            if table.nbytes > 1 << 20:
                _release()

    return passed


def lean_tables(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """lean_table() for applyInArrow of a cogroup."""

    def passed(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            if left.nbytes + right.nbytes > 1 << 20:
                _release()

    return passed


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """df.mapInArrow(lean(run), schema) for columns of any name: in between they are called by their numbers."""
    plain = [f"_{i}" for i in range(len(schema))]
    kind = StructType([StructField(n, f.dataType) for n, f in zip(plain, schema)])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch.rename_columns(plain)

    return df.toDF(*(f"_{i}" for i in range(len(df.columns)))).mapInArrow(lean(numbered), kind).toDF(*schema.names)
