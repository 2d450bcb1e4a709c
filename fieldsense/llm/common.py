"""Helpers shared by the corpus operators: intermediate tables in the shared folder, table reads."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Columns of the documents table, in order; pipeline stages return exactly these.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@lru_cache(maxsize=1)
def _local_scratch() -> str:
    return "file://" + tempfile.mkdtemp(prefix="fieldsense-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local[*] session, as in tests, may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return _local_scratch()
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


class Scratch:
    """Tables that one caller has written and deletes when all results that read them are written."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def clear(self) -> None:
        discard(*self.tables)
        self.tables = []


_scratch: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


@contextmanager
def noted_in(scratch: Scratch) -> Iterator[None]:
    """Inside the block, what this thread materializes is noted in the scratch."""
    before = _scratch.set(scratch)
    try:
        yield
    finally:
        _scratch.reset(before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fieldsense/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    table = spark.read.schema(schema).parquet(path)
    if scratch := _scratch.get():
        scratch.tables.append(table)
    return table


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables. Only for a caller that has written all results that read them."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def in_slices(column, rows: int = 256):
    """Values of an Arrow column, a few rows at a time as Python objects."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def releasing(run):
    """An Arrow function that gives back freed Arrow memory after each batch. Workers serve many tasks and would keep
    it, beside the executor's heap, while other operators run."""
    import pyarrow as pa

    def task(batches):
        for batch in run(batches):
            yield batch
            pa.default_memory_pool().release_unused()

    return task
