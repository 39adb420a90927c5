"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The white space of every word and line rule: space and U+0009..U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: The same as a pattern for runs of other characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table in the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def slices(batches: Iterable[pa.RecordBatch], column: str, budget: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``budget`` bytes in each: bounds a task's memory.

    A single row over the budget is a slice of its own; none is cut or dropped.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > budget:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of UTF-8 bytes by the white space of all rules, about ``size`` bytes at a time; none is cut."""
    start = 0
    while start < len(data):
        gap = BLANK.search(data, start + size)
        end = gap.start() if gap else len(data)
        yield data[start:end].split()
        start = end


#: Rows of an Arrow batch between Spark and Python. Rows hold whole texts, so a batch of the default size is large.
BATCH_ROWS = 1000


def mapped(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, forget: Callable[[], None] | None = None) -> DataFrame:
    """``df.mapInArrow`` with bounded memory: batches are small (the session's setting is lowered where it is larger),
    and at its end a task calls ``forget`` and gives unused memory back, as Spark keeps its Python workers."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))

    def tidied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if forget:
                forget()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return df.mapInArrow(tidied, schema)


def gathered(batches: Iterable[pa.RecordBatch], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Batches joined until each has about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def unused(taken: Iterable[str], name: str) -> str:
    """``name``, or that with underscores until no column of ``taken`` has it (names differ by more than case)."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without its columns of these names: an operator's own columns take the place of an input's."""
    lowered = {n.lower() for n in names}
    clash = [c for c in df.columns if c.lower() in lowered]
    return df.select(*(f"`{c}`" for c in df.columns if c not in clash)) if clash else df


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
