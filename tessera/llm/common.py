"""What the operators share: the shared folder, Arrow row mapping, small inline tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from ..sources.scratch import fresh_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Text bytes that one call of a batch function sees at most, but for a single longer row.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The paths written within each `scratch` that is open, by thread.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def stored(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and lost executors lose nothing.

    keep: the table outlives the innermost `scratch`.
    """
    spark, within = df.sparkSession, _open.get()
    within = within[:-1] if keep else within
    path = fresh_path(spark, tag)
    if within:
        within[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored within are deleted at the end, but for those to be kept; results may rest on these and the inputs only."""
    paths: list[str] = []
    token = _open.set((*_open.get(), paths))
    try:
        yield
    finally:
        _open.reset(token)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@cache
def _allocator() -> ctypes.CDLL | None:
    """The C library, told to take large blocks from the system one by one; None where it isn't glibc."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD: a fixed one, else it grows to 32 MB and freed arrays stay
        return libc
    except (OSError, AttributeError):
        return None


def give_back() -> None:
    """Freed memory goes back to the system: Python workers are kept between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if libc := _allocator():
        libc.malloc_trim(0)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id's text has this remainder. A null id has remainder -1, so it is in neither fold's exception."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus, F.lit(-1)) == remainder


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns whose names equal one of names; an operator's own columns replace them."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def map_columns(df: DataFrame, inputs: list[str], outputs: list[StructField], make: Callable[[], Callable], drop: tuple[str, ...] = ()) -> DataFrame:
    """df plus the output columns that a batch function makes from the input columns (lists in, Arrow arrays out).

    make() runs once in each task and returns the function. Batches are cut so that one call sees about SLICE_BYTES of
    its first input. Columns of df with an output's name are replaced; those in drop are not passed on.
    """
    gone = {f.name.lower() for f in outputs} | {d.lower() for d in drop}
    kept = [f for f in df.schema.fields if f.name.lower() not in gone]
    names = [f.name for f in df.schema.fields]
    keep_at = [i for i, n in enumerate(names) if n.lower() not in gone]
    take_at = [next(i for i, n in enumerate(names) if n.lower() == x.lower()) for x in inputs]
    out_names = [f.name for f in kept] + [f.name for f in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _allocator()
        fn = make()
        for batch in batches:
            part = made = None
            for part in slices(batch, take_at[0]):
                made = fn(*(part.column(i) for i in take_at))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in keep_at] + list(made), names=out_names)
            del batch, part, made
            give_back()
        del fn
        give_back()

    return df.mapInArrow(run, StructType(kept + outputs))


def slices(batch: pa.RecordBatch, at: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about limit bytes each, by the lengths of column at."""
    if not batch.num_rows:
        return
    col = batch.column(at)
    is_list = pa.types.is_list(col.type)
    if not (is_list or pa.types.is_string(col.type) or pa.types.is_binary(col.type)) or col.nbytes <= limit:
        yield batch
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(col) if is_list else pc.binary_length(col), 0).to_pylist()
    limit //= 4 if is_list else 1  # ids of four bytes or so
    first = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    yield batch.slice(first)


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of literals that stays inside the JVM's plan."""
    fields = StructType.fromDDL(schema).fields
    if not rows:
        return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
    structs = [F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, fields))) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
