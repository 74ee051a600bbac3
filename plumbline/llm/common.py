"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one slice of an Arrow batch may hold before it is worked off.
SLICE_CHARS = 1 << 21
#: Unicode White_Space as the tokenizers' regular expressions see it (fixed values).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Rows of an Arrow batch while an operator writes a table of its own.
BATCH_ROWS, _BATCH = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset and the session runs in one process, a folder made here; on a cluster, an error."""
    global _own_dir
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if there:
        return there.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="plumbline-")
    return _own_dir


def written(df: DataFrame, what: str) -> DataFrame:
    """df as Parquet in the shared folder, read again: cuts lineage and survives lost executors. Arrow batches are small meanwhile, as their rows can be whole texts."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what written() made; only for frames that no later plan reads."""
    for df in frames:
        path = getattr(df, "_plumbline_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """The names, with marks added where a column of that name is there already."""
    low, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


_holds: dict[str, Callable[[], None]] = {}


def hold(owner: str, release: Callable[[], None] = lambda: None) -> None:
    """Tells that this worker process now works for owner and fills its caches. Those of other operators, left from earlier tasks, are released."""
    others = [o for o in _holds if o != owner]
    for other in others:
        _holds.pop(other)()
    if others:
        trim()
    _holds[owner] = release


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _libc = None


def trim() -> None:
    """Gives memory that is free again back to the system: workers outlive their tasks, and an executor has several."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def trimmed(run):
    """A function of batches that gives its worker's free memory back when it ends."""

    def ended(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return ended


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_CHARS) -> Iterator[tuple[list[pa.Array], list[str]]]:
    """Cuts of a batch with about limit bytes of text: the columns and the texts, null as ''."""
    k = batch.schema.get_field_index(column)
    sizes = pc.fill_null(pc.binary_length(batch.column(k)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= limit or i + 1 == len(sizes):
            cut = batch.slice(start, i + 1 - start)
            yield cut.columns, [x or "" for x in cut.column(k).to_pylist()]
            start, size = i + 1, 0


def map_texts(
    df: DataFrame, key: str | Column, text: str | Column, work: Callable[[], Callable[[list[str]], list]], schema: str, fields: list[pa.Field], key_type: pa.DataType = None
) -> DataFrame:
    """One row out per row in: (key, *work()(texts)), in Arrow batches cut by size.

    work is called once per task and returns the function from texts to columns; nothing is
    shuffled. Null keys and texts pass ('' stands for a null text)."""
    key = F.col(key) if isinstance(key, str) else key
    text = F.col(text) if isinstance(text, str) else text
    out = pa.schema([pa.field("key", key_type or pa.int64()), *fields])

    def run(batches):
        f = work()
        for batch in batches:
            for cols, texts in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([cols[0].cast(out.field(0).type), *(pa.array(c, x.type) for c, x in zip(f(texts), fields, strict=True))], schema=out)

    return df.select(key.alias("key"), text.alias("text")).mapInArrow(trimmed(run), f"key bigint, {schema}")
