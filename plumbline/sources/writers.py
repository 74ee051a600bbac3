"""Sinks: delimited files, JSON documents, tables in Markdown, writes that never overwrite, cached results, and a record of a run."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _files(spark, path)
    return fs.exists(p)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """single: one file, for small reports only."""
    (df.coalesce(1) if single else df).write.option("header", True).csv(path)


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """A small document to any file system that Spark writes to."""
    fs, p = _files(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(content.encode()))
    out.close()


def write_json(spark: SparkSession, path: str, document: dict) -> None:
    write_text(spark, path, json.dumps(document, indent=2, ensure_ascii=False, sort_keys=True, default=str))


def write_once(df: DataFrame, path: str, force: bool = False) -> str | None:
    """Parquet that must not be there yet. force moves what is there to the next free path.archiveN, whose name it returns."""
    spark, moved = df.sparkSession, None
    if exists(spark, path):
        if not force:
            raise FileExistsError(f"{path} is there already")
        n = 1
        while exists(spark, f"{path}.archive{n}"):
            n += 1
        moved = f"{path}.archive{n}"
        fs, p = _files(spark, path)
        fs.rename(p, _files(spark, moved)[1])
    df.write.mode("errorifexists").parquet(path)
    return moved


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at path, made and written first if it is not there."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """A small table as Markdown; more than limit rows are an error, not a cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line("-" for _ in df.columns), *map(line, rows)])


def run_record(spark: SparkSession, seeds: dict, order: list[str], outputs: DataFrame) -> dict:
    """Versions, settings, seeds, run order, and path and sha256 of each output file (columns path, sha256)."""
    import platform

    conf = {k: v for k, v in spark.sparkContext.getConf().getAll() if k.startswith("spark.sql")}
    return {"python": platform.python_version(), "spark": spark.version, "conf": conf, "seeds": seeds, "run_order": order, "outputs": {r.path: r.sha256 for r in outputs.select("path", "sha256").toLocalIterator()}}


_own_dir: list[str] = []


def kept(df: DataFrame, what: str) -> DataFrame:
    """df as Parquet in the folder that spark.checkpoint.dir names, read again: what several jobs read is made once and survives lost executors.

    Where that is unset and the session is one process, as in tests, a temporary folder; on a cluster, an error."""
    import re
    import tempfile
    import uuid

    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="plumbline-"))
        top = _own_dir[0]
    path = f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes what kept() wrote, once no later plan reads it."""
    for df in frames:
        fs, p = _files(df.sparkSession, df._kept_path)
        fs.delete(p, True)
