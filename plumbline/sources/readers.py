"""Sources: delimited files, JSON, folders of files, Parquet vectors. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.checks import required_columns


def read_csv(spark: SparkSession, path: str, schema: StructType | str, timestamps: str | None = None) -> DataFrame:
    """With a header; an empty field and "" are null. Doubles are parsed to the nearest value. Columns not read are not parsed."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST").schema(schema)
    return (reader.option("timestampFormat", timestamps) if timestamps else reader).csv(path)


def read_labels(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A label sheet: names trimmed and lowered, an unnamed last column called annotation_note, required columns checked."""
    sheet = read_csv(spark, path, schema)
    sheet = required_columns(sheet, ["sentence_id", "text", "sentiment"])
    unnamed = [c for c in sheet.columns if c.startswith("unnamed") or c.startswith("_c")]
    return sheet.withColumnRenamed(unnamed[0], "annotation_note") if unnamed else sheet


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_vectors(spark: SparkSession, path: str, vector: str = "embedding") -> DataFrame:
    from ..functions.numeric import l2_normalized

    df = spark.read.parquet(path)
    return df.withColumn(vector, l2_normalized(F.col(vector)))


def scan_folder(spark: SparkSession, path: str, pattern: str, parts: dict[str, int], extensions: list[str], content: bool = False, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files below a folder. parts names groups of the file name's pattern; a rejected file has an issue: extension, name or,
    where folder names the part that a file's own folder is called after, folder_mismatch.

    Only names, sizes and times are read unless content is asked for, which adds the md5 and sha256 of each file."""
    columns = ["path", "length", "modificationTime"] + (["content"] if content else [])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(*columns)
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    made = files.withColumns({k: F.regexp_extract(name, pattern, g) for k, g in parts.items()} | {"extension": extension})
    if content:
        made = made.withColumns({"md5": F.md5("content"), "sha256": F.sha2("content", 256)}).drop("content")
    issue = F.when(~extension.isin(extensions), "extension").when(~name.rlike(pattern), "name")
    if folder:
        issue = issue.when(F.lower(F.element_at(F.split("path", "/"), -2)) != F.lower(folder), "folder_mismatch")
    marked = made.withColumn("issue", issue)
    return marked.where("issue is null").drop("issue"), marked.where("issue is not null")
