"""Readers of other formats, all by Spark's readers, so that any store Spark reaches will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexloom.sources.warc import read_warc, write_warc  # noqa: F401 (a reader among the others)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line: of text files, compressed ones included."""
    return spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("line"))


def read_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One JSON object a line; broken lines come as rows of nulls, and the schema is given so that the data are read once."""
    return spark.read.schema(schema).json(path)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content, git_name: whole files and the name that git gives their blob."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", "content", blob_name(F.col("content")).alias("git_name"))


def blob_name(content):
    """The SHA-1 of git's blob header, a NUL and the content; null stays null."""
    head = F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), content.cast("binary")))
