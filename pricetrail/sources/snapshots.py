"""Readers for page snapshots and captured responses, batch and stream."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrail import schemas


def read_snapshots(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Page snapshots from parquet, ORC or JSON lines, with the schema given, not inferred."""
    return spark.read.format(fmt).schema(schemas.PAGE_SNAPSHOTS).load(path)


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(schemas.NETWORK_RESPONSES).load(path)


def read_html_files(spark: SparkSession, path: str, base_url: str) -> DataFrame:
    """Saved pages, one file each: the page URL is ``base_url`` plus the file's path below ``path``."""
    folder = re.sub(r"^[A-Za-z0-9]+:(//[^/]*)?", "", path).rstrip("/")
    below = F.regexp_extract("_metadata.file_path", rf"\Q{folder}\E/(.*?)(?:\.html?)?$", 1)
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.concat(F.lit(base_url.rstrip("/") + "/"), below).alias("page_url"),
        F.col("_metadata.file_modification_time").alias("fetched_at"),
        F.lit(200).alias("http_status"),
        F.lit("text/html").alias("content_type"),
        F.col("value").alias("body"),
    )


def stream_snapshots(
    spark: SparkSession, path: str, fmt: str = "parquet", max_files: int = 1000
) -> DataFrame:
    """Page snapshots as a stream of new files; ``max_files`` bounds one micro-batch."""
    return (
        spark.readStream.format(fmt)
        .schema(schemas.PAGE_SNAPSHOTS)
        .option("maxFilesPerTrigger", max_files)
        .load(path)
    )
