"""Stored tables as parquet.

Shops, products and last prices are small next to the history and are written as whole versions;
a load reads version N and writes N+1, so it never overwrites what it reads and can be repeated
after a failure. Price rows are appended: each load owns a folder, partitioned by month.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetrail import schemas

def version_path(root: str, table: str, version: int) -> str:
    return f"{root.rstrip('/')}/{table}/v{version:012d}"


def write_version(df: DataFrame, root: str, table: str, version: int) -> None:
    """Write a whole version; repeating a load replaces its own unfinished output only."""
    df.write.mode("overwrite").parquet(version_path(root, table, version))


def read_version(spark: SparkSession, root: str, table: str, version: int) -> DataFrame | None:
    """A version of a table, or None before the first load."""
    if version < 0:
        return None
    return spark.read.parquet(version_path(root, table, version))


def write_prices(prices: DataFrame, root: str, version: int) -> None:
    """Price rows of one load, by month of ``parsed_at``, so reads of a time range skip folders.

    The rebalance keeps the files of a month few and of even size, and splits a month that is large.
    """
    by_month = prices.withColumn("month", F.date_format("parsed_at", "yyyy-MM")).hint("rebalance", "month")
    by_month.write.mode("overwrite").partitionBy(
        "month"
    ).parquet(f"{root.rstrip('/')}/product_prices/load={version}")


def read_prices(spark: SparkSession, root: str, version: int) -> DataFrame | None:
    """All price rows of loads 0..version; ``load`` and ``month`` are folders and prune the scan."""
    if version < 0:
        return None
    schema = T.StructType(
        [
            *schemas.PRODUCT_PRICES,
            T.StructField("load", T.IntegerType()),
            T.StructField("month", T.StringType()),
        ]
    )
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/product_prices").where(F.col("load") <= version)


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    """Append to a database table through Spark's JDBC writer (the driver jar comes with the cluster)."""
    df.write.jdbc(url, table, mode="append", properties=properties)
