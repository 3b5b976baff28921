"""Schemas of the input tables and the stored tables."""

from pyspark.sql import types as T

PAGE_SNAPSHOTS = T.StructType(
    [
        T.StructField("page_url", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)

NETWORK_RESPONSES = T.StructType(
    [
        T.StructField("page_url", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("url", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)

# One offer inside a page; prices stay wide until the range check.
PAGE_OFFER = (
    "struct<position:int,name:string,price:decimal(38,2),url:string,"
    "internal_product_id:string,manufacturer_code:string,is_in_stock:boolean>"
)

PRODUCT_PRICES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("price", T.DecimalType(10, 2)),
        T.StructField("is_in_stock", T.BooleanType()),
        T.StructField("parsed_at", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
