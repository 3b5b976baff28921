"""A training corpus from ``documents``: filter by quality, drop near copies and repeated passages, mix, encode."""

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pricetrail.llm import stages  # noqa: E402
from pricetrail.llm.common import stored, table  # noqa: E402
from pricetrail.session import ship_package  # noqa: E402

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", stages.quality),
    ("near_copies", stages.near_copies),
    ("repeated_passages", stages.repeated_passages),
    ("mixing", stages.mixing),
    ("pieces", stages.pieces),
]

#: The classifier is trained and the segmentation is a search over a vocabulary: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read by the next."""
    ship_package(spark)
    docs = table(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
