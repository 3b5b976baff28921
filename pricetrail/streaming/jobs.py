"""Streams over page snapshots and observations.

Extraction is stateless and row-local, so it is the batch code on a stream. What depends on stored
rows runs per micro-batch on the batch operators and ends with a commit: a replayed micro-batch is
known by its query and number and not loaded twice. The change test runs as
the split batch fold instead of keyed state, because keyed state puts all of a hot product's rows
into one task.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricetrail.operators import extract
from pricetrail.operators.routing import Rule
from pricetrail.plans import reports, seen, store
from pricetrail.plans.batch import load_snapshots
from pricetrail.session import scratch


def extracted_stream(pages: DataFrame, kind: str = "catalog", delay: str = "1 day") -> DataFrame:
    """Snapshot stream to extracted pages, copies of a snapshot dropped within the watermark.

    Copies are dropped behind the extraction: page bodies stay out of the shuffle and the state.
    They are dropped twice: first per input partition, so that a page with very many copies is
    spread over the tasks, then over all.
    """
    extracted = extract.extract_catalog(pages) if kind == "catalog" else extract.extract_product(pages)
    page = ["page_url", "fetched_at"]
    return (
        extracted.withWatermark("fetched_at", delay)
        .withColumn("_salt", F.spark_partition_id())
        .dropDuplicatesWithinWatermark([*page, "_salt"])
        .drop("_salt")
        .dropDuplicatesWithinWatermark(page)
    )


def offers_stream(pages: DataFrame, kind: str = "catalog", delay: str = "1 day") -> DataFrame:
    """Snapshot stream to offers; may be written in append mode."""
    return extract.offers(extracted_stream(pages, kind, delay))


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to parquet until the input at hand is used up."""
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def _query_id(rows: DataFrame, checkpoint: str) -> str:
    """The running stream's id: kept in its checkpoint, so a restart has it again and a new checkpoint a new one."""
    return rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint


def _per_batch(rows: DataFrame, load, checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_offers(
    pages: DataFrame,
    root: str,
    checkpoint: str,
    kind: str = "catalog",
    more_rules: list[Rule] | None = None,
    more_offers: dict[str, str] | None = None,
) -> StreamingQuery:
    """Snapshot stream to offers, as committed versions: pages that come late are loaded, and every page that is not
    loaded leaves a reject. ``offers_stream`` is the stateful form, which forgets pages behind its watermark.
    """
    spark = pages.sparkSession

    def load(batch: DataFrame, number: int) -> None:
        source = _query_id(batch, checkpoint)
        if store.committed(store.state(spark, root), source, number):
            return
        version = store.Load(spark, root, source, number)
        extracted = (extract.extract_catalog if kind == "catalog" else extract.extract_product)(batch, more_rules, more_offers)
        with scratch(spark):
            seen.load_offers(version, extracted)
            version.commit()

    return _per_batch(pages, load, checkpoint)


def stream_history(
    observations: DataFrame, keys: list[str], order: list[str], root: str, checkpoint: str, keep_months: bool = False
) -> StreamingQuery:
    """Change-only history of an observation stream, as committed versions: see ``plans.store``."""
    spark = observations.sparkSession

    def load(batch: DataFrame, number: int) -> None:
        source = _query_id(batch, checkpoint)
        if store.committed(store.state(spark, root), source, number):
            return
        version = store.Load(spark, root, source, number)
        with scratch(spark):
            kept = keep_months or reports.is_kept(version.before)
            store.fold(version, batch, keys, order, beside=(lambda written: reports.keep_months(version, written, keys, order)) if kept else None)
            version.commit()
        store.compact(spark, root)

    return _per_batch(observations, load, checkpoint)


def stream_load(
    pages: DataFrame,
    root: str,
    checkpoint: str,
    kind: str = "catalog",
    responses: DataFrame | None = None,
    more_rules: list[Rule] | None = None,
    more_offers: dict[str, str] | None = None,
) -> StreamingQuery:
    """Load a snapshot stream into shops, products and prices: scheduled refresh with ``availableNow``.

    ``responses`` is a table of captured responses that holds those of the pages that come. Streams
    of product pages and of catalogues may take turns on one ``root``.
    """
    spark = pages.sparkSession

    def load(batch: DataFrame, number: int) -> None:
        source = _query_id(batch, checkpoint)
        load_snapshots(spark, batch, root, kind, responses, True, more_rules, more_offers, source, number)
        store.compact(spark, root)

    return _per_batch(pages, load, checkpoint)
