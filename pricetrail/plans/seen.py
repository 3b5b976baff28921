"""Offers of page snapshots that come in any order and more than once, each snapshot loaded or set aside.

A watermark forgets pages, so a stream that drops copies by one must drop late pages too. Here the snapshots seen lie in
a table by day and key bucket: a batch is compared with the days and buckets of its own pages, however old they are, and no
other folder is read. One row per snapshot stays, without its offers.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrail.operators import extract
from pricetrail.plans import store
from pricetrail.plans.batch import COPY, differing_copies, without_copies
from pricetrail.session import fresh_path

PAGE = ["page_url", "fetched_at"]
_DAY = "yyyy-MM-dd"
SEEN, OUTCOME = "seen", "outcome"


def _kept(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    path = fresh_path(df.sparkSession, label)
    df.write.partitionBy(*(by or [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _same_page(left: str, right: str) -> Column:
    same = F.lit(True)
    for name in PAGE:
        same = same & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return same


def _outcome() -> Column:
    """What becomes of a snapshot, given what is known of its page and time."""
    good = F.col("stage").isNull()
    return (
        F.when(F.col("known").isNull(), "new")
        .when(good & ~F.col("known.good"), "new")
        .when(F.col("known.digest") == F.col("digest"), "copy")
        .otherwise("differs")
    )


def load_offers(load: store.Load, extracted: DataFrame) -> None:
    """Add extracted pages to ``offers``, ``rejects``, ``seen`` and ``counters`` of a load; the caller commits.

    Of equal snapshots one is loaded, whenever they come. Of differing ones with one page and time the first good one to come
    is loaded, and of those in one batch the one with most offers; the others leave a reject each batch. A page that failed is
    loaded when a good snapshot comes. Counters tell pages of the batch after copies inside it were put together, by outcome.
    """
    extracted = _kept(extracted, "extracted")
    differing = differing_copies(extracted)
    one = without_copies(extracted).withColumns(
        {
            "digest": F.xxhash64(*COPY, "offers"),
            store.SLICE: store.slice_of("fetched_at", _DAY),
            store.BUCKET: store.bucket_of(PAGE, load.n),
        }
    )
    one = _kept(one, "pages")
    places = [tuple(r) for r in one.select(store.SLICE, store.BUCKET).distinct().collect()]
    older = store.appended(load.spark, load.before, load.root, SEEN)
    if older is None:
        labelled = one.withColumn(OUTCOME, F.lit("new"))
    else:
        # Folders of these days and buckets; the number of both is bounded, not the number of pages.
        older = older.where(
            F.col(store.SLICE).isin(sorted({s for s, _ in places})) & F.col(store.BUCKET).isin(sorted({b for _, b in places}))
        )
        # At most two rows a page: one that failed, and one that was good later.
        known = older.groupBy(*PAGE).agg(F.max(F.struct("good", "digest")).alias("known"))
        labelled = one.alias("n").join(known.alias("k"), _same_page("n", "k"), "left").select("n.*", "known").withColumn(OUTCOME, _outcome())
        labelled = _kept(labelled.drop("known"), "labelled")
    new = labelled.where(F.col(OUTCOME) == "new")
    differs = labelled.where(F.col(OUTCOME) == "differs").selectExpr(
        *PAGE, "'copy' AS stage", "'snapshots of one page and time differ' AS reason"
    )
    load.append("offers", extract.offers(new))
    load.append("rejects", extract.rejects(new).unionByName(differing).unionByName(differs))
    seen = new.select(*PAGE, "digest", F.col("stage").isNull().alias("good"), store.SLICE, store.BUCKET)
    load.append(SEEN, seen, [store.SLICE, store.BUCKET])
    load.append("counters", labelled.groupBy(OUTCOME).agg(F.count(F.lit(1)).alias("n_pages")))
