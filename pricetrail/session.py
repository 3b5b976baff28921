"""Session helpers: settings for local runs and the shared folder for cut lineage."""

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: str = "8", name: str = "pricetrail") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors reach: ``spark.checkpoint.dir`` of the session.

    Only a local master that names none (tests, local runs) gets a temporary folder; on several machines
    executors would write it each to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        folder = tempfile.mkdtemp(prefix="pricetrail-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    for paths in _scopes.get():
        paths.append(path)
    return path


#: Lists of paths of the open scopes. Each thread has its own, so loads side by side in one driver don't meet.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that this thread, or one of ``side_by_side``, makes inside are removed at the end: results
    must be stored by then."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def side_by_side(*jobs: Callable) -> list:
    """Results of jobs that do not need each other, started at once, so the tail of one leaves no executor idle."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [done.result() for done in [pool.submit(copy_context().run, job) for job in jobs]]


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    shipped = spark.conf.get("pricetrail.shipped", None)
    if shipped != spark.sparkContext.applicationId:
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(
            f"{tempfile.mkdtemp(prefix='pricetrail-zip-')}/pricetrail", "zip", root.parent, root.name
        )
        spark.sparkContext.addPyFile(archive)
        spark.conf.set("pricetrail.shipped", spark.sparkContext.applicationId)
