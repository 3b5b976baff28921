"""Small files of the driver (commit records, folder names) through Hadoop's file systems, as Spark reads its tables."""

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names inside a folder, sorted; none if it isn't there."""
    where, system = _at(spark, path)
    if not system.exists(where):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(where))


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _at(spark, path)
    return system.exists(where)


def read_text(spark: SparkSession, path: str) -> str:
    where, system = _at(spark, path)
    stream = system.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file whole, unless it is there already: of several writers one gets True."""
    jvm = spark._jvm
    target, system = _at(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{jvm.java.util.UUID.randomUUID().toString()}.draft")
    stream = system.create(draft, False)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    # Only the renaming shows the file, and it doesn't replace one.
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = getattr(option, "NONE")
    uri = system.makeQualified(target).toUri()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, spark._jsc.hadoopConfiguration())
    try:
        context.rename(system.makeQualified(draft), system.makeQualified(target), options)
        return True
    except Exception as error:
        if "FileAlreadyExistsException" not in str(error):
            raise
        system.delete(draft, False)
        return False


def delete(spark: SparkSession, path: str) -> None:
    where, system = _at(spark, path)
    system.delete(where, True)
