"""Small files and folders of any store that Spark can reach, handled by the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Taken(RuntimeError):
    """A file of this name is there already."""


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if there is no folder."""
    store, place = _at(spark, folder)
    return sorted(s.getPath().getName() for s in store.listStatus(place)) if store.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    store, place = _at(spark, path)
    stream = store.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file as a whole: under another name first, then renamed. Raises Taken if the name is in use."""
    store, place = _at(spark, path)
    _, draft = _at(spark, f"{path}.{uuid.uuid4().hex}")
    stream = store.create(draft)
    stream.write(bytearray(text.encode()))
    stream.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(store.makeQualified(draft), store.makeQualified(place), options)
    except Exception as error:
        store.delete(draft, False)
        if store.exists(place):
            raise Taken(path) from error
        raise


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or a folder with all in it, if it is there."""
    store, place = _at(spark, path)
    store.delete(place, True)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern."""
    store, place = _at(spark, pattern)
    return sorted(s.getPath().toString() for s in store.globStatus(place) or [])
