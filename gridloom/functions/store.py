"""Small files and folders of the shared store, through the file systems that Spark itself uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _at(spark, path)
    return store.exists(place)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    store, place = _at(spark, folder)
    return [s.getPath().getName() for s in store.listStatus(place)] if store.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    store, place = _at(spark, path)
    store.delete(place, True)


def read_small(spark: SparkSession, path: str) -> str:
    """Text of a file of a few kB; a missing one is an error."""
    store, place = _at(spark, path)
    stream = store.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that is either there in full or not at all."""
    store, place = _at(spark, path)
    draft = _at(spark, f"{path}.draft")[1]
    stream = store.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not store.rename(draft, place):
        raise OSError(f"could not name {path}")
