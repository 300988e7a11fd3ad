"""Tables that are replaced as a whole, and never half.

A write goes to a folder of its own; a row in the table's list of versions, appended
last, makes it the one that readers take. A job that is cut short before leaves the
earlier version in use, and its rerun writes another. Old folders are cleared by age, so
that readers that began before a switch can end.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LIST = "number long, folder string, written_s double"


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def fresh(path: str) -> str:
    """A folder for a new version."""
    return f"{path}/v-{uuid.uuid4().hex}"


def switch(spark: SparkSession, path: str, folder: str) -> None:
    """Make the folder the version in use: the last step of a write."""
    now = time.time()
    row = [(time.time_ns(), folder, now)]
    spark.createDataFrame(row, _LIST).coalesce(1).write.mode("append").parquet(f"{path}/versions")


def current(spark: SparkSession, path: str) -> str | None:
    """The folder in use, None before the first write."""
    fs, place = _files(spark, f"{path}/versions")
    if not fs.exists(place):
        return None
    found = spark.read.schema(_LIST).parquet(f"{path}/versions").orderBy(F.desc("number"), "folder").first()
    return found["folder"] if found else None


def write(df: DataFrame, path: str) -> None:
    """Replace the table; `df` may be computed from the version in use."""
    folder = fresh(path)
    df.write.parquet(folder)
    switch(df.sparkSession, path, folder)


def read(spark: SparkSession, path: str) -> DataFrame:
    folder = current(spark, path)
    if folder is None:
        raise ValueError(f"no table under {path}")
    return spark.read.parquet(folder)


def clear(spark: SparkSession, path: str, seconds: float) -> int:
    """Delete the folders that aren't in use and were last written longer ago; their number."""
    used = current(spark, path)
    fs, place = _files(spark, path)
    gone = 0
    for status in fs.listStatus(place) if fs.exists(place) else []:
        name = status.getPath().getName()
        if name.startswith("v-") and f"{path}/{name}" != used and status.getModificationTime() / 1000 < time.time() - seconds:
            fs.delete(status.getPath(), True)
            gone += 1
    return gone
