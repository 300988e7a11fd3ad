"""Reading uploads, the registry and documents."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkspan import codes
from linkspan.operators.clean import normalise_headers
from linkspan.sources.tables import read_by_file

SPLITS_SENT = 100_000  # split offsets sent to every task up to here


def file_key() -> Column:
    """Names the upload that a row is read from: 64 hex digits from path, time of change and length.

    The same file gets the same key; another one put under its path gets its own.
    """
    changed = F.unix_micros("_metadata.file_modification_time").cast("string")
    length = F.col("_metadata.file_size").cast("string")
    return F.sha2(F.concat_ws("\n", "_metadata.file_path", changed, length), 256)


def one_key_each(files: DataFrame) -> None:
    """Fail if two paths of a load (file_id, path) share a key: one would replace the other."""
    same = files.groupBy("file_id").agg(F.min("path").alias("one"), F.max("path").alias("other")).where("one <> other")
    if pair := same.first():
        raise ValueError(f"{pair['one']} and {pair['other']} have the same key {pair['file_id']}")


def csv_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the *.csv files of a folder; other names are skipped."""
    listing = spark.read.option("pathGlobFilter", "*.csv").text(folder)
    return sorted(listing.inputFiles())


def _read_one_layout(spark: SparkSession, paths: list[str], header: list[str], multi_line: bool) -> DataFrame:
    fields = ", ".join(f"`{name.replace('`', '``')}` string" for name in header)
    return spark.read.schema(fields).csv(
        paths, header=True, multiLine=multi_line, enforceSchema=True
    ).select(
        "*", F.col("_metadata.file_path").alias("path"), file_key().alias("upload_key"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


def with_row_ids(rows: DataFrame) -> DataFrame:
    """Add id, the row's number in its file from 1, dense.

    Needs the columns path and block_start.  Each piece of a file a task reads
    is counted once; a row's id is its place in the piece plus the rows of the
    earlier pieces.  The rows themselves are not shuffled and no task has to
    see a whole file.
    """
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    pieces = placed.groupBy("path", "block_start").agg(
        F.count(F.lit(1)).alias("rows"), F.min("place").alias("first")
    )
    before = F.sum("rows").over(Window.partitionBy("path").orderBy("block_start")) - F.col("rows")
    offsets = pieces.select("path", "block_start", "first", before.alias("before"))
    if offsets.count() <= SPLITS_SENT:
        offsets = F.broadcast(offsets)
    number = F.col("place") - F.col("first") + F.col("before") + 1
    return (
        placed.join(offsets, ["path", "block_start"])
        .withColumn("id", number.cast("string")).drop("place", "first", "before", "block_start")
    )


def read_uploads(spark: SparkSession, folder: str, multi_line: bool = False) -> DataFrame:
    """All CSV uploads of a folder as text columns with file_id and row id.

    Files may have different headers: files with the same header are read
    together and the layouts put together by column name.  `header` holds each
    file's own column list.  Text columns keep leading zeros.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)  # contents aren't read
    one_key_each(listed.select(file_key().alias("file_id"), F.col("_metadata.file_path").alias("path")))
    layouts: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for path in csv_files(spark, folder):
        names = spark.read.csv(path, header=True, multiLine=multi_line).columns
        layouts[tuple(names)].append(path)
    out = None
    for header, paths in layouts.items():
        clean = [name.strip().lower() for name in header]
        part = with_row_ids(_read_one_layout(spark, paths, clean, multi_line)).select(
            F.col("upload_key").alias("file_id"), "path", "id", *clean,
            F.lit(",".join(clean)).alias("header"),
        )
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], "file_id string, path string, id string, header string")
    return out


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    """Curated uploads, header names normalised."""
    return normalise_headers(read_by_file(spark, path, merge=True))


def register_files(uploads: DataFrame, institution: Column, now: Column) -> DataFrame:
    """One row per upload for the file table, status "uploaded"."""
    return uploads.groupBy("file_id", "path", "header").agg(F.count(F.lit(1)).alias("row_count")).select(
        "file_id", F.element_at(F.split("path", "/"), -1).alias("original_filename"),
        institution.alias("institution_name"),
        F.concat(F.lit("file_id="), "file_id").alias("minio_path"),
        now.alias("upload_timestamp"), F.lit(codes.UPLOADED).alias("processing_status"),
        F.col("row_count").cast("int").alias("row_count"), "header",
    )


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The eleven registry columns from Parquet."""
    return normalise_headers(spark.read.parquet(path)).select(*codes.MASTER_COLUMNS)


def read_registry_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int,
                       upper: int, parts: int, **properties: str) -> DataFrame:
    """The registry from a database, read in `parts` key ranges side by side."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=lower, upperBound=upper,
        numPartitions=parts, **properties,
    )
    return reader.load().select(*codes.MASTER_COLUMNS)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Text files whole, one row per file."""
    return spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def read_tables(spark: SparkSession, folder: str, multi_line: bool = False) -> DataFrame:
    """Lazy scan of a folder of CSV files with one header."""
    return spark.read.option("pathGlobFilter", "*.csv").csv(folder, header=True, multiLine=multi_line)
