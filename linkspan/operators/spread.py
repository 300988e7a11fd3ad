"""Joins and numbering that hold when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from linkspan.sources.scratch import settle

FILE_PARTS = 64
KEYS_SENT = 200_000
HOT_KEYS = 5_000  # keys that are split, at most
PART_ROWS = 100_000  # rows of a key that stay together


def join_by_file(rows: DataFrame, files: DataFrame, spread_by: str, how: str = "left",
                 parts: int = FILE_PARTS) -> DataFrame:
    """Join rows with a table that has one row per file.

    A small `files` is sent to the tasks as it is. Otherwise both sides are shuffled: one file
    may hold a large part of all rows, so each file is cut into `parts` pieces by `spread_by`
    and its row in the file table repeated for each piece. The planner takes the repeated rows
    for a single one, and would send them all through the driver; so the join's kind is named.
    """
    files = settle(files, "files")
    if files.count() <= KEYS_SENT:
        return rows.join(F.broadcast(files), "file_id", how)
    pieces = files.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    cut = F.pmod(F.xxhash64(spread_by), F.lit(parts)).cast("int")
    return rows.withColumn("piece", cut).join(pieces.hint("merge"), ["file_id", "piece"], how).drop("piece")


def first_of_wanted(table: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The smallest row of each wanted key; `wanted` has the key column, nulls are no keys.

    Few keys are sent to the table. With many of them the table is brought to a row per
    key before it moves, so a key with very many rows doesn't come to one task.
    """
    keys = settle(wanted.select(key).where(F.col(key).isNotNull()).distinct(), "keys")
    rest = [c for c in table.columns if c != key]

    def first(df: DataFrame) -> DataFrame:
        return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row"))

    if keys.count() <= KEYS_SENT:
        one = first(table.join(F.broadcast(keys), key, "left_semi"))
    else:
        one = first(table).join(keys, key, "left_semi")
    return one.select(*(F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in table.columns))


def join_unique(rows: DataFrame, unique: DataFrame, key: str, spread_by: list[str], how: str = "left") -> DataFrame:
    """Join rows (inner or left) with a table that has one row per key, whatever share one key has.

    A small `unique` is sent to the tasks. Otherwise keys with more rows than a part holds
    are cut into parts by a hash of the columns `spread_by`, and their row in `unique` is
    repeated for each part. A part holds `PART_ROWS` rows or, of very many rows, a
    `HOT_KEYS`th of all: fewer than `HOT_KEYS` keys can have more, so their list may be
    sent. Rows without a key meet nothing and are spread as they are.
    """
    unique = settle(unique, "unique")
    if unique.count() <= KEYS_SENT:
        return rows.join(F.broadcast(unique), key, how)
    rows = settle(rows, "rows")
    part = max(PART_ROWS, -(-rows.count() // HOT_KEYS))
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > part)
    hot = F.broadcast(settle(counts.select(key, F.ceil(F.col("_n") / part).cast("int").alias("_parts")), "hot"))
    cut = F.coalesce("_parts", F.when(F.col(key).isNull(), HOT_KEYS), F.lit(1))
    left = rows.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(*spread_by), cut).cast("int"))
    right = unique.join(hot, key, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    )
    return left.drop("_parts").join(right.drop("_parts"), [key, "_part"], how).drop("_part")


def number_rows(df: DataFrame, group: str, order: str, name: str = "number",
                width: int = 100_000) -> DataFrame:
    """Row number from 1 within each group, in the order of a whole-number column
    that is unique in the group.

    Rows are numbered inside spans of `width` consecutive order values, so no
    task sees more than `width` rows of a group; the counts of the earlier
    spans are added.
    """
    spanned = df.withColumn("span", F.floor(F.col(order) / width).cast("long"))
    counts = spanned.groupBy(group, "span").agg(F.count(F.lit(1)).alias("rows"))
    before = counts.select(
        group, "span",
        (F.sum("rows").over(Window.partitionBy(group).orderBy("span")) - F.col("rows")).alias("before"),
    )
    local = F.row_number().over(Window.partitionBy(group, "span").orderBy(order))
    return (
        spanned.withColumn("local", local).join(before, [group, "span"])
        .withColumn(name, F.col("before") + F.col("local")).drop("span", "local", "before")
    )


def repeat_rows(df: DataFrame, times: int) -> DataFrame:
    """Every row `times` times."""
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_copy")


def latest_per_key(df: DataFrame, keys: list[str], version: str, n: int = 1) -> DataFrame:
    """The n latest versions of every key, newest first by `version`.

    The limit applies in every task before rows move, so a key with very many
    versions sends only n rows from each.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(version).desc()))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def children_of_latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """All rows that belong to the latest version of their key."""
    newest = df.groupBy(*keys).agg(F.max(version).alias(version))
    return df.join(newest, [*keys, version], "left_semi")


def ordered_children_of_latest(df: DataFrame, keys: list[str], version: str, order: list[str],
                               children: list[str]) -> DataFrame:
    """One row per key: its latest version, and `items`, an array of its children in order.

    The latest version is found by a pre-aggregated maximum, so rows of earlier ones don't
    move. A version's children come to one row, as its reader wants them.
    """
    newest = df.groupBy(*keys).agg(F.max(version).alias(version))
    mine = df.join(newest, [*keys, version], "left_semi")
    in_order = F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("place"), F.struct(*children).alias("child"))))
    return mine.groupBy(*keys, version).agg(in_order.alias("items")).withColumn(
        "items", F.transform("items", lambda x: x["child"])
    )
