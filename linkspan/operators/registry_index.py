"""The registry made ready for matching: one slim table per blocking rule.

A row for each registry row and block: block, nik_master and the compared fields, already
cleaned and as text. One pass over the registry makes the tables of all rules. Each is
bucketed by block, so that a match that shuffles only moves its incoming side, and sorted
within buckets. A table can be kept and opened again by later runs, and rows of changed
registry parts are put in anew without the others (`refresh`).

`part` cuts the registry by its id number; a refresh writes new tables beside the old
ones, from the changed parts and the old rows of the others, and switches last: a run
that is cut short leaves the old tables in use.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspan.functions.scoring import ALL_PROFILES, ScoreProfile
from linkspan.operators.blocking import BLOCK, RULES, BlockingRule
from linkspan.sources import versions
from linkspan.sources.scratch import fresh_path

PARTS = 64
BUCKETS = 64
#: Every field that some profile compares.
FIELDS = sorted({f for p in ALL_PROFILES.values() for f in p.fields})


def part_of(nik: str | Column = "nik", parts: int = PARTS) -> Column:
    """The part of the registry that an id number belongs to; null counts as empty."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(nik) if isinstance(nik, str) else nik, F.lit(""))), F.lit(parts)).cast("int")


def _rules() -> dict[str, BlockingRule]:
    return {rule.name: rule for rule in RULES.values()}


def entries(master: DataFrame, parts: int = PARTS, rules: list[str] | None = None,
            fields: list[str] | None = None) -> DataFrame:
    """rule, block, part, nik_master, b_<field>: the rows of all tables, from one pass over the cleaned registry.

    `rules`, `fields`: those wanted, all by default; other fields are null.
    """
    keys = [
        F.struct(F.lit(name).alias("rule"), key.alias(BLOCK))
        for name, rule in _rules().items() if rules is None or name in rules for key in rule.master_keys()
    ]
    value = lambda f: F.col(f"{f}_master_clean") if fields is None or f in fields else F.lit(None)
    values = [value(f).cast("string").alias(f"b_{f}") for f in FIELDS]
    found = master.select(
        F.explode(F.array(*keys)).alias("key"), part_of("nik", parts).alias("part"), F.col("nik").alias("nik_master"), *values
    )
    return found.select("key.*", "part", "nik_master", *(f"b_{f}" for f in FIELDS)).where(F.col(BLOCK).isNotNull())


@dataclass(frozen=True)
class RegistryIndex:
    """The tables of one folder, by rule."""

    tables: dict[str, str]
    buckets: int
    parts: int
    spark: SparkSession

    def rows(self, rule: BlockingRule, profile: ScoreProfile) -> DataFrame:
        """block, nik_master and the profile's fields."""
        return self.spark.table(self.tables[rule.name]).select(BLOCK, "nik_master", *(f"b_{f}" for f in profile.fields))

    def every(self) -> DataFrame:
        """All rows, as from `entries`."""
        found = None
        for name, table in self.tables.items():
            own = self.spark.table(table).select(
                F.lit(name).alias("rule"), BLOCK, "part", "nik_master", *(f"b_{f}" for f in FIELDS)
            )
            found = own if found is None else found.unionByName(own)
        return found

    def close(self) -> None:
        """Forget the tables' names in this session; the files stay."""
        for table in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def _columns() -> str:
    return ", ".join([f"{BLOCK} string", "part int", "nik_master string", *(f"b_{f} string" for f in FIELDS)])


def _opened(spark: SparkSession, folder: str, buckets: int, parts: int, rules: list[str] | None = None) -> RegistryIndex:
    tables = {}
    for name in rules or _rules():
        table = f"linkspan_{name}_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {table} ({_columns()}) USING parquet CLUSTERED BY ({BLOCK}) SORTED BY ({BLOCK})"
            f" INTO {buckets} BUCKETS LOCATION '{folder}/{name}'"
        )
        tables[name] = table
    return RegistryIndex(tables, buckets, parts, spark)


def _written(rows: DataFrame, folder: str, buckets: int, parts: int, rules: list[str] | None = None) -> RegistryIndex:
    """The tables of these rows, which are read once.

    They are put down by rule where they are; then each rule's are dealt by block, the only time that
    they move, and each task writes a bucket. A single rule's are dealt at once.
    """
    spark = rows.sparkSession
    index = _opened(spark, folder, buckets, parts, rules)
    if len(index.tables) > 1:
        stored = f"{folder}/dealt"
        rows.write.partitionBy("rule").parquet(stored)
        rows = spark.read.schema(f"{_columns()}, rule string").parquet(stored)
    for name, table in index.tables.items():
        own = rows.where(F.col("rule") == name).select(BLOCK, "part", "nik_master", *(f"b_{f}" for f in FIELDS))
        own.repartition(buckets, BLOCK).write.insertInto(table)
    return index


def build(master: DataFrame, path: str | None = None, buckets: int = BUCKETS, parts: int = PARTS,
          rules: list[str] | None = None, fields: list[str] | None = None) -> RegistryIndex:
    """The tables of a cleaned registry, in a scratch folder or kept under `path`.

    One for a run that needs only some rules and fields may leave out the others; a kept one has all.
    """
    if path and (rules is not None or fields is not None):
        raise ValueError("a kept index has all rules and fields")
    spark = master.sparkSession
    folder = versions.fresh(path) if path else fresh_path(spark, "index")
    index = _written(entries(master, parts, rules, fields), folder, buckets, parts, rules)
    if path:
        _keep(index, path, folder)
    return index


def _keep(index: RegistryIndex, path: str, folder: str) -> None:
    facts = index.spark.createDataFrame([(index.buckets, index.parts)], "buckets int, parts int")
    facts.coalesce(1).write.parquet(f"{folder}/facts")
    versions.switch(index.spark, path, folder)


def load(spark: SparkSession, path: str) -> RegistryIndex:
    """The tables kept under `path`."""
    folder = versions.current(spark, path)
    if folder is None:
        raise ValueError(f"no index under {path}")
    facts = spark.read.parquet(f"{folder}/facts").first()
    return _opened(spark, folder, facts["buckets"], facts["parts"])


def refresh(spark: SparkSession, path: str, changed: DataFrame, parts: list[int]) -> RegistryIndex:
    """The kept tables with these parts of the registry put in anew.

    `changed`: all cleaned registry rows of these parts, as `part_of` deals them; other rows in it don't count.
    """
    old = load(spark, path)
    new = entries(changed, old.parts).where(F.col("part").isin(parts))
    rows = old.every().where(~F.col("part").isin(parts)).unionByName(new)
    folder = versions.fresh(path)
    index = _written(rows, folder, old.buckets, old.parts)
    _keep(index, path, folder)
    old.close()
    return index
