"""Blocking rules: which registry rows an incoming row is compared with.

A rule is data: branches of key expressions over the cleaned columns of both
sides.  Two rows are candidates when they agree on all keys of one branch; a
null key never agrees.  Every branch is turned into one text key per row, so a
rule with several branches still needs a single equi-join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspan.sources.scratch import settle

BLOCK = "block"
TASK_ROWS = 1_000_000  # registry rows that a task tells apart, on average
_SEPARATOR = "\u001f"


@dataclass(frozen=True)
class Branch:
    """`incoming` and `master` are SQL key expressions, pairwise compared.

    `covered` marks a branch whose pairs all belong to another branch as well;
    it is documented but adds no candidates.
    """

    name: str
    incoming: tuple[str, ...]
    master: tuple[str, ...]
    incoming_if: str = "true"
    master_if: str = "true"
    covered: bool = False


@dataclass(frozen=True)
class BlockingRule:
    """`narrow_by`: a field compared exactly by the score; equality on it gives
    a narrower block that is searched first.  `unique_key`: the key is meant to
    be unique in the registry (repeated keys still work)."""

    name: str
    branches: tuple[Branch, ...]
    narrow_by: str | None = None
    unique_key: bool = False

    def _keys(self, side: str) -> list[Column]:
        active = [b for b in self.branches if not b.covered]
        keys = []
        for branch in active:
            parts = [F.expr(e).cast("string") for e in getattr(branch, side)]
            text = parts[0] if len(parts) == 1 else F.concat(
                *[p for part in parts for p in (part, F.lit(_SEPARATOR))]
            )
            if len(active) > 1:
                text = F.concat(F.lit(branch.name + _SEPARATOR), text)
            test = getattr(branch, side + "_if")
            keys.append(text if test == "true" else F.when(F.expr(test), text))
        return keys

    def incoming_keys(self) -> list[Column]:
        return self._keys("incoming")

    def master_keys(self) -> list[Column]:
        return self._keys("master")


def _day_and_month(column: str) -> tuple[str, str]:
    return f"day({column})", f"month({column})"


def _prefix(column: str) -> str:
    return f"left({column}, 3)"


_IN, _MA = "{}_clean", "{}_master_clean"
_DATE_IN = _day_and_month("tanggal_lahir_clean")
_DATE_MA = _day_and_month("tanggal_lahir_master_clean")


def _has_text(column: str) -> str:
    return f"coalesce({column}, '') <> ''"


BY_NIK = BlockingRule("nik", (Branch("nik", ("nik",), ("nik",)),), unique_key=True)

GENDER_DATE_NAME = BlockingRule(
    "gender_date_name",
    (
        Branch(
            "complete",
            ("jenis_kelamin_clean", *_DATE_IN, _prefix("nama_clean")),
            ("jenis_kelamin_master_clean", *_DATE_MA, _prefix("nama_master_clean")),
        ),
    ),
    narrow_by="tanggal_lahir",
)

BY_PRESENT_FIELDS = BlockingRule(
    "by_present_fields",
    (
        Branch(
            "no_gender",
            (_prefix("tempat_lahir_clean"), *_DATE_IN),
            (_prefix("tempat_lahir_master_clean"), *_DATE_MA),
            incoming_if=f"jenis_kelamin_clean is null and {_has_text('tempat_lahir_clean')}",
            master_if=_has_text("tempat_lahir_master_clean"),
        ),
        Branch(
            "no_place",
            ("jenis_kelamin_clean", _prefix("nama_clean"), *_DATE_IN),
            ("jenis_kelamin_master_clean", _prefix("nama_master_clean"), *_DATE_MA),
            incoming_if=f"tempat_lahir_clean is null and {_has_text('nama_clean')}",
            master_if=_has_text("nama_master_clean"),
            covered=True,  # every such pair is a pair of "complete" too
        ),
        Branch(
            "no_date",
            ("jenis_kelamin_clean", _prefix("tempat_lahir_clean"), _prefix("nama_clean")),
            (
                "jenis_kelamin_master_clean",
                _prefix("tempat_lahir_master_clean"),
                _prefix("nama_master_clean"),
            ),
            incoming_if="tanggal_lahir_clean is null and "
            + _has_text("tempat_lahir_clean") + " and " + _has_text("nama_clean"),
            master_if=_has_text("tempat_lahir_master_clean")
            + " and " + _has_text("nama_master_clean"),
        ),
        Branch(
            "complete",
            ("jenis_kelamin_clean", _prefix("nama_clean"), *_DATE_IN),
            ("jenis_kelamin_master_clean", _prefix("nama_master_clean"), *_DATE_MA),
        ),
    ),
    narrow_by="tanggal_lahir",
)

LIFE_DATE_NAME = BlockingRule(
    "life_date_name",
    (
        Branch(
            "life",
            ("status_hidup_clean", _prefix("nama_clean"), *_DATE_IN),
            ("status_hidup_master_clean", _prefix("nama_master_clean"), *_DATE_MA),
            incoming_if=_has_text("nama_clean"),
            master_if=_has_text("nama_master_clean"),
        ),
    ),
    narrow_by="tanggal_lahir",
)

RULES = {1: BY_NIK, 2: BY_NIK, 3: GENDER_DATE_NAME, 4: BY_PRESENT_FIELDS, 5: LIFE_DATE_NAME}


def with_blocks(df: DataFrame, keys: list[Column]) -> DataFrame:
    """One row per block a row belongs to; rows without any block disappear.

    A single key takes the same way as several: filters on a generated column
    are not pushed below the generator, where they would compute the long key
    expressions once more for every part of the key.
    """
    return df.withColumn(BLOCK, F.explode(F.array(*keys))).filter(F.col(BLOCK).isNotNull())


def candidate_pairs(incoming: DataFrame, master: DataFrame, rule: BlockingRule) -> DataFrame:
    """All distinct candidate pairs with the columns of both sides.

    For looking at a rule on small data; matching itself never lists pairs.
    """
    left = with_blocks(incoming, rule.incoming_keys())
    right = with_blocks(master.withColumnRenamed("nik", "nik_master"), rule.master_keys())
    right = right.select(BLOCK, "nik_master", *[c for c in right.columns if c.endswith("_master_clean")])
    return left.join(right, BLOCK).drop(BLOCK).distinct()


def candidate_counts(incoming: DataFrame, master: DataFrame, rule: BlockingRule) -> DataFrame:
    """Number of distinct candidates per incoming row, without listing them.

    Registry rows are counted per block first, so the join carries one row per
    block and per incoming row whatever the size of the blocks.  Equal rows come together by
    block and id number, to as many tasks as the registry has rows for (`TASK_ROWS` each).
    """
    compared = ["nik"] + [c for c in master.columns if c.endswith("_master_clean")]
    entries = with_blocks(master.select(*compared), rule.master_keys())
    tasks = max(
        master.sparkSession.sparkContext.defaultParallelism,
        -(-master.count() * sum(not b.covered for b in rule.branches) // TASK_ROWS),
    )
    sizes = (
        entries.repartition(tasks, BLOCK, "nik")
        .groupBy(BLOCK, *compared).agg(F.lit(1).alias("one"))
        .groupBy(BLOCK).agg(F.count("one").alias("size"))
    )
    ids = ["file_id", "id"]
    # Keys are long expressions; written once, they are not computed again in
    # every filter the join derives from them.
    keyed = settle(with_blocks(incoming, rule.incoming_keys()).select(*ids, BLOCK), "keys")
    found = keyed.join(sizes, BLOCK).groupBy(*ids).agg(F.sum("size").alias("n_candidates"))
    return (
        incoming.select(*ids).distinct().join(found, ids, "left")
        .select(*ids, F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"))
    )
