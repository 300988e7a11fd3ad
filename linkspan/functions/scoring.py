"""Score profiles: how much each attribute of a record counts, and how.

One formula serves two places.  On columns it builds a Spark expression; on
Arrow batches (inside the blocked join, where only the best partner of a record
may leave the task) it works on whole arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspan import codes
from linkspan.functions import text as tx
from linkspan.functions.similarity import jaro_winkler, jaro_winkler_arrow

TIE_DIGITS = 9  # scores equal to this many decimals are ties


@dataclass(frozen=True)
class Term:
    """One attribute: its weight and how the two sides are compared.

    how: "jw" (similarity of the text), "exact" (equal or not) or "area"
    (mean similarity over the region levels present on both sides).
    always: the weight counts even when the incoming value is missing.
    """

    field: str
    weight: float
    how: str = "jw"
    always: bool = False


@dataclass(frozen=True)
class ScoreProfile:
    """A weighted sum on the scale 0-100.

    With `renormalise` the sum is divided by the weights of the attributes that
    are present, so a missing attribute neither helps nor hurts.
    `missing` lists what counts as a missing attribute; a tuple is missing when
    all its members are.
    """

    name: str
    grade: int
    terms: tuple[Term, ...]
    renormalise: bool = False
    missing: tuple = ()

    @property
    def fields(self) -> tuple[str, ...]:
        names: list[str] = []
        for term in self.terms:
            names += codes.AREA_COLUMNS if term.how == "area" else [term.field]
        return tuple(names)

    def ceiling_without(self, field: str) -> float:
        """Highest score a pair can reach when `field` is not equal."""
        total = sum(t.weight for t in self.terms)
        lost = sum(t.weight for t in self.terms if t.field == field and t.how == "exact")
        return 100.0 * (total - lost) / total


# Weights per grade.  The first five compare dates exactly, the *_text ones
# compare the date's text.
PROFILE_A = ScoreProfile("a", 1, (Term("nama", 1.0),))
PROFILE_B = ScoreProfile(
    "b", 2,
    (Term("nama", 0.8), Term("tempat_lahir", 0.1), Term("nama_ibu", 0.1)),
    missing=("nama", "tempat_lahir", "nama_ibu"),
)
PROFILE_C = ScoreProfile(
    "c", 3,
    (Term("nama", 0.6), Term("tempat_lahir", 0.2), Term("tanggal_lahir", 0.2, "exact")),
)
PROFILE_D = ScoreProfile(
    "d", 4,
    (
        Term("nama", 0.6, always=True),
        Term("tempat_lahir", 0.05),
        Term("tanggal_lahir", 0.3, "exact"),
        Term("nama_ibu", 0.05),
    ),
    renormalise=True,
    missing=("tanggal_lahir", "tempat_lahir", "nama_ibu"),
)
PROFILE_E = ScoreProfile(
    "e", 5,
    (
        Term("nama", 0.5),
        Term("tanggal_lahir", 0.1, "exact"),
        Term("area", 0.3, "area"),
        Term("nama_ibu", 0.1),
    ),
    renormalise=True,
    missing=("nama", "tanggal_lahir", codes.AREA_COLUMNS, "nama_ibu"),
)
PROFILE_C_TEXT = ScoreProfile(
    "c_text", 3, (Term("nama", 0.6), Term("tempat_lahir", 0.2), Term("tanggal_lahir", 0.2))
)
PROFILE_D_TEXT = ScoreProfile(
    "d_text", 4,
    (
        Term("nama", 0.6),
        Term("tempat_lahir", 0.05),
        Term("nama_ibu", 0.05),
        Term("tanggal_lahir", 0.3),
    ),
    missing=("tanggal_lahir", "tempat_lahir", "nama_ibu"),
)
PROFILE_E_TEXT = ScoreProfile(
    "e_text", 5,
    (
        Term("nama", 0.5),
        Term("area", 0.3, "area"),
        Term("nama_ibu", 0.1),
        Term("tanggal_lahir", 0.1),
    ),
    renormalise=True,
    missing=("nama", "tanggal_lahir", codes.AREA_COLUMNS, "nama_ibu"),
)
PROFILES = {1: PROFILE_A, 2: PROFILE_B, 3: PROFILE_C, 4: PROFILE_D, 5: PROFILE_E}
TEXT_DATE_PROFILES = {
    1: PROFILE_A, 2: PROFILE_B, 3: PROFILE_C_TEXT, 4: PROFILE_D_TEXT, 5: PROFILE_E_TEXT,
}
#: Profiles by name, as a rule table names them.
ALL_PROFILES = {p.name: p for p in [*PROFILES.values(), *TEXT_DATE_PROFILES.values()]}


class _OnColumns:
    zero = F.lit

    def similar(self, a, b):
        return jaro_winkler(a, b)

    def equal(self, a, b):
        return F.coalesce((a == b).cast("double"), F.lit(0.0))

    def filled(self, a):
        return tx.filled(a)

    def where(self, test, then, other):
        return F.when(test, then).otherwise(other)


class _OnArrays:
    def similar(self, a, b):
        return jaro_winkler_arrow(a, b)

    def equal(self, a, b):
        return pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False).astype(float)

    def filled(self, a):
        return pc.fill_null(pc.not_equal(a, ""), False).to_numpy(zero_copy_only=False)

    def where(self, test, then, other):
        return np.where(test, then, other)


def _value(term: Term, pair, on):
    """(similarity, is it to be counted) of one term."""
    if term.how == "area":
        total, levels = 0.0, 0.0
        for field in codes.AREA_COLUMNS:
            a, b = pair(field)
            both = on.filled(a) & on.filled(b)
            total = on.where(both, on.similar(a, b), 0.0) + total
            levels = on.where(both, 1.0, 0.0) + levels
        return on.where(levels > 0, total / on.where(levels > 0, levels, 1.0), 0.0), levels > 0
    a, b = pair(term.field)
    return (on.equal if term.how == "exact" else on.similar)(a, b), on.filled(a)


def _formula(profile: ScoreProfile, pair, on):
    gained, possible = 0.0, 0.0
    for term in profile.terms:
        value, counted = _value(term, pair, on)
        if profile.renormalise and not term.always:
            gained = on.where(counted, value * term.weight, 0.0) + gained
            possible = on.where(counted, term.weight, 0.0) + possible
        else:
            gained = value * term.weight + gained
            possible = possible + term.weight
    if not profile.renormalise:
        return gained * 100.0
    if isinstance(possible, float):
        return gained / possible * 100.0
    return on.where(possible > 0, gained / on.where(possible > 0, possible, 1.0), 0.0) * 100.0


def score_column(profile: ScoreProfile) -> Column:
    """Score of a pair row with columns <field>_clean and <field>_master_clean."""
    pair = lambda f: (
        F.col(f"{f}_clean").cast("string"),
        F.col(f"{f}_master_clean").cast("string"),
    )
    return _formula(profile, pair, _OnColumns())


def score_batch(profile: ScoreProfile, batch: pa.RecordBatch) -> np.ndarray:
    """Scores of an Arrow batch with string columns a_<field> and b_<field>."""
    pair = lambda f: (batch.column(f"a_{f}"), batch.column(f"b_{f}"))
    return np.round(_formula(profile, pair, _OnArrays()), TIE_DIGITS)


def missing_count(profile: ScoreProfile) -> Column:
    """Number of missing attributes of an incoming row (<field>_clean columns)."""
    total = F.lit(0)
    for item in profile.missing:
        members = (item,) if isinstance(item, str) else item
        present = F.lit(False)
        for field in members:
            present = present | tx.filled(F.col(f"{field}_clean"))
        total = total + F.when(present, 0).otherwise(1)
    return total


# Thresholds used when no rule table is given (our own choice, scale 0-100):
# grade, auto_missing_max, auto_score_min, review_missing_count,
# review_score_min, review_score_max
DEFAULT_RULES = (
    (1, None, 80.0, None, 80.0, 80.0),
    (2, 1, 85.0, None, 70.0, 100.01),
    (3, None, 85.0, None, 70.0, 85.0),
    (4, 1, 85.0, None, 70.0, 100.01),
    (5, 1, 85.0, None, 70.0, 100.01),
)
RULE_SCHEMA = (
    "grade_code int, auto_missing_max int, auto_score_min double, "
    "review_missing_count int, review_score_min double, review_score_max double"
)


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFAULT_RULES), RULE_SCHEMA)


def with_rules(scored: DataFrame, rules: DataFrame, grade: str = "grade") -> DataFrame:
    """Attach the thresholds of each row's grade.

    One row per grade is kept, so at most five rows are broadcast.
    """
    table = (
        rules.filter(F.col("grade_code").between(1, 5))
        .dropDuplicates(["grade_code"])
        .withColumnRenamed("grade_code", grade)
    )
    return scored.join(F.broadcast(table), grade, "left")


def classify(score: Column, missing: Column) -> Column:
    """Automatic match, manual review or unmatched; needs the rule columns."""
    auto = (
        F.col("auto_missing_max").isNull() | (missing <= F.col("auto_missing_max"))
    ) & (score >= F.col("auto_score_min"))
    review = (
        F.col("review_missing_count").isNull() | (missing == F.col("review_missing_count"))
    ) & (score >= F.col("review_score_min")) & (score < F.col("review_score_max"))
    return (
        F.when(auto, codes.AUTO_MATCH)
        .when(review, codes.REVIEW)
        .otherwise(codes.AUTO_UNMATCH)
    )
