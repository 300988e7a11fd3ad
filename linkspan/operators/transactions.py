"""Sample job: transactions checked against the registry of merchants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspan.functions.similarity import jaro_winkler


def clean_transactions(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "customer_name": F.coalesce("customer_name", F.lit("UNKNOWN")),
        "merchant_name": F.upper("merchant_name"),
        "status": F.upper("status"),
        "amount": F.coalesce("amount", F.lit(0)),
    })


def name_score(left: str, right: str) -> Column:
    """Similarity to four decimals; 0 when a name is null."""
    both_empty = (F.col(left) == "") & (F.col(right) == "")
    score = F.when(F.coalesce(both_empty, F.lit(False)), 1.0).otherwise(jaro_winkler(left, right))
    return F.round(score, 4)


def name_grade(score: Column) -> Column:
    return F.when(score >= 0.98, "A").when(score >= 0.90, "B").when(score >= 0.75, "C").otherwise("D")


def grade_transactions(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """Incoming transactions with the registered merchant, score and grade."""
    known = registry.select(
        "transaction_id", F.upper("merchant_name").alias("master_merchant_name")
    )
    scored = clean_transactions(incoming).join(known, "transaction_id", "left").withColumn(
        "match_score", name_score("merchant_name", "master_merchant_name")
    )
    return scored.withColumn("grade", name_grade(F.col("match_score")))


def grade_counts(graded: DataFrame) -> DataFrame:
    of = lambda g: F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}")
    return graded.agg(F.count(F.lit(1)).alias("total_rows"), *[of(g) for g in "ABCD"])
