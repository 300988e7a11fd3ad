"""Why a review row and its registry partner differ.

Each pair of rows is reduced to a pattern: the status of five fields.  There
are at most 4^5 patterns whatever the number of rows, so explanations are made
once per pattern, kept as templates in a pattern table, and filled in per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from linkspan import codes
from linkspan.functions import text as tx
from linkspan.operators.spread import first_of_wanted, join_unique
from linkspan.sources.scratch import settle

SAME, EMPTY_IN, EMPTY_MASTER, DIFFERENT = "SAMA", "KOSONG_INCOMING", "KOSONG_MASTER", "BEDA"
FIELDS = tuple(field for field, _ in codes.PATTERN_FIELDS)

_PAIR_FIELDS = (
    ("nama_incoming", "nama_lengkap"),
    ("tempat_lahir_incoming", "tempat_lahir"),
    ("tanggal_lahir_incoming", "tanggal_lahir"),
    ("jenis_kelamin_incoming", "jenis_kelamin"),
    ("nama_ibu_incoming", "nama_ibu"),
)
PATTERN_SCHEMA = (
    "pattern_hash string, pattern_name string, pattern_signature string, "
    "reason_template string, sample_id long, hit_count long, "
    "created_at timestamp, updated_at timestamp"
)


def comparison_pairs(manual: DataFrame, results: DataFrame, master: DataFrame,
                     statuses: tuple[str, ...] | None = (codes.PENDING, codes.FAILED),
                     limit: int | None = None) -> DataFrame:
    """Open review rows beside the registry row they are compared with.

    A row with a nik of its own meets the registry on it; a row without one
    takes the partner found by the match.  Each review row appears once.
    `statuses=None` takes rows of any status (a single row asked for by id). `limit` takes
    the first so many of them by id, none all.
    """
    if statuses is not None:
        manual = manual.filter(F.col("reasoning_status").isin(*statuses))
    if limit is not None:
        manual = manual.orderBy("id").limit(limit)
    row = manual.select(
        "id", "file_id", "id_incoming", "nik_incoming",
        *[F.col(source).alias(name) for source, name in _PAIR_FIELDS],
    )
    registry = master.select(
        F.col("nik").alias("join_nik"), *[F.col(f).alias(f"master_{f}") for f in FIELDS]
    )
    no_nik = ~tx.filled(F.col("nik_incoming"))
    found = results.filter(F.col("nik_master").isNotNull()).select("file_id", "id_incoming", "nik_master")
    own = row.filter(~no_nik).withColumn("join_nik", F.col("nik_incoming"))
    matched = (
        row.filter(no_nik).join(found, ["file_id", "id_incoming"])
        .withColumn("join_nik", F.col("nik_master")).drop("nik_master")
    )
    # Both paths exclude each other, so one join with the registry serves both.
    asked = settle(own.unionByName(matched), "asked")
    registry = first_of_wanted(registry, "join_nik", asked)
    pairs = join_unique(asked, registry, "join_nik", ["file_id", "id"], "inner").drop("join_nik")
    rest = [c for c in pairs.columns if c != "id"]
    one = pairs.groupBy("id").agg(F.min(F.struct(*rest)).alias("pair"))
    return one.select("id", *[F.col(f"pair.{c}").alias(c) for c in rest])


def _gender(value: Column) -> Column:
    return F.coalesce(tx.canonical(value, codes.PATTERN_GENDER_WORDS), tx.clean_text(value))


def _status(field: str) -> Column:
    mine, theirs = F.col(field).cast("string"), F.col(f"master_{field}").cast("string")
    plain = _gender if field == "jenis_kelamin" else tx.clean_text
    return (
        F.when(tx.blank_like(mine) & tx.blank_like(theirs), SAME)
        .when(tx.blank_like(mine), EMPTY_IN)
        .when(tx.blank_like(theirs), EMPTY_MASTER)
        .when(plain(mine) != plain(theirs), DIFFERENT)
        .otherwise(SAME)
    )


def detect_patterns(pairs: DataFrame) -> DataFrame:
    """Add status_<field>, pattern_signature, pattern_hash and pattern_name_suffix."""
    stated = pairs.withColumns({f"status_{f}": _status(f) for f in FIELDS})
    signature = F.concat_ws(
        "|", *[F.concat(F.lit(f"{f}:"), F.col(f"status_{f}")) for f in sorted(FIELDS)]
    )
    parts = [
        F.when(F.col(f"status_{field}") == EMPTY_IN, f"{short}_KOSONG")
        .when(F.col(f"status_{field}") == EMPTY_MASTER, f"{short}_KOSONG_MASTER")
        .when(F.col(f"status_{field}") == DIFFERENT, f"{short}_BEDA")
        for field, short in codes.PATTERN_FIELDS
    ]
    named = F.concat_ws("__", *parts)
    return stated.withColumns({
        "pattern_signature": signature,
        "pattern_name_suffix": F.when(named == "", "SEMUA_SAMA").otherwise(named),
    }).withColumn("pattern_hash", F.sha2("pattern_signature", 256))


def _shown(value: Column, kind: str) -> Column:
    """A value as it stands in a reason; nothing shows as EMPTY."""
    text = F.date_format(value, "dd-MM-yyyy") if kind == "date" else value.cast("string")
    stripped = tx.strip(text)
    nothing = F.coalesce(F.lower(stripped).isin("none", "null", "nan", "", "kosong"), F.lit(True))
    return F.when(nothing, "EMPTY").otherwise(stripped)


_LABELS = {
    "nama_lengkap": "Full Name",
    "tempat_lahir": "Place of Birth",
    "tanggal_lahir": "Date of Birth",
    "jenis_kelamin": "Gender",
    "nama_ibu": "Mother's Name",
}


def describe(pairs: DataFrame) -> Column:
    """Text that names only the fields which differ, with both values.

    Needs the status columns.
    """
    kinds = dict(pairs.dtypes)
    lines = [
        F.when(
            F.col(f"status_{f}") != SAME,
            F.concat(
                F.lit(f"{_LABELS[f]}: "), _shown(F.col(f), kinds[f]), F.lit(" vs "),
                _shown(F.col(f"master_{f}"), kinds[f"master_{f}"]),
            ),
        )
        for f in FIELDS
    ]
    text = F.concat_ws("; ", *lines)
    return F.when(text == "", "No difference").otherwise(text)


_PLACEHOLDERS = tuple(
    (column, f"{{{side}.{field}}}")
    for field in ("nama_lengkap", "tempat_lahir", "tanggal_lahir", "nama_ibu")
    for side, column in (("incoming", field), ("master", f"master_{field}"))
)


_NEVER = "(?!)"  # matches nothing


def to_template(pairs: DataFrame, reason: Column) -> Column:
    """The reason with the row's own values replaced by placeholders.

    Case is ignored; values that only say "nothing" are not replaced.
    """
    kinds = dict(pairs.dtypes)
    out = reason
    for column, placeholder in _PLACEHOLDERS:
        is_date = kinds[column] == "date"
        value = F.date_format(column, "dd-MM-yyyy") if is_date else F.col(column).cast("string")
        nothing = F.coalesce(
            (tx.strip(value) == "") | F.lower(value).isin("null", "none", "kosong", "empty"),
            F.lit(True),
        )
        quoted = F.concat(F.lit(r"(?iu)\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        # The pattern, not the result, depends on the value: the text before
        # stays a single expression however many placeholders there are.
        pattern = F.when(nothing, F.lit(_NEVER)).otherwise(quoted)
        out = F.regexp_replace(out, pattern, F.lit(placeholder))
    return out


def fill_template(pairs: DataFrame, template: Column) -> Column:
    """The template with its placeholders replaced by the row's values."""
    kinds = dict(pairs.dtypes)
    out = template
    for column, placeholder in _PLACEHOLDERS:
        out = F.replace(out, F.lit(placeholder), _shown(F.col(column), kinds[column]))
    return out


def new_patterns(detected: DataFrame, known: DataFrame, now: Column) -> DataFrame:
    """Pattern rows for hashes the table does not hold yet.

    The row with the smallest id stands for its pattern; numbers go on after
    the patterns already known, in the order of those ids.  At most 4^5 rows
    leave the aggregation, so numbering them in one window is safe.
    """
    fresh = detected.join(F.broadcast(known.select("pattern_hash")), "pattern_hash", "left_anti")
    firsts = fresh.groupBy("pattern_hash").agg(
        F.min_by(F.struct(*[c for c in fresh.columns if c != "pattern_hash"]), "id").alias("row")
    ).select("pattern_hash", "row.*")
    firsts = firsts.withColumns({
        "reason_template": to_template(firsts, describe(firsts)),
        "sample_id": F.col("id").cast("long"),
    })
    already = known.agg(F.count(F.lit(1)).alias("n")).scalar()
    number = F.row_number().over(Window.orderBy("sample_id")) + already
    return firsts.select(
        "pattern_hash",
        F.format_string("P%03d_%s", number, "pattern_name_suffix").alias("pattern_name"),
        "pattern_signature", "reason_template", "sample_id", F.lit(1).cast("long").alias("hit_count"),
        now.alias("created_at"), now.alias("updated_at"),
    )


def explain(pairs: DataFrame, known: DataFrame, now: Column, dry_run: bool = False) -> DataFrame:
    """Reason, pattern name and source of every pair.

    The first row of a new pattern is described (source LLM, the name the
    stored rows use for a fresh explanation); every other row is filled from a
    template (source CACHE).  In a dry run nothing is known and nothing stored.
    """
    if dry_run:
        detected = detect_patterns(pairs)
        return detected.select(
            "id", "file_id", "pattern_hash",
            describe(detected).alias("reason"),
            F.concat(F.lit("DRY_RUN_"), "pattern_name_suffix").alias("pattern_name"),
            F.lit("LLM").alias("source"),
        )
    detected = settle(detect_patterns(pairs), "detected")  # read twice below
    wanted = ["pattern_hash", "pattern_name", "reason_template", "sample_id"]
    table = known.select(*wanted, F.lit(False).alias("is_new")).unionByName(
        new_patterns(detected, known, now).select(*wanted, F.lit(True).alias("is_new"))
    )
    joined = detected.join(F.broadcast(table), "pattern_hash", "left")  # at most 4^5 rows
    fresh = F.col("is_new") & (F.col("sample_id") == F.col("id"))
    return joined.select(
        "id", "file_id", "pattern_hash",
        F.when(fresh, describe(joined)).otherwise(fill_template(joined, F.col("reason_template"))).alias("reason"),
        "pattern_name",
        F.when(fresh, "LLM").otherwise("CACHE").alias("source"),
    )


def count_hits(known: DataFrame, explained: DataFrame, now: Column) -> DataFrame:
    """Pattern table with one more hit per row filled from it."""
    hits = explained.filter(F.col("source") == "CACHE").groupBy("pattern_hash").agg(
        F.count(F.lit(1)).alias("hits")
    )
    return known.join(F.broadcast(hits), "pattern_hash", "left").withColumns({
        "hit_count": F.col("hit_count") + F.coalesce("hits", F.lit(0)),
        "updated_at": F.when(F.col("hits").isNotNull(), now).otherwise(F.col("updated_at")),
    }).drop("hits")


def write_back(manual: DataFrame, explained: DataFrame) -> DataFrame:
    """Review rows with their reasons; rows asked for that have no partner failed.

    `explained` may hold rows with a null reason: those failed.
    """
    new = explained.select(
        "id", F.col("reason").alias("new_reason"), F.col("pattern_name").alias("new_name"),
        F.col("source").alias("new_source"),
        F.when(F.col("reason").isNull(), codes.FAILED).otherwise(codes.COMPLETED).alias("new_status"),
    )
    return (
        manual.join(new, "id", "left")
        .withColumns({
            "reason": F.coalesce("new_reason", "reason"),
            "pattern_name": F.coalesce("new_name", "pattern_name"),
            "reasoning_source": F.coalesce("new_source", "reasoning_source"),
            "reasoning_status": F.coalesce("new_status", "reasoning_status"),
        })
        .drop("new_reason", "new_name", "new_source", "new_status")
    )


def mark_processing(manual: DataFrame) -> DataFrame:
    """Open rows are being worked on."""
    waiting = F.col("reasoning_status").isin(codes.PENDING, codes.FAILED)
    return manual.withColumn(
        "reasoning_status", F.when(waiting, codes.PROCESSING).otherwise(F.col("reasoning_status"))
    )


def files_after_reasons(files: DataFrame, manual: DataFrame) -> DataFrame:
    """Files in progress whose review rows are all explained (or failed) await action.

    Files in any other state, such as closed ones, keep it.
    """
    unfinished = F.col("reasoning_status").isin(codes.PENDING, codes.PROCESSING)
    open_rows = manual.groupBy("file_id").agg(F.count_if(unfinished).alias("open_rows"))
    return (
        files.join(open_rows, "file_id", "left")
        .withColumn(
            "sync_status",
            F.when(
                (F.col("open_rows") == 0) & (F.col("sync_status") == codes.SYNC_IN_PROGRESS), codes.SYNC_AWAITING
            ).otherwise(F.col("sync_status")),
        )
        .drop("open_rows")
    )


def reason_summary(explained: DataFrame) -> DataFrame:
    """Rows explained per file and source."""
    return explained.groupBy("file_id", "source").agg(F.count(F.lit(1)).alias("n_rows"))
