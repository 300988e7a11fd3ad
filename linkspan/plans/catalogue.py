"""Every operator as a query over the given tables, with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspan import codes
from linkspan.functions import scoring as sc
from linkspan.functions import text as tx
from linkspan.functions.similarity import jaro_winkler
from linkspan.operators import (
    audit, blocking, conversations, documents, grading, matching, reasons, reports, review,
    search, spread, transactions,
)
from linkspan.operators.clean import clean_incoming, clean_master
from linkspan.plans import pipeline
from linkspan.plans.fixtures import derive, scan, with_tables
from linkspan.sources import intake, tables
from linkspan.sources.scratch import fresh_path, settle
from linkspan.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

NOW = "2024-01-20 12:00:00"
ONE_FILE, REVIEWED_FILE, EXPORTED_FILE = "f3", "f2", "f1"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def keep(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return function(spark, sf_dir)

        QUERIES[function.__name__] = run
        if sql is not None:
            CHECKS[function.__name__] = sql
        return function

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/{name}.parquet")


def _incoming(spark, sf_dir):
    return clean_incoming(derive(spark, sf_dir, "incoming_v"))


def _master(spark, sf_dir):
    return clean_master(derive(spark, sf_dir, "master_v"))


def _now():
    return F.lit(NOW).cast("timestamp")


# --- cleaning -----------------------------------------------------------------

_DATE_SQL = (
    "cast(coalesce(" + ", ".join(
        f"try_strptime(trim(lower(tanggal_lahir)), '{f}')"
        for f in ("%d/%m/%Y", "%d-%m-%Y", "%d %m %Y", "%d-%b-%Y", "%d %B %Y", "%Y-%m-%d")
    ) + ") as date)"
)
_GENDER_SQL = (
    "CASE WHEN trim(lower(jenis_kelamin)) IN ('laki-laki','laki laki','pria','male','l') THEN 'l'"
    " WHEN trim(lower(jenis_kelamin)) IN ('perempuan','wanita','female','p') THEN 'p' END"
)
_TEXT = codes.TEXT_COLUMNS
_CLEAN_INCOMING = (
    "SELECT file_id, id, trim(nik) AS nik, "
    + ", ".join(f"trim(lower({c})) AS {c}_clean" for c in _TEXT)
    + f", CASE WHEN year({_DATE_SQL}) >= 1900 THEN {_DATE_SQL} END AS tanggal_lahir_clean"
    + f", {_GENDER_SQL} AS jenis_kelamin_clean"
    + ", CASE WHEN trim(lower(status_hidup)) IN ('hidup','h') THEN 'h'"
    " WHEN trim(lower(status_hidup)) IN ('meninggal','mati','wafat','m') THEN 'm' END AS status_hidup_clean"
    " FROM incoming_v"
)
_CLEAN_MASTER = (
    "SELECT nik, "
    + ", ".join(
        f"trim(lower({'nama_lengkap' if c == 'nama' else c})) AS {c}_master_clean" for c in _TEXT
    )
    + ", try_cast(tanggal_lahir AS date) AS tanggal_lahir_master_clean"
    + f", {_GENDER_SQL} AS jenis_kelamin_master_clean"
    + ", CASE WHEN status_kematian IN ('hidup','h') THEN 'h'"
    " WHEN status_kematian IN ('meninggal','mati','wafat','m') THEN 'm' END AS status_hidup_master_clean"
    " FROM master_v"
)
_CLEAN = dict(inc=_CLEAN_INCOMING, mas=_CLEAN_MASTER)


@query(with_tables("incoming_v", **_CLEAN) + "SELECT * FROM inc")
def clean_incoming_rows(spark, sf_dir):
    df = _incoming(spark, sf_dir)
    return df.select("file_id", "id", "nik", *[c for c in df.columns if c.endswith("_clean")])


@query(with_tables("incoming_v", **_CLEAN) + "SELECT * FROM mas")
def clean_master_rows(spark, sf_dir):
    df = _master(spark, sf_dir)
    return df.select("nik", *[c for c in df.columns if c.endswith("_clean")])


# --- profile and grade --------------------------------------------------------

def _profile_sql() -> str:
    parts = ["file_id", "count(*) AS total_rows"]
    for c in codes.GRADED_COLUMNS:
        parts.append(f"count({c}) / count(*) AS {c}_nonnull")
        parts.append(f"count(*) - count({c}) AS {c}_null_count")
    parts.append("count(*) FILTER (WHERE length(nik) = 16) / count(*) AS nik_len16")
    parts.append("count(*) FILTER (WHERE length(nik) <> 16) AS nik_not_len16_count")
    return f"SELECT {', '.join(parts)} FROM upload_rows_v GROUP BY file_id"


_PERSON = codes.GRADED_COLUMNS[1:]
_MOSTLY_SQL = (
    "nama_null_count = 0 AND tempat_lahir_nonnull >= 0.7 AND tanggal_lahir_nonnull >= 0.7"
    " AND jenis_kelamin_nonnull >= 0.7 AND nama_ibu_nonnull >= 0.6"
)
_FULL_SQL = " AND ".join(f"{c}_null_count = 0" for c in _PERSON)
_GRADE_SQL = (
    "SELECT p.file_id, total_rows, cast(CASE"
    f" WHEN header LIKE '%,nik,%' AND nik_null_count = 0 AND {_FULL_SQL} AND nik_not_len16_count = 0 THEN 1"
    f" WHEN header LIKE '%,nik,%' AND nik_len16 >= 0.7 AND {_MOSTLY_SQL} THEN 2"
    f" WHEN header NOT LIKE '%,nik,%' AND {_FULL_SQL} THEN 3"
    f" WHEN header NOT LIKE '%,nik,%' AND {_MOSTLY_SQL} THEN 4 ELSE 5 END as int) AS grade"
    " FROM prof p JOIN upload_headers_v h ON p.file_id = h.file_id"
)


def _profiles(spark, sf_dir):
    return grading.profile_files(derive(spark, sf_dir, "upload_rows_v"))


def _grades(spark, sf_dir):
    headers = derive(spark, sf_dir, "upload_headers_v")
    return grading.grade_files(_profiles(spark, sf_dir).join(headers, "file_id"))


@query(with_tables("upload_rows_v") + _profile_sql())
def file_profile(spark, sf_dir):
    return _profiles(spark, sf_dir)


@query(with_tables("upload_rows_v", "upload_headers_v", prof=_profile_sql()) + _GRADE_SQL)
def file_grade(spark, sf_dir):
    return _grades(spark, sf_dir).select("file_id", "total_rows", "grade")


@query(
    with_tables("upload_rows_v", "upload_headers_v", "files_v", prof=_profile_sql(), graded=_GRADE_SQL)
    + f"SELECT f.file_id, coalesce(g.grade, f.grade) AS grade, 2 AS processing_status,"
    f" CASE WHEN g.grade IS NULL THEN f.upload_timestamp ELSE timestamp '{NOW}' END AS upload_timestamp"
    " FROM files_v f LEFT JOIN graded g ON f.file_id = g.file_id"
)
def files_after_grading(spark, sf_dir):
    files = grading.apply_grades(derive(spark, sf_dir, "files_v"), _grades(spark, sf_dir), _now())
    return files.select("file_id", "grade", "processing_status", "upload_timestamp")


@query(
    with_tables("upload_rows_v", "upload_headers_v", prof=_profile_sql(), graded=_GRADE_SQL)
    + "SELECT file_id, total_rows * 4 AS total_rows, grade FROM graded"
)
def grade_repeated_file(spark, sf_dir):
    """The grading load test: the same rows several times over."""
    rows = spread.repeat_rows(derive(spark, sf_dir, "upload_rows_v"), 4)
    headers = derive(spark, sf_dir, "upload_headers_v")
    graded = grading.grade_files(grading.profile_files(rows).join(headers, "file_id"))
    return graded.select("file_id", "total_rows", "grade")


# --- matching -----------------------------------------------------------------

_BLOCK_SQL = {
    1: "i.nik = m.nik",
    3: "i.jenis_kelamin_clean = m.jenis_kelamin_master_clean"
       " AND day(i.tanggal_lahir_clean) = day(m.tanggal_lahir_master_clean)"
       " AND month(i.tanggal_lahir_clean) = month(m.tanggal_lahir_master_clean)"
       " AND left(i.nama_clean, 3) = left(m.nama_master_clean, 3)",
    5: "i.status_hidup_clean = m.status_hidup_master_clean AND i.nama_clean <> '' AND m.nama_master_clean <> ''"
       " AND left(i.nama_clean, 3) = left(m.nama_master_clean, 3)"
       " AND day(i.tanggal_lahir_clean) = day(m.tanggal_lahir_master_clean)"
       " AND month(i.tanggal_lahir_clean) = month(m.tanggal_lahir_master_clean)",
}
_BLOCK_SQL[2] = _BLOCK_SQL[1]
_DATE_EQ = (
    " AND day(i.tanggal_lahir_clean) = day(m.tanggal_lahir_master_clean)"
    " AND month(i.tanggal_lahir_clean) = month(m.tanggal_lahir_master_clean)"
)
_D_BRANCHES = (
    "i.jenis_kelamin_clean IS NULL AND i.tempat_lahir_clean <> '' AND m.tempat_lahir_master_clean <> ''"
    " AND left(i.tempat_lahir_clean, 3) = left(m.tempat_lahir_master_clean, 3)" + _DATE_EQ,
    "i.tempat_lahir_clean IS NULL AND i.jenis_kelamin_clean = m.jenis_kelamin_master_clean"
    " AND i.nama_clean <> '' AND m.nama_master_clean <> ''"
    " AND left(i.nama_clean, 3) = left(m.nama_master_clean, 3)" + _DATE_EQ,
    "i.tanggal_lahir_clean IS NULL AND i.jenis_kelamin_clean = m.jenis_kelamin_master_clean"
    " AND i.tempat_lahir_clean <> '' AND m.tempat_lahir_master_clean <> ''"
    " AND left(i.tempat_lahir_clean, 3) = left(m.tempat_lahir_master_clean, 3)"
    " AND i.nama_clean <> '' AND m.nama_master_clean <> ''"
    " AND left(i.nama_clean, 3) = left(m.nama_master_clean, 3)",
    "i.jenis_kelamin_clean = m.jenis_kelamin_master_clean"
    " AND left(i.nama_clean, 3) = left(m.nama_master_clean, 3)" + _DATE_EQ,
)


def _pairs_sql(grade: int) -> str:
    columns = "i.*, m.nik AS nik_master, m.* EXCLUDE (nik)"
    if grade != 4:
        return f"SELECT {columns} FROM inc i JOIN mas m ON {_BLOCK_SQL[grade]}"
    return "SELECT DISTINCT * FROM (" + " UNION ALL ".join(
        f"SELECT {columns} FROM inc i JOIN mas m ON {b}" for b in _D_BRANCHES
    ) + ")"


def _jw(field: str) -> str:
    a, b = f"cast({field}_clean as varchar)", f"cast({field}_master_clean as varchar)"
    return (
        f"(CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 0.0::double"
        f" ELSE jaro_winkler_similarity({a}, {b}) END)"
    )


def _has(field: str, side: str = "clean") -> str:
    return f"(coalesce(cast({field}_{side} as varchar), '') <> '')"


def _score_sql(profile: sc.ScoreProfile) -> str:
    gained, possible = [], []
    for t in profile.terms:
        w = f"{t.weight}::double"
        if t.how == "area":
            both = [f"({_has(f)} AND {_has(f, 'master_clean')})" for f in codes.AREA_COLUMNS]
            levels = " + ".join(f"cast({b} as int)" for b in both)
            total = " + ".join(
                f"(CASE WHEN {b} THEN {_jw(f)} ELSE 0 END)" for b, f in zip(both, codes.AREA_COLUMNS)
            )
            value, counted = f"(({total}) / nullif({levels}, 0))", f"({levels} > 0)"
        elif t.how == "exact":
            value = f"(CASE WHEN {t.field}_clean = {t.field}_master_clean THEN 1.0::double ELSE 0.0::double END)"
            counted = _has(t.field)
        else:
            value, counted = _jw(t.field), _has(t.field)
        if profile.renormalise and not t.always:
            gained.append(f"(CASE WHEN {counted} THEN {value} * {w} ELSE 0 END)")
            possible.append(f"(CASE WHEN {counted} THEN {w} ELSE 0 END)")
        else:
            gained.append(f"{value} * {w}")
            possible.append(w)
    if not profile.renormalise:
        return f"({' + '.join(gained)}) * 100"
    return f"coalesce(({' + '.join(gained)}) / nullif({' + '.join(possible)}, 0), 0) * 100"


def _missing_sql(profile: sc.ScoreProfile) -> str:
    parts = ["0"]
    for item in profile.missing:
        members = (item,) if isinstance(item, str) else item
        parts.append(f"cast(NOT ({' OR '.join(_has(f) for f in members)}) as int)")
    return " + ".join(parts)


_RULES_SQL = "SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if v is None else f"{v}::double" if isinstance(v, float) else str(v) for v in row) + ")"
    for row in sc.DEFAULT_RULES
) + ") r(grade_code, auto_missing_max, auto_score_min, review_missing_count, review_score_min, review_score_max)"


def _match_parts(profile: sc.ScoreProfile, pairs: str | None = None) -> dict[str, str]:
    """Texts that end in `matched`: one result row per incoming row."""
    grade = profile.grade
    return dict(
        **_CLEAN,
        pairs=pairs or _pairs_sql(grade),
        rules=_RULES_SQL,
        scored=f"SELECT file_id, id, nik_master, round({_score_sql(profile)}, 9) AS score FROM pairs",
        best="SELECT file_id, id, max(score) AS score, arg_min(nik_master, (-score, nik_master)) AS nik_master"
             " FROM scored GROUP BY file_id, id",
        matched="SELECT i.file_id, i.id AS id_incoming, b.nik_master,"
                " CASE WHEN b.nik_master IS NULL THEN 0 ELSE round(b.score, 2) END AS match_score,"
                f" {_missing_sql(profile)} AS missing_count,"
                " cast(CASE WHEN b.nik_master IS NULL THEN 3"
                f" WHEN (r.auto_missing_max IS NULL OR ({_missing_sql(profile)}) <= r.auto_missing_max)"
                "  AND b.score >= r.auto_score_min THEN 1"
                f" WHEN (r.review_missing_count IS NULL OR ({_missing_sql(profile)}) = r.review_missing_count)"
                "  AND b.score >= r.review_score_min AND b.score < r.review_score_max THEN 2"
                " ELSE 3 END as int) AS match_result"
                " FROM inc i LEFT JOIN best b ON i.file_id = b.file_id AND i.id = b.id"
                f" JOIN rules r ON r.grade_code = {grade}",
    )


def _match_sql(profile: sc.ScoreProfile, pairs: str | None = None) -> str:
    return with_tables("incoming_v", **_match_parts(profile, pairs)) + "SELECT * FROM matched"


def _link(spark, sf_dir, grade, **options):
    return matching.link(
        _incoming(spark, sf_dir), _master(spark, sf_dir), grade, sc.default_rules(spark), **options
    )


@query(
    with_tables("incoming_v", **_CLEAN)
    + f"SELECT i.file_id, i.id, m.nik AS nik_master, round({_jw('nama')}, 6) AS name_similarity,"
    f" round({_jw('tanggal_lahir')}, 6) AS date_similarity, round({_jw('nama_ibu')}, 6) AS mother_similarity"
    " FROM inc i JOIN mas m ON i.nik = m.nik"
)
def string_similarity(spark, sf_dir):
    pairs = _incoming(spark, sf_dir).join(
        _master(spark, sf_dir).withColumnRenamed("nik", "nik_master"), F.col("nik") == F.col("nik_master")
    )
    like = lambda f: F.round(jaro_winkler(f"{f}_clean", f"{f}_master_clean"), 6)
    return pairs.select(
        "file_id", "id", "nik_master", like("nama").alias("name_similarity"),
        like("tanggal_lahir").alias("date_similarity"), like("nama_ibu").alias("mother_similarity"),
    )


@query(_match_sql(sc.PROFILE_A))
def match_nik_a(spark, sf_dir):
    return _link(spark, sf_dir, 1)


@query(_match_sql(sc.PROFILE_B))
def match_nik_b(spark, sf_dir):
    return _link(spark, sf_dir, 2)


@query(_match_sql(sc.PROFILE_C))
def match_c(spark, sf_dir):
    return _link(spark, sf_dir, 3)


@query(_match_sql(sc.PROFILE_D))
def match_d(spark, sf_dir):
    return _link(spark, sf_dir, 4)


@query(_match_sql(sc.PROFILE_E))
def match_e(spark, sf_dir):
    return _link(spark, sf_dir, 5)


@query(_match_sql(sc.PROFILE_C_TEXT))
def match_c_text_dates(spark, sf_dir):
    return _link(spark, sf_dir, 3, profile=sc.PROFILE_C_TEXT)


@query(_match_sql(sc.PROFILE_D_TEXT))
def match_d_text_dates(spark, sf_dir):
    return _link(spark, sf_dir, 4, profile=sc.PROFILE_D_TEXT)


@query(_match_sql(sc.PROFILE_E_TEXT))
def match_e_text_dates(spark, sf_dir):
    return _link(spark, sf_dir, 5, profile=sc.PROFILE_E_TEXT)


def _counts_sql(grade: int) -> str:
    return (
        with_tables("incoming_v", **_CLEAN, pairs=_pairs_sql(grade),
                    n="SELECT file_id, id, count(*) AS n FROM (SELECT DISTINCT file_id, id, nik_master FROM pairs)"
                      " GROUP BY file_id, id")
        + "SELECT i.file_id, i.id, coalesce(n.n, 0) AS n_candidates FROM inc i"
          " LEFT JOIN n ON i.file_id = n.file_id AND i.id = n.id"
    )


def _counts(spark, sf_dir, grade):
    return blocking.candidate_counts(_incoming(spark, sf_dir), _master(spark, sf_dir), blocking.RULES[grade])


@query(_counts_sql(3))
def block_c(spark, sf_dir):
    return _counts(spark, sf_dir, 3)


@query(_counts_sql(4))
def block_d(spark, sf_dir):
    return _counts(spark, sf_dir, 4)


@query(_counts_sql(5))
def block_e(spark, sf_dir):
    return _counts(spark, sf_dir, 5)


RULE_TEXT = """
SELECT i.file_id, i.id AS incoming_row_id, m.nik AS nik_master, i.nama_clean, m.nama_master_clean,
 i.tempat_lahir_clean, m.tempat_lahir_master_clean, i.nama_ibu_clean, m.nama_ibu_master_clean
FROM incoming_df i JOIN master_df m
 ON i.tempat_lahir_clean = m.tempat_lahir_master_clean AND i.tanggal_lahir_clean = m.tanggal_lahir_master_clean
"""


RULE_PAIRS = (
    "SELECT i.*, m.nik AS nik_master, m.* EXCLUDE (nik) FROM inc i JOIN mas m"
    " ON i.tempat_lahir_clean = m.tempat_lahir_master_clean"
    " AND i.tanggal_lahir_clean = m.tanggal_lahir_master_clean"
)


@query(_match_sql(sc.PROFILE_B, RULE_PAIRS))
def match_rule_sql(spark, sf_dir):
    return matching.link_with_sql(
        _incoming(spark, sf_dir), _master(spark, sf_dir), RULE_TEXT, 2, sc.default_rules(spark), by_values=True
    )


@query(
    with_tables("incoming_v", **_match_parts(sc.PROFILE_D))
    + "SELECT file_id, count(*) AS processed_rows, count(*) FILTER (WHERE match_result = 1) AS matched_rows,"
      " count(*) FILTER (WHERE match_result = 2) AS manual_review_rows,"
      " count(*) FILTER (WHERE match_result = 3) AS unmatched_rows FROM matched GROUP BY file_id"
)
def match_summary(spark, sf_dir):
    return matching.match_summary(_link(spark, sf_dir, 4))


@query(
    with_tables("incoming_v", **_match_parts(sc.PROFILE_A))
    + "SELECT file_id, cast(CASE WHEN bool_or(match_result = 2) THEN 1 ELSE 3 END as int) AS sync_status"
      " FROM matched GROUP BY file_id"
)
def file_sync_status(spark, sf_dir):
    return matching.file_sync_status(_link(spark, sf_dir, 1))


def _by_grade_sql(profiles=sc.PROFILES, pairs: dict[int, str] = {}) -> str:
    """Each file by its own grade: five chains of texts side by side."""
    parts = {"rules": _RULES_SQL, **_CLEAN}
    unions = []
    for grade, profile in profiles.items():
        own = _match_parts(profile, pairs.get(grade))
        names = {n: f"{n}{grade}" for n in ("pairs", "scored", "best", "matched")}
        parts[f"inc{grade}"] = f"SELECT i.* FROM inc i JOIN files_v f ON i.file_id = f.file_id WHERE f.grade = {grade}"
        for n in names:
            text = own[n].replace("FROM inc i", f"FROM inc{grade} i")
            for old, new in names.items():
                text = text.replace(f"FROM {old} ", f"FROM {new} ").replace(f"JOIN {old} ", f"JOIN {new} ")
                if text.endswith(f"FROM {old}"):
                    text = text[: -len(old)] + new
            parts[names[n]] = text
        unions.append(f"SELECT * FROM matched{grade}")
    return with_tables("incoming_v", "files_v", **parts) + (
        f"SELECT m.*, f.upload_timestamp AS upload_date FROM ({' UNION ALL '.join(unions)}) m"
        " JOIN files_v f ON m.file_id = f.file_id"
    )


@query(_by_grade_sql())
def match_files_by_grade(spark, sf_dir):
    return matching.link_files(
        derive(spark, sf_dir, "files_v"), _incoming(spark, sf_dir), _master(spark, sf_dir),
        sc.default_rules(spark),
    )


@query(_by_grade_sql(sc.TEXT_DATE_PROFILES, {2: RULE_PAIRS}))
def match_files_by_rule_table(spark, sf_dir):
    """Grade 2 by a text of candidates, the others by their own blocks; dates compared as text."""
    thresholds = sc.default_rules(spark)
    named = spark.createDataFrame(
        [(g, RULE_TEXT if g == 2 else None, p.name, g == 2) for g, p in sc.TEXT_DATE_PROFILES.items()],
        "grade_code int, matching_query string, profile string, by_values boolean",
    )
    table = thresholds.join(named, "grade_code").select(
        *(f.split()[0] for f in matching.RULE_TABLE_SCHEMA.split(", ")), "by_values"
    )
    return matching.link_files(derive(spark, sf_dir, "files_v"), _incoming(spark, sf_dir), _master(spark, sf_dir), table)


@query(
    with_tables("incoming_v", "files_v", **_match_parts(sc.PROFILE_D),
                st="SELECT file_id, CASE WHEN bool_or(match_result = 2) THEN 1 ELSE 3 END AS s FROM matched GROUP BY file_id")
    + "SELECT f.file_id, CASE WHEN st.s IS NULL THEN f.is_sync ELSE 1 END AS is_sync,"
      " coalesce(st.s, f.sync_status) AS sync_status FROM files_v f LEFT JOIN st ON f.file_id = st.file_id"
)
def files_after_match(spark, sf_dir):
    files = review.start_sync(
        derive(spark, sf_dir, "files_v"), derive(spark, sf_dir, "incoming_v").select("file_id")
    )
    statuses = matching.file_sync_status(_link(spark, sf_dir, 4))
    return review.finish_sync(files, statuses).select("file_id", "is_sync", "sync_status")


@query(
    with_tables("incoming_v", **_match_parts(sc.PROFILE_D),
                s="SELECT file_id, count(*) AS a, count(*) FILTER (WHERE match_result = 1) AS b,"
                  " count(*) FILTER (WHERE match_result = 2) AS c, count(*) FILTER (WHERE match_result = 3) AS d"
                  " FROM matched GROUP BY file_id")
    + "SELECT 'MATCHING_GRADE_4' AS action, file_id AS resource_id, 'SUCCESS' AS result,"
      " concat('{\"file_id\":\"', file_id, '\",\"processed_rows\":', a, ',\"matched_rows\":', b,"
      " ',\"manual_review_rows\":', c, ',\"unmatched_rows\":', d, '}') AS after_state FROM s"
)
def audit_event_of_match(spark, sf_dir):
    summary = matching.match_summary(_link(spark, sf_dir, 4))
    event = audit.job_event(summary, "MATCHING_GRADE_4", "SUCCESS", 0, _now())
    return event.select("action", "resource_id", "result", "after_state")


# --- review -------------------------------------------------------------------

_AREA_SQL = "concat_ws(', ', nullif(trim(provinsi), ''), nullif(trim(kabupaten), ''), nullif(trim(kecamatan), ''), nullif(trim(kelurahan), ''))"


@query(
    with_tables("incoming_v", **_match_parts(sc.PROFILE_D))
    + f"SELECT i.file_id, i.id AS id_incoming, i.nik AS nik_incoming, i.nama AS nama_incoming,"
      f" i.tempat_lahir AS tempat_lahir_incoming, {_AREA_SQL} AS area_incoming,"
      " i.tanggal_lahir AS tanggal_lahir_incoming, i.jenis_kelamin AS jenis_kelamin_incoming,"
      " i.nama_ibu AS nama_ibu_incoming, 'PENDING' AS reasoning_status"
      " FROM incoming_v i JOIN matched m ON i.file_id = m.file_id AND i.id = m.id_incoming WHERE m.match_result = 2"
)
def review_rows(spark, sf_dir):
    results = _link(spark, sf_dir, 4)
    return review.review_rows(results, derive(spark, sf_dir, "incoming_v"))


_QUEUE_SQL = (
    "SELECT p.file_id, p.id_incoming, p.nik_master, p.match_score, 'MANUAL_REVIEW' AS match_result_name, m.reason"
    " FROM partners_v p JOIN manual_v m ON p.file_id = m.file_id AND p.id_incoming = m.id_incoming"
    " WHERE p.match_result = 2"
)


@query(with_tables("partners_v", "manual_v") + _QUEUE_SQL)
def review_queue(spark, sf_dir):
    return reports.review_queue(derive(spark, sf_dir, "partners_v"), derive(spark, sf_dir, "manual_v"))


@query(
    with_tables("partners_v", "manual_v") + _QUEUE_SQL
    + f" AND p.file_id = '{REVIEWED_FILE}' ORDER BY match_score, id_incoming LIMIT 10 OFFSET 10"
)
def review_page(spark, sf_dir):
    return reports.review_page(
        derive(spark, sf_dir, "partners_v"), derive(spark, sf_dir, "manual_v"), REVIEWED_FILE, 2
    )


@query(
    with_tables("partners_v", "manual_v", q=_QUEUE_SQL + f" AND p.file_id = '{REVIEWED_FILE}'")
    + "SELECT 2 AS page, 10 AS page_size, count(*) AS total_rows,"
      " cast(ceil(count(*) / 10) as bigint) AS total_pages, 2 < ceil(count(*) / 10) AS has_next, true AS has_prev FROM q"
)
def review_page_info(spark, sf_dir):
    queue = reports.review_queue(derive(spark, sf_dir, "partners_v"), derive(spark, sf_dir, "manual_v"), REVIEWED_FILE)
    return reports.page_info(queue, 2, codes.PAGE_REVIEW)


def _decisions(spark, sf_dir):
    """Every third stored result gets a decision."""
    results = derive(spark, sf_dir, "results_v")
    number = F.col("id_incoming").cast("long")
    return results.filter(number % 3 == 0).select(
        "file_id", "id_incoming", F.when(number % 2 == 0, 4).otherwise(5).alias("decision")
    )


@query(
    with_tables("results_v")
    + "SELECT file_id, id_incoming, nik_master, match_score, upload_date,"
      " cast(CASE WHEN match_result = 2 AND n % 3 = 0 THEN CASE WHEN n % 2 = 0 THEN 4 ELSE 5 END"
      " ELSE match_result END as int) AS match_result, match_result = 2 AND n % 3 = 0 AS changed"
      " FROM (SELECT *, cast(id_incoming as bigint) AS n FROM results_v)"
)
def decide_reviews(spark, sf_dir):
    return review.decide(derive(spark, sf_dir, "results_v"), _decisions(spark, sf_dir))


def _closing(spark, sf_dir):
    return derive(spark, sf_dir, "files_v").filter(F.col("grade") == 2).select("file_id")


@query(
    with_tables("results_v", "files_v")
    + "SELECT r.file_id, r.id_incoming, r.nik_master, r.match_score, r.upload_date,"
      " cast(CASE WHEN f.grade = 2 AND r.match_result = 2 THEN 5 ELSE r.match_result END as int) AS match_result"
      " FROM results_v r LEFT JOIN files_v f ON r.file_id = f.file_id"
)
def close_file_results(spark, sf_dir):
    return review.close_results(derive(spark, sf_dir, "results_v"), _closing(spark, sf_dir))


@query(
    with_tables("files_v")
    + "SELECT file_id, cast(CASE WHEN grade = 2 AND sync_status = 2 THEN 3 ELSE sync_status END as int) AS sync_status FROM files_v"
)
def close_files(spark, sf_dir):
    return review.close_files(derive(spark, sf_dir, "files_v"), _closing(spark, sf_dir)).select("file_id", "sync_status")


@query(
    with_tables("files_v")
    + "SELECT file_id, CASE WHEN grade = 2 THEN 'READY' ELSE export_status END AS export_status,"
      " CASE WHEN grade = 2 THEN concat('download/', file_id, '/m.csv') ELSE export_match_path END AS export_match_path,"
      " export_unmatch_path FROM files_v"
)
def export_states(spark, sf_dir):
    updates = _closing(spark, sf_dir).select(
        "file_id", F.lit("READY").alias("status"),
        F.concat(F.lit("download/"), "file_id", F.lit("/m.csv")).alias("match_path"),
        F.lit(None).cast("string").alias("unmatch_path"),
    )
    return review.set_export_status(derive(spark, sf_dir, "files_v"), updates).select(
        "file_id", "export_status", "export_match_path", "export_unmatch_path"
    )


@query(
    "SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN value + 1"
    " ELSE value END AS value, props FROM events"
    " UNION ALL SELECT -1 - event_id, NULL, NULL, NULL, value + 1, NULL FROM events WHERE event_id % 3 = 0 AND event_id % 2 = 1"
)
def upsert_partial(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    third = events.filter(F.col("event_id") % 3 == 0)
    updates = third.select(
        F.when(F.col("event_id") % 2 == 0, F.col("event_id")).otherwise(-1 - F.col("event_id")).alias("event_id"),
        (F.col("value") + 1).alias("value"),
    )
    return review.upsert_partial(events, updates, "event_id")


# --- reports ------------------------------------------------------------------

_GRADE_NAME = "CASE grade WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' WHEN 4 THEN 'D' WHEN 5 THEN 'E' END"
_SYNC_NAME = "CASE sync_status WHEN 1 THEN 'In Progress' WHEN 2 THEN 'Awaiting Action' WHEN 3 THEN 'Completed' END"
_RESULT_NAME = (
    "CASE match_result WHEN 1 THEN 'AUTO_MATCH' WHEN 2 THEN 'MANUAL_REVIEW' WHEN 3 THEN 'AUTO_UNMATCH'"
    " WHEN 4 THEN 'MANUAL_MATCH' WHEN 5 THEN 'MANUAL_UNMATCH' END"
)


@query(
    with_tables("files_v")
    + f"SELECT file_id, original_filename, institution_name, upload_timestamp, {_GRADE_NAME} AS grade, row_count,"
      " 'GRADED' AS processing_status, is_sync, matching_task_status FROM files_v"
      " ORDER BY upload_timestamp DESC, file_id LIMIT 10"
)
def graded_files_page(spark, sf_dir):
    return reports.newest_first(reports.graded_files(derive(spark, sf_dir, "files_v")), 1, codes.PAGE_GRADED)


@query(
    with_tables("files_v")
    + f"SELECT file_id, original_filename, institution_name, upload_timestamp, {_GRADE_NAME} AS grade, row_count,"
      f" is_sync, {_SYNC_NAME} AS sync_status FROM files_v"
      " WHERE lower(institution_name) LIKE '%supplier#00%' AND grade IN (1, 3, 5) AND sync_status IN (1, 3)"
      " ORDER BY upload_timestamp DESC, file_id LIMIT 15"
)
def synced_files_page(spark, sf_dir):
    files = reports.synced_files(derive(spark, sf_dir, "files_v"), " 'SUPPLIER#00' ".strip(), "1, 3,5", "1,3")
    return reports.newest_first(files, 1, codes.PAGE_SYNCED)


@query(
    with_tables("files_v", "results_v",
                c="SELECT file_id, count(*) FILTER (WHERE match_result = 1) AS a,"
                  " count(*) FILTER (WHERE match_result = 4) AS m,"
                  " count(*) FILTER (WHERE match_result IN (3, 5)) AS u FROM results_v GROUP BY file_id")
    + "SELECT f.file_id, institution_name, original_filename, upload_timestamp, export_status,"
      " a AS total_auto_match, m AS total_manual_match, u AS total_unmatch,"
      " CASE WHEN a + m + u > 0 THEN round(u / (a + m + u) * 100, 2) ELSE 0 END AS percentage_unmatch"
      " FROM files_v f JOIN c ON f.file_id = c.file_id WHERE sync_status = 3"
      " AND cast(upload_timestamp as date) BETWEEN date '2024-01-02' AND date '2024-02-28'"
)
def history_by_file(spark, sf_dir):
    return reports.history(
        derive(spark, sf_dir, "files_v"), derive(spark, sf_dir, "results_v"), None, "2024-01-02", "2024-02-28"
    )


_HISTORY_SQL = (
    with_tables("files_v", "results_v",
                c="SELECT file_id, count(*) FILTER (WHERE match_result = 1) AS a,"
                  " count(*) FILTER (WHERE match_result = 4) AS m,"
                  " count(*) FILTER (WHERE match_result IN (3, 5)) AS u FROM results_v GROUP BY file_id")
    + "SELECT f.file_id, institution_name, original_filename, upload_timestamp, export_status,"
      " a AS total_auto_match, m AS total_manual_match, u AS total_unmatch,"
      " CASE WHEN a + m + u > 0 THEN round(u / (a + m + u) * 100, 2) ELSE 0 END AS percentage_unmatch"
      " FROM files_v f JOIN c ON f.file_id = c.file_id WHERE sync_status = 3"
)


@query(_HISTORY_SQL + " ORDER BY upload_timestamp DESC, f.file_id LIMIT 2 OFFSET 2")
def history_page(spark, sf_dir):
    return reports.history_page(derive(spark, sf_dir, "files_v"), derive(spark, sf_dir, "results_v"), 2, 2)


@query(
    with_tables("files_v")
    + "SELECT count(*) AS total_files, count(*) FILTER (WHERE is_sync = 0) AS total_pending,"
      " count(*) FILTER (WHERE is_sync = 1 AND sync_status = 3) AS total_completed,"
      " count(*) FILTER (WHERE is_sync = 1 AND sync_status = 1) AS total_in_progress,"
      " count(*) FILTER (WHERE is_sync = 1 AND sync_status = 2) AS total_awaiting_action, "
    + ", ".join(f"count(*) FILTER (WHERE grade = {g}) AS total_grade_{n.lower()}" for g, n in codes.GRADE_LABELS.items())
    + " FROM files_v"
)
def dashboard_summary(spark, sf_dir):
    return reports.dashboard_summary(derive(spark, sf_dir, "files_v"))


@query(
    with_tables("files_v")
    + f"SELECT file_id, institution_name, original_filename, upload_timestamp, {_SYNC_NAME} AS sync_status,"
      f" {_GRADE_NAME} AS grade FROM files_v WHERE is_sync = 1 AND cast(upload_timestamp as date) = date '2024-01-15'"
)
def today_files(spark, sf_dir):
    return reports.synced_on(derive(spark, sf_dir, "files_v"), F.lit("2024-01-15").cast("date"))


@query(
    with_tables("files_v") + "SELECT file_id, minio_path FROM files_v WHERE is_sync = 1 OR sync_status = 3"
)
def servable_files(spark, sf_dir):
    return reports.servable(derive(spark, sf_dir, "files_v"), codes.SYNC_COMPLETED).select("file_id", "minio_path")


_TOP_SQL = (
    "SELECT * FROM (SELECT 'match' AS side, file_id, id_incoming, nik_master, match_score, "
    f"{_RESULT_NAME} AS match_result_name FROM results_v WHERE file_id = '{ONE_FILE}' AND match_result IN (1, 4)"
    " ORDER BY match_score DESC, id_incoming LIMIT 10)"
    " UNION ALL SELECT * FROM (SELECT 'unmatch', file_id, id_incoming, nik_master, match_score, "
    f"{_RESULT_NAME} FROM results_v WHERE file_id = '{ONE_FILE}' AND match_result IN (3, 5)"
    " ORDER BY match_score, id_incoming LIMIT 10)"
)


@query(with_tables("results_v") + _TOP_SQL)
def top_matches(spark, sf_dir):
    return reports.top_matches(derive(spark, sf_dir, "results_v"), ONE_FILE)


@query(
    with_tables("results_v", "incoming_v", t=_TOP_SQL)
    + "SELECT t.side, t.file_id, t.id_incoming, i.nama AS incoming_name, t.match_score,"
      " t.match_result_name AS match_result_desc, m.nama_lengkap AS master_name, m.kelurahan AS master_area"
      " FROM t LEFT JOIN incoming_v i ON t.file_id = i.file_id AND t.id_incoming = i.id"
      " LEFT JOIN master_v m ON t.nik_master = m.nik"
)
def preview_rows(spark, sf_dir):
    top = reports.top_matches(derive(spark, sf_dir, "results_v"), ONE_FILE)
    shown = reports.side_by_side(top, derive(spark, sf_dir, "incoming_v"), derive(spark, sf_dir, "master_v"))
    return shown.select(
        "side", "file_id", "id_incoming", F.col("institution.nama").alias("incoming_name"),
        F.col("institution.match_score").alias("match_score"),
        F.col("institution.match_result_desc").alias("match_result_desc"),
        F.col("master.nama_lengkap").alias("master_name"), F.col("master.kelurahan").alias("master_area"),
    )


@query(
    with_tables("results_v", "master_v")
    + "SELECT nik, nama_lengkap, tempat_lahir, provinsi, kabupaten, kecamatan, kelurahan, tanggal_lahir,"
      " jenis_kelamin, nama_ibu, status_kematian FROM master_v"
      " WHERE nik IN (SELECT nik_master FROM results_v WHERE match_result IN (1, 4))"
)
def registry_lookup(spark, sf_dir):
    niks = derive(spark, sf_dir, "results_v").filter(
        F.col("match_result").isin(*codes.MATCHED_RESULTS)
    ).select(F.col("nik_master").alias("nik"))
    return reports.registry_rows(derive(spark, sf_dir, "master_v"), niks)


@query(
    with_tables("results_v", "incoming_v")
    + "SELECT i.* FROM incoming_v i WHERE EXISTS (SELECT 1 FROM results_v r WHERE r.file_id = i.file_id"
      " AND r.id_incoming = i.id AND r.match_result = 2)"
)
def uploaded_rows(spark, sf_dir):
    ids = derive(spark, sf_dir, "results_v").filter(F.col("match_result") == codes.REVIEW).select(
        "file_id", F.col("id_incoming").alias("id")
    )
    return reports.uploaded_rows(derive(spark, sf_dir, "incoming_v"), ids)


_RAW = "k, nik, nama, tempat_lahir, tanggal_lahir, jenis_kelamin, nama_ibu, provinsi, kabupaten, kecamatan, kelurahan, status_hidup"
_RAW_I = ", ".join(f"i.{c.strip()}" for c in _RAW.split(","))


@query(
    with_tables("partners_v", "incoming_v")
    + f"SELECT p.file_id, {_RAW_I}, " + ", ".join(f"m.{c} AS master_{c}" for c in codes.MASTER_COLUMNS)
    + " FROM partners_v p LEFT JOIN incoming_v i ON p.file_id = i.file_id AND p.id_incoming = i.id"
      " LEFT JOIN master_v m ON p.nik_master = m.nik WHERE p.match_result IN (1, 4)"
)
def export_match(spark, sf_dir):
    return reports.export_matched(
        derive(spark, sf_dir, "partners_v"), derive(spark, sf_dir, "incoming_v"), derive(spark, sf_dir, "master_v")
    )


@query(
    with_tables("partners_v", "incoming_v")
    + f"SELECT p.file_id, {_RAW_I} FROM partners_v p"
      " LEFT JOIN incoming_v i ON p.file_id = i.file_id AND p.id_incoming = i.id WHERE p.match_result IN (3, 5)"
)
def export_unmatch(spark, sf_dir):
    return reports.export_unmatched(derive(spark, sf_dir, "partners_v"), derive(spark, sf_dir, "incoming_v"))


# --- reasons ------------------------------------------------------------------

_PAIR_SQL = (
    "SELECT mm.id, mm.file_id, mm.id_incoming, mm.nik_incoming, mm.nama_incoming AS nama_lengkap,"
    " mm.tempat_lahir_incoming AS tempat_lahir, mm.tanggal_lahir_incoming AS tanggal_lahir,"
    " mm.jenis_kelamin_incoming AS jenis_kelamin, mm.nama_ibu_incoming AS nama_ibu,"
    " m.nama_lengkap AS master_nama_lengkap, m.tempat_lahir AS master_tempat_lahir,"
    " m.tanggal_lahir AS master_tanggal_lahir, m.jenis_kelamin AS master_jenis_kelamin,"
    " m.nama_ibu AS master_nama_ibu FROM manual_v mm"
)
_PAIRS_SQL = (
    f"{_PAIR_SQL} JOIN master_v m ON mm.nik_incoming = m.nik WHERE mm.reasoning_status IN ('PENDING', 'FAILED')"
    f" UNION ALL {_PAIR_SQL} JOIN partners_v p ON p.file_id = mm.file_id AND p.id_incoming = mm.id_incoming"
    " JOIN master_v m ON p.nik_master = m.nik WHERE mm.reasoning_status IN ('PENDING', 'FAILED')"
    " AND coalesce(mm.nik_incoming, '') = ''"
)


def _empty(c: str) -> str:
    return f"(coalesce(trim(lower({c})), '') IN ('', 'null', 'none'))"


def _status_sql(field: str) -> str:
    a, b = field, f"master_{field}"
    plain = lambda c: f"trim(lower({c}))"
    if field == "jenis_kelamin":
        plain = lambda c: (
            f"CASE WHEN trim(lower({c})) IN ('l','laki-laki','pria') THEN 'l'"
            f" WHEN trim(lower({c})) IN ('p','perempuan','wanita') THEN 'p' ELSE trim(lower({c})) END"
        )
    return (
        f"CASE WHEN {_empty(a)} AND {_empty(b)} THEN 'SAMA' WHEN {_empty(a)} THEN 'KOSONG_INCOMING'"
        f" WHEN {_empty(b)} THEN 'KOSONG_MASTER' WHEN {plain(a)} <> {plain(b)} THEN 'BEDA' ELSE 'SAMA' END"
    )


_STATED_SQL = "SELECT *, " + ", ".join(f"{_status_sql(f)} AS status_{f}" for f in reasons.FIELDS) + " FROM cp"
_DETECTED_SQL = (
    "SELECT *, sha256(pattern_signature) AS pattern_hash FROM (SELECT *, concat("
    + ", '|', ".join(f"'{f}:', status_{f}" for f in sorted(reasons.FIELDS))
    + ") AS pattern_signature, coalesce(nullif(concat_ws('__', "
    + ", ".join(
        f"CASE status_{f} WHEN 'KOSONG_INCOMING' THEN '{s}_KOSONG' WHEN 'KOSONG_MASTER' THEN '{s}_KOSONG_MASTER'"
        f" WHEN 'BEDA' THEN '{s}_BEDA' END"
        for f, s in codes.PATTERN_FIELDS
    )
    + "), ''), 'SEMUA_SAMA') AS pattern_name_suffix FROM stated)"
)
_SHOW = lambda c: f"coalesce(nullif(trim({c}), ''), 'EMPTY')"
_DESCRIBE_SQL = "coalesce(nullif(concat_ws('; ', " + ", ".join(
    f"CASE WHEN status_{f} <> 'SAMA' THEN concat('{reasons._LABELS[f]}: '".replace("'s Name", "''s Name")
    + f", {_SHOW(f)}, ' vs ', {_SHOW('master_' + f)}) END"
    for f in reasons.FIELDS
) + "), ''), 'No difference')"
_REASON_TEXTS = dict(cp=_PAIRS_SQL, stated=_STATED_SQL, detected=_DETECTED_SQL)
_REASON_TABLES = ("manual_v", "partners_v", "master_v")


def _pairs(spark, sf_dir):
    return reasons.comparison_pairs(
        derive(spark, sf_dir, "manual_v"), derive(spark, sf_dir, "partners_v"), derive(spark, sf_dir, "master_v")
    )


def _no_patterns(spark):
    return spark.createDataFrame([], reasons.PATTERN_SCHEMA)


@query(with_tables(*_REASON_TABLES) + _PAIRS_SQL)
def reason_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(
    with_tables(*_REASON_TABLES, **_REASON_TEXTS)
    + "SELECT id, " + ", ".join(f"status_{f}" for f in reasons.FIELDS)
    + ", pattern_signature, pattern_name_suffix, pattern_hash FROM detected"
)
def pattern_detect(spark, sf_dir):
    return reasons.detect_patterns(_pairs(spark, sf_dir)).select(
        "id", *[f"status_{f}" for f in reasons.FIELDS], "pattern_signature", "pattern_name_suffix", "pattern_hash"
    )


def _table_sql(rows: str = "detected", after: str = "0") -> str:
    """Patterns of `rows`, numbered on from `after`."""
    return (
        f"SELECT pattern_hash, printf('P%03d_%s', row_number() OVER (ORDER BY sample_id) + {after}, pattern_name_suffix)"
        " AS pattern_name, pattern_signature, sample_id, 1 AS hit_count FROM (SELECT pattern_hash, pattern_signature,"
        f" pattern_name_suffix, min(id) AS sample_id FROM {rows} GROUP BY ALL)"
    )


def _template_sql() -> str:
    """The description of each pattern's sample, its own values replaced in the order of the placeholders."""
    out = _DESCRIBE_SQL
    for c, placeholder in reasons._PLACEHOLDERS:
        nothing = f"{c} IS NULL OR trim({c}) = '' OR lower({c}) IN ('null', 'none', 'kosong', 'empty')"
        never = r"'\b\B'"  # matches nothing
        out = f"regexp_replace({out}, CASE WHEN {nothing} THEN {never} ELSE regexp_escape({c}) END, '{placeholder}', 'gi')"
    return f"SELECT pattern_hash AS template_hash, {out} AS reason_template FROM detected WHERE id IN (SELECT sample_id FROM pt)"


def _explained_sql(fresh: str = "id = sample_id") -> str:
    filled = "reason_template"
    for c, placeholder in reasons._PLACEHOLDERS:
        filled = f"replace({filled}, '{placeholder}', {_SHOW(c)})"
    return (
        f"SELECT d.id AS id, d.file_id AS file_id, d.pattern_hash AS pattern_hash, CASE WHEN {fresh} THEN {_DESCRIBE_SQL}"
        f" ELSE {filled} END AS reason, pattern_name, CASE WHEN {fresh} THEN 'LLM' ELSE 'CACHE' END AS source"
        " FROM detected d JOIN pt ON d.pattern_hash = pt.pattern_hash JOIN templates ON d.pattern_hash = template_hash"
    )


_TABLE_SQL = _table_sql()
_PATTERN_TEXTS = dict(**_REASON_TEXTS, pt=_TABLE_SQL, templates=_template_sql())
_EARLIER = "file_id < 'f5'"


@query(
    with_tables(*_REASON_TABLES, **_PATTERN_TEXTS)
    + "SELECT pt.*, reason_template FROM pt JOIN templates ON pattern_hash = template_hash"
)
def pattern_table(spark, sf_dir):
    made = reasons.new_patterns(reasons.detect_patterns(_pairs(spark, sf_dir)), _no_patterns(spark), _now())
    return made.select("pattern_hash", "pattern_name", "pattern_signature", "sample_id", "hit_count", "reason_template")


@query(
    with_tables(*_REASON_TABLES, **_PATTERN_TEXTS)
    + "SELECT pattern_name, reason_template FROM pt JOIN templates ON pattern_hash = template_hash"
)
def pattern_templates(spark, sf_dir):
    made = reasons.new_patterns(reasons.detect_patterns(_pairs(spark, sf_dir)), _no_patterns(spark), _now())
    return made.select("pattern_name", "reason_template")


@query(with_tables(*_REASON_TABLES, **_PATTERN_TEXTS) + _explained_sql())
def reason_explain(spark, sf_dir):
    """Described first rows and filled-in templates."""
    return reasons.explain(_pairs(spark, sf_dir), _no_patterns(spark), _now())


@query(
    with_tables(
        *_REASON_TABLES, **_REASON_TEXTS,
        known=_table_sql(f"(SELECT * FROM detected WHERE {_EARLIER})"),
        fresh=_table_sql(
            "(SELECT * FROM detected WHERE pattern_hash NOT IN (SELECT pattern_hash FROM known))",
            "(SELECT count(*) FROM known)",
        ),
        pt="SELECT *, false AS is_new FROM known UNION ALL SELECT *, true FROM fresh",
        templates=_template_sql(),
    )
    + _explained_sql("is_new AND id = sample_id")
)
def reason_explain_known(spark, sf_dir):
    """All review rows, with the patterns of earlier files known already."""
    pairs = settle(_pairs(spark, sf_dir), "pairs")
    earlier = reasons.detect_patterns(pairs.filter(_EARLIER))
    known = settle(reasons.new_patterns(earlier, _no_patterns(spark), _now()), "known")
    return reasons.explain(pairs, known, _now())


@query(
    with_tables(*_REASON_TABLES, **_REASON_TEXTS)
    + f"SELECT id, file_id, pattern_hash, {_DESCRIBE_SQL} AS reason,"
      " concat('DRY_RUN_', pattern_name_suffix) AS pattern_name, 'LLM' AS source FROM detected"
)
def reason_dry_run(spark, sf_dir):
    return reasons.explain(_pairs(spark, sf_dir), _no_patterns(spark), _now(), dry_run=True)


@query(
    with_tables(*_REASON_TABLES, **_REASON_TEXTS, pt=_TABLE_SQL)
    + "SELECT file_id, CASE WHEN d.id = t.sample_id THEN 'LLM' ELSE 'CACHE' END AS source, count(*) AS n_rows"
      " FROM detected d JOIN pt t ON d.pattern_hash = t.pattern_hash GROUP BY ALL"
)
def reason_summary(spark, sf_dir):
    return reasons.reason_summary(reasons.explain(_pairs(spark, sf_dir), _no_patterns(spark), _now()))


@query(
    with_tables(*_REASON_TABLES, **_REASON_TEXTS, pt=_TABLE_SQL)
    + "SELECT t.pattern_hash, t.pattern_name, count(*) AS hit_count FROM detected d JOIN pt t"
      " ON d.pattern_hash = t.pattern_hash GROUP BY ALL"
)
def pattern_hits(spark, sf_dir):
    """First hit from the new pattern, one more for every row filled from it."""
    pairs = settle(_pairs(spark, sf_dir), "pairs")
    none = _no_patterns(spark)
    made = settle(reasons.new_patterns(reasons.detect_patterns(pairs), none, _now()), "patterns")
    counted = reasons.count_hits(made, reasons.explain(pairs, none, _now()), _now())
    return counted.select("pattern_hash", "pattern_name", "hit_count")


@query(
    with_tables(*_REASON_TABLES, **_PATTERN_TEXTS, said=_explained_sql())
    + "SELECT m.id, m.file_id, s.reason, s.pattern_name, s.source AS reasoning_source,"
      " CASE WHEN s.id IS NULL THEN m.reasoning_status ELSE 'COMPLETED' END AS reasoning_status"
      " FROM manual_v m LEFT JOIN said s ON m.id = s.id"
)
def reason_write_back(spark, sf_dir):
    said = reasons.explain(_pairs(spark, sf_dir), _no_patterns(spark), _now())
    return reasons.write_back(derive(spark, sf_dir, "manual_v"), said).select(
        "id", "file_id", "reason", "pattern_name", "reasoning_source", "reasoning_status"
    )


@query(
    with_tables("manual_v")
    + "SELECT id, CASE WHEN reasoning_status IN ('PENDING', 'FAILED') THEN 'PROCESSING' ELSE reasoning_status END"
      " AS reasoning_status FROM manual_v"
)
def reason_mark_processing(spark, sf_dir):
    return reasons.mark_processing(derive(spark, sf_dir, "manual_v")).select("id", "reasoning_status")


@query(
    with_tables("manual_v", "files_v",
                o="SELECT file_id, count(*) FILTER (WHERE id % 2 = 0 AND reasoning_status IN ('PENDING', 'PROCESSING')) AS n"
                  " FROM manual_v WHERE id % 7 <> 3 OR file_id < 'f5' GROUP BY file_id")
    + "SELECT f.file_id, cast(CASE WHEN o.n = 0 AND f.sync_status = 1 THEN 2 ELSE f.sync_status END as int) AS sync_status"
      " FROM files_v f LEFT JOIN o ON f.file_id = o.file_id"
)
def reason_status_rollup(spark, sf_dir):
    manual = derive(spark, sf_dir, "manual_v").filter("id % 7 <> 3 OR file_id < 'f5'").withColumn(
        "reasoning_status", F.when(F.col("id") % 2 == 0, F.col("reasoning_status")).otherwise("COMPLETED")
    )
    return reasons.files_after_reasons(derive(spark, sf_dir, "files_v"), manual).select("file_id", "sync_status")


# --- audit --------------------------------------------------------------------

_BOTH = "SELECT event_time, result, latency_ms FROM audit_v UNION ALL SELECT event_time, result, latency_ms FROM access_v"
_WEEK = f"event_time >= timestamp '{NOW}' - INTERVAL 7 DAY"
_DAY = f"event_time >= timestamp '{NOW}' - INTERVAL 1 DAY"


def _logs(spark, sf_dir):
    return derive(spark, sf_dir, "audit_v"), derive(spark, sf_dir, "access_v")


@query(
    with_tables("audit_v", "access_v", b=_BOTH)
    + "SELECT count(*) FILTER (WHERE result = 'SUCCESS') AS success, count(*) FILTER (WHERE result = 'FAILED') AS failed"
      f" FROM b WHERE {_WEEK}"
)
def audit_summary(spark, sf_dir):
    return audit.outcome_counts(*_logs(spark, sf_dir), audit.in_period("weekly", _now()))


@query(
    with_tables("audit_v", "access_v", b=_BOTH)
    + "SELECT strftime(event_time, '%H:00') AS time, round(avg(latency_ms), 0) AS latency FROM b"
      f" WHERE {_DAY} AND latency_ms > 0 GROUP BY 1"
)
def latency_hourly(spark, sf_dir):
    return audit.latency_chart(*_logs(spark, sf_dir), audit.in_period("daily", _now()), "daily")


@query(
    with_tables("audit_v", "access_v", b=_BOTH)
    + "SELECT strftime(event_time, '%Y-%m-%d') AS time, round(avg(latency_ms), 0) AS latency FROM b"
      " WHERE event_time >= timestamp '2024-01-05 00:00:00' AND event_time <= timestamp '2024-01-18 23:59:59'"
      " AND latency_ms > 0 GROUP BY 1"
)
def latency_daily(spark, sf_dir):
    condition = audit.in_period("custom", _now(), "2024-01-05", "2024-01-18")
    return audit.latency_chart(*_logs(spark, sf_dir), condition, "custom")


@query(
    with_tables("audit_v")
    + f"SELECT id, event_time, actor_org_id AS actor, action, resource_id, result, latency_ms FROM audit_v WHERE {_WEEK}"
      " ORDER BY event_time DESC, id DESC LIMIT 10 OFFSET 10"
)
def audit_page(spark, sf_dir):
    log = audit.audit_log(derive(spark, sf_dir, "audit_v"), audit.in_period("weekly", _now()))
    return audit.newest_events(log, 2, 10)


@query(
    with_tables("access_v")
    + "SELECT id, event_time, actor_user_id AS actor, action, resource_type, resource_id, ip_address, result, latency_ms"
      f" FROM access_v WHERE {_WEEK} ORDER BY event_time DESC, id DESC LIMIT 10"
)
def access_page(spark, sf_dir):
    log = audit.access_log(derive(spark, sf_dir, "access_v"), audit.in_period("weekly", _now()))
    return audit.newest_events(log, 1, 10)


@query(
    with_tables("audit_v")
    + f"SELECT 1 AS page, 10 AS page_size, count(*) AS total_rows, cast(greatest(ceil(count(*) / 10), 1) as bigint) AS total_pages,"
      f" 1 < greatest(ceil(count(*) / 10), 1) AS has_next, false AS has_prev FROM audit_v WHERE {_WEEK}"
)
def audit_page_info(spark, sf_dir):
    log = audit.audit_log(derive(spark, sf_dir, "audit_v"), audit.in_period("weekly", _now()))
    return reports.page_info(log, 1, 10, at_least_one=True)


def _policies(spark):
    return spark.createDataFrame(
        [(1, "AUDIT_LOG", 10, "ACTIVE"), (2, "AUDIT_LOG", 3, "INACTIVE"), (3, "OTHER", 1, "ACTIVE")],
        "id int, resource_type string, retention_days int, status string",
    )


_KEPT = (
    f"SELECT 'AUDIT_LOG' AS log, id, event_time FROM audit_v WHERE event_time >= timestamp '{NOW}' - INTERVAL 10 DAY"
    f" UNION ALL SELECT 'ACCESS_LOG', id, event_time FROM access_v WHERE event_time >= timestamp '{NOW}' - INTERVAL 30 DAY"
)


@query(with_tables("audit_v", "access_v") + _KEPT)
def retention_apply(spark, sf_dir):
    logs = dict(zip(audit.LOG_TYPES, _logs(spark, sf_dir)))
    kept = [
        audit.keep_recent(log, _policies(spark), kind, _now()).select(F.lit(kind).alias("log"), "id", "event_time")
        for kind, log in logs.items()
    ]
    return kept[0].unionByName(kept[1])


_DONE = f"SELECT %s AS log, cast(%d as bigint) AS policy_id, timestamp '{NOW}' AS executed_at"


@query(
    with_tables("audit_v", "access_v", kept=_KEPT, done=f"{_DONE % ("'AUDIT_LOG'", 1)} UNION ALL {_DONE % ("'ACCESS_LOG'", 0)}")
    + "SELECT log, policy_id, executed_at, (SELECT count(*) FROM kept WHERE kept.log = done.log) AS events,"
      " (SELECT min(event_time) FROM kept WHERE kept.log = done.log) AS oldest FROM done"
)
def retention_job(spark, sf_dir):
    """Both logs stored by day and aged twice: what was done, and what is left."""
    store = pipeline.Store(fresh_path(spark, "retention"))
    audit_log, requests = _logs(spark, sf_dir)
    state = {c: F.lit(None).cast("string") for c in ("before_state", "after_state")}
    columns = [c.split()[0] for c in audit.EVENT_SCHEMA.split(", ")]
    tables.append_events(_timed(audit_log.withColumns(state)).select(*columns), store.audit)
    pipeline.log_access(store, _timed(requests))
    for _ in range(2):
        actions = pipeline.retain(spark, store, _policies(spark), _now())
    left = None
    for kind in audit.LOG_TYPES:
        part = pipeline.read_log(spark, store, kind).agg(
            F.count(F.lit(1)).alias("events"), F.min("event_time").cast("timestamp_ntz").alias("oldest")
        ).withColumn("log", F.lit(kind))
        left = part if left is None else left.unionByName(part)
    return actions.withColumnRenamed("resource_type", "log").join(left, "log").select(
        "log", "policy_id", F.col("executed_at").cast("timestamp_ntz").alias("executed_at"), "events", "oldest"
    )


def _timed(log):
    return log.withColumn("event_time", F.col("event_time").cast("timestamp"))


@query(
    with_tables("audit_v")
    + "SELECT count(*) AS total_executions, count(*) FILTER (WHERE result = 'SUCCESS') AS success_executions,"
      " coalesce(strftime(max(event_time), '%Y-%m-%d %H:%M:%S'), 'Never') AS last_execution FROM audit_v"
)
def retention_summary(spark, sf_dir):
    """Every audit event read as one retention run."""
    actions = derive(spark, sf_dir, "audit_v").select(
        F.col("result").alias("action_status"), F.col("event_time").alias("executed_at")
    )
    return audit.retention_summary(actions)


# --- documents ----------------------------------------------------------------

_BLANK_SQL = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
_CHUNK_TEXTS = dict(
    raw="SELECT doc_id, path, text, i AS position, trim(parts[i], " + _BLANK_SQL + ") AS page"
        " FROM (SELECT doc_id, path, text, parts, unnest(range(1, len(parts) + 1)) AS i"
        " FROM (SELECT *, string_split(text, '<!-- page break -->') AS parts FROM faq_v))",
    tidy="SELECT doc_id, path, text, position, regexp_replace(page, '\\n{3,}', chr(10) || chr(10), 'g') AS page FROM raw",
    cut="SELECT *, least(coalesce(nullif(instr(page, chr(10) || chr(10)), 0), length(page) + 1),"
        " coalesce(nullif(instr(page, chr(10) || '<query>'), 0), length(page) + 1)) AS stop FROM tidy",
    part="SELECT *, trim(substr(page, 3, stop - 3), " + _BLANK_SQL + ") AS question,"
         " trim(substr(page, stop), " + _BLANK_SQL + ") AS rest FROM cut",
    piece="SELECT *, trim(CASE WHEN instr(rest, '<query>') > 0 THEN substr(rest, 1, instr(rest, '<query>') - 1) ELSE rest END, "
          + _BLANK_SQL + ") AS answer, CASE WHEN instr(rest, '<query>') > 0 THEN substr(rest, instr(rest, '<query>')) ELSE '' END AS tail FROM part",
    tagged="SELECT doc_id, path, text, position, CASE WHEN starts_with(page, 'Q:') THEN trim(concat('<question>', question, '</question>', chr(10),"
           " CASE WHEN answer <> '' THEN concat('<answer>', answer, '</answer>', chr(10)) ELSE '' END, tail), " + _BLANK_SQL + ")"
           " ELSE page END AS page_content FROM piece",
    chunks="SELECT path, string_split(path, '/')[-1] AS doc_name, 'text' AS content_type, string_split(path, '/')[-1] AS source_file,"
           " sha256(text) AS file_hash, cast(row_number() OVER (PARTITION BY doc_id ORDER BY position) as int) AS faq,"
           " page_content, sha256(page_content) AS chunk_hash FROM tagged WHERE page_content <> ''",
)


@query(with_tables("faq_v", **_CHUNK_TEXTS) + "SELECT * FROM chunks")
def faq_chunks(spark, sf_dir):
    return documents.chunk_documents(derive(spark, sf_dir, "faq_v"))


@query(
    with_tables("faq_v", **_CHUNK_TEXTS,
                store="SELECT CASE WHEN path LIKE '%7.md' THEN file_hash END AS file_hash,"
                      " CASE WHEN faq % 2 = 0 THEN chunk_hash END AS chunk_hash FROM chunks")
    + "SELECT path, faq, chunk_hash FROM chunks c"
      " WHERE NOT EXISTS (SELECT 1 FROM store s WHERE s.file_hash = c.file_hash)"
      " AND NOT EXISTS (SELECT 1 FROM store s WHERE s.chunk_hash = c.chunk_hash)"
)
def faq_new_chunks(spark, sf_dir):
    """The store knows some files whole and every second chunk of the others."""
    faq = settle(derive(spark, sf_dir, "faq_v"), "faq")
    store = documents.chunk_documents(faq).select(
        F.when(F.col("path").like("%7.md"), F.col("file_hash")).alias("file_hash"),
        F.when(F.col("faq") % 2 == 0, F.col("chunk_hash")).alias("chunk_hash"),
    )
    return documents.new_chunks(faq, store).select("path", "faq", "chunk_hash")


@query(
    "SELECT page_id, url AS path, CASE WHEN contains(url, 'markdown') OR contains(url, '.md') THEN 'text'"
    " WHEN contains(url, 'tables') THEN 'tables' WHEN contains(url, 'images_desc') THEN 'image' ELSE 'unknown' END AS content_type,"
    " CASE WHEN NOT (contains(url, 'markdown') OR contains(url, '.md')) AND (contains(url, 'tables') OR contains(url, 'images_desc'))"
    " THEN string_split(url, '/')[-2] ELSE string_split(url, '/')[-1] END AS doc_name, sha256(html) AS file_hash FROM pages"
)
def describe_documents(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").withColumnRenamed("url", "path")
    return documents.describe_documents(pages, "path", "html").select(
        "page_id", "path", "content_type", "doc_name", "file_hash"
    )


@query(
    r"SELECT doc_id, regexp_replace(text, '\b\d{13}(\d{3})\b', '*************\1', 'g') AS text FROM documents"
)
def pii_mask(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", tx.mask_ids(F.col("text")).alias("text"))


@query(r"SELECT doc_id, regexp_replace(text, '\b\d{16}\b', '[REDACTED]', 'g') AS text FROM documents")
def pii_redact(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", tx.mask_ids(F.col("text"), "redact").alias("text"))


@query(
    r"SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN"
    r" regexp_replace(text, '\b\d{13}(\d{3})\b', '*************\1', 'g') ELSE text END AS text FROM conversations"
)
def mask_answers(spark, sf_dir):
    return conversations.mask_answers(_table(spark, sf_dir, "conversations"))


# --- search -------------------------------------------------------------------

_DENSE_SQL = (
    "SELECT q.query_id, v.vec_id AS item_id, round(list_cosine_similarity(cast(q.vector as double[]), cast(v.embedding as double[])), 6) AS score"
    " FROM qv q, embeddings v"
)


def _ranked(name: str, digits: str = "score") -> str:
    return (
        f"SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY {digits} DESC, item_id) as int) AS rank"
        f" FROM {name} QUALIFY rank <= 5"
    )


def _vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))


@query(
    "WITH qv AS (SELECT cast(label as bigint) AS query_id, arg_min(embedding, vec_id) AS vector FROM embeddings GROUP BY label),"
    f" d AS ({_DENSE_SQL}) " + _ranked("d")
)
def dense_topk(spark, sf_dir):
    """Nearest vectors of the first vector of every label."""
    requests = _table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("query_id")).agg(
        F.min_by("embedding", "vec_id").alias("vector")
    )
    return search.dense_topk(_vectors(spark, sf_dir), requests)


@query(
    "WITH qv AS (SELECT vec_id AS query_id, embedding AS vector FROM embeddings),"
    f" d AS ({_DENSE_SQL}) " + _ranked("d")
)
def dense_neighbours(spark, sf_dir):
    """Nearest vectors of every vector, by a grid of pieces of both sides."""
    vectors = _vectors(spark, sf_dir)
    return search.dense_topk(
        vectors, vectors.withColumnRenamed("item_id", "query_id"), request_block=200, vector_block=400
    )


_BM25_TEXTS = dict(
    w=r"SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM documents",
    n="SELECT count(*) AS n, avg(len(words)) AS mean FROM w",
    qt=r"SELECT item_id AS query_id, term, count(*) AS asked FROM (SELECT item_id,"
       r" unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark) GROUP BY ALL",
    tf="SELECT doc_id, size, term, count(*) AS tf FROM (SELECT doc_id, len(words) AS size, unnest(words) AS term FROM w)"
       " WHERE term IN (SELECT term FROM qt) GROUP BY ALL",
    dfs="SELECT term, count(*) AS df FROM tf GROUP BY term",
    bm="SELECT query_id, doc_id AS item_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * asked * tf * 2.2::double"
       " / (tf + 1.2::double * (0.25::double + 0.75::double * size / mean))), 6) AS score"
       " FROM tf JOIN qt USING (term) JOIN dfs USING (term), n GROUP BY ALL",
)


def _ctes(**texts: str) -> str:
    return "WITH " + ", ".join(f"{name} AS ({text})" for name, text in texts.items()) + " "


def _texts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return docs, asked


@query(_ctes(**_BM25_TEXTS) + _ranked("bm"))
def bm25_topk(spark, sf_dir):
    return search.bm25_topk(*_texts(spark, sf_dir))


@query(
    _ctes(
        **_BM25_TEXTS, sparse=_ranked("bm"),
        qv="SELECT item_id AS query_id, embedding AS vector FROM benchmark JOIN embeddings ON item_id = vec_id",
        d=_DENSE_SQL, dense=_ranked("d"),
        votes="SELECT query_id, item_id, 1.0::double / (60 + rank) AS vote FROM sparse"
              " UNION ALL SELECT query_id, item_id, 1.0::double / (60 + rank) FROM dense",
        fused="SELECT query_id, item_id, round(sum(vote), 9) AS score FROM votes GROUP BY ALL",
    ) + _ranked("fused")
)
def hybrid_topk(spark, sf_dir):
    docs, asked = _texts(spark, sf_dir)
    vectors = _vectors(spark, sf_dir)
    asked_vectors = vectors.withColumnRenamed("item_id", "query_id").join(asked.select("query_id"), "query_id", "left_semi")
    return search.hybrid_topk(docs, vectors, asked, asked_vectors)


# --- conversations ------------------------------------------------------------

@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def latest_per_key(spark, sf_dir):
    return spread.latest_per_key(_table(spark, sf_dir, "conversations"), ["conv_id"], "turn").drop("rank")


@query(
    "SELECT conv_id, cast(floor(turn / 2) as bigint) AS version, turn, role, text FROM conversations"
    " QUALIFY version = max(version) OVER (PARTITION BY conv_id)"
)
def children_of_latest(spark, sf_dir):
    versions = _table(spark, sf_dir, "conversations").withColumn("version", F.floor(F.col("turn") / 2).cast("long"))
    return spread.children_of_latest(versions, ["conv_id"], "version").select("conv_id", "version", "turn", "role", "text")


@query(
    "SELECT conv_id, version, string_agg(concat(role, ': ', text), chr(10) ORDER BY turn) AS said, count(*) AS n_children FROM ("
    "SELECT conv_id, cast(floor(turn / 4) as bigint) AS version, turn, role, text FROM conversations"
    " QUALIFY version = max(version) OVER (PARTITION BY conv_id)) GROUP BY conv_id, version"
)
def ordered_children_of_latest(spark, sf_dir):
    versions = _table(spark, sf_dir, "conversations").withColumn("version", F.floor(F.col("turn") / 4).cast("long"))
    found = spread.ordered_children_of_latest(versions, ["conv_id"], "version", ["turn"], ["role", "text"])
    line = F.transform("items", lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return found.select("conv_id", "version", F.array_join(line, "\n").alias("said"), F.size("items").cast("long").alias("n_children"))


@query("SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations")
def conversation_messages(spark, sf_dir):
    return conversations.number_messages(_table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("SELECT conv_id AS conversation_id, turn AS id, turn AS created_at, role, text FROM conversations WHERE conv_id = 3")
def messages_of_conversation(spark, sf_dir):
    messages = _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("conversation_id"), F.col("turn").alias("id"), F.col("turn").alias("created_at"), "role", "text"
    )
    return conversations.messages_of(messages, 3)


# --- sample transactions ------------------------------------------------------

_TX_SQL = (
    "SELECT transaction_id, coalesce(customer_name, 'UNKNOWN') AS customer_name, upper(i.merchant_name) AS merchant_name,"
    " coalesce(i.amount, 0) AS amount, upper(i.status) AS status, upper(m.merchant_name) AS master_merchant_name,"
    " CASE WHEN i.merchant_name IS NULL OR m.merchant_name IS NULL THEN 0"
    " ELSE round(jaro_winkler_similarity(upper(i.merchant_name), upper(m.merchant_name)), 4) END AS match_score"
    " FROM tx_incoming_v i LEFT JOIN tx_master_v m USING (transaction_id)"
)
_TX_GRADE = "SELECT *, CASE WHEN match_score >= 0.98 THEN 'A' WHEN match_score >= 0.9 THEN 'B' WHEN match_score >= 0.75 THEN 'C' ELSE 'D' END AS grade FROM t"


def _transactions(spark, sf_dir):
    return transactions.grade_transactions(derive(spark, sf_dir, "tx_incoming_v"), derive(spark, sf_dir, "tx_master_v"))


@query(with_tables("tx_incoming_v", "tx_master_v", t=_TX_SQL) + _TX_GRADE)
def etl_fuzzy_grade(spark, sf_dir):
    return _transactions(spark, sf_dir)


@query(
    with_tables("tx_incoming_v", "tx_master_v", t=_TX_SQL, g=_TX_GRADE)
    + "SELECT count(*) AS total_rows, " + ", ".join(f"count(*) FILTER (WHERE grade = '{g}') AS grade_{g.lower()}" for g in "ABCD") + " FROM g"
)
def etl_grade_counts(spark, sf_dir):
    return transactions.grade_counts(_transactions(spark, sf_dir))


@query(
    "SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN NULL ELSE value END AS value FROM events"
)
def sanitize_nan(spark, sf_dir):
    odd = F.col("event_id") % 5
    dirty = _table(spark, sf_dir, "events").select(
        "event_id",
        F.when(odd == 0, float("nan")).when(odd == 1, float("-inf")).otherwise(F.col("value")).alias("value"),
    )
    return tx.finite_or_null(dirty)


# --- sources, sinks and streams -----------------------------------------------

_UPLOAD_COLUMNS = ["nik", "nama", "tempat_lahir", "tanggal_lahir", "jenis_kelamin", "nama_ibu"]


def _as_csv(spark, sf_dir) -> str:
    """The derived uploads as CSV files, several per folder."""
    folder = fresh_path(spark, "csv")
    derive(spark, sf_dir, "upload_rows_v").repartition(4, "file_id").select(*_UPLOAD_COLUMNS).write.option(
        "header", True).csv(folder)
    return folder


_TOTALS_SQL = (
    "SELECT count(*) AS n_rows, count(nik) AS n_nik, count(DISTINCT nik) AS distinct_nik, count(nama_ibu) AS n_mothers,"
    " count(tanggal_lahir) AS n_dates, true AS dense_ids FROM upload_rows_v"
)


_SHARE_ROWS = 250_000  # rows of a task that tells id numbers apart


def _totals(rows):
    """Totals over all files; row ids must be 1..n in every file.

    What a task holds doesn't grow with the table: ids are told apart by a bit each, 64 to a
    group, and id numbers in shares of the rows before they meet.
    """
    number = F.col("id").cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(63).cast("int"))
    ids = rows.groupBy("file_id", F.shiftright(number, 6).alias("word")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_count(F.bit_or(bit)).alias("d"),
        F.min(number).alias("low"), F.max(number).alias("high"),
    ).groupBy("file_id").agg(
        F.sum("n").alias("n"), F.sum("d").alias("d"), F.min("low").alias("low"), F.max("high").alias("high"),
    ).agg(F.min((F.col("n") == F.col("d")) & (F.col("low") == 1) & (F.col("high") == F.col("n"))).alias("ok")).scalar()
    shares = max(1, -(-rows.count() // _SHARE_ROWS))
    share = F.pmod(F.xxhash64("file_id", "id"), F.lit(16 * shares)).alias("share")  # many small ones a task come out even
    niks = rows.where(F.col("nik").isNotNull()).select("nik", share).repartition(shares, "share").distinct()
    distinct = niks.select("nik").repartition(shares, "nik").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("nik").alias("n_nik"),
        F.count("nama_ibu").alias("n_mothers"), F.count("tanggal_lahir").alias("n_dates"),
    )
    return counts.select(
        "n_rows", "n_nik", distinct.alias("distinct_nik"), "n_mothers", "n_dates", ids.alias("dense_ids")
    )


@query(with_tables("upload_rows_v") + _TOTALS_SQL)
def csv_intake(spark, sf_dir):
    """CSV files -> rows with ids -> curated Parquet -> read back."""
    rows = intake.read_uploads(spark, _as_csv(spark, sf_dir))
    curated = fresh_path(spark, "curated")
    tables.write_curated(rows, curated)
    return _totals(intake.read_curated(spark, curated))


@query(with_tables("upload_rows_v") + "SELECT cast(sum(1) as bigint) AS row_count, true AS named FROM upload_rows_v")
def register_uploads(spark, sf_dir):
    rows = intake.read_uploads(spark, _as_csv(spark, sf_dir))
    files = intake.register_files(rows, F.lit("office"), _now())
    return files.agg(
        F.sum("row_count").alias("row_count"), F.min(F.col("original_filename").endswith(".csv")).alias("named")
    )


@query(
    with_tables("partners_v", "incoming_v")
    + "SELECT i.nik, i.nama, i.tanggal_lahir, m.nama_lengkap AS master_nama_lengkap FROM partners_v p"
      " JOIN incoming_v i ON p.file_id = i.file_id AND p.id_incoming = i.id LEFT JOIN master_v m ON p.nik_master = m.nik"
      f" WHERE p.match_result IN (1, 4) AND p.file_id = '{EXPORTED_FILE}'"
)
def export_csv(spark, sf_dir):
    """The semicolon export of one file, read back."""
    matched, _ = tables.export_file(
        derive(spark, sf_dir, "partners_v"), derive(spark, sf_dir, "incoming_v"),
        derive(spark, sf_dir, "master_v"), EXPORTED_FILE, fresh_path(spark, "export"),
    )
    rows = spark.read.csv(matched, sep=";", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return rows.select("nik", "nama", "tanggal_lahir", "master_nama_lengkap")


@query(with_tables("upload_rows_v") + _TOTALS_SQL)
def stream_intake(spark, sf_dir):
    """The same uploads through the intake stream."""
    work = fresh_path(spark, "intake")
    jobs.watch_uploads(
        spark, _as_csv(spark, sf_dir), _UPLOAD_COLUMNS, f"{work}/curated", f"{work}/grades", f"{work}/state"
    ).awaitTermination()
    return _totals(spark.read.parquet(f"{work}/curated"))


@query(
    with_tables("audit_v", "access_v", b=_BOTH)
    + "SELECT date_trunc('hour', event_time) AS hour_start, round(avg(latency_ms), 2) AS latency, count(*) AS events"
      " FROM b WHERE latency_ms > 0 GROUP BY 1"
)
def stream_latency(spark, sf_dir):
    """Both event logs through the latency stream."""
    logs = fresh_path(spark, "events")
    both = audit.both_logs(*_logs(spark, sf_dir)).withColumn("event_time", F.col("event_time").cast("timestamp"))
    tables.append_rows(both, logs)
    work = fresh_path(spark, "latency")
    events = spark.readStream.schema(both.schema).parquet(logs)
    jobs.keep_latency(events, f"{work}/table", f"{work}/state").awaitTermination()
    return jobs.read_latency(spark, f"{work}/table")


@query(
    with_tables("incoming_v", **_match_parts(sc.PROFILE_A))
    + "SELECT file_id, id_incoming, nik_master, match_score, match_result FROM matched"
)
def stream_match(spark, sf_dir):
    """Graded files through the match stream."""
    work = fresh_path(spark, "match")
    incoming = derive(spark, sf_dir, "incoming_v")
    graded = incoming.select("file_id").distinct().withColumn("grade", F.lit(1))
    tables.append_rows(graded, f"{work}/graded")
    tables.write_curated(incoming, f"{work}/curated")
    jobs.watch_matches(
        spark, f"{work}/curated", f"{work}/graded", "file_id string, grade int", _master(spark, sf_dir),
        sc.default_rules(spark), f"{work}/results", f"{work}/state", _now(),
    ).awaitTermination()
    return tables.read_by_file(spark, f"{work}/results").select(
        "file_id", "id_incoming", "nik_master", "match_score", "match_result"
    )


@query(
    with_tables(*_REASON_TABLES, **_PATTERN_TEXTS) + _explained_sql()
)
def stream_reasons(spark, sf_dir):
    """Review pairs through the reason stream."""
    work = fresh_path(spark, "reasons")
    pairs = _pairs(spark, sf_dir)
    tables.append_rows(pairs, f"{work}/pairs")
    stream = spark.readStream.schema(pairs.schema).option("maxFilesPerTrigger", 1000).parquet(f"{work}/pairs")
    jobs.watch_reasons(
        spark, stream, f"{work}/patterns", f"{work}/explained", f"{work}/state", _now()
    ).awaitTermination()
    return spark.read.parquet(f"{work}/explained").select(
        "id", "file_id", "pattern_hash", "reason", "pattern_name", "source"
    )
