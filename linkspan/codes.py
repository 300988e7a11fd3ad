"""Codes, labels, word lists, formats and weights.

They are data-model constants; results are only comparable with them as given.
"""

# File grades
GRADE_A, GRADE_B, GRADE_C, GRADE_D, GRADE_E = 1, 2, 3, 4, 5
GRADE_LABELS = {1: "A", 2: "B", 3: "C", 4: "D", 5: "E"}

# Processing status of an uploaded file
UPLOADED, GRADED = 1, 2
PROCESS_LABELS = {1: "UPLOADED", 2: "GRADED"}

# Synchronisation status of an uploaded file
SYNC_IN_PROGRESS, SYNC_AWAITING, SYNC_COMPLETED = 1, 2, 3
SYNC_LABELS = {1: "In Progress", 2: "Awaiting Action", 3: "Completed"}

# Match results
AUTO_MATCH, REVIEW, AUTO_UNMATCH, MANUAL_MATCH, MANUAL_UNMATCH = 1, 2, 3, 4, 5
RESULT_LABELS = {
    1: "AUTO_MATCH",
    2: "MANUAL_REVIEW",
    3: "AUTO_UNMATCH",
    4: "MANUAL_MATCH",
    5: "MANUAL_UNMATCH",
}
MATCHED_RESULTS = (AUTO_MATCH, MANUAL_MATCH)
UNMATCHED_RESULTS = (AUTO_UNMATCH, MANUAL_UNMATCH)

# Explanation status of a review row
PENDING, PROCESSING, COMPLETED, FAILED = "PENDING", "PROCESSING", "COMPLETED", "FAILED"

# Columns of an uploaded file
GRADED_COLUMNS = ("nik", "nama", "tempat_lahir", "tanggal_lahir", "jenis_kelamin", "nama_ibu")
TEXT_COLUMNS = ("nama", "tempat_lahir", "provinsi", "kabupaten", "kecamatan", "kelurahan", "nama_ibu")
AREA_COLUMNS = ("provinsi", "kabupaten", "kecamatan", "kelurahan")
MASTER_COLUMNS = (
    "nik", "nama_lengkap", "tempat_lahir", "provinsi", "kabupaten", "kecamatan",
    "kelurahan", "tanggal_lahir", "jenis_kelamin", "nama_ibu", "status_kematian",
)
NIK_LENGTH = 16

# Spellings of gender and life status
GENDER_WORDS = {
    "l": ("laki-laki", "laki laki", "pria", "male", "l"),
    "p": ("perempuan", "wanita", "female", "p"),
}
LIFE_WORDS = {
    "h": ("hidup", "h"),
    "m": ("meninggal", "mati", "wafat", "m"),
}
# The narrower list used when two gender values are compared for a reason
PATTERN_GENDER_WORDS = {
    "l": ("l", "laki-laki", "pria"),
    "p": ("p", "perempuan", "wanita"),
}

# Accepted birth dates: d/m/yyyy, d-m-yyyy, d m yyyy, d-mon-yyyy, d month yyyy,
# yyyy-m-d (see functions.text.birth_date); the registry has yyyy-m-d only
EARLIEST_BIRTH_YEAR = 1900

# Characters with the Unicode White_Space property
WHITESPACE = (
    "\t\n\u000b\f\r \u0085          "
    "       　"
)

# Jaro-Winkler parameters
JW_PREFIX_WEIGHT = 0.1
JW_PREFIX_LENGTH = 4
JW_PREFIX_FROM = 0.7

# Pattern fields: field, short name used in the pattern name
PATTERN_FIELDS = (
    ("nama_lengkap", "NAMA"),
    ("tempat_lahir", "TMPTLAHIR"),
    ("tanggal_lahir", "TGLLAHIR"),
    ("jenis_kelamin", "GENDER"),
    ("nama_ibu", "IBU"),
)

# Page sizes of the reports
PAGE_GRADED = 10
PAGE_REVIEW = 10
PAGE_SYNCED = 15
PREVIEW_ROWS = 10

# Default number of days events are kept
RETENTION_DAYS = 30

# Document markup
PAGE_BREAK = "<!-- page break -->"
