"""Identity tables derived from the given tables.

Each text is plain SQL that reads the same in Spark and in other engines, so a
check can start from exactly the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_FIRST = "budi,siti,agus,dewi,rina,joko,putri,andi,wati,hadi,yusuf,maya,bayu,indah,tono,lestari"
_LAST = "santoso,wijaya,pratama,saputra,hidayat,nugroho,kusuma,siregar,nasution,halim,gunawan,setiawan"
_PLACES = "jakarta,bandung,surabaya,medan,semarang,makassar,denpasar,palembang,padang,bogor"
_MOTHER_FIRST = "sri,ani,tuti,lina,nur,ratna,yanti"
_MOTHER_LAST = "rahayu,utami,handayani,sari,wulandari"
_PROVINCES = "jawa barat,jawa tengah,jawa timur,bali,banten"
_MONTHS = "Jan,Feb,Mar,Apr,May,Jun,Jul,Aug,Sep,Oct,Nov,Dec"
_LONG_MONTHS = (
    "January,February,March,April,May,June,July,August,September,October,November,December"
)


def _pick(words: str, index: str) -> str:
    return f"split_part('{words}', ',', cast(1 + {index} as int))"


MASTER = f"""
SELECT k, cast(3200000000000000 + k as string) AS nik,
 concat({_pick(_FIRST, 'k % 16')}, ' ', {_pick(_LAST, 'cast(floor(k/16.0) as bigint) % 12')}) AS nama_lengkap,
 {_pick(_PLACES, '(k*7) % 10')} AS tempat_lahir,
 cast(date '1950-01-01' + cast((k*37) % 20000 as int) as string) AS tanggal_lahir,
 CASE WHEN k % 2 = 0 THEN 'L' ELSE 'P' END AS jenis_kelamin,
 concat({_pick(_MOTHER_FIRST, 'k % 7')}, ' ', {_pick(_MOTHER_LAST, 'k % 5')}) AS nama_ibu,
 {_pick(_PROVINCES, 'k % 5')} AS provinsi,
 concat('kab ', cast(k % 40 as string)) AS kabupaten,
 concat('kec ', cast(k % 200 as string)) AS kecamatan,
 concat('kel ', cast(k % 900 as string)) AS kelurahan,
 CASE WHEN k % 7 = 0 THEN 'meninggal' ELSE 'hidup' END AS status_kematian
FROM (SELECT o_orderkey AS k FROM orders) o
"""

_DAY, _MONTH, _YEAR = (
    "substr(tanggal_lahir,9,2)", "substr(tanggal_lahir,6,2)", "substr(tanggal_lahir,1,4)",
)
_MONTH_INDEX = f"cast({_MONTH} as int) - 1"

INCOMING = f"""
SELECT k, concat('f', cast(cast(floor(k/3.0) as bigint) % 10 as string)) AS file_id,
 cast(k + 1 as string) AS id,
 CASE WHEN k % 11 = 0 THEN NULL ELSE nik END AS nik,
 concat(' ', upper(CASE WHEN k % 5 = 0 THEN replace(nama_lengkap,'a','o')
                        WHEN k % 6 = 0 THEN concat(nama_lengkap,' alias') ELSE nama_lengkap END)) AS nama,
 CASE WHEN k % 8 = 0 THEN NULL ELSE tempat_lahir END AS tempat_lahir,
 CASE WHEN k % 9 = 0 THEN NULL
      WHEN k % 2 = 0 THEN concat({_DAY},'/',{_MONTH},'/',{_YEAR})
      WHEN k % 5 = 0 THEN concat({_DAY},'-',{_MONTH},'-',{_YEAR})
      WHEN k % 7 = 0 THEN concat({_DAY},' ',{_MONTH},' ',{_YEAR})
      WHEN k % 11 = 0 THEN concat({_DAY},'-',{_pick(_MONTHS, _MONTH_INDEX)},'-',{_YEAR})
      WHEN k % 13 = 0 THEN concat({_DAY},' ',{_pick(_LONG_MONTHS, _MONTH_INDEX)},' ',{_YEAR})
      ELSE tanggal_lahir END AS tanggal_lahir,
 CASE WHEN k % 10 = 0 THEN NULL WHEN jenis_kelamin = 'L' THEN 'Laki-laki' ELSE 'Perempuan' END AS jenis_kelamin,
 CASE WHEN k % 12 = 0 THEN NULL ELSE nama_ibu END AS nama_ibu,
 provinsi, kabupaten, kecamatan, kelurahan,
 CASE WHEN status_kematian='hidup' THEN 'H' ELSE 'wafat' END AS status_hidup
FROM master_v WHERE k % 3 = 0
"""

# Files of different completeness: 0,5 full; 1,6 with gaps; 2,7 without nik;
# 3,8 without nik and with gaps; 4,9 mostly empty.
UPLOAD_ROWS = """
SELECT file_id, id,
 CASE WHEN kind IN (2,3) THEN NULL WHEN kind = 1 AND k % 11 = 0 THEN NULL
      WHEN kind = 1 AND k % 13 = 0 THEN substr(nik, 1, 10) ELSE full_nik END AS nik,
 nama,
 CASE WHEN kind IN (1,3) AND k % 7 = 0 OR kind = 4 AND k % 4 > 1 THEN NULL ELSE coalesce(tempat_lahir, 'bogor') END AS tempat_lahir,
 CASE WHEN kind IN (1,3) AND k % 4 = 0 OR kind = 4 THEN tanggal_lahir ELSE coalesce(tanggal_lahir, '1990-01-01') END AS tanggal_lahir,
 CASE WHEN kind IN (1,3,4) THEN jenis_kelamin ELSE coalesce(jenis_kelamin, 'L') END AS jenis_kelamin,
 CASE WHEN kind = 4 THEN NULL WHEN kind IN (1,3) THEN nama_ibu ELSE coalesce(nama_ibu, 'sri') END AS nama_ibu
FROM (SELECT *, cast(3200000000000000 + k as string) AS full_nik,
             cast(floor(k/3.0) as bigint) % 5 AS kind FROM incoming_v) x
"""

# Header of each upload, as a comma list
UPLOAD_HEADERS = """
SELECT concat('f', cast(s_suppkey as string)) AS file_id,
 CASE WHEN s_suppkey % 5 IN (2, 3) THEN 'id,nama,tempat_lahir,tanggal_lahir,jenis_kelamin,nama_ibu'
      ELSE 'id,nik,nama,tempat_lahir,tanggal_lahir,jenis_kelamin,nama_ibu' END AS header
FROM supplier
"""

UPLOADED_FILES = """
SELECT concat('f', cast(s_suppkey as string)) AS file_id,
 concat('upload_', cast(s_suppkey as string), '.csv') AS original_filename,
 s_name AS institution_name,
 concat('curated/upload_', cast(s_suppkey as string), '.parquet') AS minio_path,
 cast(date '2024-01-01' + cast((s_suppkey * 7) % 60 as int) as timestamp) AS upload_timestamp,
 2 AS processing_status,
 cast(1 + s_suppkey % 5 as int) AS grade,
 CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 1 END AS is_sync,
 cast(1 + s_suppkey % 3 as int) AS sync_status,
 cast(1000 + s_suppkey as int) AS row_count,
 CASE WHEN s_suppkey % 6 = 0 THEN 'READY' ELSE NULL END AS export_status,
 CASE WHEN s_suppkey % 6 = 0 THEN concat('download/f', cast(s_suppkey as string), '/match.csv') ELSE NULL END AS export_match_path,
 cast(NULL as string) AS export_unmatch_path,
 CASE WHEN s_suppkey % 5 = 0 THEN 'RUNNING' ELSE 'IDLE' END AS matching_task_status
FROM supplier
"""

# Stored match results, for the reports
RESULTS = """
SELECT file_id, id_incoming, CASE WHEN match_result IN (3, 5) THEN NULL ELSE nik END AS nik_master,
 match_score, match_result, upload_date
FROM (SELECT concat('f', cast(cast(floor(k/3.0) as bigint) % 10 as string)) AS file_id,
  cast(k + 1 as string) AS id_incoming, cast(3200000000000000 + k as string) AS nik,
  cast((k*7919) % 10001 as double) / 100.0 AS match_score,
  cast(1 + k % 5 as int) AS match_result,
  cast(date '2024-01-01' + cast(k % 60 as int) as timestamp) AS upload_date
 FROM (SELECT o_orderkey AS k FROM orders) o) r
"""

# Rows waiting for review
MANUAL = """
SELECT k AS id, file_id, id AS id_incoming, nik AS nik_incoming, nama AS nama_incoming,
 tempat_lahir AS tempat_lahir_incoming,
 concat_ws(', ', provinsi, kabupaten, kecamatan, kelurahan) AS area_incoming,
 tanggal_lahir AS tanggal_lahir_incoming, jenis_kelamin AS jenis_kelamin_incoming,
 nama_ibu AS nama_ibu_incoming,
 cast(NULL as string) AS reason, cast(NULL as string) AS pattern_name,
 cast(NULL as string) AS reasoning_source,
 CASE WHEN k % 7 = 0 THEN 'FAILED' WHEN k % 7 = 1 THEN 'COMPLETED' WHEN k % 7 = 2 THEN 'PROCESSING' ELSE 'PENDING' END AS reasoning_status
FROM incoming_v
"""

# Every incoming row has a stored result pointing to a neighbour in the registry
PARTNERS = """
SELECT file_id, id AS id_incoming,
 CASE WHEN k % 4 = 0 THEN cast(3200000000000000 + k + 1 as string) ELSE cast(3200000000000000 + k as string) END AS nik_master,
 cast((k*7919) % 10001 as double) / 100.0 AS match_score,
 cast(CASE WHEN k % 2 = 0 THEN 2 ELSE 1 + k % 5 END as int) AS match_result
FROM incoming_v
"""

AUDIT_EVENTS = """
SELECT event_id AS id, ts AS event_time, 'system_poc' AS actor_user_id,
 concat('org', cast(user_id % 20 as string)) AS actor_org_id, event_type AS action,
 'FILE' AS resource_type, concat('f', cast(user_id as string)) AS resource_id,
 CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS result,
 CASE WHEN event_id % 13 = 0 THEN NULL ELSE cast(floor(value) as bigint) END AS latency_ms
FROM events WHERE event_id % 2 = 0
"""

ACCESS_EVENTS = """
SELECT event_id AS id, ts AS event_time, 'anonymous_poc' AS actor_user_id, event_type AS action,
 'REPORT' AS resource_type, concat('f', cast(user_id as string)) AS resource_id,
 concat('10.0.0.', cast(user_id % 250 as string)) AS ip_address,
 CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS result,
 CASE WHEN event_id % 13 = 0 THEN NULL ELSE cast(floor(value) as bigint) END AS latency_ms
FROM events WHERE event_id % 2 = 1
"""

TRANSACTIONS_MASTER = f"""
SELECT cast(o_orderkey as string) AS transaction_id,
 concat({_pick(_LAST, 'o_orderkey % 12')}, ' ', {_pick(_PLACES, '(o_orderkey*3) % 10')}) AS merchant_name,
 o_totalprice AS amount, o_orderstatus AS status
FROM orders
"""

TRANSACTIONS_INCOMING = f"""
SELECT cast(o_orderkey as string) AS transaction_id,
 CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE concat('customer ', cast(o_custkey as string)) END AS customer_name,
 CASE WHEN o_orderkey % 4 = 0 THEN replace({_pick(_LAST, 'o_orderkey % 12')}, 'a', 'e')
      WHEN o_orderkey % 9 = 0 THEN NULL
      WHEN o_orderkey % 4 = 1 THEN concat({_pick(_LAST, 'o_orderkey % 12')}, ' ', {_pick(_PLACES, '(o_orderkey*3) % 10')})
      ELSE concat({_pick(_LAST, 'o_orderkey % 12')}, ' ', {_pick(_PLACES, '(o_orderkey*3) % 10')}) END AS merchant_name,
 CASE WHEN o_orderkey % 33 = 0 THEN NULL ELSE o_totalprice + (o_orderkey % 11) - 5 END AS amount,
 lower(o_orderstatus) AS status
FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 5 = 0
"""

# Question-and-answer documents made of the given texts: every line a page, its
# first sentence the question.
FAQ = """
SELECT doc_id, concat('kb/markdown/', source, '/faq_', cast(doc_id as string), '.md') AS path,
 concat('Q: ', replace(replace(CASE WHEN doc_id % 3 = 0 THEN replace(text, ', ', concat(chr(10), '<query>')) ELSE text END,
   '. ', concat('.', chr(10), chr(10), chr(10), chr(10))),
   chr(9), ' ')) AS body
FROM documents
"""
FAQ_DOCUMENTS = """
SELECT doc_id, path, replace(body, concat('.', chr(10), 'E'), concat('.', chr(10), '<!-- page break -->', chr(10), 'Q: E')) AS text
FROM faq_body_v
"""

TEXTS = {
    "faq_body_v": FAQ,
    "faq_v": FAQ_DOCUMENTS,
    "master_v": MASTER,
    "incoming_v": INCOMING,
    "upload_rows_v": UPLOAD_ROWS,
    "upload_headers_v": UPLOAD_HEADERS,
    "files_v": UPLOADED_FILES,
    "results_v": RESULTS,
    "manual_v": MANUAL,
    "partners_v": PARTNERS,
    "audit_v": AUDIT_EVENTS,
    "access_v": ACCESS_EVENTS,
    "tx_master_v": TRANSACTIONS_MASTER,
    "tx_incoming_v": TRANSACTIONS_INCOMING,
}
NEEDS = {
    "incoming_v": ("master_v",),
    "upload_rows_v": ("incoming_v",),
    "manual_v": ("incoming_v",),
    "partners_v": ("incoming_v",),
    "faq_v": ("faq_body_v",),
}
BASE_TABLES = ("orders", "supplier", "events", "documents")


def needed(names: tuple[str, ...]) -> list[str]:
    """The named texts and what they read, in order."""
    out: list[str] = []
    for name in names:
        for item in (*needed(NEEDS.get(name, ())), name):
            if item not in out:
                out.append(item)
    return out


def with_tables(*names: str, **more: str) -> str:
    """WITH clause that defines the named tables (and further texts) for a check."""
    parts = [f"{name} AS ({TEXTS[name]})" for name in needed(names)]
    parts += [f"{name} AS ({text})" for name, text in more.items()]
    return "WITH " + ",\n".join(parts) + "\n"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A table; one that comes in fewer pieces than there are cores is spread."""
    table = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table over the parquet tables of a folder."""
    parts = needed((name,))
    tables = {
        t: scan(spark, f"{sf_dir}/{t}.parquet")
        for t in BASE_TABLES
        if any(f"FROM {t}" in TEXTS[p] for p in parts)
    }
    ctes = []
    for part in parts:
        body = TEXTS[part].replace("{", "{{").replace("}", "}}")
        for table in tables:
            body = body.replace(f"FROM {table}", f"FROM {{{table}}}")
        ctes.append(f"{part} AS ({body})")
    return spark.sql(f"WITH {', '.join(ctes)} SELECT * FROM {name}", **tables)
