"""WARC archives: one gzip member a record, written by tasks and read back in byte ranges.

`write` gives every page a response record, except that of pages with equal payloads of
at least `least` bytes only the largest page_id keeps it; the others become revisit
records that name it. Each task writes files of its own name, and the manifest
of the files of finished tasks, written by Spark's own commit, says which of them count:
files of lost or repeated attempts are never read.

`read_archives` is splittable: a task looks for gzip magic bytes from the start of its
range, takes a place for a member only if its first bytes unpack to a WARC version line,
and owns the records that start inside the range, which it reads to their end. Records
written here also name their place, so that an archive inside a payload is not taken for
records of the outer one. Memory is bounded by the largest record.

Archives are opened with pyarrow's file systems, so the folder may be a path or a URI
that those know.

Defined results: a null html is an empty payload, a null url an empty one; a null page_id
is written as no id and read back as null; as a partner it counts as the smallest, and
of payloads that only have null ids all are responses. Rows with the same page_id and payload are
all written, and are responses together if theirs is the largest. Payloads may hold
anything, also gzip magic and WARC headers. An empty table writes no file and reads back
no rows. Other columns are not written.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
READ_BYTES = 1 << 20

RECORD = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary, file string, position long"
)
_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_RECORD = pa.schema([(name, _KINDS[kind]) for name, kind in (f.split() for f in RECORD.split(", "))])


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """A path without a scheme is on a folder that all executors share."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def record(
    kind: str, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, place: str = "",
    date: str = "1970-01-01T00:00:00Z",
) -> bytes:
    """A gzip member with one record; a revisit has no body. `place`: its file and position, which make its id."""
    body = payload if kind == "response" else b""
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{place} {page_id} {kind} {digest}')}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", len(payload)),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", page_id))
    if place:
        fields.append(("X-Place", place))
    if kind == "revisit":
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("X-Refers-To-Page-ID", refers_to),
        ]
    fields.append(("Content-Length", len(body)))
    head = VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head + body + b"\r\n\r\n") + pack.flush()


def plan(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to of each page.

    Only digests and ids are grouped; a payload held by very many pages is counted in
    the tasks that read it first.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.length("payload") >= least
    kept = rows.where(large).groupBy("digest").agg(
        F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").select(F.col("digest").alias("repeated"), "keeper")
    joined = rows.join(kept, large & (F.col("digest") == F.col("repeated")), "left")
    again = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select(
        "page_id", "url", "payload", "digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("keeper")).alias("refers_to"),
    )


MANIFEST = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])


def write(planned: DataFrame, folder: str) -> DataFrame:
    """Write the archives below `folder`; gives the manifest (file, bytes, records).

    All records have the date of this call.
    """
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        name, out, records = f"part-{uuid.uuid4().hex}.warc.gz", None, 0
        size = 0
        for batch in batches:
            for n in range(batch.num_rows):
                page_id, url, payload, digest, kind, keeper = (c[n].as_py() for c in batch.columns)
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                member = record(kind, page_id, url, payload, digest, keeper, f"{name}@{size}", date)
                out.write(member)
                size += len(member)
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size]), pa.array([records])], schema=MANIFEST)

    manifest = f"{folder.rstrip('/')}/manifest"
    rows = planned.select("page_id", "url", "payload", "digest", "record_type", "refers_to")
    rows.mapInArrow(archive, "file string, bytes long, records long").write.parquet(manifest)
    return planned.sparkSession.read.schema("file string, bytes long, records long").parquet(manifest)


def misplaced(data: bytes, name: str, at: int) -> bool:
    """Whether a record says that it stands elsewhere: then it is part of a payload.

    Records without that field, as of other writers, are taken as they are.
    """
    head, _, _ = data.partition(b"\r\n\r\n")
    said = [x for x in head.split(b"\r\n") if x.startswith(b"X-Place: ")]
    return bool(said) and said[0] != f"X-Place: {name}@{at}".encode()


def members(stream, size: int, start: int, end: int, name: str = "") -> Iterator[tuple[int, bytes]]:
    """(position, unpacked bytes) of the members of a file that start in [start, end)."""
    at, held, base = start, b"", start  # held: bytes of the file from base on
    while at < end:
        if at - base + len(MAGIC) > len(held) and base + len(held) < size:
            held = held[at - base:]
            base = at
            stream.seek(base + len(held))
            held += stream.read(READ_BYTES)
        found = held.find(MAGIC, at - base)
        if found < 0:
            if base + len(held) >= size:
                return
            at = max(at, base + len(held) - len(MAGIC) + 1)
            continue
        at = base + found
        if at >= end:
            return
        unpack = zlib.decompressobj(31)
        parts, place, good, seen = [], at, True, 0
        chunk = held[at - base:]
        while good:
            try:
                part = unpack.decompress(chunk)
            except zlib.error:
                good = False
                break
            place += len(chunk)
            parts.append(part)
            seen += len(part)
            if seen >= len(VERSION) > seen - len(part):
                good = b"".join(parts).startswith(VERSION)
            if unpack.eof or not good:
                break
            if place >= size:
                good = False
                break
            stream.seek(place)
            chunk = stream.read(READ_BYTES)
        if good and seen >= len(VERSION) and not misplaced(data := b"".join(parts), name, at):
            yield at, data
            following = place - len(unpack.unused_data)
            held, base, at = unpack.unused_data, following, following
        else:
            at += 1


def parsed(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    whole = lambda name: int(fields[name]) if name in fields else None
    body = rest[:int(fields["Content-Length"])]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and hashlib.sha1(body).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": whole("X-Page-ID"), "url": fields["WARC-Target-URI"],
        "payload_bytes": whole("X-Payload-Length"), "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": whole("X-Refers-To-Page-ID"),
        "payload": body if fields["WARC-Type"] == "response" else None,
    }


def read_archives(spark: SparkSession, folder: str, files: DataFrame, range_bytes: int = 8 << 20) -> DataFrame:
    """The records of the files of a manifest (file, bytes), by ranges of `range_bytes`."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.where("bytes > 0").select("file", F.col("bytes").alias("size"), starts.alias("start"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                found, held = [], 0
                with store.open_input_file(f"{base}/{row['file']}") as stream:
                    for place, data in members(
                        stream, row["size"], row["start"], row["start"] + range_bytes, row["file"]
                    ):
                        found.append({**parsed(data), "file": row["file"], "position": place})
                        held += len(data)
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_pylist(found, _RECORD)
                            found, held = [], 0
                if found:
                    yield pa.RecordBatch.from_pylist(found, _RECORD)

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(tasks).mapInArrow(scan, RECORD)
