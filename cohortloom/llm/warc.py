"""Web archives: gzip members of one record each, written by tasks and read back by byte ranges.

A reading task owns the records whose first byte lies inside its range. It looks for the gzip magic,
takes a place for a member only if the bytes inflate to a record header, and reads on past the end
of its range to finish the last record. Archives need no index and are never read by one task whole.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, stage, store

MAGIC = b"\x1f\x8b\x08"
#: Fixed values of the archive format.
VERSION, REVISIT_PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN, NULL_URN = "urn:x-record:", "urn:x-null-record:"
CHUNK = 1 << 20
MAX_TASKS = 100_000


def classify(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int = 100) -> DataFrame:
    """id, url, payload, digest, record type and the id that a revisit refers to.

    Among equal payloads of at least `least` bytes the smallest id is the response (all rows that
    carry it), the others revisit it; smaller payloads and rows with a null id are responses.
    """
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= least
    first = rows.where(large).groupBy("digest").agg(F.min("id").alias("first_id"))
    # Small payloads meet no partner. A null key would send them all to one task, so each row has a key of its own.
    alone = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    keyed = rows.withColumn("key", F.when(large, F.col("digest")).otherwise(alone))
    joined = keyed.join(first.withColumnRenamed("digest", "key"), "key", "left")
    again = F.coalesce(F.col("id") > F.col("first_id"), F.lit(False))
    return joined.select(
        "id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
    )


def record_bytes(key: str | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: str | None,
                 number: int) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header (with the payload's length), not the payload."""
    urn = NULL_URN + uuid.uuid4().hex if key is None else RECORD_URN + quote(key, safe="")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{urn}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="/:?&=#%+,;@!$'()*~[]"))
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{RECORD_URN}{quote(refers_to, safe='')}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


_MANIFEST = pa.schema([("path", pa.string()), ("n_bytes", pa.int64()), ("n_records", pa.int64())])


def write_archives(records: DataFrame, folder: str, file_bytes: int = 1 << 30) -> DataFrame:
    """Write classified records to archives in `folder`; a lazy manifest (path, n_bytes, n_records).

    Every attempt of a task writes files of its own, and only the files of attempts that Spark
    commits come out in the manifest: persist it before reading. Lost or repeated attempts leave
    files that no manifest names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(folder)
        system.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, name, size, count = None, "", 0, 0
        for b in batches:
            for r in zip(*(b.column(c) for c in ("id", "url", "payload", "digest", "record_type", "refers_to")), strict=True):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                member = record_bytes(*(x.as_py() for x in r), number=count)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= file_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, count))
        for path, size, count in done:
            yield batch(_MANIFEST, {"path": [path], "n_bytes": [size], "n_records": [count]})

    text = records.withColumns({"id": F.col("id").cast("string"), "refers_to": F.col("refers_to").cast("string")})
    return text.mapInArrow(run, "path string, n_bytes bigint, n_records bigint")


def _header(inflated: bytes) -> dict[str, str] | None:
    """Fields of a record header, or None if these bytes are not the start of a record."""
    end = inflated.find(b"\r\n\r\n")
    if not inflated.startswith(b"WARC/1.") or end < 0:
        return None
    lines = inflated[:end].decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    known = {"warc-type", "warc-record-id", "content-length"} <= fields.keys() and fields["content-length"].isdigit()
    return fields | {"": str(end + 4)} if known else None


def _member(f, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """(header, block, place after the member) of a valid member at `at`, else None."""
    f.seek(at)
    inflate, data, header = zlib.decompressobj(31), bytearray(), None
    used = searched = 0
    try:
        while not inflate.eof:
            raw = f.read(CHUNK if header else 16_384)
            if not raw:
                return None
            used += len(raw)
            data += inflate.decompress(raw)
            if header is None:
                if not data.startswith(b"WARC/1."[: len(data)]):
                    return None
                # A header may be of any length; what has been searched for its end is not searched again.
                end = data.find(b"\r\n\r\n", max(0, searched - 3))
                searched = len(data)
                if end >= 0 and (header := _header(bytes(data[: end + 4]))) is None:
                    return None
    except zlib.error:
        return None
    if header is None:
        return None
    start = int(header[""])
    return header, bytes(data[start : start + int(header["content-length"])]), at + used - len(inflate.unused_data)


def scan_range(f, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, header, block) of the records whose first byte lies in [start, end)."""
    at = start
    while at < end:
        f.seek(at)
        window = f.read(min(CHUNK, end - at) + len(MAGIC) - 1)
        found = window.find(MAGIC)
        if found < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += found
        if at >= end:
            return
        member = _member(f, at)
        if member is None:
            at += 1
            continue
        yield at, member[0], member[1]
        at = member[2]


def _key(urn: str | None) -> str | None:
    urn = (urn or "").strip("<>")
    return unquote(urn[len(RECORD_URN):]) if urn.startswith(RECORD_URN) else None


_RECORD = pa.schema([
    ("path", pa.string()), ("place", pa.int64()), ("key", pa.string()), ("url", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("payload", pa.binary()),
])
RECORD = (
    "path string, place bigint, key string, url string, record_type string, refers_to string, "
    "payload_bytes bigint, payload_digest string, payload binary"
)


def _record(path: str, place: int, head: dict[str, str], block: bytes, payload: bool) -> dict[str, list]:
    http, _, body = block.partition(b"\r\n\r\n")
    kind, stated = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "revisit":
        lengths = [x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        n_bytes, digest, body = int(lengths[0].split(b":")[1]) if lengths else None, stated or None, None
    else:
        n_bytes, digest = len(body), hashlib.sha256(body).hexdigest()
        if stated and stated != digest:
            raise ValueError(f"{path} at {place}: payload digest {digest} differs from the stated {stated}")
    url = head.get("warc-target-uri")
    return {
        "path": [path], "place": [place], "key": [_key(head["warc-record-id"])],
        "url": [None if url is None else unquote(url)], "record_type": [kind],
        "refers_to": [_key(head.get("warc-refers-to"))], "payload_bytes": [n_bytes], "payload_digest": [digest],
        "payload": [body if payload else None],
    }


def read_archives(
    spark: SparkSession, files: DataFrame, range_bytes: int = 64 << 20, payload: bool = True
) -> DataFrame:
    """Records of the archives in `files` (path, n_bytes), read by ranges of `range_bytes`.

    path, place, key (the writer's id as text; null for records of other writers), url, record_type,
    refers_to (key), payload_bytes, payload_digest (of the full payload, also for a revisit) and the
    payload (null for a revisit, or if `payload` is false). A payload that differs from its stated
    digest is an error. No archive, or an empty one, gives no rows.
    """
    ranges = files.where(F.col("n_bytes") > 0).select(
        "path", "n_bytes", F.explode(F.sequence(F.lit(0), F.col("n_bytes") - 1, F.lit(range_bytes))).alias("start")
    )
    # Ranges are a few bytes each but stand for much reading: the number of tasks is set, not left to their size.
    n_ranges = files.agg(F.sum(F.ceil(F.col("n_bytes") / range_bytes))).first()[0] or 1
    ranges = ranges.repartition(min(int(n_ranges), MAX_TASKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                system, name = store(r["path"])
                with system.open_input_file(name) as f:
                    end = min(r["start"] + range_bytes, r["n_bytes"])
                    held, size = [], 0
                    for place, head, block in scan_range(f, r["start"], end):
                        held.append(_record(r["path"], place, head, block, payload))
                        size += len(block) * payload + 500
                        if size > 8_000_000:
                            yield batch(_RECORD, {c: [h[c][0] for h in held] for c in _RECORD.names})
                            held, size = [], 0
                    if held:
                        yield batch(_RECORD, {c: [h[c][0] for h in held] for c in _RECORD.names})

    return ranges.mapInArrow(run, RECORD)


def verified(records: DataFrame, manifest: DataFrame, path: str) -> DataFrame:
    """The records of `read_archives`, written to `path`; an error if an archive gave more or fewer than its n_records."""
    held = stage(records, path)
    wrong = (
        manifest.groupBy("path").agg(F.sum("n_records").alias("stated"))
        .join(held.groupBy("path").agg(F.count("*").alias("read")), "path", "full")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("stated", "read")}).where("stated <> read").first()
    )
    if wrong:
        raise ValueError(f"{wrong.path}: {wrong.read} records read, the manifest states {wrong.stated}")
    return held


def archive_pages(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least: int = 100, file_bytes: int = 1 << 30,
) -> DataFrame:
    """Write a record per row of `pages` into `folder`; the persisted manifest of the archives.

    Only the three named columns are read. A null payload is empty, a null url is left out, a null
    id becomes a record without a key; repeated rows are records of their own; an empty table gives
    an empty manifest.
    """
    records = classify(pages, id_col, url_col, payload_col, least)
    path = f"{folder}/manifest"
    write_archives(records, f"{folder}/archives", file_bytes).write.parquet(path)
    return pages.sparkSession.read.schema("path string, n_bytes bigint, n_records bigint").parquet(path)
