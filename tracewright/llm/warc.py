"""WARC archives written and read as streams of chunk rows.

A record is a run of rows ``(record, chunk number)``. A payload is cut where it is exploded, a chunk at a time;
the writer takes the chunks and the reader gives them back, each carrying the digest state forward inside its
task and comparing it with the header's at the record's end. Beyond the row of the table itself, which Spark
reads whole, no side holds an oversized payload. Only responses carry payloads, and these meet their role by
digest and id together, so the copies of one payload are dealt to many tasks. Archives are gzip files of one
member a record in the shared folder, whose scheme must be one that Arrow opens (file, hdfs, s3, gs, abfs);
a task writes under a name of its own attempt and moves the file into place.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import map_arrow, table
from tracewright.plans.storage import materialize, shared_dir

CHUNK = 64 * 1024
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_FIELDS = ["page_id", "url", "record_type", "refers_to", "chunk_no", "chunk_bytes", "bytes_so_far", "last", "payload_bytes", "payload_digest"]
_SCHEMA = (
    "page_id long, url string, record_type string, refers_to long, chunk_no int, chunk_bytes long, bytes_so_far long, last boolean, "
    "payload_bytes long, payload_digest string"
)


def _urn(page_id: int | None, place: str = "") -> str:
    """``place`` tells records without an id apart."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}' if page_id is not None else f'place:{place}')}>"


def open_store(uri: str):
    """Arrow's file system and path of a URI as Spark has it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("s3://" + uri.partition("://")[2] if uri.startswith(("s3a://", "s3n://")) else uri)


def _header(row: dict, place: str = "") -> bytes:
    response = row["record_type"] == "response"
    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    lines = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_urn(row['page_id'], place)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {row['size']}",
    ]
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {row['page_id']}")
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {quote(row['url'], safe=SAFE)}")
    if response:
        lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(HTTP) + row['size']}"]
    else:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(row['refers_to'])}", f"X-Refers-To-Page: {row['refers_to']}", "Content-Length: 0"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + (HTTP if response else b"")


#: Left as they are in a target URI; everything else outside ASCII letters and digits is percent-encoded.
SAFE = "!#$&'()*+,-./:;=?@_~[]"


def assign_roles(df: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows with ``payload, size, digest (SHA-1, hex), record_type, refers_to``; revisits have no payload.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the largest id is the response.
    """
    payload = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    heads = materialize(rows.drop("payload"), "warc-heads")
    groups = heads.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("first"))
    groups = materialize(groups, "warc-groups")
    first = [F.col("digest").alias("__digest"), F.col("size").alias("__size"), F.col("first")]
    same = (F.col("digest") == F.col("__digest")) & (F.col("size") == F.col("__size"))
    own = same & F.col("page_id").eqNullSafe(F.col("first"))
    columns = ["page_id", "url", "payload", "size", "digest"]
    large = rows.where(F.col("size") >= min_bytes).join(groups.select(*first), own, "left_semi").select(*columns)
    small = rows.where(F.col("size") < min_bytes).select(*columns)
    later = heads.join(groups.select(*first), same & ~F.col("page_id").eqNullSafe(F.col("first")))
    later = later.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "size", "digest", F.lit("revisit").alias("record_type"), F.col("first").alias("refers_to"))
    whole = large.union(small) if min_bytes > 0 else large
    return whole.select(*columns, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).union(later)


def write_archives(records: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Write the rows of :func:`assign_roles` below ``path``; returns the written table of archives."""
    path = path or f"{shared_dir(records.sparkSession)}/tracewright/warc-{uuid.uuid4().hex}"
    steps = F.when(F.col("record_type") == "response", F.greatest(F.lit(1), F.ceil(F.col("size") / chunk))).otherwise(1)
    head = ["page_id", "url", "size", "digest", "record_type", "refers_to"]
    rows = records.select(*head, "payload", F.explode(F.sequence(F.lit(0), (steps - 1).cast("int"))).alias("no"))
    rows = rows.select(*head, "no", F.substring("payload", F.col("no") * chunk + 1, F.lit(chunk)).alias("data"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = open_store(path)
        name = f"part-{context.partitionId():06d}.warc.gz"
        draft = f"{root}/_attempts/{name}-{context.taskAttemptId()}"
        out, packer, count, state, open_row = None, None, 0, None, None

        def close() -> None:
            """Ends the open record, whose chunks must add up to the digest in its header."""
            if open_row["record_type"] == "response" and state.hexdigest() != open_row["digest"]:
                raise ValueError(f"chunks of page {open_row['page_id']} do not match its digest")
            out.write(packer.compress(b"\r\n\r\n") + packer.flush())

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(f"{root}/_attempts", recursive=True)
                    out = store.open_output_stream(draft, compression=None)
                if row["no"] == 0:
                    if packer is not None:
                        close()
                    packer, count, state, open_row = zlib.compressobj(1, zlib.DEFLATED, 31), count + 1, hashlib.sha1(), row
                    out.write(packer.compress(_header(row, f"{name}:{count}")))
                if row["data"]:
                    state.update(row["data"])
                    out.write(packer.compress(row["data"]))
        if out is not None:
            close()
            out.close()
            try:
                store.move(draft, f"{root}/{name}")
            except OSError:
                # Some stores do not move onto a file: then an earlier attempt at this task has put the same one there.
                if store.get_file_info(f"{root}/{name}").type != fs.FileType.File:
                    raise
                store.delete_file(draft)
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([count], pa.int64())], ["archive", "records"])

    return materialize(map_arrow(rows, write, "archive string, records long"), "warc-archives")


def read_records(stream, chunk: int = CHUNK, with_payload: bool = False) -> Iterator[tuple]:
    """Chunk rows of one archive; the last row of a record has its payload's length and digest."""
    with gzip.GzipFile(fileobj=stream, mode="rb") as lines:
        while True:
            line = lines.readline()
            if not line:
                return
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("archive is damaged: no record where one should begin")
            fields: dict[str, str] = {}
            while (line := lines.readline()) not in (b"\r\n", b"\n", b""):
                key, _, value = line.decode().partition(":")
                fields[key.lower()] = value.strip()
            left = int(fields["content-length"])
            kind = fields["warc-type"]
            page = int(fields["x-page-id"]) if "x-page-id" in fields else None
            refers = fields.get("x-refers-to-page")
            refers = int(refers) if refers not in (None, "None") else None
            head = (page, fields.get("warc-target-uri"), kind, refers)
            digest = fields["warc-payload-digest"].removeprefix("sha1:")
            if kind != "response":
                lines.read(left)
                yield (*head, 0, 0, 0, True, int(fields["x-payload-length"]), digest) + ((b"",) if with_payload else ())
                continue
            while (line := lines.readline()) not in (b"\r\n", b""):
                left -= len(line)
            left -= len(line)
            state, seen, number = hashlib.sha1(), 0, 0
            while True:
                data = lines.read(min(chunk, left))
                left -= len(data)
                seen += len(data)
                state.update(data)
                last = left == 0
                if not data and not last:
                    raise ValueError("archive is damaged: a record is cut short")
                found = base64.b32encode(state.digest()).decode() if last else None
                if last and (found != digest or seen != int(fields["x-payload-length"])):
                    raise ValueError(f"payload of page {page} does not match its digest")
                yield (*head, number, len(data), seen, last, seen if last else None, found) + ((data,) if with_payload else ())
                number += 1
                if last:
                    break


def read_archives(archives: DataFrame, chunk: int = CHUNK, with_payload: bool = False) -> DataFrame:
    """Chunk rows of all archives listed in ``archives``; ``with_payload`` adds the bytes of each chunk."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = _FIELDS + ["data"] * with_payload, kinds + [pa.binary()] * with_payload
        limit = 64 if with_payload else 5000
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, at = open_store(uri)
                rows: list[tuple] = []
                with store.open_input_stream(at, compression=None) as stream:
                    for row in read_records(stream, chunk, with_payload):
                        rows.append(row)
                        if len(rows) >= limit:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    spread = archives.select("archive").repartition(archives.sparkSession.sparkContext.defaultParallelism * 4, "archive")
    return map_arrow(spread, read, _SCHEMA + ", data binary" * with_payload)


def archive_pages(df: DataFrame, min_bytes: int = 0, path: str | None = None, **columns: str) -> DataFrame:
    """Write every row as a record, read the archives back: one row per record.

    A null payload counts as empty. Rows without an id are responses if no equal payload has one, else
    revisits; rows repeated with the largest id are all responses. A null URL writes no target. An empty
    table writes nothing and gives no rows; other columns are not read.
    """
    back = read_archives(write_archives(assign_roles(df, min_bytes, **columns), path))
    return back.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("chunk_no").alias("last_chunk"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))
