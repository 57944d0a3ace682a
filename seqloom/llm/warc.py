"""WARC archives, index first: write an index of all records, then read what is selected from it by byte ranges.

`write` stores every page as one gzip member and returns the index `(page_id, url, digest, payload_bytes, record_type,
refers_to, path, offset, length)`. Records of equal payload become revisits of the one with the smallest page id. `read`
takes any selection of index rows, puts those of one stretch of an archive together, joins neighbouring byte ranges
and reads each range once. A retried task writes a new file; only files of finished tasks are in the index.

Archives go to a folder that all executors reach, by its URI; any file system that pyarrow knows will do.

Defined results: a null payload is the empty payload; a null url is left out of the record; pages that share id and payload
are each a response (the smallest id of their payload) or each a revisit; a null page id is larger than any other;
an empty table gives an empty index; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import join_heavy
from seqloom.session import settle, shared_dir

#: Bytes after which a task starts a new archive, bytes of a stretch read by one row of work, gap read over.
ARCHIVE_BYTES, STRETCH_BYTES, GAP_BYTES = 1 << 30, 8 << 20, 64 << 10
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_DATE = "2000-01-01T00:00:00Z"


def base32_sha1(column: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 40 bits at a time, ten hex digits make eight letters."""
    digits = F.sha1(column)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def decide(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages with payload, digest and, for all but the first of equal payloads, the page they revisit."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("long")})
    groups = settle(rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")))
    joined = join_heavy(rows, groups.select("digest", "first"), groups.select("digest", "copies"), "digest", "copies")
    other = (F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.withColumn("refers_to", F.when(other, F.col("first"))).drop("first")


def _line(value: str) -> str:
    """A header value of one line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in value)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member with a response, or a revisit that repeats only the head of the reply."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", _DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", _line(url)))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """Fields and payload of one record; a response whose payload does not have its digest raises."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    reply, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line.split(b":")[1] for line in reply.split(b"\r\n") if line.lower().startswith(b"content-length:")))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None, "url": fields.get("WARC-Target-URI"), "payload_bytes": size,
            "payload_digest": digest, "record_type": fields["WARC-Type"],
            "refers_to": int(fields["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in fields else None, "payload": payload}


def _store(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


_INDEX = "page_id long, url string, digest string, payload_bytes long, record_type string, refers_to long, path string, offset long, length long"


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write all pages to archives in `folder` and return their index."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        out, path, offset = None, "", 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1_000):
                rows: dict[str, list] = {n.split()[0]: [] for n in _INDEX.split(", ")}
                for r in batch.slice(start, 1_000).to_pylist():
                    if out is None or offset >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        path, offset = f"{folder.rstrip('/')}/{name}", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    member = record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"])
                    out.write(member)
                    kind = "response" if r["refers_to"] is None else "revisit"
                    for name, value in zip(rows, (r["page_id"], r["url"], r["digest"], r["payload_bytes"], kind, r["refers_to"], path, offset, len(member))):
                        rows[name].append(value)
                    offset += len(member)
                yield pa.RecordBatch.from_pydict(rows, schema=_INDEX_FIELDS)
        if out is not None:
            out.close()

    rows = decide(pages, least_bytes).select("page_id", "url", "payload", "digest", "payload_bytes", "refers_to")
    return settle(rows.mapInArrow(run, _INDEX))


_INDEX_FIELDS = pa.schema([(n.split()[0], pa.int64() if n.split()[1] == "long" else pa.string()) for n in _INDEX.split(", ")])


def ranges(entries: list[tuple[int, int]], gap: int = GAP_BYTES) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted `(offset, length)` entries joined to byte ranges `(start, end, entries)` across gaps of at most `gap`."""
    out: list[tuple[int, int, list]] = []
    for offset, length in sorted(entries):
        if out and offset - out[-1][1] <= gap:
            start, end, held = out[-1]
            held.append((offset, length))
            out[-1] = (start, max(end, offset + length), held)
        else:
            out.append((offset, offset + length, [(offset, length)]))
    return out


def read(index: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of the given index rows: `(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload])`."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    fields = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
    # A stretch of an archive holds a bounded number of bytes, so its list of records is bounded too.
    work = index.groupBy("path", F.floor(F.col("offset") / STRETCH_BYTES).alias("stretch")).agg(
        F.collect_list(F.struct("offset", "length")).alias("entries")).select("path", "entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _store(row["path"])
                with store.open_input_file(path) as file:
                    for start, end, entries in ranges([(e["offset"], e["length"]) for e in row["entries"]]):
                        data = file.read_at(end - start, start)
                        found = [parse(data[o - start:o - start + n]) for o, n in entries]
                        yield pa.RecordBatch.from_pydict({n: [f[n] for f in found] for n in names}, schema=fields)

    schema = ", ".join(f"{n} {'long' if kinds.get(n) == pa.int64() else 'binary' if n == 'payload' else 'string'}" for n in names)
    return work.mapInArrow(run, schema)


def archive_folder(spark) -> str:
    """A new folder for archives beside the checkpoints."""
    return f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
