"""WARC: a writer with revisit records and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm.common import materialize

#: Payloads from this many bytes on are stored once; equal ones become revisits.
MIN_DEDUP = 1000
#: Bytes of archive that a reading task owns.
SPLIT = 4 << 20
READ = 1 << 20
GZIP_MAGIC = b"\x1f\x8b\x08"
#: A stored deflate block holds fewer bytes: members inside a member cannot follow
#: one another for longer.
STORED = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"
RECORDS = "page_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string"


# ---------------------------------------------------------------- writing


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_DEDUP) -> DataFrame:
    """page_id, url, payload (null for revisits), digest, n_bytes, refers_to.

    Of rows with equal payloads of at least ``min_bytes`` bytes, the one with
    the largest page_id keeps the payload and the others refer to it. Rows that
    share the largest page_id all keep theirs; a null page_id refers to the
    largest one, and keeps its payload if there is none.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    t = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), body.alias("payload"), F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"))
    large = t.where(F.col("n_bytes") >= min_bytes)
    kept = large.groupBy("digest").agg(F.count(F.lit(1)).alias("_n"), F.max("page_id").alias("_keeper")).where("_n > 1 and _keeper is not null").drop("_n")
    t = t.join(kept, "digest", "left")
    again = F.col("_keeper").isNotNull() & (F.col("n_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("_keeper"))
    return t.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "digest", "n_bytes", F.when(again, F.col("_keeper")).alias("refers_to"))


def record(page_id, url, payload, digest: str, n_bytes: int, refers_to) -> bytes:
    """One WARC record; its block is an HTTP response head and the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, path: str, min_bytes: int = MIN_DEDUP) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as .warc.gz files under ``path``, a
    gzip member for each record. Returns the files: file, n_bytes.

    A retried task writes a file of another name; files not returned do not
    count. A null html is an empty payload, a null url leaves the target out.
    An empty table gives no files.
    """

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        name, out, size = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "n_bytes", "refers_to")]
            for i in range(batch.num_rows):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = squeeze.compress(record(*(c[i].as_py() for c in columns))) + squeeze.flush()
                out.write(member)
                size += len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{path}/{name}"], "n_bytes": pa.array([size], pa.int64())})

    return materialize(mark_revisits(pages, min_bytes).mapInArrow(write, "file string, n_bytes long"), "warc-files")


# ---------------------------------------------------------------- reading


class Stream:
    """Sequential bytes of a file from ``at`` on, with a position to go back to."""

    def __init__(self, file, at: int):
        self.file, self.at, self.held, self.size = file, at, b"", file.size()

    def more(self) -> bool:
        got = self.file.read_at(min(READ, self.size - self.at - len(self.held)), self.at + len(self.held)) if self.at + len(self.held) < self.size else b""
        self.held += got
        return bool(got)

    def skip(self, n: int) -> None:
        self.held, self.at = self.held[n:], self.at + n


def decode_member(stream: Stream) -> tuple[bytes, int] | None:
    """The decoded WARC record of the gzip member that starts at the stream's
    position, and the member's length; None if no sound record starts there.
    Headers are checked as soon as they are decoded, so that a chance magic
    number costs little."""
    expand, used, parts, checked = zlib.decompressobj(31), 0, [], False
    while not expand.eof:
        if used >= len(stream.held) and not stream.more():
            return None
        piece = stream.held[used : used + (1 << 16)]
        try:
            parts.append(expand.decompress(piece))
        except zlib.error:
            return None
        used += len(piece)
        if not checked:
            head = b"".join(parts)
            if head[:5] != b"WARC/"[: len(head)]:
                return None
            if b"\r\n\r\n" in head:
                checked = True
    return (b"".join(parts), used - len(expand.unused_data)) if checked else None


def members(file, start: int):
    """(position, decoded record or None, position after it) of the sound members
    from ``start`` on. Finds the first by its magic number, follows members from
    there, and searches again after bytes that are no sound member."""
    stream = Stream(file, start)
    while True:
        found = stream.held.find(GZIP_MAGIC)
        if found < 0:
            keep = len(GZIP_MAGIC) - 1
            if len(stream.held) > keep:
                stream.skip(len(stream.held) - keep)
            if not stream.more():
                return
            continue
        stream.skip(found)
        member = decode_member(stream)
        if member is None:
            stream.skip(1)
            continue
        yield stream.at, member[0], stream.at + member[1]
        stream.skip(member[1])


def owned_records(file, start: int, end: int):
    """Decoded records whose members start in [start, end).

    A payload may itself hold members. Those from a range's first member on are
    the file's own if each begins where the one before ends, over more bytes than
    a stored block has or up to the file's end. Where that chain breaks, by such a
    payload or by damage, members are followed from the file's beginning instead.
    """
    size, held, first, after = file.size(), [], None, None
    for at, data, to in members(file, start):
        if first is None and at >= end:
            return
        if first is not None and at != after:
            break
        if at < end:
            held.append(data)
        first, after = at if first is None else first, to
        if to >= size or to >= end and to >= first + STORED:
            yield from held
            return
    if start == 0 or first is not None:
        for at, data, _ in members(file, 0):
            if at >= end:
                return
            if at >= start:
                yield data


def _sha1(name: str | None) -> str | None:
    """Hexadecimal form of a sha1 digest in base 32 or 16; None if it is neither."""
    kind, _, value = (name or "").partition(":")
    if kind.lower() != "sha1":
        return None
    if re.fullmatch("[0-9a-fA-F]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch("[a-zA-Z2-7]{32}", value) else None


def parse_record(data: bytes) -> tuple | None:
    """A row of RECORDS and the payload; None for other record types. Records of
    other writers may lack a digest, or name one of the payload before decoding;
    a record of this module's writer that differs from its digest raises."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    length = fields.get("content-length", "")
    block = rest[: int(length)] if length.isdecimal() else rest.removesuffix(b"\r\n\r\n")
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda field: int(m[1]) if (m := re.fullmatch(rf"<{URN}(-?\d+)>", fields.get(field, ""))) else None
    named = _sha1(fields.get("warc-payload-digest"))
    if kind == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if fields.get("warc-record-id", "").startswith(f"<{URN}") and named not in (None, digest):
            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    else:
        length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        size, digest = int(length[1]) if length else None, named
    return number("warc-record-id"), fields.get("warc-target-uri"), kind, number("warc-refers-to"), size, digest, payload


def read_warc(files: DataFrame, split: int = SPLIT, payloads: bool = False) -> DataFrame:
    """Records of .warc.gz ``files`` (file, n_bytes), read by byte ranges of
    ``split`` bytes that need no index: see ``owned_records``. Columns: RECORDS
    and, if asked for, payload (binary)."""
    ranges = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))
    schema = RECORDS + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def read(batches):
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                fs, p = pafs.FileSystem.from_uri(file)
                rows = []
                with fs.open_input_file(p) as f:
                    for data in owned_records(f, start, start + split):
                        if (row := parse_record(data)) is not None:
                            rows.append(row[: len(names)])
                        if len(rows) >= 500:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
                            rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    n = files.agg(F.sum(F.ceil(F.col("n_bytes") / split))).first()[0] or 1
    return ranges.repartition(int(max(1, min(n, 100_000)))).mapInArrow(read, schema)


def round_trip(spark: SparkSession, pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages`` under ``path``, read the archives back."""
    return read_warc(write_warc(pages, path))
