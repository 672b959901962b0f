"""WARC archives through a chunked record table (operator 4).

A payload is never held whole by Python and meets no join whole: Spark cuts it into rows of record identifier, chunk number and bytes
as it is read, the writer streams the chunks of a record into a gzip member while a running SHA-1 goes along, and the reader streams an archive
back into chunk rows with the running digest and length so far. Archives are written by any file system that pyarrow can
open, under a name of their own for each attempt, and a manifest row names those that count; so a lost or repeated
task leaves at most a file that nothing reads.

Equal payloads are found by digest and length; the record of largest id is the response and the others are revisits
that refer to it. Ids are grouped with partial aggregation, so a payload that a third of the pages share is no hot task.

Defined results: a null payload is empty; equal payloads of fewer than ``min_bytes`` bytes are all responses; rows repeated in full are
records each, revisiting the largest id unless they have it; a null id is written as an empty one and read back as null.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, workspace

#: Bytes of a chunk row.
CHUNK = 1 << 16
#: base32 digits in order.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Tasks that read archives, at most; beyond it a task reads several.
READERS = 20_000
#: A record's time; archives of the same rows are then the same.
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column, five hex digits (20 bits) at a time."""
    digits = F.sha1(payload)
    out = []
    for group in range(8):
        value = F.conv(F.substring(digits, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.substr(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*out)


def record_table(pages: DataFrame, min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of every page: record, page_id, url, digest, bytes, type, refers_to, chunk_no, chunk, last.

    A revisit has one row without bytes.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    p = p.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("bytes", F.octet_length("payload").cast("bigint"))
    p = p.withColumn("record", F.monotonically_increasing_id())
    keys = materialize(p.select("page_id", "digest", "bytes"), "warc-digests")
    heads = keys.where(F.col("bytes") >= min_bytes).groupBy(F.col("digest").alias("d"), F.col("bytes").alias("b")).agg(F.max("page_id").alias("head"), F.count("*").alias("times"))
    # Only payloads that occur twice change a record's type. These tables are written first, so that the copies of a payload can be split where they are joined.
    heads = materialize(heads.where("times > 1").select("d", "b", "head"), "warc-heads")
    again = keys.join(heads.hint("merge"), (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b"))).where("page_id != head")
    again = materialize(again.select(F.col("page_id").alias("revisit"), F.col("digest").alias("d"), F.col("bytes").alias("b"), "head").distinct(), "warc-revisits")
    size = F.col("bytes")
    starts = F.when(size > 0, F.sequence(F.lit(0).cast("bigint"), size - 1, F.lit(chunk).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    pieces = F.transform(starts, lambda at: F.substring("payload", (at + 1).cast("int"), F.lit(chunk)))
    cut = p.select("record", "page_id", "url", "digest", "bytes", (F.size(starts) - 1).alias("end"), F.posexplode(pieces).alias("chunk_no", "chunk"))
    cut = cut.join(again.hint("merge"), (F.col("page_id") == F.col("revisit")) & (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")), "left")
    whole = F.col("head").isNull()
    cut = cut.where(whole | (F.col("chunk_no") == 0))
    kind, last = F.when(whole, "response").otherwise("revisit"), F.when(whole, F.col("chunk_no") == F.col("end")).otherwise(F.lit(True))
    return cut.select("record", "page_id", "url", "digest", "bytes", kind.alias("type"), F.col("head").alias("refers_to"), "chunk_no", F.when(whole, F.col("chunk")).otherwise(F.lit(b"")).alias("chunk"), last.alias("last"))


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _clean(value: str | None) -> str:
    """A header value: line ends would end the header."""
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def _open(place: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(place)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write the chunk rows as gzipped WARC files under ``folder``; returns (archive, records) of those that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        name, out, pack, digest, n = "", None, None, None, 0
        for batch in batches:
            for page, url, expected, size, kind, refers, no, chunk, last in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "bytes", "type", "refers_to", "chunk_no", "chunk", "last"))):
                if out is None:
                    name = f"{path}/{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(name, compression=None)
                if no == 0:
                    head = [
                        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url)}",
                        f"WARC-Payload-Digest: sha1:{expected}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {size if kind == 'response' else 0}",
                    ]
                    if kind == "revisit":
                        head += [f"WARC-Refers-To: {_urn(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Payload-Length: {size}"]
                    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(pack.compress(("\r\n".join(head) + "\r\n\r\n").encode()))
                    digest = hashlib.sha1()
                out.write(pack.compress(chunk))
                digest.update(chunk)
                if last:
                    if kind == "response" and base64.b32encode(digest.digest()).decode() != expected:
                        raise ValueError(f"the payload of page {page} does not have its digest")
                    out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                    n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["archive", "records"])

    columns = ("record", "page_id", "url", "digest", "bytes", "type", "refers_to", "chunk_no", "chunk", "last")
    ordered = records.select(*columns).sortWithinPartitions("record", "chunk_no")
    return materialize(ordered.mapInArrow(run, "archive string, records bigint"), "warc-manifest")


class _Member:
    """Bytes of one gzip stream of records, taken as far as asked for."""

    def __init__(self, source, step: int):
        self.source, self.step, self.raw, self.ready, self.pack = source, step, b"", b"", None

    def fill(self) -> bool:
        """More bytes are ready; false at the end of the file."""
        while True:
            if not self.raw:
                self.raw = self.source.read(self.step)
                if not self.raw:
                    return False
            if self.pack is None:
                self.pack = zlib.decompressobj(31)
            made = self.pack.decompress(self.raw, self.step)
            self.raw = self.pack.unconsumed_tail
            if self.pack.eof:
                self.raw, self.pack = self.pack.unused_data, None
            if made:
                self.ready += made
                return True

    def upto(self, mark: bytes) -> bytes | None:
        while mark not in self.ready:
            if not self.fill():
                return None
        head, _, self.ready = self.ready.partition(mark)
        return head

    def take(self, n: int) -> bytes:
        while not self.ready:
            if not self.fill():
                raise ValueError("a record ends early")
        out, self.ready = self.ready[:n], self.ready[n:]
        return out


def read_archive(source, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of an archive: headers, chunk_no, chunk, offset, running digest (base32 at the last chunk), last."""
    member = _Member(source, chunk)
    while (head := member.upto(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8").lstrip("\r\n").split("\r\n")
        headers = dict(x.partition(": ")[::2] for x in lines[1:])
        left, no, at, digest = int(headers["Content-Length"]), 0, 0, hashlib.sha1()
        while True:
            piece = member.take(min(left, chunk)) if left else b""
            left -= len(piece)
            digest.update(piece)
            yield {"headers": headers, "chunk_no": no, "chunk": piece, "offset": at, "last": not left, "digest": base64.b32encode(digest.digest()).decode() if not left else None}
            at += len(piece)
            no += 1
            if not left:
                break
        if member.upto(b"\r\n\r\n") is None:
            raise ValueError("a record has no end")
    if member.ready.strip() or member.pack is not None:
        raise ValueError("the archive is cut off")


def read_archives(manifest: DataFrame, chunk: int = CHUNK, place: str = "", payloads: bool = True) -> DataFrame:
    """The chunked record table of the archives: page_id, url, type, refers_to, payload_bytes and payload_digest (on the last
    row of a record), chunk_no, chunk, last. Without ``payloads`` only the last rows, and no bytes."""
    names = ["page_id", "url", "type", "refers_to", "payload_bytes", "payload_digest", "chunk_no", "chunk", "last"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.bool_()]
    number = lambda urn: int(x) if (x := urn[len("<urn:page:") : -1]) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open(place)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows: list[tuple] = []
                held = 0
                with system.open_input_stream(name, compression=None) as source:
                    for r in read_archive(source, chunk):
                        if not (payloads or r["last"]):
                            continue
                        h, revisit = r["headers"], r["headers"]["WARC-Type"] == "revisit"
                        stated = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if r["last"] and not revisit and r["digest"] != stated:
                            raise ValueError(f"{name}: a payload does not have its digest")
                        size = int(h["X-Payload-Length"]) if revisit else r["offset"] + len(r["chunk"])
                        rows.append((number(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["WARC-Type"], number(h["WARC-Refers-To"]) if revisit else None, size if r["last"] else None, stated if r["last"] else None, r["chunk_no"], r["chunk"] if payloads else None, r["last"]))
                        held += len(r["chunk"]) if payloads else 100
                        if held > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    # About an archive each task: the manifest has a row for each, and a stated number is not coalesced.
    spread = manifest.select("archive").repartition(min(max(manifest.count(), 1), READERS))
    return spread.mapInArrow(run, "page_id bigint, url string, type string, refers_to bigint, payload_bytes bigint, payload_digest string, chunk_no int, chunk binary, last boolean")


def warc_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, from the archives written."""
    folder = workspace(pages.sparkSession, "warc-archives")
    manifest = write_archives(record_table(pages, min_bytes), folder)
    back = read_archives(manifest, place=folder, payloads=False)
    return back.where("last").select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")
