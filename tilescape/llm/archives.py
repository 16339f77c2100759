"""WARC archives of fetched tile documents: one gzip member per record, with an offset index."""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._common import file_system, salted_join

CRLF, END = "\r\n", "\r\n\r\n"
CHUNK = 1 << 18
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, n_bytes long, record_id string, record_type string, target string"
RECORDS = "fetch_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: five hex digits make four characters."""
    letters = F.array(*[F.lit(c) for c in ALPHABET])
    four = lambda v: F.concat(*[F.get(letters, F.shiftright(v, s).bitwiseAND(F.lit(31))) for s in (15, 10, 5, 0)])
    # The hex digits are bound once as the element of a one-row array.
    hexed = F.transform(F.array(F.sha1(payload)), lambda h: F.concat(*[
        four(F.conv(F.substring(h, F.lit(i * 5 + 1), F.lit(5)), 16, 10).cast("int")) for i in range(8)]))
    return F.get(hexed, F.lit(0))


def write_archives(fetches: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write `fetches` (fetch_id, url, body) as WARC archives, each one gzip stream as a whole.

    Records are responses (an HTTP message whose entity is the body in UTF-8; null: empty).
    Of fetches with equal bodies, that with the largest id is the response and the others
    are revisits that refer to it. Equal bodies are found by their SHA-1 with a grouped
    maximum; the join back is salted, since one body may hold a third of all rows.
    Spark's text writer makes and commits the files. Rows without an id are written as well:
    they refer to the largest id of their body, or are responses where no fetch of it has one.
    Fetches repeated with the same id and body are all written. Line ends in addresses are
    escaped. Other columns are ignored. An empty table writes no records.
    """
    rows = fetches.select(F.col("fetch_id").cast("long").alias("fetch_id"), "url", F.coalesce("body", F.lit("")).alias("body"))
    keyed = rows.withColumn("_sha", F.unhex(F.sha1(F.encode("body", "UTF-8"))))
    shared = (keyed.groupBy("_sha").agg(F.max("fetch_id").alias("_latest"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_sha", "_latest"))
    roles = salted_join(keyed, shared, ["_sha"], F.struct("fetch_id", "url"), "left").withColumn("_refers", F.when(~F.col("_latest").eqNullSafe(F.col("fetch_id")), F.col("_latest")))
    made = roles.select("fetch_id", "url", "body", "_refers", base32_sha1(F.encode("body", "UTF-8")).alias("_digest"), F.octet_length("body").alias("_n"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("_n"), F.lit(END))
    block = made.withColumn("_block", F.concat(http, F.when(F.col("_refers").isNull(), F.col("body")).otherwise("")))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(F.col("_refers").isNull(), "response").otherwise("revisit"),
        F.lit(f"{CRLF}WARC-Record-ID: <urn:x-fetch:"), F.coalesce(F.col("fetch_id").cast("string"), F.lit("")), F.lit(f">{CRLF}WARC-Date: {date}{CRLF}"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(CRLF)), F.lit("")),
        F.coalesce(F.concat(F.lit(f"WARC-Profile: {REVISIT}{CRLF}WARC-Refers-To: <urn:x-fetch:"), F.col("_refers"), F.lit(f">{CRLF}")), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("_digest"),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length("_block"), F.lit(END), F.col("_block"))
    block.select(record.alias("value")).write.mode("overwrite").option("lineSep", END).text(folder, compression="gzip")


class _Inflated:
    """The bytes of a gzip stream (of one or more members), inflated once and in order.

    At most CHUNK bytes are inflated at a time, however well the stream compresses, and a
    position moves through them, so memory is bounded and the work is linear in the bytes.
    """

    def __init__(self, stream):
        self.stream, self.inflate = stream, zlib.decompressobj(31)
        self.raw, self.started, self.buffer, self.at = b"", False, bytearray(), 0

    def more(self) -> bool:
        if self.inflate.eof:
            self.raw, self.started, self.inflate = self.inflate.unused_data, False, zlib.decompressobj(31)
        data = self.raw or self.stream.read(CHUNK)
        if not data:
            if self.started:
                raise ValueError("archive ends within a member")
            return False
        del self.buffer[:self.at]
        self.buffer += self.inflate.decompress(data, CHUNK)
        self.raw, self.started, self.at = self.inflate.unconsumed_tail, True, 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        """The bytes up to and with the mark; None at the end of the stream."""
        seen = 0  # bytes after the position that are known not to begin a mark
        while (found := self.buffer.find(mark, self.at + seen)) < 0:
            seen = max(0, len(self.buffer) - self.at - len(mark) + 1)
            if not self.more():
                if self.buffer[self.at:].strip():
                    raise ValueError("archive ends within a record")
                return None
        end = found + len(mark)
        out, self.at = bytes(self.buffer[self.at:end]), end
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if self.at == len(self.buffer):
                if not self.more():
                    raise ValueError("archive ends within a record")
                continue
            out = bytes(self.buffer[self.at:self.at + n])
            self.at, n = self.at + len(out), n - len(out)
            yield out


def _fields(header: bytes) -> dict[str, str]:
    lines = header.decode("utf-8", "surrogateescape").split(CRLF)[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def normalise_archives(spark: SparkSession, folder: str, out: str, level: int = 6) -> None:
    """Rewrite every record of the gzip archives in `folder` as a gzip member of its own.

    Each archive is one task's work: its stream is inflated once, at most CHUNK bytes at a time,
    and records are passed on as they come, so memory does not grow with archives or records. The new file
    holds the same records in the same order. `out/index` (Parquet, written by Spark) is the
    sidecar: archive, offset, n_bytes, record id, type and target of each record. File names
    are new for each attempt and the index names only those of tasks that succeeded, so a
    lost executor's files are never read. An empty folder gives an empty index; an archive
    that ends within a record stops the job.
    """
    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        to, base = file_system(out)
        to.create_dir(posixpath.join(base, "archives"))
        for batch in batches:
            for path in batch["path"]:
                name = f"archives/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                fs, source = file_system(path)
                rows, offset = [], 0
                with fs.open_input_stream(source, compression=None) as stream, to.open_output_stream(posixpath.join(base, name), compression=None, buffer_size=1 << 20) as sink:
                    records = _Inflated(stream)
                    while (header := records.until(END.encode())) is not None:
                        fields = _fields(header)
                        member, n = zlib.compressobj(level, zlib.DEFLATED, 31), 0
                        n += sink.write(pa.py_buffer(member.compress(header)))
                        for part in records.take(int(fields["content-length"]) + len(END)):
                            n += sink.write(pa.py_buffer(member.compress(part)))
                        n += sink.write(pa.py_buffer(member.flush()))
                        rows.append((name, offset, n, fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri")))
                        offset += n
                        if len(rows) == 5000:
                            yield pd.DataFrame(rows, columns=["archive", "offset", "n_bytes", "record_id", "record_type", "target"])
                            rows = []
                yield pd.DataFrame(rows, columns=["archive", "offset", "n_bytes", "record_id", "record_type", "target"])

    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path")
    archives.mapInPandas(rewrite, INDEX).write.mode("overwrite").parquet(f"{out}/index")


def read_record(member: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(fetch_id, payload_bytes, payload_digest, record_type, refers_to) of one gzip member; checks length and digest. A record without an id gives None."""
    data = zlib.decompress(member, 31)
    header, _, rest = data.partition(END.encode())
    fields = _fields(header)
    block = rest[:int(fields["content-length"])]
    head, _, payload = block.partition(END.encode())
    n, digest, kind = int(_fields(head)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    number = lambda uri: int(n) if (n := uri.strip("<>").rpartition(":")[2]) else None
    if kind == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    return number(fields["warc-record-id"]), n, digest, kind, number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None


def read_archives(spark: SparkSession, out: str) -> DataFrame:
    """(fetch_id, payload_bytes, payload_digest, record_type, refers_to) per record, read through the offset index.

    A response's payload is checked against its length and digest; a damaged one stops the
    job. A revisit has the length and digest of the full payload in its headers.
    """
    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = file_system(out)
        opened, name = None, None
        for batch in batches:
            rows = []
            for archive, offset, n in zip(batch["archive"], batch["offset"], batch["n_bytes"]):
                if archive != name:
                    opened, name = fs.open_input_file(posixpath.join(base, archive)), archive
                rows.append(read_record(opened.read_at(int(n), int(offset))))
            frame = pd.DataFrame(rows, columns=["fetch_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], dtype=object)
            yield frame.astype({"fetch_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})

    return spark.read.schema(INDEX).parquet(f"{out}/index").mapInPandas(load, RECORDS)
