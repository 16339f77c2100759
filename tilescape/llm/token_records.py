"""Token ids of extracts as length-delimited binary records with an offset index."""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ._common import file_system
from .tokens import encoder

#: Added to the rotated checksum, so that a checksum stored among checked bytes is not its own.
MASK_DELTA = 0xA282EAD8
HEAD, TAIL = struct.Struct("<QI"), struct.Struct("<I")
INDEX = "slice int, file string, extract_id long, offset long, n_bytes long, n_tokens long, at long"


def masked(data: bytes) -> int:
    """CRC-32, rotated right by 15 bits, plus a constant."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """Length (8 bytes), its masked checksum, the payload, its masked checksum; little-endian."""
    length = struct.pack("<Q", len(payload))
    return length + TAIL.pack(masked(length)) + payload + TAIL.pack(masked(payload))


def unframe(record: bytes) -> bytes:
    """The payload of one record; ValueError where a length or checksum does not hold."""
    n, check = HEAD.unpack_from(record)
    if check != masked(record[:8]) or len(record) != n + 16 or TAIL.unpack_from(record, n + 12)[0] != masked(record[12:n + 12]):
        raise ValueError("damaged record")
    return record[12:n + 12]


def pack_ids(ids: np.ndarray) -> bytes:
    width = 2 if ids.max(initial=0) < 1 << 16 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def unpack_ids(payload: bytes) -> np.ndarray:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1).astype("<u4")


def write_token_records(extracts: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> None:
    """Write `extracts` (extract_id, text) to `folder` in ascending id order.

    The texts meant are the project's map extracts. Each is encoded whole (null: empty) and
    ends with `end_id`. A record's payload is one byte, the width of its ids (2 or 4 bytes,
    as the largest id needs), and the ids as little-endian unsigned integers. Rows are dealt out by ranges of their id; each slice becomes one file, streamed
    record by record. The files' names carry the task attempt and `folder/index` (Parquet,
    written by Spark) names only those of tasks that succeeded, so a lost executor's files
    are never read. Rows with equal ids stay next to each other, ordered by a hash of
    their text, then by text. Rows without an id come last. Other columns are ignored; an empty table writes an empty index.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        encode, end = encoder(tokenizer_path), struct.pack("<I", end_id)
        fs, base = file_system(folder)
        task, out, offset, tokens = TaskContext.get(), None, 0, 0
        name = f"records/{task.partitionId():06d}-{uuid.uuid4().hex}.bin"
        for batch in batches:
            if out is None and len(batch):
                fs.create_dir(posixpath.join(base, "records"))
                out = fs.open_output_stream(posixpath.join(base, name), buffer_size=1 << 20)
            rows = []
            for key, text in zip(batch["extract_id"].tolist(), batch["text"].tolist()):
                ids = np.frombuffer(encode(text or "") + end, "<u4")
                record = frame(pack_ids(ids))
                out.write(pa.py_buffer(record))
                n = len(ids)
                rows.append((task.partitionId(), name, key, offset, len(record), n, tokens))
                offset, tokens = offset + len(record), tokens + n
            yield pd.DataFrame(rows, columns=["slice", "file", "extract_id", "offset", "n_bytes", "n_tokens", "at"])
        if out is not None:
            out.close()

    # The hash lets slices end within rows of equal or no id, which may be a third of all. Ids pass pandas as text, where null stays null.
    key = [F.col("extract_id").asc_nulls_last(), F.col("_hash").asc()]
    rows = extracts.select(F.col("extract_id").cast("long").alias("extract_id"), "text").withColumn("_hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange(*key).sortWithinPartitions(*key, "text").select(F.col("extract_id").cast("string").alias("extract_id"), "text")
    index = ordered.mapInPandas(write, INDEX.replace("extract_id long", "extract_id string"))
    index.withColumn("extract_id", F.col("extract_id").cast("long")).write.mode("overwrite").parquet(f"{folder}/index")


def read_token_records(spark: SparkSession, folder: str) -> DataFrame:
    """(extract_id, start, n_tokens, ids_crc32) per record of `write_token_records`, read from the files.

    `start` counts the ids of all records before it, from the index. Each file is read
    through its index rows in shuffled-read style (one ranged read per record); lengths and
    checksums are verified, and a damaged record stops the job.
    """
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    sizes = index.groupBy("slice").agg(F.sum("n_tokens").alias("n"))  # one row per file
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = file_system(folder)
        opened, name = None, None
        for batch in batches:
            n, crc = [], []
            for file, offset, size in zip(batch["file"], batch["offset"], batch["n_bytes"]):
                if file != name:
                    opened, name = fs.open_input_file(posixpath.join(base, file)), file
                ids = unpack_ids(unframe(opened.read_at(int(size), int(offset))))
                n.append(len(ids))
                crc.append(zlib.crc32(ids))
            yield pd.DataFrame({"slice": batch["slice"], "extract_id": batch["extract_id"], "at": batch["at"], "n_tokens": n, "ids_crc32": crc})

    texts = index.withColumn("extract_id", F.col("extract_id").cast("string"))
    read = texts.mapInPandas(load, "slice int, extract_id string, at long, n_tokens long, ids_crc32 long")
    return read.join(sizes, "slice").select(F.col("extract_id").cast("long").alias("extract_id"), (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
