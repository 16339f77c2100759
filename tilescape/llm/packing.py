"""Packing of token sequences into fixed-size training sequences."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ._common import SALTS, cut
from .tokens import encoder

PIECES = "extract_id long, doc long, start long, length int, ids_crc32 long, doc_tokens long"


def shortest_pack_first(histogram: Mapping[int, int], limit: int) -> list[tuple[list[int], int]]:
    """Packing patterns (lengths, how many sequences) for a histogram length -> count.

    Lengths are placed from the longest to the shortest, each on the patterns with the
    least tokens so far that still have room; a pattern used only in part is split in two.
    What fits nowhere opens a new pattern. The work depends on the number of different
    lengths (at most `limit`), not on the counts.
    """
    by_total: dict[int, list[tuple[list[int], int]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for total in sorted(t for t in by_total if t + length <= limit):
            while left and by_total[total]:
                pattern, count = by_total[total].pop()
                used = min(left, count)
                if count > used:
                    by_total[total].append((pattern, count - used))
                by_total.setdefault(total + length, []).append((pattern + [length], used))
                left -= used
            if not by_total[total]:
                del by_total[total]
            if not left:
                break
        if left:
            by_total.setdefault(length, []).append(([length], left))
    return [p for total in sorted(by_total) for p in by_total[total]]


def token_pieces(extracts: DataFrame, tokenizer_path: str, end_id: int, limit: int) -> DataFrame:
    """Cut each extract's ids (with `end_id`) every `limit` ids; one row per piece."""
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end, step = encoder(tokenizer_path), struct.pack("<I", end_id), 4 * limit
        for batch in batches:
            rows = []
            for key, doc, text in zip(batch["extract_id"].tolist(), batch["doc"].tolist(), batch["text"].tolist()):
                ids = encode(text or "") + end
                for at in range(0, len(ids), step):
                    piece = ids[at:at + step]
                    rows.append((key, doc, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4))
            out = pd.DataFrame(rows, columns=["extract_id", "doc", "start", "length", "ids_crc32", "doc_tokens"])
            yield out.astype({"extract_id": "Int64"})

    rows = extracts.select(F.col("extract_id").cast("long").alias("extract_id"), F.monotonically_increasing_id().alias("doc"), "text")
    return rows.mapInPandas(pieces, PIECES)


def pack_extracts(extracts: DataFrame, tokenizer_path: str, end_id: int, limit: int = 1024) -> DataFrame:
    """(extract_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece of `extracts` (extract_id, text).

    The texts meant are the project's map extracts. Each is encoded whole (null: empty) with
    `end_id` after it and cut every `limit` ids. Pieces are placed by shortest-pack-first
    over the histogram of their lengths, which has at most `limit` entries and is all that
    the driver sees. The patterns come back as runs of ranks per length (a few thousand at
    most), and a piece joins the run that its rank falls in. Ranks are counted within
    (length, salt), so one length, such as that of full pieces, is spread over tasks.

    Repeated rows and ids are packed each on their own; a null id stays null. Other columns
    are ignored. An empty table gives an empty result.
    """
    spark = extracts.sparkSession
    salt = F.pmod(F.xxhash64("extract_id", "doc", "start"), F.lit(SALTS)).cast("int")
    pieces = cut(token_pieces(extracts, tokenizer_path, end_id, limit).withColumn("salt", salt))
    counts = {(r["length"], r["salt"]): r["n"] for r in pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).collect()}
    histogram: dict[int, int] = {}
    firsts = []
    for length, s in sorted(counts):
        firsts.append((length, s, histogram.get(length, 0)))
        histogram[length] = histogram.get(length, 0) + counts[length, s]

    runs, sequence, ranked = [], 0, dict.fromkeys(histogram, 0)
    for pattern, count in shortest_pack_first(histogram, limit):
        offset = 0
        for length in pattern:
            runs.append((length, ranked[length], ranked[length] + count, sequence, offset))
            ranked[length], offset = ranked[length] + count, offset + length
        sequence += count
    by_length: dict[int, list] = {}
    for length, *run in runs:
        by_length.setdefault(length, []).append(tuple(run))

    first = spark.createDataFrame(firsts, "length int, salt int, first long")
    table = spark.createDataFrame(list(by_length.items()), "length int, runs array<struct<low: long, high: long, sequence: long, offset: long>>")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc", "start")) - 1
    ranked_pieces = pieces.withColumn("rank", rank).join(F.broadcast(first), ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("first"))
    placed = ranked_pieces.join(F.broadcast(table), "length").withColumn(
        "run", F.get(F.filter("runs", lambda r: (r["low"] <= F.col("rank")) & (F.col("rank") < r["high"])), F.lit(0)))
    return placed.select("extract_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
                         (F.col("run.sequence") + F.col("rank") - F.col("run.low")).alias("sequence_id"), F.col("run.offset").alias("offset"))
