"""Similarity join of texts on their word 5-grams, by bands of signatures of one fixed depth."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ._common import DOC, components, cut, keyed, salted_join, units

SPACE = r"[\x20\x09-\x0D]+"
WORDS = 5
TREES = 20
MAX_DEPTH = 6
#: Rows of a unit of work; a larger prefix group is split in blocks and each pair of blocks is a unit.
BLOCK = 512
#: Shingles signed at a time, and shingles of a unit multiplied at a time.
SIGN_AT_ONCE, COLUMNS_AT_ONCE = 1 << 20, 4096
UNIT = ["tree", "prefix", "low", "high"]
KEY = "_null boolean, _id long, _hash long"


def forest_depth(similarity: float, recall: float, trees: int = TREES, max_depth: int = MAX_DEPTH) -> int:
    """The depth of all bands, from the two constants alone: the largest up to `max_depth` at which a pair at the threshold meets in some tree with probability `recall`."""
    depth = max_depth
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def _word_hashes(text: str) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACE), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def window_hashes(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of the 5-word windows in order; of all words if there are fewer."""
    w = np.asarray(words).astype(np.int64, copy=False).view(np.uint64)
    n = min(WORDS, len(w))
    out = np.full(len(w) - n + 1 if n else 0, np.uint64(n))
    for i in range(n):
        out = _mixed(out + w[i:len(w) - n + 1 + i])
    return out


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct window hashes."""
    return np.unique(window_hashes(words))


@lru_cache
def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2), rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """(len(sets), count) smallest hashes, 32 bits each; sets must not be empty."""
    offsets = np.cumsum([0, *map(len, sets)])[:-1]
    everything, out = np.concatenate(sets), np.empty((len(sets), count), np.uint32)
    for k, (flip, odd) in enumerate(zip(*_functions(count))):
        v = (everything ^ flip) * odd
        v ^= v >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(v * odd, offsets) >> np.uint64(32)
    return out


def _sign(count: int):
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(w) for w in batch["words"]]
            sigs: list[bytes | None] = [None] * len(sets)
            group, size = [], 0
            for i, s in enumerate(sets):
                if len(s):
                    group.append(i)
                    size += len(s)
                if group and (size >= SIGN_AT_ONCE or i == len(sets) - 1):
                    for j, sig in zip(group, signatures([sets[j] for j in group], count)):
                        sigs[j] = sig.tobytes()
                    group, size = [], 0
            if group:
                for j, sig in zip(group, signatures([sets[j] for j in group], count)):
                    sigs[j] = sig.tobytes()
            out = batch[DOC].copy()
            out["digest"] = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            out["n"] = [len(s) for s in sets]
            out["sig"] = sigs
            yield out
    return sign


def _new_pairs(columns: dict, tree: int, low: int, high: int, depth: int, similarity: float, screen: int):
    """Row numbers and the matrix of pairs that first meet in this tree and can be similar."""
    sig = np.frombuffer(b"".join(columns["sig"]), np.uint32).reshape(len(columns["sig"]), -1)
    block, n = columns["block"], columns["n"].astype(np.int64)
    rows = np.flatnonzero(block == low)
    cols = np.flatnonzero(block == high)
    same = sig[rows][:, None, :] == sig[cols][None, :, :]
    met = same.reshape(len(rows), len(cols), TREES, depth).all(3)
    new = met[:, :, tree] & ~met[:, :, :tree].any(2) & (same.sum(2) >= screen)
    new &= np.minimum(n[rows][:, None], n[cols][None, :]) >= similarity * np.maximum(n[rows][:, None], n[cols][None, :]) - 1e-9
    if low == high:
        new &= np.arange(len(rows))[:, None] < np.arange(len(cols))[None, :]
    return rows, cols, new


def _candidates(depth: int, similarity: float, screen: int):
    """Members of a unit that have at least one new pair there; all else need not be read again."""
    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for (tree, _, low, high), columns in units(batches, UNIT):
            rows, cols, new = _new_pairs(columns, tree, low, high, depth, similarity, screen)
            keep = np.union1d(rows[new.any(1)], cols[new.any(0)])
            if len(keep):
                held.append(pd.DataFrame({c: columns[c][keep] for c in [*UNIT, "block", *DOC, "n", "copies", "sig"]}))
                size += len(keep)
                if size > 5000:
                    yield pd.concat(held)
                    held, size = [], 0
        if held:
            yield pd.concat(held)
    return pick


def overlaps(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs marked in `new`."""
    out = np.zeros(new.shape, np.int64)
    a, b = np.nonzero(new)
    if len(a) <= 4 * (len(rows) + len(cols)):
        for i, j in zip(a, b):
            out[i, j] = len(np.intersect1d(sets[rows[i]], sets[cols[j]], assume_unique=True))
        return out
    number, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.bincount(column, minlength=len(number)) > 1
    place = np.cumsum(shared) - 1
    used = shared[column]
    owner, column = owner[used], place[column[used]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(shared.sum()), COLUMNS_AT_ONCE):
        x, y = np.searchsorted(column, [at, at + COLUMNS_AT_ONCE])
        m = np.zeros((len(sets), COLUMNS_AT_ONCE), np.float32)
        m[owner[x:y], column[x:y] - at] = 1
        out += (m[rows] @ m[cols].T).astype(np.int64)
    return out


def _verify(depth: int, similarity: float, screen: int):
    """Exact Jaccard of the new pairs; per member with links: their weight and the smallest member of its piece."""
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (tree, _, low, high), columns in units(batches, UNIT):
            once = np.unique(np.stack([columns[c].astype(np.int64) for c in DOC]), axis=1, return_index=True)[1]  # repeated rows of a document
            columns = {c: v[once] for c, v in columns.items()}
            rows, cols, new = _new_pairs(columns, tree, low, high, depth, similarity, screen)
            if not new.any():
                continue
            sets = [shingles(w) for w in columns["words"]]
            n, both = np.array([len(s) for s in sets]), overlaps(sets, rows, cols, new)
            linked = new & (both >= similarity * (n[rows][:, None] + n[cols][None, :] - both) - 1e-9)
            weight = np.zeros(len(sets), np.int64)
            copies = columns["copies"].astype(np.int64)
            np.add.at(weight, rows, (linked * copies[cols][None, :]).sum(1))
            np.add.at(weight, cols, (linked * copies[rows][:, None]).sum(0))
            root = np.arange(len(sets))  # members are in the order of DOC, so a smaller number is a smaller document
            a, b = np.nonzero(linked)
            a, b = rows[a], cols[b]
            while len(a):
                least = np.minimum(root[a], root[b])
                before = root.copy()
                np.minimum.at(root, a, least)
                np.minimum.at(root, b, least)
                np.minimum.at(root, before[a], least)
                np.minimum.at(root, before[b], least)
                root = root[root]
                if (root == before).all():
                    break
            some = np.flatnonzero(weight)
            yield pd.DataFrame({**{f"a{c}": columns[c][some] for c in DOC}, **{f"b{c}": columns[c][root[some]] for c in DOC}, "weight": weight[some]})
    return check


def near_extracts(extracts: DataFrame, similarity: float = 0.8, recall: float = 0.999999) -> DataFrame:
    """(extract_id, class_id, class_size, n_links, first, _hash) per row of `extracts` (extract_id, text).

    The texts meant are the project's map extracts, of which overlapping areas give near
    copies. Two texts are linked if the sets of their 5-word windows (lower case, split at
    white space; all words where there are fewer than five) have a Jaccard similarity of at
    least `similarity`. `n_links` counts linked rows, copies included. Classes are connected
    by links; `class_id` is the smallest extract_id of the class, `class_size` its rows and
    `first` marks the row to keep: the smallest by id (null last), then by hash of the text.

    Method: banding at one fixed depth, which stands for an LSH forest. Texts with equal
    window sets are one node. Each node has TREES signatures of min-hashes; in each tree
    nodes meet that share the first `forest_depth` of them, so that a pair at the threshold
    meets in some tree with probability `recall`. No prefix is adapted to the data.
    Groups are split in blocks of BLOCK nodes and each pair of blocks is a unit, so a large
    group of near copies is spread over tasks and no pair is ever a row. A pair counts in the
    first tree where it meets, and there it is verified exactly on the windows of the whole
    texts. Pairs whose signatures agree in under two fifths of all places, which a pair at the
    threshold does with a chance below 1e-9, are not verified.

    Texts without words (null, empty) are copies of each other. Rows equal in id and text
    are each counted and only one of them is `first`. An empty table gives an empty result.
    Other columns are ignored.
    """
    depth = forest_depth(similarity, recall)
    count = TREES * depth
    screen = count * 2 // 5 if similarity >= 0.8 else 0
    docs = keyed(extracts.select("extract_id", "text"))
    signed = cut(docs.select(*DOC, _word_hashes("text").alias("words")).mapInPandas(_sign(count), f"{KEY}, digest binary, n long, sig binary"))
    place = F.struct(*DOC)
    nodes = cut(signed.groupBy("digest").agg(F.min(place).alias("doc"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
                .select("digest", "doc.*", "copies", "n", "sig"))

    prefix = F.xxhash64(F.expr(f"substring(sig, tree * {4 * depth} + 1, {4 * depth})"))
    met = (nodes.filter("n > 0").select(*DOC, "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
           .select(*DOC, "tree", prefix.alias("prefix")))
    groups = met.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = (salted_join(met, groups, ["tree", "prefix"], place).withColumn("blocks", blocks)
              .withColumn("block", F.pmod(F.xxhash64(F.lit(3), *DOC), F.col("blocks")).cast("int")))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *DOC, "tree", "prefix", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    members = paired.join(nodes.select(*DOC, "n", "copies", "sig"), DOC)
    ordered = lambda df: df.repartition(*UNIT).sortWithinPartitions(*UNIT)
    schema = f"tree int, prefix long, low int, high int, block int, {KEY}, n long, copies long, sig binary"
    hopeful = cut(ordered(members.select(*UNIT, "block", *DOC, "n", "copies", "sig")).mapInPandas(_candidates(depth, similarity, screen), schema))
    whole = ordered(hopeful.join(docs.select(*DOC, "text"), DOC)).select(*UNIT, "block", *DOC, "n", "copies", "sig", _word_hashes("text").alias("words"))
    ends = ", ".join(f"{s}_{c}" for s in "ab" for c in ("null boolean", "id long", "hash long"))
    found = cut(whole.mapInPandas(_verify(depth, similarity, screen), f"{ends}, weight long"))

    links = found.groupBy(*[F.col(f"a{c}").alias(c) for c in DOC]).agg(F.sum("weight").alias("weight"))
    roots = components(found, ["null", "id", "hash"]).select(F.col("node.null").alias("_null"), F.col("node.id").alias("_id"), F.col("node.hash").alias("_hash"), "root")
    of_node = nodes.join(links, DOC, "left").join(roots, DOC, "left").select(
        "digest", "copies", F.coalesce("weight", F.lit(0)).alias("weight"),
        F.coalesce("root", F.struct(F.col("_null").alias("null"), F.col("_id").alias("id"), F.col("_hash").alias("hash"))).alias("root"))
    of_node = cut(of_node)
    sizes = of_node.groupBy("root").agg(F.sum("copies").alias("class_size"))
    of_node = salted_join(of_node, sizes, ["root"], F.col("digest"))
    rows = salted_join(signed.select(*DOC, "digest"), of_node, ["digest"], place)
    least = F.struct(F.col("_null").alias("null"), F.col("_id").alias("id"), F.col("_hash").alias("hash")) == F.col("root")
    return rows.select(F.when(~F.col("_null"), F.col("_id")).alias("extract_id"), F.when(~F.col("root.null"), F.col("root.id")).alias("class_id"),
                       "class_size", (F.col("weight") + F.col("copies") - 1).alias("n_links"), least.alias("first"), "_hash")


def drop_near_extracts(extracts: DataFrame, similarity: float = 0.8, recall: float = 0.999999) -> DataFrame:
    """`extracts` with one row of each class of `near_extracts`."""
    first = near_extracts(extracts, similarity, recall).filter("first").select(
        F.col("extract_id").isNull().alias("_null"), F.coalesce("extract_id", F.lit(0)).alias("_id"), "_hash").distinct()
    kept = keyed(extracts).join(first, DOC, "left_semi").dropDuplicates(DOC)
    return kept.select(*extracts.columns)
