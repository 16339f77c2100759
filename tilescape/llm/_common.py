"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tilescape.session import checkpoint_dir, cut

__all__ = ["DOC", "components", "cut", "file_system", "keyed", "read", "salted_join", "shared_folder", "units"]

#: Copies of a small side, and so the number of tasks that share one hot key of the large side.
SALTS = 16


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run, below the folder that all executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(folder: str):
    """The file system of a folder's URI and the folder's path in it. Needed for binary files, which Spark cannot write."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), posixpath.abspath(folder))


def salted_join(large: DataFrame, small: DataFrame, keys: Sequence[str], spread: Column, how: str = "inner") -> DataFrame:
    """Equi-join whose large side may hold a third of its rows under one key.

    Every row of `small` (unique by `keys`, narrow) is repeated once per salt; rows of
    `large` take the salt of `spread`. `how` is inner, left, left_semi or left_anti.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    right = small.withColumn("_salt", salts)
    left = large.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


#: Identity and order of a text document: its id (null last), then a hash of its text.
DOC = ["_null", "_id", "_hash"]


def keyed(extracts: DataFrame) -> DataFrame:
    """Add the columns DOC. Rows equal in id and text are one document."""
    return extracts.withColumns({"_null": F.col("extract_id").isNull(), "_id": F.coalesce("extract_id", F.lit(0)).cast("long"),
                                 "_hash": F.xxhash64(F.coalesce("text", F.lit("")))})


def units(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[tuple, dict]]:
    """(key, columns as numpy arrays) of each run of equal keys in a sorted stream, one run in memory at a time."""
    import numpy as np

    held: list[dict] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        change = np.zeros(len(batch), dtype=bool)
        for k in keys:
            change[1:] |= columns[k][1:] != columns[k][:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            part = {c: v[a:b] for c, v in columns.items()}
            if held and any(held[-1][k][0] != part[k][0] for k in keys):
                yield _unit(held, keys)
                held = []
            held.append(part)
    if held:
        yield _unit(held, keys)


def _unit(held: list[dict], keys: Sequence[str]) -> tuple[tuple, dict]:
    import numpy as np

    columns = held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]}
    return tuple(columns[k][0] for k in keys), columns


def components(edges: DataFrame, node: Sequence[str]) -> DataFrame:
    """(node, root) of each node of `edges` (columns a_<n> and b_<n> for each n of `node`); the root is the component's smallest node.

    Every node hooks to its smallest neighbour, pointers are shortened, and the edges are
    contracted to the roots; they shrink each round until none is left. Each round is written
    to the shared folder. Hot roots are salted.
    """
    struct = lambda s: F.struct(*[F.col(f"{s}_{n}").alias(n) for n in node])
    pairs = edges.select(struct("a").alias("a"), struct("b").alias("b")).filter("a != b")
    pairs = cut(pairs.union(pairs.select("b", "a")).distinct())
    nodes = cut(pairs.select(F.col("a").alias("node")).distinct())
    labels = nodes.select("node", F.col("node").alias("root"))
    while not pairs.isEmpty():
        parent = pairs.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("root"))
        for _ in range(2):
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("up"))
            parent = salted_join(parent, up, ["root"], F.col("node")).select("node", F.col("up").alias("root"))
        parent = cut(parent)
        for end, other in (("a", "b"), ("b", "a")):
            to = parent.select(F.col("node").alias(end), F.col("root").alias("to"))
            pairs = salted_join(pairs, to, [end], F.col(other)).select(F.col("to").alias(end), other)
        pairs = cut(pairs.select("a", "b").filter("a != b").distinct())
        moved = parent.select(F.col("node").alias("root"), F.col("root").alias("to"))
        labels = cut(salted_join(labels, moved, ["root"], F.col("node"), "left").select("node", F.coalesce("to", "root").alias("root")))
    return labels
