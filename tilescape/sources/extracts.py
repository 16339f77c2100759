"""Large map extracts, each one JSON document, read by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tilescape.session import by_keys, cut, cut_texts

from .documents import ELEMENTS, element_rows

#: How an element begins in a file.
ELEMENT_START = '{"type"'
#: Depth of an element: inside the document and its list.
INSIDE = 2


def read_pieces(spark: SparkSession, path: str, start: str = ELEMENT_START) -> DataFrame:
    """(path, block, row, value): the files below `path`, cut before each `start`.

    Spark's text reader cuts files at a separator of one's own, so a file is dealt to tasks by
    byte ranges. `block` is the range's first byte and `row` grows along it. All but the
    first piece of a file begin with `start`, which the reader takes away and is put back here.
    """
    pieces = spark.read.text(path, lineSep=start, recursiveFileLookup=True)
    return pieces.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                         F.monotonically_increasing_id().alias("row"), "value")


def _measures(value: Column) -> tuple[Column, Column, Column]:
    """(unescaped quotes, depth gained from outside a string, depth gained from inside one)."""
    bare = F.when(F.instr(value, "\\") > 0, F.regexp_replace(value, r"\\.", "")).otherwise(value)
    without = lambda text, sign: F.length(F.replace(text, F.lit(sign), F.lit("")))
    gained = lambda text: without(text, "}") + without(text, "]") - without(text, "{") - without(text, "[")
    # What lies outside when a piece begins outside lies inside when it begins inside, and the other way round.
    outside, both = gained(F.regexp_replace(bare, r'"[^"]*("|$)', "")), gained(bare)
    return F.length(bare) - without(bare, '"'), outside, both - outside


def with_state(pieces: DataFrame, start: str = ELEMENT_START) -> tuple[DataFrame, DataFrame]:
    """(pieces, files): `pieces` with `first` (of its file), `in_string` and `depth` where a piece begins, `depth_after`, and the file's
    `broken`; (path, broken) of each file.

    Quotes and brackets are summed along each block as if it began outside and as if it began
    inside a string; one short fold over the blocks of a file tells which it was. So no task
    sees more than a block. A file is broken if it ends in a string or at another depth than
    0, or goes below 0 where a piece ends. The text is written once, where it is read, and shuffled
    once, with the state of its block; the sums before are shuffled without it.
    """
    along = Window.partitionBy("path", "block").orderBy("row")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    quotes, out, inn = _measures(F.col("value"))
    read = cut_texts(pieces.select("path", "block", "row", "value", quotes.alias("_q"), out.alias("_out"), inn.alias("_in")))

    def summed(df: DataFrame) -> DataFrame:
        # The first piece of a file begins at its first byte, so the text is not read twice to find it. The others begin with `start`.
        q, o, i = _measures(F.lit(start))
        told = df.withColumn("first", (F.col("block") == 0) & (F.row_number().over(along) == 1))
        swapped, own = q % 2 == 1, F.col("first")
        told = told.withColumns({"_q": F.when(own, F.col("_q")).otherwise(F.col("_q") + q),
                                 "_out": F.when(own, F.col("_out")).otherwise(F.when(swapped, F.col("_in")).otherwise(F.col("_out")) + o),
                                 "_in": F.when(own, F.col("_in")).otherwise(F.when(swapped, F.col("_out")).otherwise(F.col("_in")) + i)})
        parity = told.withColumn("_p", F.coalesce(F.sum("_q").over(before), F.lit(0)) % 2)
        same, other = F.when(F.col("_p") == 0, F.col("_out")).otherwise(F.col("_in")), F.when(F.col("_p") == 0, F.col("_in")).otherwise(F.col("_out"))
        return parity.withColumns({"_g0": same, "_g1": other}).withColumns({"_d0": F.sum("_g0").over(along), "_d1": F.sum("_g1").over(along)})

    # One row per block, then one short array per file.
    blocks = summed(read.drop("value")).groupBy("path", "block").agg((F.sum("_q") % 2).alias("q"), F.max_by("_d0", "row").alias("d0"), F.max_by("_d1", "row").alias("d1"),
                                                                     F.min("_d0").alias("m0"), F.min("_d1").alias("m1"))
    files = blocks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block", "q", "d0", "d1", "m0", "m1"))).alias("_blocks"))
    state = F.struct(F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("d"), F.lit(False).alias("below"),
                     F.array().cast("array<struct<block: bigint, p: bigint, d: bigint>>").alias("at"))

    def step(s: Column, b: Column) -> Column:
        gained, least = F.when(s["p"] == 0, b["d0"]).otherwise(b["d1"]), F.when(s["p"] == 0, b["m0"]).otherwise(b["m1"])
        here = F.struct(b["block"].alias("block"), s["p"].alias("p"), s["d"].alias("d"))
        return F.struct(((s["p"] + b["q"]) % 2).cast("bigint").alias("p"), (s["d"] + gained).cast("bigint").alias("d"), (s["below"] | (s["d"] + least < 0)).alias("below"),
                        F.array_append(s["at"], here).alias("at"))

    folded = files.select("path", F.aggregate("_blocks", state, step).alias("s"))
    broken = (F.col("s.p") != 0) | (F.col("s.d") != 0) | F.col("s.below")
    begins = cut(folded.select("path", broken.alias("broken"), F.explode("s.at").alias("b")).select("path", "broken", F.col("b.block").alias("block"), F.col("b.p").alias("_bp"), F.col("b.d").alias("_bd")))
    placed = summed(read.join(by_keys(begins), ["path", "block"]))
    after = F.col("_bd") + F.when(F.col("_bp") == 0, F.col("_d0")).otherwise(F.col("_d1"))
    gained = F.when(F.col("_bp") == 0, F.col("_g0")).otherwise(F.col("_g1"))
    text = F.when(F.col("first"), F.col("value")).otherwise(F.concat(F.lit(start), "value"))
    whole = placed.select("path", "block", "row", "first", text.alias("value"), ((F.col("_p") + F.col("_bp")) % 2 == 1).alias("in_string"), (after - gained).alias("depth"),
                          after.alias("depth_after"), "broken")
    return whole, begins.select("path", "broken").distinct()


def small_documents(pieces: DataFrame) -> DataFrame:
    """(path, value): pieces (of `with_state`) as small documents of whole elements; files that are broken are left out.

    A border is a true one if it lies outside strings at the depth of an element. Pieces
    behind a false border (a member of a relation) are joined to the piece before them
    where their block is; only what is open at the end or the beginning of a block is shuffled.
    """
    true = F.col("first") | (~F.col("in_string") & (F.col("depth") == INSIDE))
    along, block = Window.partitionBy("path", "block").orderBy("row"), Window.partitionBy("path", "block")
    owned = pieces.filter(~F.col("broken")).withColumn("_own", F.max(F.when(true, F.col("row"))).over(along))
    owned = owned.withColumn("_last", F.col("_own").eqNullSafe(F.max("_own").over(block)) | F.col("_own").isNull())

    def joined(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
        listed = df.groupBy("path", *by).agg(F.array_sort(F.collect_list(F.struct(*order, "value", "first", "depth_after"))).alias("_l"))
        return listed.select("path", *by, F.array_join(F.transform("_l", lambda p: p["value"]), "").alias("value"), F.get("_l", F.lit(0))["first"].alias("first"),
                             F.element_at("_l", -1)["depth_after"].alias("depth_after"))

    groups = cut_texts(joined(owned, ["block", "_own", "_last"], ["row"]))
    order = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per block: where the element began that is open at the block's first byte.
    carried = (groups.groupBy("path", "block").agg(F.max("_own").alias("_ended"))
               .select("path", "block", F.last(F.when(F.col("_ended").isNotNull(), F.struct("block", "_ended")), ignorenulls=True).over(order).alias("_carried")))
    edges = (groups.filter("_last").join(carried, ["path", "block"])
             .withColumn("_group", F.when(F.col("_own").isNotNull(), F.struct(F.col("block"), F.col("_own").alias("_ended"))).otherwise(F.col("_carried"))))
    ends = ["path", "value", "first", "depth_after"]
    return groups.filter("not _last").select(*ends).unionByName(joined(edges, ["_group"], ["block"]).select(*ends)).select("path", _closed().alias("value"))


def _closed() -> Column:
    """A document around the elements of `value`: its own head and tail where it has them."""
    body = F.when(F.col("depth_after") == 0, F.col("value")).otherwise(F.concat(F.regexp_replace("value", r",?\s*$", ""), F.lit("]}")))
    return F.when(F.col("first"), body).otherwise(F.concat(F.lit('{"elements":['), body))


def read_elements(spark: SparkSession, path: str, start: str = ELEMENT_START) -> tuple[DataFrame, DataFrame]:
    """(elements, rejected) of the extracts below `path`: what `element_rows` gives for whole files, read by many tasks.

    `rejected` has (path, reason) for each extract that is not one well-formed document with
    a list `elements`; none of its elements are returned. `start` is how most elements begin
    in the files (with its white space, for instance `{\n  "type"`); elements that begin in
    another way are parsed with the one before them, and a file without any is one piece. An
    extract holds one list of objects. Empty files are passed over, as by all of Spark's readers.
    """
    pieces, files = with_state(read_pieces(spark, path, start), start)
    small = small_documents(pieces)
    unbalanced = files.filter("broken").select("path").withColumn("reason", F.lit("brackets or quotes do not match"))
    unreadable = small.filter(F.from_json("value", ELEMENTS)["elements"].isNull()).select("path").distinct().withColumn("reason", F.lit("no list of elements"))
    rejected = cut(unbalanced.unionByName(unreadable))
    good = small.join(rejected.select("path"), "path", "left_anti")
    return element_rows(good.select("path", "value")), rejected
