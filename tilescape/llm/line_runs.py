"""Removal of runs of lines that repeat earlier ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ._common import DOC, cut, keyed, salted_join

SPACE = r"[\x20\x09-\x0D]+"


def _windows(extracts: DataFrame, min_words: int) -> DataFrame:
    """(document, first, last, anchor, anchor_at, digest): the smallest runs of at least `min_words` words.

    There is one run from each line on and one up to each line. Which lines a run has depends
    on their content alone, so equal passages have equal runs. The anchor is the run's
    smallest line hash (the last one of equal ones): the fingerprint that winnowing selects.
    """
    line = F.expr(r"transform(split(text, '\n'), (s, i) -> struct(i as at, trim(BOTH ' \t\u000b\u000c\r' from s) as line))")
    lines = (keyed(extracts).select(*DOC, F.inline(line))
             .select(*DOC, "at", F.size(F.array_remove(F.split("line", SPACE), "")).alias("words"), F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("g"))
             .filter("words > 0").repartition(*DOC).dropDuplicates([*DOC, "at"]))
    doc = Window.partitionBy(*DOC)
    placed = lines.withColumn("end", F.sum("words").over(doc.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col("words"))

    def runs(frame, first, last):
        seen = placed.select(*DOC, first(frame).alias("first"), last(frame).alias("last"), F.sum("words").over(frame).alias("n"),
                             F.min(F.struct("h", -F.col("at"))).over(frame).alias("low"), F.collect_list(F.struct("h", "g")).over(frame).alias("content"))
        return seen.filter(F.col("n") >= min_words).select(
            *DOC, "first", "last", F.col("low.h").alias("anchor"), (-F.col("low.col2")).alias("anchor_at"),
            F.xxhash64("content").alias("d1"), F.xxhash64(F.lit(7), "content").alias("d2"))

    here = lambda frame: F.col("at")
    after = runs(doc.orderBy("begin").rangeBetween(0, min_words - 1), here, lambda f: F.max("at").over(f))
    upto = runs(doc.orderBy("end").rangeBetween(1 - min_words, 0), lambda f: F.min("at").over(f), here)
    return after.unionByName(upto)


def repeated_runs(extracts: DataFrame, min_words: int = 50) -> DataFrame:
    """(_null, _id, _hash, runs): per document the disjoint, sorted line ranges (first, last) that repeat an earlier run."""
    windows = cut(_windows(extracts, min_words).distinct())
    at = F.struct(*DOC, "anchor_at")
    anchors = (windows.groupBy("anchor").agg(F.min(at).alias("a"), F.max(at).alias("b")).filter("a != b").select("anchor"))
    # Positions of repeated fingerprints, extended both ways to the ends of their run.
    extended = cut(salted_join(windows, anchors, ["anchor"], F.struct(*DOC, "first"), "left_semi"))
    place = F.struct(*DOC, "first", "last")
    earliest = (extended.groupBy("d1", "d2").agg(F.min(place).alias("earliest"), F.max(place).alias("latest"))
                .filter("earliest != latest").select("d1", "d2", "earliest"))
    later = salted_join(extended, earliest, ["d1", "d2"], place).filter(place != F.col("earliest")).select(*DOC, "first", "last")
    order = Window.partitionBy(*DOC).orderBy("first", "last")
    open_to = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("new", F.coalesce(F.col("first") > open_to, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy(*DOC, "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def drop_repeated_runs(extracts: DataFrame, min_words: int = 50) -> DataFrame:
    """`extracts` (extract_id, text, any others) without repeated runs of lines, plus n_lines and n_removed.

    Made for the project's map extracts: line-oriented texts of overlapping areas, which
    repeat runs of lines. A line goes if it lies in a run of consecutive lines of at least
    `min_words` words that equals an earlier run, in the same text or in one before it (by
    id, null last, then by a hash of the text). Lines are compared without white space at
    their ends; blank lines do not count, and go where a deleted smallest run spans them.
    Shorter repeats stay, so headings and common short lines are left alone.

    Method: winnowing. In each smallest run of at least `min_words` words the smallest line
    hash is selected, so two equal passages of that many words select equal fingerprints,
    guaranteed. Positions with repeated fingerprints are joined, extended to both ends of
    their runs, and every run but the earliest of its content is deleted; longer passages are
    chains of overlapping runs (the runs that begin at a line and those that end at one cover
    each of its lines). Runs are compared with the earliest one, by a 128-bit digest, never
    in pairs, and hot ones are salted, so the work is linear.

    Null texts stay null; rows equal in id and text are one document and stay as repeated
    rows. Columns that begin with an underscore are not allowed. An empty table stays empty.
    """
    own = extracts.columns
    cuts = repeated_runs(extracts, min_words)
    joined = keyed(extracts).join(cuts, DOC, "left").withColumn("_lines", F.split("text", "\n"))
    zero = F.lit(0)
    starts = F.concat(F.array(zero), F.transform("runs", lambda r: r["last"] + 1))
    ends = F.concat(F.transform("runs", lambda r: r["first"]), F.array(F.size("_lines")))
    staged = joined.withColumns({"_starts": starts, "_ends": ends})
    kept = F.array_join(F.flatten(F.zip_with("_starts", "_ends", lambda a, b: F.slice("_lines", a + 1, b - a))), "\n")
    removed = F.aggregate("runs", F.lit(0), lambda s, r: s + (r["last"] - r["first"] + 1).cast("int"))
    rest = [F.when(F.col("runs").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in own]
    return staged.select(*rest, F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
                         F.coalesce(removed, zero).cast("long").alias("n_removed"))
