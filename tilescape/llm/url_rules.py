"""Allow and block rules for the addresses that tile documents are fetched from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._common import cut

#: Ends the host part of a key; sorts below every character of an address.
MARK = "\u0001"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: str | Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://`."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: str | Column) -> Column:
    """From the end of the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(name: str, labels: Column | None = None) -> Column:
    parts = F.reverse(F.split(name, r"\."))
    return F.array_join(parts if labels is None else F.slice(parts, F.lit(1), labels), ".")


def _rule_stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): each rule with all rules whose key is a prefix of its own, itself included.

    Keys are cut into their prefixes, so a stack is at most as deep as its key is long.
    """
    known = (rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
             .filter((F.col("host") != "") & F.col("verdict").isNotNull())
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))  # of equal rules, block counts
    named = known.select(F.concat(_reversed("host"), F.lit(MARK), "path").alias("key"), F.struct(
        (F.length("host") + F.length("path")).alias("length"), F.length("host").alias("host_length"),
        F.concat("host", "path").alias("rule"), "verdict").alias("found"))
    prefixes = named.select("key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n")).select(
        "key", F.expr("substring(key, 1, n)").alias("prefix"))
    return (prefixes.join(named.select(F.col("key").alias("prefix"), "found"), "prefix").groupBy("key")
            .agg(F.collect_list(F.struct("prefix", "found")).alias("stack")))


def judge_urls(fetches: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(fetch_id, host, path, rule, verdict) for each row of `fetches` (fetch_id, url).

    `rules` (host, path, verdict allow or block) fit a host and all its subdomains where the
    address's path starts with the rule's path. The longest rule (host and path together)
    counts; among equally long ones that of the longer host, among equal rules a block.
    Where none fits, `rule` is null and the verdict is `default`.

    Method: sort-merge range join. With reversed hosts as keys (`net.example` MARK `/en/`) a
    rule fits exactly the interval of keys that start with its own. Each address has one key
    per host suffix. Keys and rules are dealt out in key order and swept: the last rule at or
    before a key carries the stack of rules open there, and the innermost one that is a prefix
    of the key is still open. The stack that is open at the start of a slice comes from the
    slices before it (one row per slice). Order is by key and fetch, so a hot host is spread
    over many slices.

    Null addresses and those without `://` have empty host and path. Repeated rows stay
    repeated. Rules with null or empty host or null verdict are ignored; a null path is empty.
    Other columns are ignored. Empty inputs give an empty result, or the default verdict.
    """
    parts = fetches.select("fetch_id", host("url").alias("host"), path("url").alias("path"))
    labels = F.when(F.col("host") != "", F.sequence(F.lit(1), F.size(F.split("host", r"\."))))
    keys = parts.select("fetch_id", "host", "path", F.explode_outer(labels).alias("_n"))
    keys = keys.select("fetch_id", "host", "path", F.concat(_reversed("host", F.col("_n")), F.lit(MARK), "path").alias("key"),
                       F.coalesce(F.col("_n") == 1, F.lit(True)).alias("whole"), F.lit(1).alias("kind"))
    events = keys.unionByName(_rule_stacks(rules).withColumn("kind", F.lit(0)), allowMissingColumns=True)
    swept = cut(events.repartitionByRange("key", "kind", "fetch_id").withColumn("slice", F.spark_partition_id()))

    opened = F.when(F.col("kind") == 0, F.struct("key", "stack"))
    slices = swept.groupBy("slice").agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("last"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("slice", F.last("last", True).over(before).alias("carried"))
    order = Window.partitionBy("slice").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    at = (swept.withColumn("open", F.last(opened, True).over(order)).filter("kind = 1").join(slices, "slice", "left")
          .withColumn("stack", F.coalesce("open.stack", "carried")))
    fits = F.filter("stack", lambda r: F.col("key").startswith(r["prefix"]))
    found = at.select("fetch_id", "host", "path", "whole", F.array_max(F.transform(fits, lambda r: r["found"])).alias("found"))
    best = found.groupBy("fetch_id", "host", "path").agg(F.max("found").alias("found"), F.count_if("whole").alias("n"))
    rows = best.select("fetch_id", "host", "path", F.col("found.rule").alias("rule"),
                       F.coalesce("found.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_i"))
    return rows.drop("_i")
