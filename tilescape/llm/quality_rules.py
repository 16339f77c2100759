"""Quality rules for text extracts, with cutoffs that keep false rejections limited."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ._common import cut

SPACE = r"[\x20\x09-\x0D]+"
#: Bits that hold a window's place; the other 40 hold a hash of its words.
PLACE_BITS = 24

#: Rule: (measure in hundredths, cutoffs from the loosest to the strictest). A text above its cutoff is rejected.
RULES: Mapping[str, tuple[str, Sequence[float]]] = {
    "symbols": ("100.0 * n_symbols / n_words", (400, 300, 200, 150, 100, 75, 50, 35, 25, 15, 10)),
    "dup_lines": ("100.0 * n_dup_lines / n_lines", (90, 80, 70, 60, 50, 40, 30, 20, 15, 10)),
    "repeats": ("100.0 * n_repeat_words / n_words", (50, 45, 40, 35, 30, 25, 20, 15, 10)),
    "word_length": ("100.0 * word_chars / n_words", (5000, 3000, 2000, 1600, 1400, 1200, 1100, 1000, 900)),
}


def with_measures(extracts: DataFrame, text: str = "text") -> DataFrame:
    """`extracts` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed.

    Words are runs without white space; a null text has none. Every measure is built from
    arrays of the row itself, so nothing is shuffled and no text is cut.
    """
    own = [c for c in extracts.columns if not c.startswith("_m_")]
    body = F.coalesce(F.col(text), F.lit(""))
    words = extracts.select(*own, F.array_remove(F.split(body, SPACE), "").alias("_m_words"))
    # Hash and place of each 3-word window in one number: sorting brings equal windows together.
    place = F.sequence(F.lit(0), F.size("_m_words") - 3)
    packed = F.transform(place, lambda i: F.shiftleft(F.xxhash64(F.get("_m_words", i), F.get("_m_words", i + 1), F.get("_m_words", i + 2)), PLACE_BITS)
                         .bitwiseOR(i.cast("bigint")))
    windows = words.select(*own, "_m_words", F.when(F.size("_m_words") >= 3, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")).alias("_m_sorted"))

    at = lambda j: F.get("_m_sorted", j)
    mask = F.lit((1 << PLACE_BITS) - 1)
    start = lambda v: v.bitwiseAND(mask).cast("int")

    def same(j: Column, k: Column) -> Column:
        a, b = at(j), at(k)
        word = lambda v, d: F.get("_m_words", start(v) + d)
        return ((F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS)) & (word(a, 0) == word(b, 0))
                & (word(a, 1) == word(b, 1)) & (word(a, 2) == word(b, 2)))

    seen_again = F.filter("_m_sorted", lambda v, j: F.coalesce(((j > 0) & same(j - 1, j)) | ((j < F.size("_m_sorted") - 1) & same(j, j + 1)), F.lit(False)))
    starts = windows.select(*own, "_m_words", F.transform(seen_again, lambda v: start(v)).alias("_m_at"))
    shifted = lambda d: F.transform("_m_at", lambda p: p + d)
    lines = F.filter(F.split(body, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    counted = starts.select(*own, F.size("_m_words").cast("bigint").alias("n_words"),
                            F.char_length(F.array_join("_m_words", "")).cast("bigint").alias("word_chars"),
                            F.char_length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
                            lines.alias("_m_lines"),
                            F.size(F.array_union(F.array_union("_m_at", shifted(1)), shifted(2))).cast("bigint").alias("n_repeat_words"))
    return counted.select(*own, "n_words", "word_chars", "n_symbols", F.size("_m_lines").cast("bigint").alias("n_lines"),
                          (F.size("_m_lines") - F.size(F.array_distinct("_m_lines"))).cast("bigint").alias("n_dup_lines"), "n_repeat_words",
                          ((F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)).alias("base_failed"))


def binomial_at_most(x: Column, n: Column, p: float) -> Column:
    """P(at most x of n succeed) with chance p; exact for x below n*p, else 1 (all a bound needs)."""
    k = F.sequence(F.lit(1).cast("bigint"), x)
    choose = F.when(x > 0, F.aggregate(k, F.lit(0.0), lambda s, i: s + F.log((n - i + 1) / i))).otherwise(F.lit(0.0))
    first = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(s: Column, i: Column) -> Column:  # from the term of x down to that of 0
        term = s["term"] * i / (n - i + 1) * ((1 - p) / p)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    tail = F.when(x > 0, F.aggregate(F.reverse(k), first, step)["total"]).otherwise(F.lit(1.0))
    top = F.exp(choose + x * F.log(F.lit(p)) + (n - x) * F.log(F.lit(1 - p)))
    return F.when(x < n * p, F.least(F.lit(1.0), top * tail)).otherwise(F.lit(1.0))


def _ratio(measure: str) -> Column:
    return F.expr(measure.replace("/ n_words", "/ nullif(n_words, 0)").replace("/ n_lines", "/ nullif(n_lines, 0)"))


def risk_cutoffs(measured: DataFrame, verdicts: DataFrame, stratum: str, risk: float = 0.02, error: float = 0.05,
                 rules: Mapping[str, tuple[str, Sequence[float]]] = RULES) -> DataFrame:
    """(stratum, one cutoff column per rule): the strictest cutoffs whose false rejections are limited.

    `verdicts` (extract_id, good) labels extracts as worth keeping or not; those labelled good
    that pass the base rules are the holdout. In each stratum and for each rule the cutoffs
    are tested from the loosest on, and testing stops at the first failure (a fixed sequence,
    which needs no correction along it). A cutoff passes if x or fewer of n good extracts
    being rejected would have a probability of at most error / (strata * rules) (Bonferroni)
    at a true rate of risk / rules: an exact one-sided binomial bound. So with probability
    1 - error, no stratum loses more than `risk` of its good extracts to all rules together.
    A rule without a passing cutoff gets none (null) and rejects nothing.

    Counts are over all labelled extracts. An extract labelled twice counts as good only if
    all its labels say so. Null ids, labels and strata: not part of the holdout.
    """
    labels = verdicts.select("extract_id", F.col("good").cast("boolean").alias("good")).dropna().groupBy("extract_id").agg(F.min("good").alias("good")).filter("good")
    held = (measured.filter(~F.col("base_failed") & F.col(stratum).isNotNull())
            .select("extract_id", F.col(stratum).alias("stratum"), *[_ratio(m).alias(r) for r, (m, _) in rules.items()])
            .join(labels, "extract_id", "left_semi"))
    lost = [F.count_if(F.coalesce(F.col(r) > float(c), F.lit(False))) for r, (_, cs) in rules.items() for c in cs]
    counts = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.array(*lost).alias("x"))
    counts = cut(counts)  # one row per stratum
    share = error / (max(1, counts.count()) * len(rules))
    each, out, at = risk / len(rules), [], 0
    for r, (_, cs) in rules.items():
        x = F.slice("x", at + 1, len(cs))
        ok = F.transform(x, lambda v: binomial_at_most(v, F.col("n"), each) <= F.lit(share))
        passed = F.coalesce(F.array_position(ok, False) - 1, F.lit(0))
        passed = F.when(F.array_contains(ok, False), passed).otherwise(F.lit(len(cs)))
        out.append(F.get(F.array(*[F.lit(float(c)) for c in cs]), (passed - 1).cast("int")).alias(f"max_{r}"))
        at += len(cs)
    return counts.select("stratum", *out)


def with_verdict(measured: DataFrame, cutoffs: DataFrame, stratum: str, rules: Mapping[str, tuple[str, Sequence[float]]] = RULES) -> DataFrame:
    """`measured` with `kept`: the base rules hold and no measure is above its stratum's cutoff.

    An extract without a stratum or with one that has no cutoffs is judged by the base rules alone.
    """
    over = F.lit(False)
    for r, (m, _) in rules.items():
        over = over | F.coalesce(_ratio(m) > F.col(f"max_{r}"), F.lit(False))
    own = cutoffs.withColumnRenamed("stratum", "_m_stratum")
    joined = measured.join(own, measured[stratum] == own["_m_stratum"], "left")
    # One comparison over both sides of the join: a conjunction would be split, and its measures evaluated again below.
    failed = F.greatest(F.col("base_failed").cast("int"), over.cast("int"))
    return joined.select(*measured.columns, (failed == 0).alias("kept"))


def judge_extracts(extracts: DataFrame, verdicts: DataFrame, stratum: str = "area", risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """(extract_id, stratum and measures, base_failed, kept) per row of `extracts` (extract_id, stratum, text).

    The project's map extracts (OpenStreetMap notes and descriptions by area) are the texts
    meant here. A text of under 50 words, or with more than half of its words in repeated
    3-word windows, fails the base rules; further rules use `risk_cutoffs`. Null and empty
    texts have no words and fail. Repeated rows are judged one by one. Other columns are
    ignored. Empty tables give empty results; without labels only the base rules apply.
    """
    measured = cut(with_measures(extracts.select("extract_id", stratum, "text")).drop("text"))
    return with_verdict(measured, risk_cutoffs(measured, verdicts, stratum, risk, error), stratum)
