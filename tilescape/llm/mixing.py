"""Document rates that bring expected domain token totals to their targets."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ._common import cut

SPACE = r"[\x20\x09-\x0D]+"
BUCKETS = 1 << 14
#: Standard deviations by which a domain's count of a bucket must differ from chance to have a weight.
CLEAR = 4.0
#: Labelled texts that the classifier is fitted on (about; at most twice as many, should hashes be uneven).
LABELLED_ROWS = 60_000
#: Weight of the rates' squared distance from 1 beside the squared miss of the targets.
SOFT = 1e-8
#: Gradient of the dual, in shares of all tokens, that counts as zero.
CONVERGED = 1e-11
#: Lengths 1, 1/2, 1/4, ... of a Newton step that one pass evaluates.
STEP_LENGTHS = 24
#: Passes after which a fit stops with the best prices it has (random cases took 2 to 97).
MOST_PASSES = 200
#: A domain is out of reach if raising it to its target would bring in tokens of other domains of over this share of all tokens.
OUT_OF_REACH = 0.25


def _features(text: str) -> Column:
    """Buckets of the distinct words (lower case) and of the distinct runs of other signs."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_distinct(F.split(F.lower(body), SPACE))
    signs = F.transform(F.array_distinct(F.split(body, r"[\p{L}\p{N}\s]+")), lambda s: F.concat(F.lit("\u0001"), s))
    return F.array_distinct(F.transform(F.concat(words, signs), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))


def _count(domains: Sequence[str]):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((len(domains), BUCKETS + 1), np.int64)
        for batch in batches:
            for domain, buckets in zip(batch["domain"], batch["buckets"]):
                row = seen[domains.index(domain)]
                row[buckets] += 1
                row[BUCKETS] += 1
        d, b = np.nonzero(seen)
        yield pd.DataFrame({"d": d, "bucket": b, "n": seen[d, b]})
    return count


class Classifier:
    """Naive Bayes scores over hashed words, turned into posteriors by a calibrated softmax."""

    def __init__(self, domains: Sequence[str], counts: np.ndarray):
        self.domains = list(domains)
        docs = counts[:, BUCKETS:].astype(float)
        chance = (counts[:, :BUCKETS] + 0.5) / (docs + 1.0)
        everywhere = (counts[:, :BUCKETS].sum(0) + 0.5) / (docs.sum() + 1.0)
        spread = np.sqrt(np.maximum(docs * everywhere * (1 - everywhere), 1e-9))
        clear = np.abs(counts[:, :BUCKETS] - docs * everywhere) >= CLEAR * spread
        self.weights = np.where(clear, np.log(chance) - np.log(everywhere), 0.0).astype(np.float32)
        self.slopes = np.eye(len(domains), len(domains) + 1)
        self.slopes[:, -1] = np.log((docs[:, 0] + 0.5) / (docs.sum() + 1.0))

    def scores(self, texts: Sequence[np.ndarray]) -> np.ndarray:
        """(texts, domains + 1) sums of weights, shortened like a logarithm, and a constant."""
        total = np.array([self.weights[:, b].sum(1) for b in texts]).reshape(len(texts), len(self.domains))
        return np.column_stack([np.sign(total) * np.log1p(np.abs(total)), np.ones(len(texts))])

    def posteriors(self, scores: np.ndarray) -> np.ndarray:
        z = scores @ self.slopes.T
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def calibrate(self, scores: np.ndarray, labels: np.ndarray, rounds: int = 500, rate: float = 0.3, ridge: float = 1e-4) -> None:
        """Multinomial logistic regression of the labels on the scores, by gradient steps with momentum."""
        truth, move = np.eye(len(self.domains))[labels], np.zeros_like(self.slopes)
        for _ in range(rounds):
            slope = (self.posteriors(scores) - truth).T @ scores / len(scores) + ridge * self.slopes
            move = 0.9 * move - rate * slope
            self.slopes = self.slopes + move


def train(extracts: DataFrame, labels: DataFrame, domains: Sequence[str]) -> Classifier:
    """A classifier fitted on about LABELLED_ROWS labelled extracts: words are counted over one half, and the other calibrates.

    `labels` (extract_id, domain); domains not listed are left out. Extracts and halves are
    chosen by the hash of the id. The chosen ids are few (at most twice LABELLED_ROWS), so
    they are broadcast and no text moves for them.
    """
    known = labels.select("extract_id", "domain").filter(F.col("domain").isin(*domains) & F.col("extract_id").isNotNull()).groupBy("extract_id").agg(F.max("domain").alias("domain"))
    share = min(1.0, LABELLED_ROWS / max(1, known.count()))
    place = F.pmod(F.xxhash64("extract_id", F.lit(1)), F.lit(1 << 30))
    some = known.filter(place < int(share * (1 << 30))).limit(2 * LABELLED_ROWS)
    half = F.pmod(F.xxhash64("extract_id"), F.lit(2)) == 0
    labelled = cut(extracts.select("extract_id", "buckets").join(F.broadcast(some), "extract_id"))
    counts = np.zeros((len(domains), BUCKETS + 1), np.int64)
    parts = labelled.filter(half).select("domain", "buckets").mapInPandas(_count(list(domains)), "d int, bucket int, n long")
    for r in parts.groupBy("d", "bucket").agg(F.sum("n").alias("n")).collect():  # at most domains * BUCKETS rows
        counts[r["d"], r["bucket"]] = r["n"]
    model = Classifier(domains, counts)
    scored = (labelled.filter(~half).select("domain", "buckets").mapInPandas(_scored(model), "domain string, scores array<double>")
              .limit(2 * LABELLED_ROWS).collect())
    if scored:
        model.calibrate(np.array([r["scores"] for r in scored]), np.array([list(domains).index(r["domain"]) for r in scored]))
    return model


def _scored(model: Classifier):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"domain": batch["domain"], "scores": list(model.scores(batch["buckets"].tolist()))})
    return run


def _posteriors(model: Classifier):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = model.posteriors(model.scores(batch["buckets"].tolist()))
            yield batch.drop(columns="buckets").assign(posterior=list(p))
    return run


def rates_of(p: np.ndarray, prices: np.ndarray, max_rate: float) -> np.ndarray:
    """Rates under the prices of the domains: 1 less the expected price, kept in 0..max_rate."""
    return np.clip(1.0 - p @ prices, 0.0, max_rate)


def _sums(tried: np.ndarray, max_rate: float):
    """Per tried prices: the domain totals, and minus their slopes by the prices."""
    n = tried.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(tried), n + n * n))
        for batch in batches:
            if len(batch):
                p, tokens = np.stack(batch["posterior"]), batch["tokens"].to_numpy(float)
                for row, prices in zip(sums, tried):
                    r = rates_of(p, prices, max_rate)
                    free = (r > 0) & (r < max_rate)
                    row[:n] += (r * tokens) @ p
                    row[n:] += ((p * (tokens * free)[:, None]).T @ p).ravel()
        yield pd.DataFrame({"at": np.arange(sums.size), "total": sums.ravel()})
    return run


def within_reach(posteriors: DataFrame, targets: np.ndarray) -> np.ndarray:
    """Which domains can be brought to their targets by documents that are theirs.

    Raising a domain by some tokens takes documents whose mean posterior, weighted by their
    share of the domain, is its purity; the rest of their tokens belong to others. Where that
    rest would be more than OUT_OF_REACH of all tokens (of the targets' sum, if that is more),
    no reasonable rates reach the target: following it would empty the other domains.
    """
    n = len(targets)
    p = lambda i: F.get("posterior", F.lit(i))
    sums = posteriors.agg(F.sum("tokens").alias("all"), *[F.sum(F.col("tokens") * p(i)).alias(f"m{i}") for i in range(n)], *[F.sum(F.col("tokens") * p(i) * p(i)).alias(f"s{i}") for i in range(n)]).first()
    have, square = (np.array([float(sums[f"{c}{i}"] or 0) for i in range(n)]) for c in "ms")
    purity = np.divide(square, have, out=np.zeros(n), where=have > 0)
    missing = np.maximum(targets - have, 0)
    brought = np.divide(missing * (1 - purity), purity, out=np.where(missing > 0, np.inf, 0.0), where=purity > 0)
    return brought <= OUT_OF_REACH * max(float(sums["all"] or 0), float(np.sum(targets)))


def fit_prices(posteriors: DataFrame, targets: np.ndarray, max_rate: float = np.inf) -> np.ndarray:
    """Prices whose rates minimise |sum_i rate_i tokens_i p_i - targets|^2 over rates of 0..max_rate and the domains within reach.

    `posteriors` (tokens, posterior). Of all such rates these are the nearest to 1, weighted
    by tokens (the distance counts SOFT, in shares of all tokens). A domain out of reach
    (`within_reach`) has the price 0: the others meet their targets as if it had none. The dual problem has one
    unknown per domain and is smooth and strictly concave, so Newton steps with a line search
    find its one maximum. A pass evaluates all lengths of a step at once and moves
    n^2 + n totals per length and task; the length with the least slope along the step is
    taken, which cannot lower a concave dual when lengths are halves of each other. It ends
    when the dual's gradient is nothing but rounding, or after MOST_PASSES with a warning and
    the prices of the least gradient.
    """
    everything, targets = float(posteriors.agg(F.sum("tokens")).first()[0] or 0), np.asarray(targets, float)
    prices = np.zeros(len(targets))
    if not everything:
        return prices
    fitted = np.flatnonzero(within_reach(posteriors, targets))
    if len(fitted):
        some = posteriors.select("tokens", F.array(*[F.get("posterior", F.lit(int(i))) for i in fitted]).alias("posterior"))
        prices[fitted] = _newton(some, targets[fitted] / everything, everything, max_rate)
    return prices


def _newton(posteriors: DataFrame, targets: np.ndarray, everything: float, max_rate: float) -> np.ndarray:
    n = len(targets)
    prices, step, lengths = np.zeros(n), np.zeros(n), np.array([1.0])
    least, answer = np.inf, prices
    for _ in range(MOST_PASSES):
        tried = prices + lengths[:, None] * step
        rows = posteriors.select("tokens", "posterior").mapInPandas(_sums(tried, max_rate), "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()
        sums = np.zeros(len(tried) * (n + n * n))
        for r in rows:
            sums[r["at"]] = r["total"] / everything
        sums = sums.reshape(len(tried), -1)
        gradients = sums[:, :n] - targets - SOFT * tried
        best = int(np.argmin(np.abs(gradients @ step)))
        prices, gradient = tried[best], gradients[best]
        slack = np.abs(gradient).max()
        if slack < least:
            least, answer = slack, prices
        if slack <= CONVERGED + 1e-15 * np.abs(prices).max():
            return answer
        step = np.linalg.solve(sums[best, n:].reshape(n, n) + SOFT * np.eye(n), gradient)
        lengths = 0.5 ** np.arange(STEP_LENGTHS)
    warnings.warn(f"mixing rates have not converged: {least:.2g} of all tokens off after {MOST_PASSES} passes")
    return answer


def reached_shares(mixed: DataFrame, targets: Mapping[str, float], total: float | None = None) -> DataFrame:
    """(domain, wanted, reached, in_reach) of the rows of `mix_extracts`: expected tokens by the fitted rates beside the targets."""
    domains = list(targets)
    p = lambda i: F.get("posterior", F.lit(i))
    row = mixed.agg(F.sum(F.col("tokens") * p(0)).alias("first"), *[F.sum(F.col("rate") * F.col("tokens") * p(i)).alias(f"r{i}") for i in range(len(domains))]).first()
    wanted = _wanted(targets, total, row["first"])
    near = within_reach(mixed, wanted)
    rows = [(d, float(w), float(row[f"r{i}"] or 0), bool(k)) for i, (d, w, k) in enumerate(zip(domains, wanted, near))]
    return mixed.sparkSession.createDataFrame(rows, "domain string, wanted double, reached double, in_reach boolean")


def _wanted(targets: Mapping[str, float], total: float | None, first: float | None) -> np.ndarray:
    """Tokens per domain; without a total the first domain is to keep the tokens it has."""
    share = np.array(list(targets.values()), float) / sum(targets.values())
    return share * ((first or 0.0) / share[0] if total is None else total)


def mix_extracts(extracts: DataFrame, labels: DataFrame, targets: Mapping[str, float], total: float | None = None,
                 max_rate: float = 4.0) -> DataFrame:
    """(extract_id, tokens, posterior, rate, copies, _hash) per row of `extracts` (extract_id, text).

    The texts meant are the project's map extracts; `labels` (extract_id, domain) assigns some
    of them to the domains of `targets` (domain -> share of tokens). A classifier trained on
    them gives every text its posterior over the domains (in the order of `targets`). Rates
    are non-negative and fitted by distributed least squares, so that the expected tokens of
    each domain, sum of rate * tokens * posterior, meet its share of `total`, and of such
    rates the nearest to 1. Without a `total` it is set so that the first domain keeps what it has. No text
    is taken more than `max_rate` times on average: a scarce domain then stays below its
    share instead of being repeated without end. Tokens
    are words between white space. `copies` is the rate rounded up or down by a hash of id and
    text, so that its mean is the rate; copies of equal rows are equal.

    Null and empty texts have no tokens and keep their posterior; their rate follows from it.
    A domain without labels, or hardly found in the texts, has small posteriors everywhere. If
    its target is out of reach (`within_reach`) it is left out of the fit, so that it does not cost the
    other domains their documents; `reached_shares` tells. Without any labels all posteriors are equal and the rates are 1 where
    total is not given. Repeated rows and ids stay, a null id is never labelled. Other columns
    are ignored. An empty table gives an empty result.
    """
    domains = list(targets)
    texts = cut(extracts.select(F.col("extract_id").cast("long").alias("extract_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"),
                                F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACE), "")).cast("long").alias("tokens"), _features("text").alias("buckets")))
    model = train(texts, labels, domains)
    scored = cut(texts.mapInPandas(_posteriors(model), "extract_id long, _hash long, tokens long, posterior array<double>"))
    first = scored.agg(F.sum(F.col("tokens") * F.get("posterior", F.lit(0)))).first()[0] if total is None else None
    prices = fit_prices(scored, _wanted(targets, total, first), max_rate)

    def rated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = np.stack(batch["posterior"]) if len(batch) else np.zeros((0, len(domains)))
            yield batch.assign(rate=rates_of(p, prices, max_rate))

    out = scored.mapInPandas(rated, "extract_id long, _hash long, tokens long, posterior array<double>, rate double")
    even = F.pmod(F.xxhash64("extract_id", "_hash", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    return out.withColumn("copies", F.floor(F.col("rate") + even).cast("int"))
