"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from ._common import cut

# Words that address the reader, in the languages of the texts.
SECOND_PERSON = {
    "you", "your", "yours", "yourself", "u", "ur",
    "du", "dich", "dir", "dein", "deine", "ihr", "euch", "euer",
    "tu", "tú", "te", "ti", "usted", "ustedes", "vosotros",
    "toi", "ton", "ta", "tes", "vous", "votre", "vos",
}
# Characters that stand for letters in disguised words.
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}

#: Letters of a word stem: terms of the lexicon are whole words and their first letters.
STEMS = range(3, 9)
#: A term is learnt from this many toxic texts at least, and if it is this many times as frequent in them with a chance of about 0.975.
LEAST_TEXTS, LEAST_RATIO, SURE = 3, 4.0, 1.96
#: Words between a term and a word that addresses the reader.
NEAR = 5
#: Terms whose weight (the sure log ratio) is at least this are counted apart.
STRONG = 2.5
#: Terms a task counts before it passes the counts on, and words whose features it holds at once.
FLUSH, WORDS_AT_ONCE = 200_000, 100_000

FEATURES = ("terms", "strong_terms", "weight", "top_weight", "n_strong", "n_distinct", "second_person", "near_second_person",
            "capital_words", "capital_letters", "exclamations", "punctuation", "disguised", "disguised_terms", "n_words")

_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_OTHER = re.compile(r"[\W\d_]+")
_TABLE = str.maketrans(DISGUISES)


def plain_forms(token: str) -> tuple[str, str]:
    """(the word without what surrounds its letters, the word with disguised letters put back)."""
    low = token.lower()
    if low.isalpha():
        return low, low
    word = _EDGES.sub("", low)
    if word.isalpha():
        return word, word
    return word, _OTHER.sub("", _EDGES.sub("", low.translate(_TABLE))) if word else ""


def terms_of(word: str) -> Iterator[str]:
    """Whole word (marked by `=`) and stems."""
    if len(word) > 2:
        yield "=" + word
        for k in STEMS:
            if len(word) > k:
                yield word[:k]


class _Tokens(dict):
    """token -> row of `rows`: what the features need of it. One per call of `feature_rows`, so it stays bounded."""

    def __init__(self, lexicon: Mapping[str, float]):
        super().__init__()
        self.lexicon, self.rows = lexicon, []
        self.heads = {t.removeprefix("=")[:STEMS[0]] for t in lexicon}

    def weight(self, word: str) -> float:
        """The greatest weight of the word's terms. Most words begin like no term."""
        if word[:STEMS[0]] not in self.heads:
            return 0.0
        return max((self.lexicon[t] for t in terms_of(word) if t in self.lexicon), default=0.0)

    def __missing__(self, token: str) -> int:
        if token.isalpha() and token.islower():
            row = (self.weight(token), token in SECOND_PERSON, False, 0, 0, 0, False, False, len(token))
        else:
            word, meant = plain_forms(token)
            weight = self.weight(word)
            hidden = self.weight(meant) if meant != word else 0.0
            capitals, letters = len(token), len(token)
            if not (token.isalpha() and token.isupper()):
                capitals, letters = sum(map(str.isupper, token)), sum(map(str.isalpha, token))
            marks = token.count("!") + token.count("?")
            row = (max(weight, hidden), word in SECOND_PERSON, capitals > 1 and capitals == letters, capitals, marks,
                   len(token) - letters - marks, meant != word, hidden > weight, len(token))
        self.rows.append(row)
        self[token] = len(self.rows) - 1
        return self[token]


def feature_rows(texts: list[str], lexicon: Mapping[str, float]) -> np.ndarray:
    """One row of FEATURES per text; those but the last five of each kind are per 100 words, counts are logarithms."""
    known = _Tokens(lexicon)
    ids = [np.fromiter(map(known.__getitem__, t.split()), dtype=np.int64) for t in texts]
    sizes = np.array([len(i) for i in ids], dtype=np.int64)
    if not sizes.sum():
        return np.zeros((len(texts), len(FEATURES)))
    flat, owner = np.concatenate(ids), np.repeat(np.arange(len(texts)), sizes)
    weight, second, capital, capitals, marks, other, disguised, hidden, chars = np.array(known.rows, dtype=float)[flat].T
    total = lambda v: np.bincount(owner, v, len(texts))
    hit, strong = weight > 0, weight >= STRONG
    # Distance to the nearest addressing word of the same text, on both sides.
    at = np.arange(len(flat))
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    back = np.maximum.accumulate(np.where(second > 0, at, -1))
    ahead = np.minimum.accumulate(np.where(second > 0, at, len(flat) + NEAR + 1)[::-1])[::-1]
    near = hit & (((back >= first) & (at - back <= NEAR)) | ((ahead < first + np.repeat(sizes, sizes)) & (ahead - at <= NEAR)))
    top = np.zeros(len(texts))
    np.maximum.at(top, owner, weight)
    distinct = np.unique(np.stack([owner[hit], flat[hit]]), axis=1)[0]
    rate, n_chars = 100.0 / np.maximum(sizes, 1), np.maximum(total(chars), 1)
    return np.stack([total(hit) * rate, total(strong) * rate, total(weight) * rate, top, np.log1p(total(strong)), np.log1p(np.bincount(distinct, minlength=len(texts))),
                     total(second) * rate, total(near) * rate, total(capital) * rate, total(capitals) / n_chars, total(marks) * rate, total(other) * rate,
                     total(disguised) * rate, total(hidden) * rate, np.log1p(sizes)], axis=1)


def features(text: Column, lexicon: Mapping[str, float]) -> Column:
    """FEATURES of a text column as an array, from the whole text; null counts as empty."""

    @F.pandas_udf("array<double>")
    def rows(texts: pd.Series) -> pd.Series:
        out, held, words = [], [], 0
        for text in texts:
            held.append(text)
            words += text.count(" ") + 1
            if words >= WORDS_AT_ONCE:
                out += feature_rows(held, lexicon).tolist()
                held, words = [], 0
        return pd.Series(out + feature_rows(held, lexicon).tolist() if held else out, dtype=object)

    return rows(F.coalesce(text.cast("string"), F.lit("")))


def count_terms(samples: DataFrame) -> DataFrame:
    """(term, toxic0, clean0, toxic1, clean1): texts of `samples` (text, toxic, half) that hold a term, by label and half. Counted in tasks before the shuffle."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, list[int]] = {}

        def table() -> pd.DataFrame:
            out = pd.DataFrame(list(counts.values()), columns=["toxic0", "clean0", "toxic1", "clean1"], dtype="int64")
            out.insert(0, "term", list(counts))
            return out

        for batch in batches:
            for text, toxic, half in zip(batch["text"], batch["toxic"], batch["half"]):
                slot = 2 * half + 1 - toxic
                words = {w for t in set(text.split()) for w in plain_forms(t)}
                for term in {x for w in words for x in terms_of(w)}:
                    if term not in counts:
                        counts[term] = [0, 0, 0, 0]
                    counts[term][slot] += 1
                if len(counts) > FLUSH:
                    yield table()
                    counts.clear()
        if counts:
            yield table()

    columns = ["toxic0", "clean0", "toxic1", "clean1"]
    parts = samples.select(F.coalesce("text", F.lit("")).alias("text"), "toxic", "half").mapInPandas(counted, "term string, toxic0 long, clean0 long, toxic1 long, clean1 long")
    return parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in columns])


def choose_lexicon(counts: DataFrame, toxic: Column, clean: Column, n_toxic: int, n_clean: int, most: int = 2000) -> dict[str, float]:
    """term -> weight: the lower bound of the log ratio of its shares of toxic and clean texts. The `most` heaviest terms, ties by name."""
    share = lambda n, of: F.log((n + 0.5) / (of + 1.0))
    sure = share(toxic, n_toxic) - share(clean, n_clean) - SURE * F.sqrt(1.0 / (toxic + 0.5) + 1.0 / (clean + 0.5))
    rows = counts.filter(toxic >= LEAST_TEXTS).select("term", sure.alias("weight")).filter(F.col("weight") > math.log(LEAST_RATIO))
    return {r["term"]: r["weight"] for r in rows.orderBy(F.desc("weight"), "term").limit(most).collect()}


def score_extracts(extracts: DataFrame, verdicts: DataFrame, most_labels: int = 20_000, most_terms: int = 2000, seed: int = 7) -> DataFrame:
    """(extract_id, score) per row of `extracts` (extract_id, text): the calibrated chance, 0 to 1, that a text is toxic.

    The texts meant are those of map elements (`sources.element_texts`): names, notes and
    descriptions that anyone can edit. `verdicts` (extract_id, toxic) labels some of them;
    only these are learnt from. A text's score depends on the text alone.

    1. Words and stems that are sure to be more frequent in toxic texts make a lexicon of at
       most `most_terms` weighted terms, counted over the labelled texts.
    2. Each text becomes the dense FEATURES: term densities, terms close to a word that
       addresses the reader, capitals, punctuation, disguised words.
    3. Trees are fitted on labelled texts whose terms were learnt from the other half of the
       labels. Isotonic regression maps margins to chances; its margins come from trees and
       terms of the other half too, so no text calibrates a model that has seen it.

    At most about `most_labels` labelled texts, by a hash of their ids, are learnt from; every
    row is scored. An extract labelled twice is toxic if any of its labels says so; null ids
    and labels teach nothing. Null and empty texts are scored as texts without words,
    repeated rows alike, other columns are ignored. With labels of one kind only every score
    is that kind (0 or 1), without labels 0. An empty table gives an empty result.
    """
    spark = extracts.sparkSession
    known = (verdicts.select("extract_id", F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("extract_id").agg(F.max("toxic").alias("toxic")))
    texts = extracts.select("extract_id", "text").filter("extract_id is not null")
    total = max(1, known.count())
    mixed = F.xxhash64(F.lit(seed), "extract_id")
    share = F.lit(min(1.0, most_labels / total) * 2.0 ** 63)
    taught = known.filter(F.abs(mixed.cast("double")) < share).withColumn("half", F.pmod(F.shiftright(mixed, 7), F.lit(2)).cast("int"))
    samples = cut(texts.join(F.broadcast(taught), "extract_id"))
    sizes = {(r["half"], r["toxic"]): r["n"] for r in samples.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = (sum(n for (_, t), n in sizes.items() if t == kind) for kind in (1, 0))
    if not n_toxic or not n_clean:
        return extracts.select("extract_id", F.lit(1.0 if n_toxic else 0.0).alias("score"))

    counts = cut(count_terms(samples))
    halves = [choose_lexicon(counts, F.col(f"toxic{h}"), F.col(f"clean{h}"), sizes.get((h, 1), 0), sizes.get((h, 0), 0), most_terms) for h in (0, 1)]
    lexicon = choose_lexicon(counts, F.col("toxic0") + F.col("toxic1"), F.col("clean0") + F.col("clean1"), n_toxic, n_clean, most_terms)
    learnt = [samples.filter(F.col("half") == h).select("extract_id", "half", F.col("toxic").cast("double").alias("toxic"), features(F.col("text"), halves[1 - h]).alias("x")) for h in (0, 1)]
    learnt = cut(learnt[0].unionByName(learnt[1])).withColumn("x", array_to_vector("x")).orderBy("extract_id").coalesce(4)

    trees = GBTClassifier(featuresCol="x", labelCol="toxic", maxIter=20, maxDepth=3, maxBins=64, stepSize=0.3, minInstancesPerNode=3, seed=seed)
    margin = vector_to_array("rawPrediction")[1].alias("margin")
    apart = []
    for h in (0, 1):
        own, other = learnt.filter(F.col("half") == h), learnt.filter(F.col("half") != h)
        if (h, 0) in sizes and (h, 1) in sizes:  # a half with one kind of label fits nothing
            apart.append(trees.fit(own).transform(other).select("toxic", margin))
    model = trees.fit(learnt)
    if not apart:
        apart = [model.transform(learnt).select("toxic", margin)]
    judged = cut(apart[0] if len(apart) == 1 else apart[0].unionByName(apart[1]))
    chance = IsotonicRegression(featuresCol="margin", labelCol="toxic", predictionCol="score").fit(judged)
    every = extracts.select("extract_id", array_to_vector(features(F.col("text"), lexicon)).alias("x"))
    scored = chance.transform(model.transform(every).select("extract_id", margin))
    return scored.select("extract_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))
