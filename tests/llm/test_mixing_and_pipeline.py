"""Mixing rates and the document pipeline."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tilescape.llm import mixing
from tilescape.llm.queries import MIX, QUERIES, domain_labels, extracts

from .test_near_copies import plain_near
from .test_rules_and_tokens import plain_ids, plain_measures


def plain_rates(p, tokens, targets):
    """The same problem by plain steps of half the length in one process."""
    gram = (p * tokens[:, None]).T @ p
    r = np.ones(len(p))
    for _ in range(3000):
        r = np.maximum(0, r - 0.5 * p @ np.linalg.solve(gram, (r * tokens) @ p - targets))
    return r


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(6)
    words = {d: [f"{d}{i}" for i in range(40)] for d in ("road", "park")}
    rows, labels = [], []
    for i in range(1200):
        domain = "road" if i % 3 else "park"
        own = rng.choice(words[domain], 12).tolist() + rng.choice(["the", "of", "and", "in"], int(rng.integers(5, 60))).tolist()
        rng.shuffle(own)
        rows.append((i, " ".join(own)))
        if i % 2:
            labels.append((i, domain))
    rows += [(5000, None), (5001, ""), (None, "road1 road2"), (3, rows[3][1])]
    return (spark.createDataFrame([(*r, "clash") for r in rows], "extract_id long, text string, tokens string"),
            spark.createDataFrame(labels + [(None, "road"), (7, None), (9, "unknown")], "extract_id long, domain string"))


def test_rates_meet_targets(corpus):
    got = mixing.mix_extracts(*corpus, {"road": 0.5, "park": 0.5}).toPandas()
    assert len(got) == 1204
    p, tokens = np.stack(got.posterior), got.tokens.to_numpy(float)
    held = got[(got.extract_id < 1200) & (got.extract_id % 2 == 0)]  # not labelled
    right = (np.stack(held.posterior).argmax(1) == np.where(held.extract_id % 3, 0, 1)).mean()
    assert right > 0.98
    expected = (got.rate.to_numpy() * tokens) @ p
    total = (tokens @ p)[0]
    assert expected == pytest.approx([total, total], rel=1e-3)
    assert got.rate.min() >= 0
    assert got.rate.to_numpy() == pytest.approx(plain_rates(p, tokens, np.array([total, total])), abs=5e-3)
    assert (np.abs(got.copies - got.rate) < 1).all()
    assert got.copies.mean() == pytest.approx(got.rate.mean(), rel=0.05)
    assert (got[got.tokens == 0].extract_id.tolist()) and got[got.extract_id == 3].copies.nunique() == 1


def test_unreachable_targets_are_nonnegative(corpus):
    got = mixing.mix_extracts(*corpus, {"road": 1.0, "park": 0.0}).toPandas()
    assert got.rate.min() == 0 and np.isfinite(got.rate).all()
    got = mixing.mix_extracts(*corpus, {"road": 0.01, "park": 0.99}).toPandas()
    assert got.rate.max() == 4 and got.copies.max() <= 4


def test_mixing_without_labels_or_rows(spark, corpus):
    none = spark.createDataFrame([], "extract_id long, domain string")
    got = mixing.mix_extracts(corpus[0], none, {"road": 0.5, "park": 0.5}).toPandas()
    assert np.allclose(np.stack(got.posterior), 0.5) and np.allclose(got.rate, 1)
    assert mixing.mix_extracts(corpus[0].limit(0), corpus[1], {"road": 1, "park": 1}).count() == 0


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    extra = docs.limit(1).selectExpr("doc_id + 100000 as doc_id", "cast(null as string) as text", "lang", "source", "n_chars").unionByName(docs.limit(2)).select(columns)
    stage = dict(corpus_pipeline.STAGES)

    def rows(df):
        return [tuple(r) for r in df.collect()]

    given = docs.unionByName(extra)
    quality = corpus_pipeline.cut(stage["quality rules"](spark, given, sf))
    assert Counter(rows(quality)) == Counter(r for r in rows(given) if not plain_measures(r[1])[-1])  # too few labels for more

    from tilescape.llm.line_runs import drop_repeated_runs
    lines = corpus_pipeline.cut(stage["line dedup"](spark, quality, sf))
    want = {(r.extract_id, r.text): r.n_removed for r in drop_repeated_runs(quality.withColumnRenamed("doc_id", "extract_id")).collect()}
    assert {(r.doc_id, r.text) for r in lines.collect()} == {k for k, n in want.items() if not n or k[1].strip()}
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    near = corpus_pipeline.cut(stage["n-gram Jaccard join"](spark, lines, sf))
    pairs = [(r.doc_id, r.text) for r in lines.collect()]
    assert sorted(r.doc_id for r in near.collect()) == sorted({w[0] for w in plain_near(pairs, 0.8)})

    mixed = corpus_pipeline.cut(stage["mixing to target weights"](spark, near, sf))
    copies = {r.extract_id: r.copies for r in mixing.mix_extracts(near.withColumnRenamed("doc_id", "extract_id"), domain_labels(spark, sf), corpus_pipeline.MIX).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: n for k, n in copies.items() if n})
    assert all(x.columns == columns for x in (quality, lines, near, mixed))

    packed = stage["packing"](spark, mixed, sf).collect()
    want = Counter()
    for r in mixed.collect():
        ids = np.array(plain_ids(r.text, 0), "<u4")
        for at in range(0, len(ids), 1024):
            want[r.doc_id, at, zlib.crc32(ids[at:at + 1024].tobytes())] += 1
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in packed) == want


def test_pipeline_runs(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert extracts(spark, sf).columns == ["extract_id", "area", "source", "text"]


def test_empty_stages(spark, sf):
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def sharp(spark, share):
    """20,000 rows of two domains, of which the second has about the given share."""
    rng = np.random.default_rng(1)
    low = rng.beta(0.5, 30, 20_000) * 0.1
    second = np.where(rng.random(20_000) < share, 1 - low, low)
    p, tokens = np.stack([1 - second, second], 1), rng.integers(20, 2000, 20_000)
    return p, tokens.astype(float), spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(tokens, p)], "tokens long, posterior array<double>")


def test_fit_under_a_binding_bound_is_the_optimum(spark):
    for share in (0.001, 0.005, 0.01):
        p, tokens, rows = sharp(spark, share)
        targets = np.array([1.0, 0.05 / 0.95]) * (tokens @ p)[0]
        r = mixing.rates_of(p, mixing.fit_prices(rows, targets, 4.0), 4.0)
        slope = p @ ((r * tokens) @ p - targets) / tokens.sum()  # of the objective, by each rate
        assert r.max() == 4
        assert (slope[r < 4] > -1e-6).all() and (slope[r > 0] < 1e-6).all()


@pytest.fixture(scope="module")
def scarce(spark, tmp_path_factory):
    """A folder of documents of which one in a hundred is poor and one in ten toxic."""
    rng, rows = np.random.default_rng(3), []
    for i in range(2000):
        domain = "poor" if i % 100 == 7 else "toxic" if i % 10 == 3 else "good"
        rows.append((i, domain, " ".join([f"{domain}{k}" for k in rng.permutation(20)[:14]] + rng.choice(["the", "of", "and", "in"], 60).tolist())))
    folder = str(tmp_path_factory.mktemp("scarce"))
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, _, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(d == "good"), int(d == "toxic")) for i, d, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_scarce_domain_meets_its_target(spark, scarce):
    got = QUERIES["op6_mixing_rates"](spark, scarce).toPandas()
    p, tokens = got[[f"p_{d}" for d in MIX]].to_numpy(), got.tokens.to_numpy(float)
    share = np.array(list(MIX.values()))
    assert got.rate.max() > 4
    assert (got.rate.to_numpy() * tokens) @ p == pytest.approx(share / share[0] * (tokens @ p)[0], rel=1e-3)


def test_pipeline_mixes_poor_documents_to_their_target(spark, scarce):
    docs = spark.read.parquet(f"{scarce}/documents.parquet")
    n = Counter("poor" if r.doc_id % 100 == 7 else "toxic" if r.doc_id % 10 == 3 else "good" for r in corpus_pipeline.mix(spark, docs, scarce).collect())
    assert n["poor"] / n["good"] == pytest.approx(MIX["poor"] / MIX["good"], rel=0.15)
    assert n["toxic"] / n["good"] == pytest.approx(MIX["toxic"] / MIX["good"], rel=0.15)


@pytest.mark.parametrize("high", [0.0, 0.0002, 0.002])
def test_a_domain_out_of_reach_costs_the_others_nothing(spark, high):
    """Three domains, of which one is hardly found: the others meet their targets and the documents stay."""
    rng = np.random.default_rng(4)
    second = np.where(rng.random(20_000) < 0.12, 0.95, 0.03) * rng.uniform(0.8, 1, 20_000)
    third = rng.random(20_000) * high
    p, tokens = np.stack([1 - second - third, second, third], 1), rng.integers(20, 2000, 20_000)
    table = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(tokens, p)], "tokens long, posterior array<double>")
    targets = np.array([0.88, 0.06, 0.06]) * (tokens @ p[:, 0]) / 0.88
    assert mixing.within_reach(table, targets).tolist() == [True, True, False]
    prices = mixing.fit_prices(table, targets)
    rates = mixing.rates_of(p, prices, np.inf)
    assert prices[2] == 0 and (rates > 0).mean() >= 0.95 and rates.max() < 3
    assert np.allclose((rates * tokens) @ p[:, :2], targets[:2], rtol=1e-3)


def test_scarce_but_clear_domains_are_within_reach(spark):
    p, tokens, table = sharp(spark, 0.001)
    targets = np.array([0.95, 0.05]) * (tokens @ p[:, 0]) / 0.95
    assert mixing.within_reach(table, targets).all()
    rates = mixing.rates_of(p, mixing.fit_prices(table, targets), np.inf)
    assert np.allclose((rates * tokens) @ p, targets, rtol=1e-3)


def test_fits_end_without_an_exception(spark, monkeypatch):
    p, tokens, table = sharp(spark, 0.01)
    monkeypatch.setattr(mixing, "MOST_PASSES", 1)
    with pytest.warns(UserWarning):
        assert np.isfinite(mixing.fit_prices(table, np.array([0.9, 0.1]) * tokens.sum())).all()


def test_reached_shares(corpus):
    mixed = mixing.mix_extracts(*corpus, {"road": 0.6, "park": 0.4})
    got = {r.domain: r for r in mixing.reached_shares(mixed, {"road": 0.6, "park": 0.4}).collect()}
    assert all(r.in_reach and abs(r.reached - r.wanted) < 1e-3 * r.wanted for r in got.values())
