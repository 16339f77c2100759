"""Near copies, neighbours and notices against brute force."""

import random
import re

import numpy as np
import pytest

from tilescape.llm import notices, pivot_index, shingle_forest


# -- Near copies --------------------------------------------------------------

def windows(text):
    w = (text or "").lower()
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
    n = min(5, len(w))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def plain_near(rows, similarity):
    """Per row: (class's smallest id, class size, links), by comparing all pairs."""
    sets = [windows(t) for _, t in rows]
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    linked = lambda a, b: a == b or bool(a & b) and len(a & b) >= similarity * len(a | b) - 1e-9
    links = [[j for j in range(len(rows)) if j != i and linked(sets[i], sets[j])] for i in range(len(rows))]
    seen, out = {}, [None] * len(rows)
    for i in range(len(rows)):
        if i in seen:
            continue
        todo, members = [i], {i}
        while todo:
            for j in links[todo.pop()]:
                if j not in members:
                    members.add(j)
                    todo.append(j)
        least = min(members, key=order)
        for j in members:
            seen[j] = True
            out[j] = (rows[least][0], len(members), len(links[j]))
    return out


def edited(rng, words, times):
    w = list(words)
    for _ in range(times):
        w[rng.randrange(len(w))] = rng.choice("abcdefghijklmnop") * 3
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    bases = [[word() for _ in range(n)] for n in (120, 90, 60, 200, 30)]
    rows = [(i, edited(rng, rng.choice(bases), rng.randrange(4))) for i in range(140)]
    rows += [(200, "same text here"), (201, "Same  TEXT\nhere"), (202, None), (203, ""), (204, " "), (205, "one"), (205, "one"), (None, "one"), (206, " ".join(word() for _ in range(30000)))]
    passage = " ".join(word() for _ in range(25))
    return rows + [(300 + i, passage + " " + " ".join(word() for _ in range(15))) for i in range(40)]


@pytest.mark.parametrize("block", [512, 16])
def test_near_extracts(spark, texts, block, monkeypatch):
    monkeypatch.setattr(shingle_forest, "BLOCK", block)
    df = spark.createDataFrame([(k, t, "clash") for k, t in texts], "extract_id long, text string, block string")
    got = shingle_forest.near_extracts(df).collect()
    want = sorted(((k, *w) for (k, _), w in zip(texts, plain_near(texts, 0.8))), key=repr)
    assert sorted(((r.extract_id, r.class_id, r.class_size, r.n_links) for r in got), key=repr) == want
    kept = shingle_forest.drop_near_extracts(df)
    assert kept.columns == df.columns
    assert sorted(r.extract_id for r in kept.collect()) == sorted({w[1] for w in want})


def test_forest_depth():
    assert shingle_forest.forest_depth(0.8, 0.999999) == 3
    assert shingle_forest.forest_depth(0.95, 0.999999) > 3


def test_no_near_extracts(spark):
    assert shingle_forest.near_extracts(spark.createDataFrame([], "extract_id long, text string")).count() == 0


# -- Neighbours ---------------------------------------------------------------

def test_nearest_vectors_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[100:160] = x[7]  # ties
    rows = [(i, [float(v) for v in r], "clash") for i, r in enumerate(x)]
    odd = [(5000, None, "c"), (5001, [0.0] * 24, "c"), (5002, [1.0] * 23 + [None], "c"), (5003, [float("nan")] + [1.0] * 23, "c"), (5004, [1.0, 2.0], "c"),
           (5005, [float("inf")] + [1.0] * 23, "c"), (None, [1.0] * 24, "c"), (5, rows[5][1], "c")]
    df = spark.createDataFrame(rows + odd, "vector_id long, vector array<double>, score string")
    got = {}
    for r in pivot_index.nearest_vectors(df, df.filter("vector_id % 20 = 0 or vector_id > 4999"), 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vector_id, r.score))
    assert set(got) == set(range(0, 3000, 20))
    hits, big = 0, x.astype(np.float64)
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        s = big @ big[q]
        assert all(f[2] == pytest.approx(s[f[1]], abs=1e-12) for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(3000), -s))[:20]) & {f[1] for f in found})
    assert hits / (20 * len(got)) >= 0.9


def test_few_vectors(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vector_id long, vector array<double>")
    got = [(r.query_id, r["rank"], r.vector_id) for r in pivot_index.nearest_vectors(df, df.filter("vector_id = 0"), 20).collect()]
    assert sorted(got) == [(0, k + 1, k + 1) for k in range(4)]
    assert pivot_index.nearest_vectors(df.limit(0), df, 20).count() == 0
    assert pivot_index.nearest_vectors(df, df.limit(0), 20).count() == 0


# -- Notices ------------------------------------------------------------------

def plain_notices(text, templates, containment=0.8):
    """Names of templates of which some region of at most 1.25 times their length holds the share."""
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    grams, out = [tuple(w[i:i + 5]) for i in range(len(w) - 4)], set()
    for name, t in templates:
        tw = [x for x in re.split(r"[\W_]+", t.lower()) if x]
        wanted = {tuple(tw[i:i + 5]) for i in range(len(tw) - 4)}
        reach = int(np.ceil(1.25 * len(wanted)))
        if any(len(wanted & set(grams[i:i + reach])) >= containment * len(wanted) - 1e-9 for i in range(len(grams))):
            out.add(name)
    return out


def test_notices(spark):
    rng = random.Random(2)
    templates = [(n, t) for n, texts in notices.NOTICES.items() for t in texts]
    rows = [None, "", "four words are here", "Released under the MIT License", "x " * 9 + "RELEASED under, the MIT-License!"]
    for i in range(150):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.choice((0, 3, 40, 700)))]
        for _ in range(rng.randrange(3)):
            t = rng.choice(templates)[1].split()
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = "zz"
            at = rng.randrange(len(words) + 1)
            words[at:at] = t
        rows.append(" ".join(words))
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(rows)] + [(3, rows[3], "c"), (None, rows[3], "c")], "extract_id long, text string, notice string")
    got = notices.find_notices(df, spark.createDataFrame(templates, "notice string, text string")).collect()
    found = {}
    for r in got:
        found.setdefault(r.extract_id, set()).add(r.notice)
        if r.extract_id is not None:
            part = [x for x in re.split(r"[\W_]+", (rows[r.extract_id]).lower()) if x][r.first_word:r.last_word + 1]
            assert plain_notices(" ".join(part), [t for t in templates if t[0] == r.notice]) and 0.8 <= r.containment <= 1
    for i, t in enumerate(rows):
        assert found.get(i, set()) == plain_notices(t, templates), t
    assert found[None] == {"MIT"} and sum(r.extract_id == 3 for r in got) == 2


def test_notice_bounds(spark):
    for n in range(1, 400):
        assert notices.collision_chance(n, 0.8) > 0.9999
    none = spark.createDataFrame([], "notice string, text string")
    df = spark.createDataFrame([(1, "Released under the MIT License")], "extract_id long, text string")
    assert notices.find_notices(df, none).count() == 0
    assert notices.find_notices(df.limit(0), spark.createDataFrame([("MIT", "Released under the MIT License")], "notice string, text string")).count() == 0
    with pytest.raises(ValueError):
        notices.find_notices(df, spark.createDataFrame([("a", "too short")], "notice string, text string"))
