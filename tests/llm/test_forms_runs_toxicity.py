"""Fill-in-the-middle forms, periodic runs and toxicity scores on texts of map elements."""

import hashlib
import json
import random
import re
import zlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tilescape import sources
from tilescape.llm import fill_middle, periodic_runs, toxicity
from tilescape.llm.queries import QUERIES, with_planted_runs

CLASH = "extract_id long, text string, form string, runs string, score string, n_words string, _w int, half int, x int"


def elements_of(spark, notes):
    """Map elements with these notes, read from an extract document."""
    rows = [{"type": "node", "id": i, "lon": -122.4, "lat": 37.8, "tags": {"note": t, "highway": "crossing"} if t is not None else {}} for i, t in enumerate(notes)]
    doc = spark.createDataFrame([("/osm.json", json.dumps({"elements": rows}))], "path string, value string")
    return sources.element_texts(sources.element_rows(doc))


def rows_of(spark, texts):
    """Rows with null ids, repeated rows and columns whose names clash."""
    return spark.createDataFrame([(None if i == 1 else i // 2, t, "f", "r", "s", "n", 1, 2, 3) for i, t in enumerate(texts)], CLASH)


# -- Fill in the middle -------------------------------------------------------

FORMS = [None, "", "\n", "a", "a\nb", "a\n\nb\n", "x<P>y", "<M>", "ä\U0001F600\n日本\n", "<\nS>\n<\nP>", "\r\n\r", "line\n" * 5000, "y" * 200_000, "\n".join(str(i) for i in range(777))]


def plain_form(key, text, rate=100, spm=50):
    lines, h = re.findall(r"[^\n]*\n|[^\n]+", text), hashlib.sha256(f"7:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(lines), "plain", None, None, text
    low, high = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    pre, mid, suf = ("".join(p) for p in (lines[:low], lines[low:high], lines[high:]))
    if h4 % 100 < spm:
        return len(lines), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(lines), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("rate, spm", [(100, 50), (60, 0), (0, 50), (100, 100)])
def test_fill_middle(spark, rate, spm):
    texts = [*FORMS, *FORMS, "again", "again"]
    got = fill_middle.restore_texts(fill_middle.fill_middle(rows_of(spark, texts), rate=rate, spm_rate=spm)).collect()
    want = [((None if i == 1 else i // 2), *plain_form("null" if i == 1 else i // 2, t or "", rate, spm), t or "") for i, t in enumerate(texts)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_fill_middle_of_elements(spark):
    notes = ["first\nsecond\nthird\n", None, "", "one line", "no <P> here\n"]
    got = fill_middle.restore_texts(fill_middle.fill_middle(elements_of(spark, notes))).collect()
    assert {(r.extract_id >> 2, r.text) for r in got} == {(0, notes[0]), (3, notes[3]), (4, notes[4])}
    assert [r.form for r in got if r.extract_id >> 2 == 4] == ["plain"]
    assert fill_middle.fill_middle(rows_of(spark, ["a"]).limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=400))
def test_line_index_reaches_every_rank(widths):
    index = fill_middle.LineIndex(widths)
    assert [index.chars_before(r) for r in range(len(widths) + 1)] == [sum(widths[:r]) for r in range(len(widths) + 1)]


def test_line_index_has_express_lanes():
    index = fill_middle.LineIndex([3] * 100_000)
    assert 6 <= len(index.lanes) <= 12
    assert all(sum(units) <= 100_000 and sum(chars) == 3 * sum(units) for units, chars, _ in index.lanes)


# -- Periodic runs ------------------------------------------------------------

def plain_runs(w, least=24, times=3):
    """Every period at every place, smallest periods first."""
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q) and not any(s <= i and j + q <= s + n for (s, _), n in out.items()):
                out[i, q] = j + q - i
            i = j + 1
    return sorted((s, n, q) for (s, q), n in out.items())


piece = st.lists(st.integers(0, 3), min_size=1, max_size=9)
tiled = st.tuples(piece, st.integers(1, 9), st.integers(0, 8)).map(lambda t: t[0] * t[1] + t[0][:t[2]])


@settings(max_examples=300, deadline=None)
@given(st.lists(tiled, max_size=7), st.sampled_from([6, 9, 24]), st.integers(1, 3))
def test_find_runs(parts, least, copies):
    words = [str(x) for p in parts for x in p] * copies
    assert periodic_runs.find_runs(words, least) == plain_runs(words, least)


def test_pair_grammar_derives_the_text_and_leaves_no_pair_twice():
    rnd = random.Random(5)
    ids = [rnd.randrange(4) for _ in range(400)] + [0, 1] * 100 + [2] * 77
    rules, row = periodic_runs.pair_grammar(ids, 4)

    def derived(s):
        return [s] if s < 4 else derived(rules[s - 4][0]) + derived(rules[s - 4][1])
    assert [x for s in row for x in derived(s)] == ids
    last = {}
    for i, pair in enumerate(zip(row, row[1:])):
        assert pair not in last or i - last[pair] == 1 and pair[0] == pair[1]  # overlapping only
        last.setdefault(pair, i)


def plain_collapse(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)


RUNS = [None, "", " \n", "a b", "a " * 23, "a " * 24, "a\tb\x0bc\r\n" * 8, "x " + "a b c d e f g h i " * 3 + "a z", "    " * 20, "q " * 40 + "r s " * 40, "a b a c " * 30]


def test_collapse_runs(spark):
    texts = [*RUNS, *RUNS, "n o p " * 9]
    got = [(r.extract_id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in periodic_runs.collapse_runs(rows_of(spark, texts)).collect()]
    want = [(None if i == 1 else i // 2, *plain_collapse(t or "")) for i, t in enumerate(texts)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periodic_runs.collapse_runs(rows_of(spark, ["a"]).limit(0)).count() == 0


def test_collapse_runs_of_elements(spark):
    notes = ["surveyed on foot " * 10 + "done", None, "plain note"]
    got = {r.extract_id >> 2: (r.text, [tuple(x) for x in r.runs]) for r in periodic_runs.collapse_runs(elements_of(spark, notes)).collect()}
    assert got == {0: ("surveyed on foot done", [(0, 30, 3)]), 2: ("plain note", [])}


def test_very_long_texts_with_runs():
    words = ["u"] * 50_000 + [str(i) for i in range(50_000)] + [str(i % 9_000) for i in range(50_000)]
    n, runs, kept = periodic_runs.collapse(" ".join(words))
    assert (n, runs) == (150_000, [(0, 50_000, 1), (100_000, 50_000, 9_000)])
    assert kept.split(" ") == ["u", *words[50_000:109_000]]


def test_planted_runs(spark):
    texts = ["one two three four five six seven eight nine ten"] * 60 + ["", None]
    ids = list(range(62))
    got = {r.extract_id: r.text for r in with_planted_runs(spark.createDataFrame(list(zip(ids, texts)), "extract_id long, text string")).collect()}
    for i, t in zip(ids, texts):
        h, words = zlib.crc32(str(i).encode()), (t or "").split()
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        assert (got[i] or "").split() == words


def test_runs_and_forms_at_the_smallest_scale(spark, sf):
    """Long texts of the given table against the plain search."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    assert len(found) == len(docs)
    planted = {r.extract_id: r.text for r in with_planted_runs(spark.createDataFrame([(d.doc_id, d.text) for d in docs], "extract_id long, text string")).collect()}
    for i, text in planted.items():
        if len(text or "") < 4000:
            _, runs, kept = plain_collapse(text or "")
            assert found[i].n_runs == len(runs)
            assert found[i].runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
            assert found[i].collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()


# -- Toxicity -----------------------------------------------------------------

def insults(n, seed=3):
    rnd = random.Random(seed)
    common, bad = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)], ["blockhead", "nitwit", "dunce"]
    rows = []
    for i in range(n):
        words = [rnd.choice(common) for _ in range(rnd.randrange(5, 60))]
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(rnd.randrange(1, 4)):
                w = rnd.choice(bad)
                words.insert(rnd.randrange(len(words)), rnd.choice([w, w + "***", w.upper(), w.replace("i", "1").replace("e", "3"), w + "s"]))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_on_elements(spark):
    rows = insults(600)
    elements = elements_of(spark, [t for _, t, _ in rows])
    verdicts = spark.createDataFrame([(4 * i, t) for i, _, t in rows if i % 3], "extract_id long, toxic int")
    got = {r.extract_id >> 2: r.score for r in toxicity.score_extracts(elements, verdicts).collect()}
    assert len(got) == 600 and all(0 <= s <= 1 for s in got.values())
    unseen = [(got[i], t) for i, _, t in rows if i % 3 == 0]
    assert sum((s >= 0.5) == bool(t) for s, t in unseen) >= 0.95 * len(unseen)


def test_toxicity_defined_for_every_row(spark):
    rows = insults(200)
    texts = [(i, t) for i, t, _ in rows] + [(None, "nitwit"), (900, None), (901, ""), (902, "nitwit " * 50_000), (7, rows[7][1])]
    extracts = spark.createDataFrame([(i, t, "s", 1, 0) for i, t in texts], "extract_id long, text string, score string, toxic int, half int")
    labels = [(i, t) for i, _, t in rows] + [(None, 1), (5, None), (8, 0)]
    got = toxicity.score_extracts(extracts, spark.createDataFrame(labels, "extract_id long, toxic int")).collect()
    assert sorted((r.extract_id for r in got), key=repr) == sorted((i for i, _ in texts), key=repr)
    assert all(r.score is not None and 0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.extract_id, set()).add(r.score)
    assert len(by[7]) == 1 and by[900] == by[901] and min(by[902]) >= 0.5
    none = spark.createDataFrame([], "extract_id long, toxic int")
    assert {r.score for r in toxicity.score_extracts(extracts, none).collect()} == {0.0}
    ones = spark.createDataFrame([(3, 1)], "extract_id long, toxic int")
    assert {r.score for r in toxicity.score_extracts(extracts, ones).collect()} == {1.0}
    assert toxicity.score_extracts(extracts.limit(0), none).count() == 0


def test_features():
    rows = toxicity.feature_rows(["", "you NITWIT*** n1tw1t fine", "a b c d e f g nitwit h", "Nitwits, go!"], {"=nitwit": 3.0, "nitwi": 2.0})
    table = [dict(zip(toxicity.FEATURES, r)) for r in rows]
    assert set(table[0].values()) == {0.0}
    assert table[1]["terms"] == 50 and table[1]["near_second_person"] == 50 and table[1]["disguised_terms"] == 25 and table[1]["capital_words"] == 25
    assert table[2]["near_second_person"] == 0 and table[2]["strong_terms"] == pytest.approx(100 / 9)
    assert table[3]["top_weight"] == 2.0 and table[3]["exclamations"] == 50


def test_held_out_toxicity(spark):
    """Held-out accuracy on the given labels; the labels of the fold are never learnt from."""
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op11_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out and toxic is not null")
    right = {(r.toxic, r.predicted): r.n for r in got.groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    caught, missed = right.get((1, 1), 0), right.get((1, 0), 0)
    assert caught >= 0.85 * (caught + missed) and right.get((0, 1), 0) <= 0.02 * right[0, 0]
