"""Address rules, quality rules, token files and packing against plain Python."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tilescape.llm import packing, quality_rules, token_records, url_rules
from tilescape.llm._common import shared_folder
from tilescape.llm.queries import tokenizer_path
from tilescape.llm.tokens import encoder

TEXTS = [None, "", " ", "a", "one two three one two three one", "x\n\ny  z \n", "tabs\there\x0b\x0c\r end", "ä ö #1 $2 <|endoftext|> b",
         "Don't stop.\nThe line\nThe line\n \n", "日本語 text… ok", "w " * 60, "the cat " * 700, " lead", "trail ", "a\n b", "\u00a0b c", "a" * 5000]


@pytest.fixture(scope="module")
def extracts(spark):
    rows = [(i, "en" if i % 2 else None, t, "clash") for i, t in enumerate(TEXTS)] + [(5, "en", TEXTS[5], "again"), (None, "de", "no id here", "x")]
    return spark.createDataFrame(rows, "extract_id long, area string, text string, n_words string")


# -- Addresses ----------------------------------------------------------------

def plain_verdict(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_rules(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/x", "block"), ("a.example.net", "", "allow"), ("org", "/fr/", "allow"), ("org", "/fr/", "block")]
    urls = [None, "", "nourl", "http://", "http://X.NET/a", "https://example.net/en/xy?q#f", "http://b.example.net/en/z", "http://a.example.net", "http://a.example.net?x",
            "http://network/x", "http://notexample.net/en/", "http://x.org/fr/1", "http://ä.org/fr/", "http://a..net/", "x://y.net://z/", "http://x.net/en/" + "p" * 3000, "http://x.net\n/a"] + ["http://hot.example.net/en/1"] * 50
    fetches = spark.createDataFrame([(i % 40, u, "c") for i, u in enumerate(urls)] + [(None, "http://q.net/", "c")] * 2, "fetch_id long, url string, rule string")
    got = sorted(map(tuple, url_rules.judge_urls(fetches, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()), key=repr)
    effective = [r for r in rules if r != ("org", "/fr/", "allow")]
    want = [(i % 40, *plain_verdict(u, effective)) for i, u in enumerate(urls)] + [(None, *plain_verdict("http://q.net/", effective))] * 2
    assert got == sorted(want, key=repr)


def test_url_rules_empty(spark):
    fetches = spark.createDataFrame([(1, "http://a.net/")], "fetch_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in url_rules.judge_urls(fetches, none, "block").collect()] == [(1, "a.net", "/", None, "block")]
    assert url_rules.judge_urls(fetches.limit(0), none).count() == 0


# -- Quality ------------------------------------------------------------------

def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = list(zip(words, words[1:], words[2:]))
    often = Counter(grams)
    covered = {i + d for i, g in enumerate(grams) if often[g] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_measures(spark, extracts):
    got = quality_rules.with_measures(extracts.drop("n_words")).select("text", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert len(got) == len(TEXTS) + 2
    for text, *measures in got:
        assert tuple(measures) == plain_measures(text), text


def test_measures_of_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for r in quality_rules.with_measures(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_measures(r.text)


def test_binomial_tail(spark):
    from math import comb
    from pyspark.sql import functions as F
    cases = [(x, n) for n in (1, 10, 400, 3000) for x in (0, 1, 3, 9) if x < n]
    df = spark.createDataFrame(cases, "x long, n long").withColumn("p", quality_rules.binomial_at_most(F.col("x"), F.col("n"), 0.02))
    for x, n, p in df.collect():
        exact = sum(comb(n, k) * 0.02**k * 0.98 ** (n - k) for k in range(x + 1))
        assert p == pytest.approx(exact if x < n * 0.02 else 1.0, rel=1e-9)


def test_cutoffs_limit_false_rejection(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    good = [" ".join(word() for _ in range(60)) for _ in range(3000)]
    bad = [" ".join(word() + "#" for _ in range(60)) for _ in range(300)]
    rows = [(i, "en", t) for i, t in enumerate(good + bad)] + [(9000 + i, "few", t) for i, t in enumerate(good[:20] + bad[:5])]
    extracts = spark.createDataFrame(rows, "extract_id long, area string, text string")
    labels = spark.createDataFrame([(i, i < 3000 or i >= 9000) for i, _, _ in rows] + [(None, True), (1, None)], "extract_id long, good boolean")
    out = {r.extract_id: r.kept for r in quality_rules.judge_extracts(extracts, labels).collect()}
    assert not any(out[i] for i in range(3000, 3300))  # all symbol texts of the large stratum go
    assert sum(not out[i] for i in range(3000)) <= 0.02 * 3000
    assert all(out[9000 + i] for i in range(25))  # too few labels: only the base rules


def test_quality_without_rows_or_labels(spark, extracts):
    labels = spark.createDataFrame([], "extract_id long, good boolean")
    assert all(r.kept != r.base_failed for r in quality_rules.judge_extracts(extracts, labels).collect())
    assert quality_rules.judge_extracts(extracts.limit(0), labels).count() == 0


# -- Tokens -------------------------------------------------------------------

def plain_ids(text, end):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [end]


def test_encoder_is_the_library(spark, sf):
    encode = encoder(tokenizer_path())
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for t in texts:
        assert np.frombuffer(encode(t or ""), "<u4").tolist() == plain_ids(t, 2)[:-1], t


def test_token_records(spark, extracts):
    folder = shared_folder(spark, "test-records")
    token_records.write_token_records(extracts, folder, tokenizer_path(), 2)
    got = sorted(map(tuple, token_records.read_token_records(spark, folder).collect()), key=lambda r: r[1])
    want, start = [], 0
    for key, text in [*sorted([*enumerate(TEXTS), (5, TEXTS[5])], key=lambda x: x[0]), (None, "no id here")]:
        ids = plain_ids(text, 2)
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_damaged_records_are_found():
    record = token_records.frame(b"abcd")
    assert token_records.unframe(record) == b"abcd"
    for i in range(len(record)):
        with pytest.raises(ValueError):
            token_records.unframe(record[:i] + bytes([record[i] ^ 1]) + record[i + 1:])


def test_empty_token_records(spark, extracts):
    folder = shared_folder(spark, "test-records")
    token_records.write_token_records(extracts.limit(0), folder, tokenizer_path(), 2)
    assert token_records.read_token_records(spark, folder).count() == 0


# -- Packing ------------------------------------------------------------------

@pytest.mark.parametrize("limit", [8, 1024])
def test_packing(spark, extracts, limit):
    got = packing.pack_extracts(extracts, tokenizer_path(), 0, limit).collect()
    want = Counter()
    for key, text in [*enumerate(TEXTS), (5, TEXTS[5]), (None, "no id here")]:
        ids = plain_ids(text, 0)
        for at in range(0, len(ids), limit):
            piece = ids[at:at + limit]
            want[key, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r.extract_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= limit
    assert sorted(by) == list(range(len(by)))
    assert packing.pack_extracts(extracts.limit(0), tokenizer_path(), 0, limit).count() == 0


def test_shortest_pack_first():
    rng = np.random.default_rng(1)
    histogram = {int(k): int(v) for k, v in Counter(rng.integers(1, 1025, 20000)).items()}
    patterns = packing.shortest_pack_first(histogram, 1024)
    used = Counter()
    for p, n in patterns:
        assert sum(p) <= 1024
        for length in p:
            used[length] += n
    assert dict(used) == histogram
    total = sum(k * v for k, v in histogram.items())
    assert sum(n for _, n in patterns) * 1024 <= 1.03 * total
