"""Archives and line runs against plain Python."""

import base64
import gzip
import hashlib
import io
import posixpath
import re
import time
import zlib

import pytest

from tilescape.llm import archives, line_runs
from tilescape.llm._common import file_system, shared_folder


# -- Archives -----------------------------------------------------------------

BODIES = [None, "", "<p>a</p>", "<p>a</p>", "\r\n\r\nWARC/1.1\r\n\r\n", "ä€😀\x00", "x" * 300_000, "<p>a</p>", "y\n", "", "WARC/1.1\r\nContent-Length: 5\r\n\r\n"]


@pytest.fixture(scope="module")
def written(spark):
    rows = [(i, None if i == 4 else f"http://a/{i}\r\nX: y", b, "clash") for i, b in enumerate(BODIES)] + [(8, "http://a/8", "y\n", "clash"), (None, "u", "z", "clash"), (None, "v", "<p>a</p>", "clash"), (None, None, "z", "clash")]
    raw, out = shared_folder(spark, "test-raw"), shared_folder(spark, "test-archives")
    archives.write_archives(spark.createDataFrame(rows, "fetch_id long, url string, body string, record_type string"), raw)
    archives.normalise_archives(spark, raw, out)
    return raw, out


def test_archives(spark, written):
    latest = {}
    for i, b in enumerate(BODIES):
        latest[b or ""] = i
    want = []
    for i, b in [*enumerate(BODIES), (8, "y\n"), (None, "z"), (None, "z"), (None, "<p>a</p>")]:
        data, last = (b or "").encode(), latest.get(b or "")
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if last == i else "revisit", None if last == i else last))
    got = [tuple(r) for r in archives.read_archives(spark, written[1]).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_each_record_is_a_member(spark, written):
    raw, out = written
    fs, base = file_system(out)
    index = spark.read.parquet(f"{out}/index").collect()
    assert len(index) == len(BODIES) + 4
    by_archive = {}
    for r in index:
        data = fs.open_input_file(posixpath.join(base, r.archive)).read_at(r.n_bytes, r.offset)
        one = zlib.decompressobj(31)
        text = one.decompress(data)
        assert one.eof and not one.unused_data and text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
        assert f"WARC-Record-ID: {r.record_id}\r\n".encode() in text
        by_archive.setdefault(r.archive, []).append((r.offset, r.n_bytes))
    for name, spans in by_archive.items():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert fs.get_file_info(posixpath.join(base, name)).size == at
    fs, base = file_system(raw)
    from pyarrow.fs import FileSelector
    originals = [gzip.decompress(fs.open_input_stream(f.path, compression=None).read()) for f in fs.get_file_info(FileSelector(base)) if f.path.endswith(".gz")]
    fs, base = file_system(out)
    rewritten = [gzip.decompress(fs.open_input_stream(posixpath.join(base, n), compression=None).read()) for n in by_archive]
    assert sorted(x for x in originals if x) == sorted(rewritten)


def test_several_members_and_damage(spark, tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:x-fetch:7>\r\nWARC-Refers-To: <urn:x-fetch:9>\r\nWARC-Payload-Digest: sha1:AA\r\nContent-Length: 38\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\n\r\n\r\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record[:50]) + gzip.compress(record[50:]))
    archives.normalise_archives(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    assert [tuple(r) for r in archives.read_archives(spark, f"file://{tmp_path}/out").collect()] == [(7, 4, "AA", "revisit", 9)] * 2
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/a.warc.gz").write_bytes(gzip.compress(record[:-6]))
    with pytest.raises(Exception, match="within a record"):
        archives.normalise_archives(spark, f"file://{tmp_path}/bad", f"file://{tmp_path}/out2")
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut/a.warc.gz").write_bytes(gzip.compress(record)[:-6])
    with pytest.raises(Exception, match="within a member"):
        archives.normalise_archives(spark, f"file://{tmp_path}/cut", f"file://{tmp_path}/out3")


def test_inflating_is_linear_and_bounded():
    """2,000 records of 58 KB that compress over 300-fold: never more than two chunks are held."""
    record = b"WARC/1.1\r\nContent-Length: 58000\r\n\r\n" + (b"<td>ab</td>" * 5273)[:58000] + b"\r\n\r\n"
    packed = gzip.compress(record * 1000) + gzip.compress(b"") + gzip.compress(record * 1000)
    source, n, most, began = archives._Inflated(io.BytesIO(packed)), 0, 0, time.perf_counter()
    while (header := source.until(b"\r\n\r\n")) is not None:
        body = b"".join(source.take(58004))
        assert header + body == record
        n, most = n + 1, max(most, len(source.buffer))
    assert n == 2000 and most <= 2 * archives.CHUNK and time.perf_counter() - began < 5


def test_no_fetches(spark):
    raw, out = shared_folder(spark, "test-raw"), shared_folder(spark, "test-archives")
    archives.write_archives(spark.createDataFrame([], "fetch_id long, url string, body string"), raw)
    archives.normalise_archives(spark, raw, out)
    assert archives.read_archives(spark, out).count() == 0


# -- Line runs ----------------------------------------------------------------

def plain_runs(rows, m):
    """(id, kept lines with words); every run of at least m words is compared with every earlier one."""
    seen, out = {}, []
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (text or "").split("\n")
        word = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
        real = [i for i in range(len(lines)) if word[i]]
        gone = set()
        for a in range(len(real)):
            total = 0
            for b in range(a, len(real)):
                total += word[real[b]]
                if total >= m:
                    content = tuple(lines[i].strip(" \t\x0b\f\r") for i in real[a:b + 1])
                    if seen.setdefault(content, (key, a)) != (key, a):
                        gone |= set(range(real[a], real[b] + 1))
        out.append((key, [lines[i] for i in real if i not in gone]))
    return out


def test_line_runs_against_all_runs(spark):
    import random
    rng = random.Random(5)
    pool = [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in (1, 1, 2, 3, 5)] + ["", "  ", "\t x y"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(60)] + [(60, None), (61, ""), (62, "z " * 5000), (63, "z " * 5000)]
    for m in (1, 4, 9):
        df = spark.createDataFrame([(k, t, "clash") for k, t in rows], "extract_id long, text string, first string")
        out = line_runs.drop_repeated_runs(df, m).collect()
        assert {r.extract_id: [x for x in (r.text or "").split("\n") if x.strip(" \t\x0b\f\r")] for r in out} == dict(plain_runs(rows, m))
        assert all((r.text is None) == (dict(rows)[r.extract_id] is None) for r in out)


def test_line_runs_edges(spark):
    passage = "\n".join(" ".join(f"w{i}{j}" for j in range(10)) for i in range(6))
    rows = [(3, f"head\n{passage}\ntail"), (3, f"head\n{passage}\ntail"), (None, f"other\n\n {passage}\n"), (1, "short line\nshort line"), (9, f"{passage}\n{passage}\nend")]
    got = {(r.extract_id, r.text, r.n_removed) for r in line_runs.drop_repeated_runs(spark.createDataFrame(rows, "extract_id long, text string")).collect()}
    assert got == {(3, f"head\n{passage}\ntail", 0), (None, "other\n\n", 6), (1, "short line\nshort line", 0), (9, "end", 12)}
    assert line_runs.drop_repeated_runs(spark.createDataFrame([], "extract_id long, text string")).count() == 0
