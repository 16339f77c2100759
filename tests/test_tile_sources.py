"""Tile folders and large extracts: what is written is read back, and only where it is needed."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tilescape import sinks, sources
from tilescape.sources import extracts


def tree_table(spark, n=400):
    rnd = random.Random(4)
    rows = [(2621 + i % 3, 6331 + i % 2, rnd.randrange(10 ** 6), rnd.randrange(10 ** 6), rnd.randrange(300), rnd.randrange(100)) for i in range(n)]
    return spark.createDataFrame(rows + rows[:20], "tx bigint, ty bigint, lon_e7 bigint, lat_e7 bigint, height_dm bigint, crown_dm bigint")


def roof_table(spark, n=300):
    rnd = random.Random(5)
    rows = [(2621 + i % 3, 6331, rnd.randrange(10 ** 6), rnd.randrange(10 ** 6), i % 3, rnd.randrange(300), rnd.randrange(90), rnd.randrange(36000)) for i in range(n)]
    return spark.createDataFrame(rows, "tx bigint, ty bigint, lon_e7 bigint, lat_e7 bigint, shape int, eave_dm bigint, rise_dm bigint, ridge_cdeg bigint")


def same(left, right):
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    assert sorted(map(repr, left.select(columns).collect())) == sorted(map(repr, right.select(columns).collect()))


def test_written_layers_come_back(spark, tmp_path):
    root, trees, roofs = str(tmp_path), tree_table(spark), roof_table(spark)
    wanted = spark.createDataFrame([(2621, 6331), (9, 9)], "tx bigint, ty bigint")  # 9/9 has no trees: an empty document
    sinks.write_documents(sinks.tree_documents(trees, wanted.union(trees.select("tx", "ty")), buckets=4), f"{root}/a", layer="trees", zoom=14)
    sinks.write_documents(sinks.roof_documents(roofs, buckets=3), f"{root}/b", layer="roofs", zoom=14)
    point = spark.createDataFrame([(2621, 6331, "crosswalk", -122.4, 37.8, 90.0, 6.0, 3.0)], "tx bigint, ty bigint, kind string, lon double, lat double, bearing_deg double, len_m double, width_m double")
    line = spark.createDataFrame([(2621 + i % 2, 6331, "sidewalk", 2.0 + i, [(-122.4, 37.8), (-122.39, 37.81)]) for i in range(40)], "tx bigint, ty bigint, kind string, width_m double, path array<struct<lon: double, lat: double>>")
    ring = spark.createDataFrame([(2622, 6331, "plaza", [(-122.4, 37.8), (-122.39, 37.81), (-122.4, 37.9)])], "tx bigint, ty bigint, kind string, path array<struct<lon: double, lat: double>>")
    sinks.write_documents(sinks.paint_documents(line, ring, point, buckets=2), f"{root}/c", layer="paint", zoom=14)

    written = sources.read_tiles(spark, f"{root}/a")
    assert {r.part for r in written.select("part").collect()} == {0, 1, 2, 3}
    same(sources.tree_rows(written), trees)
    assert sources.rejected(written, "trees").count() == 0
    same(sources.tree_rows(written.filter("tx = 2622 and ty = 6331")), trees.filter("tx = 2622 and ty = 6331"))
    same(sources.roof_rows(sources.read_tiles(spark, f"{root}/b")), roofs)
    parts = sources.paint_parts(sources.read_tiles(spark, f"{root}/c"))
    assert {k: v.count() for k, v in parts.items()} == {"ribbons": 40, "polygons": 1, "decals": 1}
    assert sorted(r.width_dm for r in parts["ribbons"].collect()) == [20.0 + 10 * i for i in range(40)]


def test_filters_pick_folders(spark, tmp_path):
    sinks.write_documents(sinks.tree_documents(tree_table(spark), buckets=2), str(tmp_path), layer="trees", zoom=14)
    one = sources.tree_rows(sources.read_tiles(spark, str(tmp_path)).filter("layer = 'trees' and zoom = 14 and tx = 2621"))
    plan = spark._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "formatted")
    filters = next(x for x in plan.splitlines() if x.startswith("PartitionFilters"))
    assert all(f"try_cast({c}#" in filters for c in ("tx", "zoom")) and "layer" in filters
    for p in tmp_path.rglob("tx=2622/**/*.txt"):  # a folder that is not picked is not opened
        p.write_bytes(b"")
        p.chmod(0)
    assert sources.tree_rows(sources.read_tiles(spark, str(tmp_path)).filter("tx = 2621 and ty = 6331")).count() > 0
    boxed = sources.in_box(sources.read_tiles(spark, str(tmp_path)), -122.41, 37.7, -122.39, 37.9, 14)
    assert {r.tx for r in boxed.select("tx").collect()} == {2621}


def test_damaged_folders_and_documents_never_fail(spark, tmp_path):
    sinks.write_documents(sinks.tree_documents(tree_table(spark, 10)), str(tmp_path / "a"), layer="trees", zoom=14)
    for folder, text in (("layer=trees/zoom=14/tx=abc/ty=1/part=0", '{"trees":[[1,2,3,4]]}'), ("layer=trees/zoom=14/tx=1/ty=99999999999999999999/part=0", '{"trees":[]}'),
                         ("layer=trees/zoom=x/tx=1/ty=1/part=0", '{"trees":[[1,2]]}\n\n{"trees":[[5,6,7,8]]}\nno json'), ("layer=trees/zoom=14/odd", "{}"), ("", "{}")):
        (tmp_path / "a" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "a" / folder / "f.txt").write_text(text + "\n")
    read = sources.read_tiles(spark, str(tmp_path / "a"))
    reasons = sorted(r.reason for r in sources.rejected(read, "trees").collect())
    assert reasons == ["no tile in the path", "no tile in the path", "not a JSON object", "unexpected shape"]
    rows = sources.tree_rows(read).collect()
    assert len(rows) == 11 + 20 - 10 and (1, 1, 5, 6, 7, 8) in set(map(tuple, rows))
    assert sources.rejected_trees(read).count() == 4
    assert sorted(r.path.rsplit("/a/", 1)[1] for r in sources.misplaced(spark, str(tmp_path / "a")).collect()) == ["f.txt", "layer=trees/zoom=14/odd/f.txt"]


def test_plain_files(spark, tmp_path):
    for name, text in (("trees/14/5/6.json", '{"trees":\n[[1,2,3,4]]}'), ("trees/14/5/7.json", '{"trees":[]}'), ("trees/14/x/7.json", '{"trees":[[9,9,9,9]]}'), ("7.json", '{"trees":[]}')):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    read = sources.read_plain_tiles(spark, str(tmp_path))
    assert [tuple(r) for r in sources.tree_rows(read).collect()] == [(5, 6, 1, 2, 3, 4)]
    assert sorted(r.reason for r in sources.rejected(read, "trees").collect()) == ["no tile in the path"] * 2
    assert [(r.layer, r.zoom, r.ty) for r in read.filter("tx = 5 and ty = 7").collect()] == [("trees", 14, 7)]
    # Text rows without tile columns take either form from the path.
    rows = spark.createDataFrame([("/x/tx=3/ty=4/part=0/p.txt", '{"trees":[[1,2,3,4]]}'), ("/x/3/5.json", '{"trees":[[1,2,3,4]]}'), ("", '{"trees":[]}'), (None, '{"trees":[]}')], "path string, value string")
    assert sorted((r.tx, r.ty) for r in sources.tree_rows(rows).collect()) == [(3, 4), (3, 5)]
    assert sources.rejected(rows, "trees").count() == 2


# -- Extracts -----------------------------------------------------------------

def element(i, rnd):
    tags = {"note": rnd.choice(['plain', 'say "type" {"type" [', "ends in \\", "} ] , {", "ä\U0001F600", 'x\\"{"'])} if i % 3 else {}
    if i % 5 == 4:
        members = [{"type": "way", "role": rnd.choice(["outer", "inner"]), "geometry": [{"lon": k / 7, "lat": k / 3} for k in range(rnd.randrange(4))]} for _ in range(rnd.randrange(6))]
        return {"type": "relation", "id": i, "tags": tags, "members": members}
    if i % 5 == 3:
        return {"id": i, "type": "node", "lon": i / 11, "lat": -i / 13, "tags": tags}  # begins in another way
    return {"type": "way", "id": i, "tags": tags, "geometry": [{"lon": i / 3, "lat": i / 9}] * rnd.randrange(4)}


def documents(n):
    rnd = random.Random(n)
    for k in range(6):
        yield {"version": 0.6, "osm3s": {"note": 'a "quoted" {'}, "elements": [element(1000 * k + i, rnd) for i in range(n)], **({"generator": "x [ {"} if k % 2 else {})}


@pytest.mark.parametrize("indent, start", [(None, '{"type"'), (None, '{"type": "way"'), (1, '{\n   "type"'), (None, '"id"'), (None, "not there")])
def test_extracts_equal_the_whole_file_parse(spark, tmp_path, indent, start):
    for k, doc in enumerate(documents(60)):
        (tmp_path / f"{k}.json").write_text(json.dumps(doc, indent=indent))
    (tmp_path / "none.json").write_text('{"elements": []}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        got, rejected = sources.read_elements(spark, str(tmp_path), start)
        assert extracts.read_pieces(spark, str(tmp_path), start).select("path", "block").distinct().count() > 30 or start == "not there"
        same(got, sources.element_rows(sources.read_text(spark, str(tmp_path))))
        assert rejected.count() == 0 and got.count() == 360
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_broken_extracts_are_reported_whole(spark, tmp_path):
    good = json.dumps({"elements": [{"type": "way", "id": i, "tags": {}, "geometry": []} for i in range(30)]})
    broken = {"cut.json": good[:700], "string.json": good.replace('"tags"', '"tags', 1), "deep.json": good.replace("}, {", "}}, {{", 1), "list.json": good.replace('"elements": [', '"elements": 7, "other": [', 1)[:20] + "}",
              "word.json": good.replace('"id": 7', '"id": seven', 1), "other.json": '{"a": 1}', "text.json": "hello"}
    for name, text in {"good.json": good, **broken}.items():
        (tmp_path / name).write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    try:
        got, rejected = sources.read_elements(spark, str(tmp_path))
        assert sorted(r.id for r in got.collect()) == list(range(30))
        assert {r.path.rsplit("/", 1)[1] for r in rejected.collect()} == set(broken)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


# -- Manifest lines -----------------------------------------------------------

def test_manifest_lines_fold_and_come_back(spark, tmp_path):
    rows = [("trees", 14, x, y) for x in range(2600, 2700) for y in range(6300, 6390)] + [("wash", 14, 0, 16383)] + [("trees", 13, 1, 1), ("unknown", 14, 1, 1)] + [("trees", 14, 2600, 6300)]
    cov = spark.createDataFrame(rows, "layer string, zoom int, tx bigint, ty bigint")
    lines = sinks.manifest_lines(cov).collect()
    parsed = [json.loads(r.json) for r in lines]
    assert max(len(d.get("tiles", d.get("parts"))) for d in parsed) <= 4096
    tops = {d["layer"]: d["n"] for d in parsed if d["level"] == 0}
    assert tops == {"trees": 9000, "wash": 1, "paint": 0, "terrain": 0}  # required layers always have a line
    below = {(d["layer"], f'{d["level"]}/{d["parent"]}') for d in parsed}
    assert all((d["layer"], p) in below for d in parsed for p in d.get("parts", []))
    sinks.write_manifest_lines(cov, str(tmp_path / "m"))
    back = sources.read_manifest_lines(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, sources.coverage_rows(back).collect())) == sorted({(a, x, y) for a, z, x, y in rows if z == 14 and a != "unknown"})
    assert sources.rejected(back, "manifest_lines").count() == 0
    odd = spark.createDataFrame([("/m", '{"layer":"trees"}'), ("/n", "[]"), ("/o", '{"trees":{"zoom":14,"tiles":["3/4"]},"terrain":{"zoom":12,"tiles":["1/1"]}}')], "path string, value string")
    assert sources.rejected(odd, "manifest_lines").count() == 3
    assert [tuple(r) for r in sources.coverage_rows(odd).collect()] == [("trees", 3, 4)]
