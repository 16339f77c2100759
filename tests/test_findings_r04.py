"""Small cases of the findings at 1 GB and 6 GB."""

from pyspark.sql import functions as F


def test_a_written_surface_is_not_sent_for_the_water_levels(spark):
    from tilescape.operators import voxels
    from tilescape.session import cut

    surface = cut(spark.range(4096).selectExpr("id div 2048 as tx", "id % 64 as ix", "id div 64 % 32 as iz", "id % 3 as gy"))
    voxel = cut(surface.select("tx", "ix", F.col("gy").alias("iy"), "iz", F.lit(voxels.TAG_GROUND).alias("tag")))
    levels = surface.groupBy("tx").agg(F.max("gy").alias("sea"))
    out = voxels.flood(voxel, surface, levels, 100.0, 100.0)
    rows = out.collect()
    assert len(rows) == len({tuple(r)[:4] for r in rows}) and {r.tag for r in rows} == {voxels.TAG_GROUND, voxels.TAG_WATER}
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_steps_of_a_sweep_are_methods_that_are_compiled(spark):
    from tilescape.functions.rings import ring_of
    from tilescape.operators import collision, lines
    from tilescape.session import by_keys, cut

    box = spark.range(40).selectExpr("1 as tile", "id as fid", "cast(id % 8 * 12 as double) as x", "cast(id div 8 * 12 as double) as z", "0D as base", "cast(5 + id % 7 as double) as top")
    x, z = F.col("x"), F.col("z")
    prisms = box.select("tile", "fid", ring_of((x, z + 6), (x + 6, z + 6), (x + 6, z), (x, z)).alias("outer"), F.array().cast("array<array<struct<x: double, y: double>>>").alias("holes"), "base", "top")
    decks = box.select("tile", F.col("fid").alias("deck_id"), *lines.oriented_box(x, z, x + 9, z + 4, 1.0), (F.col("top") + 2).alias("top"), (F.col("top") + 1).alias("bottom"))
    sweeps = spark.range(60).selectExpr("id", "1 as tile", "cast(id * 7 % 95 as double) as fx", "cast(id % 16 as double) as fy", "cast(id * 11 % 55 as double) as fz",
                                        "cast(id * 13 % 95 as double) as tx", "cast(id % 9 as double) as ty", "cast(id * 5 % 55 as double) as tz", "1D as r")
    out = collision.sweep_spheres(cut(sweeps), "id", by_keys(cut(prisms)), by_keys(cut(decks)), 20.0)
    assert {r.kind for r in out.collect()} == {"prism", "deck"}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = out.select("*")._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    code = debug.codegenStringSeq(plan)
    assert code.size() > 5 and max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) <= 8000


def test_hits_of_footprints_are_shuffled_once(spark):
    from tilescape.operators import footprints

    keys = ["fid", "tx"]
    near = spark.range(3000).selectExpr("id % 7 as fid", "id % 7 % 2 as tx", "id * 31 % 640 as x", "id * 17 % 480 as y", "pow(id * 13 % 101, 1 + id % 7 / 10D) as z", "id % 7 * 10 as ox", "5L as oy")
    near = near.unionByName(spark.createDataFrame([(5, 1, 1, 1, None, 0, 5), (5, 1, 1, 1, float("nan"), 0, 5), (99, 0, 1, 1, 3.0, 0, 5)], near.schema))
    rules = footprints.RoofRules(above_ground=9, min_points=20, min_structure=30)
    want = footprints.roof_profiles(footprints.height_histogram(near, keys), keys, rules)
    got = footprints.roof_profiles_whole(near, keys, rules, 4)
    assert got.columns == want.columns
    order = lambda df: sorted(tuple(round(v, 6) for v in r) for r in df.collect())
    assert order(got) == order(want) and len(order(got)) == 7
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange") == 1 and "Join" not in plan


def test_crowded_footprints_are_told_by_cells(spark, sf, monkeypatch):
    from tilescape.operators import footprints
    from tilescape.plans import QUERIES

    order = lambda df: sorted(map(tuple, df.collect()))
    want = order(QUERIES["ag7_roof_profile"](spark, sf))
    seen = []
    old = footprints.roof_profiles
    monkeypatch.setattr(footprints, "roof_profiles", lambda hist, keys, rules: seen.append(hist.select("fid").distinct().count()) or old(hist, keys, rules))
    monkeypatch.setattr(footprints, "WHOLE_POINTS", 400)
    assert order(QUERIES["ag7_roof_profile"](spark, sf)) == want
    assert 0 < seen[0] < len(want)


def test_texts_of_extracts_are_shuffled_once(spark, tmp_path):
    from tilescape.sources import extracts

    one = lambda k: '{"type":"way","id":%d,"members":[{"type":"way","role":"in}\\"ner"}],"tags":{"name":"a]%d"}}' % (k, k)
    for name in "ab":
        (tmp_path / f"{name}.json").write_text('{"elements":[' + ",".join(one(k) for k in range(400)) + "]}")
    (tmp_path / "c.json").write_text('{"elements":[' + one(1) + "]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        pieces, files = extracts.with_state(extracts.read_pieces(spark, str(tmp_path)))
        written, real = [], extracts.cut_texts
        extracts.cut_texts = lambda df: written.append(df) or real(df)
        try:
            out = extracts.small_documents(pieces)
        finally:
            extracts.cut_texts = real
        assert {r.path[-6:]: r.broken for r in files.collect()} == {"a.json": False, "b.json": False, "c.json": True}
        assert pieces.select("path", "block").distinct().count() > 10
        # One for each element and one for the head of each file.
        assert out.count() == 802 and out.filter("value not like '{\"elements\":[%]}'").isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # Text goes through one exchange, where the states of the blocks come to it.
    plan = written[0]._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 1 and "Scan text" not in plan
    physical = written[0]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert physical.count("Exchange") == 2


def test_parts_of_a_tile_are_written_by_one_task(spark, tmp_path):
    from tilescape import sinks

    docs = spark.range(400).selectExpr("id div 4 as tx", "0L as ty", "id % 4 as part", "'{}' as json")
    sinks.write_documents(docs, str(tmp_path / "few"))
    tasks = {}
    for f in (tmp_path / "few").glob("tx=*/ty=*/part=*/*.txt"):
        tasks.setdefault(f.parts[-4], set()).add(f.name.split("-")[1])
    assert len(tasks) == 100 and all(len(t) == 1 for t in tasks.values()) and len(set.union(*tasks.values())) > 4
    # A tile of many parts is still written by many tasks.
    sinks.write_documents(docs.selectExpr("1L as tx", "ty", "tx * 4 + part as part", "json"), str(tmp_path / "many"))
    files = list((tmp_path / "many").glob("tx=1/ty=0/part=*/*.txt"))
    assert len(files) == 400 and len({f.name.split("-")[1] for f in files}) > 4
