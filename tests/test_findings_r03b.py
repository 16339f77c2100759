"""Small cases of the findings on growth."""

from pyspark.sql import functions as F


def test_hierarchy_keys_are_made_from_counted_nodes(spark, sf):
    from tilescape.plans import QUERIES

    out = QUERIES["it3_hierarchy_walk"](spark, sf)
    assert out.count() > 0
    # Points are counted in a stage of their own, so the walk does not read them again.
    assert not any(f.endswith("lineitem.parquet") for f in out.inputFiles())


def test_ring_islands_of_one_stay_are_not_shuffled(spark):
    from tilescape.operators import tracks

    # Viewer 1 jumps out of its own ring each time; viewer 2 walks, rests, leaves and comes back; viewer 3 has gaps.
    moves = [(1, k, 100 * k, -100 * k) for k in range(40)]
    path = [0, 0, 1, 1, 2, 3, 4, 3, 2, 9, 9, 2, 5, 6, 3, 3, 0]
    moves += [(2, k, x, -x // 2) for k, x in enumerate(path)]
    moves += [(3, 0, None, None), (3, 1, 0, 0), (3, 2, None, None), (3, 3, 0, 0), (3, 4, 1, 0)]
    df = spark.createDataFrame(moves, "viewer bigint, seq bigint, cx bigint, cy bigint")
    out = tracks.ring_events(df, "viewer", "seq", "cx", "cy", size=5)
    want = set()
    for v in (1, 2, 3):
        mine = [m for m in moves if m[0] == v]
        near, loaded = set(), set()
        for _, seq, x, y in mine:
            ring = lambda r: set() if x is None else {(x + a, y + b) for a in range(-r, r + 1) for b in range(-r, r + 1)}
            want |= {(v, *t, "evict", seq) for t in loaded - ring(3)}
            loaded &= ring(3)
            want |= {(v, *t, "load", seq) for t in ring(2) - loaded}
            loaded |= ring(2)
    rows = [tuple(r) for r in out.select("viewer", "tx", "ty", "event", "seq").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1  # rows of single stays go past the window


def test_crowded_boxes_leave_no_pairs_with_nodes(spark, sf):
    from tilescape import sources
    from tilescape.plans import QUERIES

    nodes = spark.createDataFrame([(f"4-{x}-{y}-0", 1) for x in range(4) for y in range(4)] + [("odd", 1)], "node_key string, n bigint")
    boxes = spark.range(2000).selectExpr("410D as min_x", "410D as min_y", "790D + id / 200 as max_x", "790D as max_y")
    kept = sources.nodes_for_boxes(nodes, boxes, (0, 0, 0, 6400, 6400, 6400), 1.0, cell=800)
    assert {r.node_key for r in kept.collect()} == {"4-1-1-0", "4-2-1-0", "odd"}
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2 and "Inner" not in plan
    assert not any(f.endswith("lineitem.parquet") for f in QUERIES["jn1_node_pruning"](spark, sf).inputFiles())


def test_scatter_draws_are_rows(spark):
    from tilescape.operators import lines

    ring = [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)]
    parks = spark.createDataFrame([(1, ring), (2, ring[:3])], "id bigint, ring array<struct<x: double, y: double>>")
    out = lines.park_trees(parks, "id")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(transform(" not in plan and "transform(sequence(" not in plan
    rows = out.collect()
    n = {k: sum(r.id == k for r in rows) for k in (1, 2)}
    assert n[1] == 2 * max(1, int(100 * 100 // lines.PARK_AREA_PER_TREE)) and 0 < n[2] < n[1]
    assert all(r.y <= r.x for r in rows if r.id == 2)


def test_surface_is_filled_without_joins(spark):
    from tilescape.operators import voxels

    df = spark.createDataFrame([(1, 0, 0, 5), (1, 0, 2, 9), (1, 11, 11, None), (2, 4, 4, -3)], "tx bigint, ix bigint, iz bigint, gy bigint")
    out = voxels.fill_surface(df, 12, 12)
    got = {(r.tx, r.ix, r.iz): r.gy for r in out.collect()}
    assert len(got) == 2 * 144
    assert got[1, 0, 1] == 9 and got[1, 1, 0] == 5 and got[1, 11, 11] == 0 and got[2, 0, 0] == got[2, 11, 11] == -3
    assert got[1, 8, 0] == 9 and got[1, 9, 0] == 0
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_points_are_not_sorted_for_their_ranges(spark, sf):
    from tilescape.operators import voxels
    from tilescape.plans import voxel_queries as q
    from tilescape.plans.fixtures import fixture
    from tilescape.session import cut

    p = fixture(spark, sf, "fx_points", keyed=False)
    ranges = cut(voxels.vertical_range(p, q.VOXEL, "z_cm", q.UNIT))
    out = voxels.with_voxel(p, ranges, q.VOXEL, q.N, q.N, "x_cm", "y_cm", "z_cm")
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_small_documents_are_written_by_many_tasks(spark, tmp_path):
    import glob

    from tilescape import sinks

    docs = spark.range(64).selectExpr("id as tx", "id * 3 as ty", "0L as part", "'{}' as json").groupBy("tx", "ty", "part").agg(F.max("json").alias("json"))
    sinks.write_documents(docs, str(tmp_path / "t"), layer="trees", zoom=14)
    files = glob.glob(f"{tmp_path}/t/layer=trees/zoom=14/tx=*/ty=*/part=0/part-*")
    assert len(files) == 64 and len({f.split("/part-")[1].split("-")[0] for f in files}) > 1


def test_pieces_are_measured_in_one_pass(spark, tmp_path):
    import re

    from pyspark.sql import Row

    from tilescape.sources import extracts

    texts = ['{"a": [1, "}]"]', 'x"}, {"b": "\\\\"}', '', '"', '[[{"q": "a\\"b]"', 'no signs', '""]}"[', 'é{"ü]"}']
    q, out, inn = extracts._measures(F.col("value"))
    got = spark.createDataFrame([Row(k=k, value=t) for k, t in enumerate(texts)]).select("k", q.alias("q"), out.alias("o"), inn.alias("i")).collect()
    gain = lambda parts: sum(p.count("{") + p.count("[") - p.count("}") - p.count("]") for p in parts)
    for r in got:
        parts = re.sub(r"\\.", "", texts[r.k]).split('"')
        assert (r.q, r.o, r.i) == (len(parts) - 1, gain(parts[::2]), gain(parts[1::2]))
    # The first piece of a file is told by its place: the text is read once, without a join.
    (tmp_path / "a.json").write_text('{"elements":[' + ",".join('{"type":"node","id":%d}' % k for k in range(5)) + "]}")
    reads, real = [], extracts.cut
    extracts.cut = lambda df: reads.append(df) or real(df)
    try:
        extracts.with_state(extracts.read_pieces(spark, str(tmp_path)))
    finally:
        extracts.cut = real
    assert "Join" not in reads[0]._jdf.queryExecution().optimizedPlan().toString()


def test_downsampled_blocks_are_gathered_in_growing_parts(spark, sf, monkeypatch):
    from tilescape.operators import raster
    from tilescape.plans import fixtures

    monkeypatch.setattr(fixtures, "SOURCE_ROWS", 10)
    table = fixtures.spark_table(spark, sf, "customer")
    parts = fixtures.parts_for(table)
    assert parts == -(-table.count() // 10)
    pixels = fixtures.fixture(spark, sf, "fx_wash")
    out = raster.box_downsample(pixels, 2, ["r"], parts=parts)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {parts})") + plan.count(f"RoundRobinPartitioning({parts})") >= 2  # source and blocks
    assert plan.count("Exchange") == 2  # blocks are not shuffled again
    want = raster.box_downsample(pixels, 2, ["r"])
    assert out.exceptAll(want).isEmpty() and want.exceptAll(out).isEmpty()


def test_party_walls_sort_only_ends(spark, sf):
    from tilescape.plans import QUERIES

    plan = QUERIES["wn16_party_walls"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    first = plan[plan.index("min("):].split("\n")[0]
    assert "before" not in first and "nx#" not in first


def test_voxels_are_shuffled_in_place_of_their_faces(spark):
    from tilescape.operators import voxels

    v = spark.createDataFrame([(t, x, 0, z, 1) for t in range(5) for x in range(3) for z in range(3)], "tx bigint, ix bigint, iy bigint, iz bigint, tag int")
    out = voxels.exposed_faces(v, parts=7)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(tx" in plan and ", 7)" in plan
    want = voxels.exposed_faces(v)
    assert out.count() == 5 * 30 and out.exceptAll(want).isEmpty() and want.exceptAll(out).isEmpty()
    p = v.selectExpr("tx", "ix", "iy + 9 as iy", "iz", "1 as cls")
    s = v.selectExpr("tx", "ix", "iz", "0L as gy")
    built = voxels.structure_voxels(p.union(p), s, 1.0, parts=7)
    assert built.count() == 45 and "hashpartitioning(tx" in built._jdf.queryExecution().executedPlan().toString()


def test_tags_are_merged_by_dealt_columns(spark):
    from tilescape.operators import voxels

    a = spark.createDataFrame([(1, x, y, 0, 1 + x % 2) for x in range(9) for y in range(4)], "tx bigint, ix bigint, iy bigint, iz bigint, tag int")
    b = a.filter("iy < 2").withColumn("tag", F.lit(3))
    out = voxels.merge_tags([a, b], tasks=7)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {tuple(r) for r in out.collect()} == {(1, x, y, 0, 3 if y < 2 else 1 + x % 2) for x in range(9) for y in range(4)}


def test_a_written_surface_is_not_broadcast(spark):
    from tilescape.operators import voxels
    from tilescape.session import cut

    # A written surface is a small file of many rows.
    s = cut(spark.range(4096).selectExpr("1L as tx", "id div 64 as ix", "id % 64 as iz", "0L as gy"))
    p = cut(s.selectExpr("tx", "ix", "9L as iy", "iz", "1 as cls"))
    v = cut(s.selectExpr("tx", "ix", "explode(array(7L, 9L)) as iy", "iz", "3 as tag"))
    ranges = spark.createDataFrame([(1, 0.0, 40)], "tx bigint, origin double, ny bigint").hint("merge")
    tops = voxels.column_tops(v, s, ranges, 1.0)
    assert tops.filter("top = 9").count() == 4096
    for out in (voxels.structure_voxels(p, s, 1.0), tops, voxels.infill(v, cut(tops))):
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_ring_stream_keeps_one_state_row_per_viewer(spark, tmp_path):
    from tilescape import streaming
    from tilescape.operators import tracks

    # Slow and fast viewers, rests, jumps back, gaps without a place; four files in order.
    moves = [(v, k, (k * v // 3) % 40 - 20, -(k * v // 5)) for v in range(1, 9) for k in range(60)]
    moves += [(20, k, 100 * (k // 3), -100 * k) for k in range(60)]
    moves += [(21, k, None if k % 7 == 3 else k // 4, None if k % 11 == 5 else 2 ** 60 + k) for k in range(60)]
    df = spark.createDataFrame(moves, "viewer bigint, seq bigint, cx bigint, cy bigint")
    for i in range(4):
        df.filter(F.expr(f"seq div 15 = {i}")).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    streaming.use_rocksdb(spark)
    for radius, margin in ((2, 1), (4, 2), (1, 0)):  # squares of 49 bits, of several words, and without a margin
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        out = streaming.ring_events_stream(source, "viewer", "seq", "cx", "cy", radius, margin)
        at = str(tmp_path / f"r{radius}")
        q = out.writeStream.format("parquet").option("path", f"{at}/d").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        got = spark.read.schema(out.schema).parquet(f"{at}/d").select("viewer", "tx", "ty", "event", "seq")
        want = tracks.ring_events(df, "viewer", "seq", "cx", "cy", radius, margin, size=20).select(got.columns)
        assert got.count() > 1000 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        assert states[-1] == 10, states  # not one per resident tile
