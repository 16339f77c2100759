"""Files in and out, and streams against their batch twins."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tilescape import sinks, sources, streaming
from tilescape.operators import coverage, tracks
from tilescape.session import checkpoint_dir


def test_tree_documents_round_trip(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(2621 + i % 3, 6331, rnd.randrange(10 ** 6), rnd.randrange(10 ** 6), rnd.randrange(300), rnd.randrange(100)) for i in range(500)] + [(2621, 6331, 5, 6, 7, 8)] * 90
    df = spark.createDataFrame(rows, "tx bigint, ty bigint, lon_e7 bigint, lat_e7 bigint, height_dm bigint, crown_dm bigint")
    assert {(r.tx, r.part) for r in sinks.tree_documents(df).collect()} == {(2621 + i, 0) for i in range(3)}
    docs = sinks.tree_documents(df, buckets=8)
    assert max(r.n for r in docs.collect()) < 60 and docs.count() == 24  # copies are spread as well
    assert docs.agg(F.sum("n")).collect()[0][0] == len(rows)
    sinks.write_documents(docs, str(tmp_path / "trees"), layer="trees", zoom=14)
    text = sources.read_text(spark, str(tmp_path / "trees"))
    lines_ = text.select(F.explode(F.split("value", "\n")).alias("line")).filter("line <> ''").collect()
    back = [t for r in lines_ for t in json.loads(r.line)["trees"]]
    assert sorted(map(tuple, back)) == sorted(r[2:] for r in rows)
    found = sinks.coverage_of_paths(sinks.scan_assets(spark, str(tmp_path)))
    assert {(r.layer, r.zoom, r.tx, r.ty) for r in found.collect()} == {("trees", 14, 2621 + i, 6331) for i in range(3)}


def test_reader_validation(spark, tmp_path):
    (tmp_path / "2621").mkdir()
    good = {"trees": [[-1223900000, 377900000, 85, 30]]}
    for name, doc in (("1", json.dumps(good)), ("2", '{"trees": [[1, 2, 3]]}'), ("3", '{"trees": [[1, 2, 3, "x"]]}'), ("4", '{"other": 1}'), ("5", "not json")):
        (tmp_path / "2621" / f"{name}.json").write_text(doc)
    text = sources.read_text(spark, str(tmp_path))
    assert [tuple(r) for r in sources.tree_rows(text).collect()] == [(2621, 1, -1223900000, 377900000, 85, 30)]
    assert sorted(r.ty for r in sources.rejected_trees(text).collect()) == [2, 3, 4, 5]


def test_rejected_documents_of_every_kind(spark):
    good = {"trees": {"trees": []}, "roofs": {"roofs": []}, "paint": {}, "manifest": {"trees": {"tiles": []}}, "elements": {"elements": []}, "pins": {"pins": []},
            "places": {"features": []}, "trace": {"samples": []}}
    bad = {"trees": {"trees": 4}, "roofs": {"roofs": [{"at": [1]}]}, "paint": {"ribbons": {}}, "manifest": {"trees": {"zoom": 3}}, "elements": {}, "pins": {"pin": []}, "places": {"features": 1}, "trace": {}}
    for kind in good:
        rows = [("/1/1.json", json.dumps(good[kind])), ("/1/2.json", json.dumps(bad[kind])), ("/1/3.json", "no json")]
        got = sources.rejected(spark.createDataFrame(rows, "path string, value string"), kind)
        assert sorted(map(tuple, got.collect())) == [("/1/2.json", "unexpected shape"), ("/1/3.json", "not a JSON object")], kind


def test_stream_reads_a_table_of_many_files(spark, sf, tmp_path):
    from tilescape.plans.registry import QUERIES
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("sm4_retry_budget_stream",):
        assert QUERIES[name](spark, str(tmp_path)).count() == QUERIES[name](spark, sf).count() > 0


def test_roofs_paint_pins_manifest(spark):
    doc = lambda value, path="/a/2621/6331.json": spark.createDataFrame([(path, json.dumps(value))], "path string, value string")
    roof = {"at": [1, 2], "shape": 1, "eave_dm": 50, "rise_dm": 10, "ridge_cdeg": 900}
    assert sources.roof_rows(doc({"roofs": [roof]})).count() == 1
    assert sources.roof_rows(doc({"roofs": [roof, {**roof, "shape": 3}]})).count() == 0
    assert sources.paint_parts(doc({"ribbons": [{"kind": "path", "width_dm": 20, "path": [[1, 2], [3, 4]]}]}))["ribbons"].count() == 1
    assert sources.paint_parts(doc({"ribbons": {"kind": "path"}}))["ribbons"].count() == 0
    pins = sources.pin_rows(doc({"pins": [{"name": "A", "lat": 1.0, "lon": 2.0}, {"name": "B", "lat": None, "lon": 1.0}, {"name": "C", "lat": 1.0, "lon": 1.0, "tier": 9, "kind": "city"}]}))
    assert sorted((r.name, r.kind, r.tier) for r in pins.collect()) == [("A", "landmark", 3), ("C", "city", 3)]
    cov = sources.coverage_rows(doc({"trees": {"zoom": 14, "tiles": ["1/2", "14/3/4"]}, "terrain": {"zoom": 15, "tiles": ["9/9"]}, "paint": {"tiles": []}}))
    assert sorted((r.layer, r.tx, r.ty) for r in cov.collect()) == [("trees", 1, 2), ("trees", 3, 4)]


def test_manifest_always_lists_required_layers(spark):
    cov = spark.createDataFrame([("trees", 14, 1, 2), ("trees", 14, 1, 10)], "layer string, zoom int, tx bigint, ty bigint")
    got = json.loads(sinks.manifest_json(cov).collect()[0].json)
    assert got == {"trees": {"zoom": 14, "tiles": ["1/10", "1/2"]}, "terrain": {"zoom": 16, "tiles": []}, "paint": {"zoom": 14, "tiles": []}}


def test_completeness_raises(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    coverage.require_complete(a, a, ["k"])
    with pytest.raises(ValueError, match="1 keys missing"):
        coverage.require_complete(a, a.filter("k = 1"), ["k"])


@pytest.fixture(scope="module")
def batches(spark, sf):
    """Events as five files in sequence order, to be read one per trigger."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = f"{checkpoint_dir(spark)}/events-{random.randrange(10 ** 9)}"
    for i in range(5):
        events.filter(F.expr(f"event_id div 200 = {i}")).coalesce(1).write.mode("append").parquet(f"{folder}/part={i}")
    return events, folder


def drain(spark, batches, build, name):
    streaming.use_rocksdb(spark)
    events, folder = batches
    stream = build(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder))
    out = f"{checkpoint_dir(spark)}/{name}-{random.randrange(10 ** 9)}"
    q = stream.writeStream.format("parquet").option("path", f"{out}/d").option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/d")


def test_ring_stream_equals_batch_over_many_triggers(spark, batches):
    moves = lambda e: e.select(F.col("user_id").alias("viewer"), F.col("event_id").alias("seq"), F.expr("event_id div 90").alias("cx"), F.expr("event_id * user_id div 9000").alias("cy"))
    got = drain(spark, batches, lambda e: streaming.ring_events_stream(moves(e), "viewer", "seq", "cx", "cy"), "ring")
    want = tracks.ring_events(moves(batches[0]), "viewer", "seq", "cx", "cy", size=100)
    key = lambda df: sorted((r.viewer, r.tx, r.ty, r.event, r.seq) for r in df.collect())
    assert key(got) == key(want)


def test_retry_and_stuck_streams_equal_batch(spark, batches):
    asks = lambda e: e.select((F.col("user_id") % 3).alias("tile"), F.col("event_id").alias("seq"), F.col("event_type").isin("error", "click", "view").alias("failed"))
    got = drain(spark, batches, lambda e: streaming.retry_budget_stream(asks(e), "tile", "seq", "failed"), "retry")
    want = tracks.retry_budget(asks(batches[0]), ["tile"], "seq", F.col("failed"), size=100)
    key = lambda df: sorted((r.tile, r.seq, r.failures, r.hole) for r in df.collect())
    assert key(got) == key(want)
    poses = lambda e: e.select((F.col("user_id") % 4).alias("track"), F.col("event_id").alias("seq"), (F.col("event_id") * 13 % 100).alias("actual"), F.lit(350).alias("commanded"),
                               (F.col("event_type") != "signup").alias("contact"), F.lit(0.25).alias("dt"))
    got = drain(spark, batches, lambda e: streaming.stuck_stream(poses(e), "track", "seq", "actual", "commanded", "contact", "dt"), "stuck")
    want = tracks.stuck_time(poses(batches[0]), ["track"], "seq", "actual", "commanded", "contact", "dt", size=100)
    key = lambda df: sorted((r.track, r.seq, round(r.stuck, 6), r.fires) for r in df.collect())
    assert key(got) == key(want)


def test_dedupe_stream(spark, batches):
    got = drain(spark, batches, lambda e: streaming.dedupe_requests(e.select("user_id", "ts"), ["user_id"], "ts", "60 days"), "dedupe")
    assert got.count() == batches[0].select("user_id").distinct().count()


def test_release_stream_joins_gates(spark, batches):
    items = lambda e: e.filter("event_type = 'view'").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    gates = lambda e: e.filter("event_type = 'signup'").select("user_id", F.col("ts").cast("timestamp").alias("opened"))
    got = drain(spark, batches, lambda e: streaming.release_when_open(items(e), gates(e), "user_id", "ts", "opened", "12 hours", "40 days").filter("opened is not null"), "gate")
    e = batches[0]
    want = items(e).join(gates(e), "user_id").filter("opened between ts - interval 12 hours and ts + interval 12 hours")
    assert sorted((r.event_id, r.opened) for r in got.collect()) == sorted((r.event_id, r.opened) for r in want.collect())


@pytest.fixture(scope="module")
def disordered(spark, sf):
    """Events of two seconds each in six files, up to 90 places out of order; then a row days later and one that comes too late."""
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type").filter("event_id < 1000")
    rows = rows.withColumns({"at": F.timestamp_seconds(F.col("event_id") * 2 + 1_700_000_000), "file": F.expr("(event_id + event_id * 37 % 90) div 200")})
    folder = f"{checkpoint_dir(spark)}/disordered-{random.randrange(10 ** 9)}"
    for i in range(6):
        rows.filter(F.col("file") == i).orderBy(F.rand(i)).coalesce(1).write.mode("append").parquet(f"{folder}/part={i}")
    extra = lambda n, seconds, user: spark.createDataFrame([(n, user, "error")], "event_id long, user_id long, event_type string").withColumns(
        {"at": F.timestamp_seconds(F.lit(1_700_000_000 + seconds)), "file": F.expr("0L div 1")}).select([F.col(f.name).cast(f.dataType) for f in rows.schema])
    extra(10 ** 6, 900_000, -1).coalesce(1).write.parquet(f"{folder}/part=6")
    extra(5, 10, -2).coalesce(1).write.parquet(f"{folder}/part=7")
    extra(10 ** 6 + 1, 900_001, -1).coalesce(1).write.parquet(f"{folder}/part=8")
    return rows, folder


def drain_disordered(spark, disordered, build, name):
    streaming.use_rocksdb(spark)
    rows, folder = disordered
    stream = build(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder))
    out = f"{checkpoint_dir(spark)}/{name}-{random.randrange(10 ** 9)}"
    q = stream.writeStream.format("parquet").option("path", f"{out}/d").option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    states = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    return spark.read.schema(stream.schema).parquet(f"{out}/d"), states


def test_rows_out_of_order_wait_for_the_watermark(spark, disordered):
    rows = disordered[0]
    asks = lambda e: e.select((F.col("user_id") % 7).alias("tile"), F.col("event_id").alias("seq"), F.col("event_type").isin("error", "click", "view").alias("failed"), "at")
    got, states = drain_disordered(spark, disordered, lambda e: streaming.retry_budget_stream(asks(e), "tile", "seq", "failed", ts="at", delay="10 minutes", idle=3600), "late-retry")
    want = tracks.retry_budget(asks(rows), ["tile"], "seq", F.col("failed"), size=100)
    key = lambda df: sorted((r.tile, r.seq, r.failures, r.hole) for r in df.collect())
    assert key(got) == key(want)
    assert sum(s["numRowsDroppedByWatermark"] for s in states) == 1  # the row that came too late
    held = [s["numRowsTotal"] for s in states]
    assert max(held) >= 14 and held[-1] <= 4, held  # seven keys with rows and a count; then only the last key's rows and timers


def test_ring_and_stuck_streams_out_of_order(spark, disordered):
    rows = disordered[0]
    moves = lambda e: e.select((F.col("user_id") % 5).alias("viewer"), F.col("event_id").alias("seq"), F.expr("event_id div 90").alias("cx"), F.expr("event_id * user_id div 9000").alias("cy"), "at")
    got, _ = drain_disordered(spark, disordered, lambda e: streaming.ring_events_stream(moves(e), "viewer", "seq", "cx", "cy", ts="at"), "late-ring")
    want = tracks.ring_events(moves(rows), "viewer", "seq", "cx", "cy", size=100)
    key = lambda df: sorted((r.viewer, r.tx, r.ty, r.event, r.seq) for r in df.collect())
    assert key(got) == key(want)
    poses = lambda e: e.select((F.col("user_id") % 4).alias("track"), F.col("event_id").alias("seq"), (F.col("event_id") * 13 % 100).alias("actual"), F.lit(350).alias("commanded"),
                               (F.col("event_type") != "signup").alias("contact"), F.lit(0.25).alias("dt"), "at")
    got, _ = drain_disordered(spark, disordered, lambda e: streaming.stuck_stream(poses(e), "track", "seq", "actual", "commanded", "contact", "dt", ts="at"), "late-stuck")
    want = tracks.stuck_time(poses(rows), ["track"], "seq", "actual", "commanded", "contact", "dt", size=100)
    key = lambda df: sorted((r.track, r.seq, round(r.stuck, 6), r.fires) for r in df.collect())
    assert key(got) == key(want)


def test_idle_keys_start_over(spark, tmp_path):
    """A key without rows for the idle time has no failures left; one in use keeps its count."""
    asks = "tile long, seq long, failed boolean, at timestamp"
    for i, group in enumerate([[(1, 1, 0), (1, 2, 1), (2, 3, 2)], [(2, 4, 3000)], [(2, 5, 6000)], [(1, 6, 7000), (2, 7, 7001)], [(3, 8, 20000)], [(3, 9, 20001)]]):
        df = spark.createDataFrame([(t, n, True, s) for t, n, s in group], "tile long, seq long, failed boolean, s long")
        df.select("tile", "seq", "failed", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("at")).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    streaming.use_rocksdb(spark)
    source = spark.readStream.schema(asks).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = streaming.retry_budget_stream(source, "tile", "seq", "failed", ts="at", delay="1 minute", idle=4000)
    out.writeStream.format("parquet").option("path", str(tmp_path / "d")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.tile, r.seq, r.failures) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "d")).collect())
    assert got == [(1, 1, 1), (1, 2, 2), (1, 6, 1), (2, 3, 1), (2, 4, 2), (2, 5, 3), (2, 7, 4)]
