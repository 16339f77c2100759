"""Queries over tracks, requests and traces."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tilescape import streaming
from tilescape.operators import coverage, tracks
from tilescape.session import checkpoint_dir

from .fixtures import fixture, spark_table
from .registry import query

CHUNK = 1000  # small here so that tracks span several chunks

POSES = "(select *, x_m // 40 as cx, z_m // 40 as cy from {fx_poses}) p"


def poses(spark, sf):
    return fixture(spark, sf, "fx_poses").withColumns({"cx": F.expr("x_m div 40"), "cy": F.expr("z_m div 40")})


@query("sm1_wanted_ring", f"""
    select seq, cx + dx as tx, cy + dy as ty from {POSES}, (select unnest(generate_series(-2, 2)) as dx) a, (select unnest(generate_series(-2, 2)) as dy) b""")
def sm1(spark, sf):
    return tracks.wanted_ring(poses(spark, sf), "cx", "cy").select("seq", "tx", "ty")


def drift(spark, sf):
    """Slowly moving viewers, so rings overlap from step to step."""
    return fixture(spark, sf, "fx_poses").select(F.col("track_id").alias("viewer"), "seq", F.expr("(seq + track_id * 97) div 400").alias("cx"),
                                                 F.expr("(seq * track_id) div 90000").alias("cy"))


SM2_SQL = """
    with p as (select track_id as viewer, seq, (seq + track_id * 97) // 400 as cx, (seq * track_id) // 90000 as cy,
                      row_number() over (partition by track_id order by seq) as k from {fx_poses}),
         near as (select viewer, k, seq, cx + dx as tx, cy + dy as ty, greatest(abs(dx), abs(dy)) <= 2 as inside
                  from p, (select unnest(generate_series(-3, 3)) as dx) a, (select unnest(generate_series(-3, 3)) as dy) b),
         isl as (select *, k - row_number() over (partition by viewer, tx, ty order by k) as island from near),
         span as (select viewer, tx, ty, min(case when inside then seq end) as load_at, max(k) as last_k from isl group by viewer, tx, ty, island)
    select viewer, tx, ty, 'load' as event, load_at as seq from span where load_at is not null
    union all select s.viewer, tx, ty, 'evict', p.seq from span s join p on p.viewer = s.viewer and p.k = s.last_k + 1 where load_at is not null"""


@query("sm2_ring_events", SM2_SQL)
def sm2(spark, sf):
    return tracks.ring_events(drift(spark, sf), "viewer", "seq", "cx", "cy", size=CHUNK)


@query("sm3_request_dedupe", "select tile, viewer, min(seq) as seq from {fx_requests} group by 1, 2")
def sm3(spark, sf):
    return tracks.drop_repeats(fixture(spark, sf, "fx_requests").select("tile", "viewer", "seq"), ["tile", "viewer"], "seq")


SM4_SQL = """
    with g as (select *, sum(ok) over (partition by tile order by seq) as grp from {fx_requests})
    select tile, seq, cast(sum(1 - ok) over (partition by tile, grp order by seq) as bigint) as failures,
           ok = 0 and sum(1 - ok) over (partition by tile, grp order by seq) = 3 as hole from g"""


@query("sm4_retry_budget", SM4_SQL)
def sm4(spark, sf):
    out = tracks.retry_budget(fixture(spark, sf, "fx_requests"), ["tile"], "seq", F.col("ok") == 0, size=CHUNK)
    return out.select("tile", "seq", F.col("failures").cast("bigint").alias("failures"), "hole")


def stuck_samples(spark, sf):
    return spark_table(spark, sf, "events").select(
        F.col("user_id").alias("track_id"), F.col("event_id").alias("seq"), (F.col("event_id") * 13 % 100).alias("actual"),
        F.lit(350).alias("commanded"), (F.col("event_type") != "signup").alias("contact"), F.lit(0.3).alias("dt"))


STUCK = """with recursive s as (select user_id as track_id, event_id as seq, event_id * 13 % 100 as actual, event_type <> 'signup' as contact,
        row_number() over (partition by user_id order by event_id) as k from events),
    f as (select *, actual < 87.5e0 and contact and coalesce(lag(contact) over (partition by track_id order by seq), false) as stuck_now from s),
    r as (select track_id, seq, k, greatest(0e0, case when stuck_now then 0.3e0 else -0.75e0 end) as stuck from f where k = 1
          union all select f.track_id, f.seq, f.k, greatest(0e0, r.stuck + case when f.stuck_now then 0.3e0 else -0.75e0 end)
          from r join f on f.track_id = r.track_id and f.k = r.k + 1)"""


@query("sm5_stuck_time", f"{STUCK} select track_id, seq, round(stuck, 6) as stuck, stuck > 1.4e0 as fires from r")
def sm5(spark, sf):
    # Steps are multiples of 0.15 s, so 1.4 s separates the same samples as the reference trigger of 1.3 s.
    out = tracks.stuck_time(stuck_samples(spark, sf), ["track_id"], "seq", "actual", "commanded", "contact", "dt", trigger=1.4, size=CHUNK)
    return out.select("track_id", "seq", F.round("stuck", 6).alias("stuck"), "fires")


@query("sm5_first_firing", f"""{STUCK}
    select track_id, min(case when stuck > 1.4e0 then seq end) as fired_at,
           round(coalesce(min_by(stuck, seq) filter (stuck > 1.4e0), max(stuck)), 6) as peak from r group by 1""")
def sm5_first(spark, sf):
    out = tracks.stuck_time(stuck_samples(spark, sf), ["track_id"], "seq", "actual", "commanded", "contact", "dt", trigger=1.4, size=CHUNK)
    return tracks.first_firing(out, ["track_id"], "seq").withColumn("peak", F.round("peak", 6))


@query("sm6_deferred_release", """
    with i as (select seq, tile from {fx_requests} where ok = 1), g as (select tile, min(seq) as opened from {fx_requests} where etype = 'signup' group by 1)
    select seq, tile, case when opened is not null then greatest(seq, opened) end as released_at from i left join g using (tile)""")
def sm6(spark, sf):
    r = fixture(spark, sf, "fx_requests")
    gates = r.filter("etype = 'signup'").select("tile", F.col("seq").alias("gate_seq"))
    return tracks.released(r.filter("ok = 1").select("seq", "tile"), gates, ["tile"], "seq", "gate_seq")


@query("sm7_displacement", """
    select track_id, seq, round(sqrt((x_m - lag(x_m) over w) ** 2 + (z_m - lag(z_m) over w) ** 2), 6) as moved
    from {fx_poses} window w as (partition by track_id order by seq)""")
def sm7(spark, sf):
    out = tracks.displacement(fixture(spark, sf, "fx_poses"), ["track_id"], "seq", "x_m", "z_m", CHUNK)
    return out.select("track_id", "seq", F.round("moved", 6).alias("moved"))


@query("jn24_interpolated_poses", """
    with n as (select track_id, seq, x_m, z_m, speed_c / 100e0 as yaw, speed_c / 70e0 as roll, lead(seq) over w as s1, lead(x_m) over w as x1, lead(z_m) over w as z1,
                      lead(speed_c / 100e0) over w as yaw1, lead(speed_c / 70e0) over w as roll1 from {fx_poses} window w as (partition by track_id order by seq)),
         g as (select *, unnest(generate_series(((seq + 49) // 50) * 50, ((s1 - 1) // 50) * 50, 50)) as at_seq from n where s1 is not null),
         t as (select *, (at_seq - seq) / (s1 - seq)::double as t, fmod(yaw1 - yaw, 2 * pi()) as d, fmod(roll1 - roll, 2 * pi()) as e from g)
    select track_id, at_seq, round(x_m + (x1 - x_m) * t, 4) as x_m, round(z_m + (z1 - z_m) * t, 4) as z_m,
           round(roll + t * case when e > pi() then e - 2 * pi() when e < -pi() then e + 2 * pi() else e end, 4) as roll,
           round(yaw + t * case when d > pi() then d - 2 * pi() when d < -pi() then d + 2 * pi() else d end, 4) as yaw from t""")
def jn24(spark, sf):
    p = fixture(spark, sf, "fx_poses").withColumns({"yaw": F.col("speed_c") / 100.0, "roll": F.col("speed_c") / 70.0})
    out = tracks.interpolate(p, ["track_id"], "seq", 50, ["x_m", "z_m"], ["yaw", "roll"], CHUNK)
    return out.select("track_id", F.col("at").alias("at_seq"), *[F.round(c, 4).alias(c) for c in ("x_m", "z_m", "yaw", "roll")])


# Deviations are planted in four of the seven components; every fourth trace lacks samples.
TRACE = {"px": "x_m", "py": "z_m", "pz": "x_m + z_m", "yaw": "speed_c / 100.0e0", "pitch": "x_m % 7", "roll": "z_m % 5", "speed": "speed_c / 10.0e0"}
OFF = {"px": "case when seq % 997 = 5 then 1 else 0 end", "py": "case when seq % 499 = 7 then -2 else 0 end", "pitch": "case when seq % 211 = 9 then 0.5e0 else 0 end",
       "speed": "case when seq % 89 = 3 then 1e-5 when seq % 83 = 1 then 1e-7 else 0 end"}
LACKS = "track_id % 4 = 1 and seq % 10 = 3"


@query("cp1_trace_difference", f"""
    with d as (select track_id as scenario, seq as f, {LACKS} as lacks, case {' '.join(f"when abs({OFF[c]}) > 1e-6 then '{c}'" for c in TRACE if c in OFF)} end as component,
                      case {' '.join(f"when abs({OFF[c]}) > 1e-6 then abs({OFF[c]}) * 1e0" for c in TRACE if c in OFF)} end as delta from {{fx_poses}}),
         x as (select scenario, sum(case when lacks then 1 else 0 end) as unmatched, min(f) filter (not lacks and component is not null) as first_sample,
                      min_by(component, f) filter (not lacks and component is not null) as component, min_by(delta, f) filter (not lacks and component is not null) as delta from d group by 1)
    select scenario, cast(unmatched as bigint) as unmatched, case when unmatched = 0 then first_sample end as first_sample, case when unmatched = 0 then component end as component,
           case when unmatched = 0 then round(delta, 8) end as delta from x""")
def cp1(spark, sf):
    p = fixture(spark, sf, "fx_poses")
    expected = p.select(F.col("track_id").alias("scenario"), F.col("seq").alias("f"), *[F.expr(v).alias(c) for c, v in TRACE.items()])
    actual = p.filter(f"not ({LACKS})").select(F.col("track_id").alias("scenario"), F.col("seq").alias("f"),
                                               *[F.expr(f"{v} + {OFF.get(c, '0')}").alias(c) for c, v in TRACE.items()])
    return tracks.trace_difference(actual, expected).withColumn("delta", F.round("delta", 8))


# -- The same on streams: the event table is read as a file stream and drained ----

def drained(spark, sf, build):
    """Run a streaming query over the events to completion and read its sink."""
    streaming.use_rocksdb(spark)
    out = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark_table(spark, sf, "events").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/events.parque[t]")  # a pattern may be a file or a folder of files
    stream = build(source)
    (stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/log")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


@query("sm2_ring_events_stream", SM2_SQL)
def sm2_stream(spark, sf):
    moves = lambda e: e.select(F.col("user_id").alias("viewer"), F.col("event_id").alias("seq"), F.expr("(event_id + user_id * 97) div 400").alias("cx"),
                               F.expr("(event_id * user_id) div 90000").alias("cy"))
    return drained(spark, sf, lambda e: streaming.ring_events_stream(moves(e), "viewer", "seq", "cx", "cy"))


@query("sm4_retry_budget_stream", SM4_SQL)
def sm4_stream(spark, sf):
    asks = lambda e: e.select((F.col("user_id") % 20).alias("tile"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"))
    return drained(spark, sf, lambda e: streaming.retry_budget_stream(asks(e), "tile", "seq", "failed"))


@query("sm5_stuck_time_stream", f"{STUCK} select track_id, seq, round(stuck, 6) as stuck, stuck > 1.4e0 as fires from r")
def sm5_stream(spark, sf):
    poses_ = lambda e: e.select(F.col("user_id").alias("track_id"), F.col("event_id").alias("seq"), (F.col("event_id") * 13 % 100).alias("actual"),
                                F.lit(350).alias("commanded"), (F.col("event_type") != "signup").alias("contact"), F.lit(0.3).alias("dt"))
    out = drained(spark, sf, lambda e: streaming.stuck_stream(poses_(e), "track_id", "seq", "actual", "commanded", "contact", "dt", trigger=1.4))
    return out.withColumn("stuck", F.round("stuck", 6))


# -- Coverage -----------------------------------------------------------------

@query("jn2_missing_nodes", """
    with need as (select distinct tx, ty from {fx_coverage}), have as (select distinct tx, ty from {fx_coverage} where layer <> 'wash')
    select n.tx, n.ty from need n left join have h using (tx, ty) where h.tx is null""")
def jn2(spark, sf):
    c = fixture(spark, sf, "fx_coverage")
    return coverage.missing(c.select("tx", "ty"), c.filter("layer <> 'wash'"), ["tx", "ty"])


@query("jn13_coverage_lookup", """
    with z12 as (select distinct tx // 16 as tx, ty // 16 as ty from {fx_coverage} where layer = 'terrain'),
         ask as (select distinct o_custkey % 6 + 2615 as tx, o_orderkey % 4 + 6330 as ty from orders)
    select ask.tx, ask.ty, z12.tx is not null as covered from ask left join z12 using (tx, ty)""")
def jn13(spark, sf):
    ask = spark_table(spark, sf, "orders").select((F.col("o_custkey") % 6 + 2615).alias("tx"), (F.col("o_orderkey") % 4 + 6330).alias("ty")).distinct()
    return coverage.covered_parents(ask, fixture(spark, sf, "fx_coverage"), "terrain", 4)


@query("jn14_readiness", """
    with listed as (select tx, ty from {fx_coverage} where layer = 'terrain'), loaded as (select tx, ty from {fx_coverage} where layer = 'trees'),
         ask as (select distinct tx // 16 as px, ty // 16 as py from {fx_coverage})
    select px, py, not exists (select 1 from listed l left join loaded d using (tx, ty) where d.tx is null and l.tx // 16 = px and l.ty // 16 = py) as ready from ask""")
def jn14(spark, sf):
    c = fixture(spark, sf, "fx_coverage")
    ask = c.select(F.expr("tx div 16").alias("px"), F.expr("ty div 16").alias("py")).distinct()
    return coverage.ready_parents(ask, c.filter("layer = 'terrain'"), c.filter("layer = 'trees'"), 4)


@query("jn15_procedural_trees", """
    with real as (select tx + 1 as tx, 'real' as src from {fx_records}), made as (select tx, 'made' as src from {fx_footprints})
    select tx, count(*) as n, sum(case when src = 'real' then 1 else 0 end)::bigint as real from (
        select * from real union all select * from made where tx not in (select tx from real)) u group by 1""")
def jn15(spark, sf):
    real = fixture(spark, sf, "fx_records").select((F.col("tx") + 1).alias("tx"), F.lit("real").alias("src"))
    made = fixture(spark, sf, "fx_footprints").select("tx", F.lit("made").alias("src"))
    return (coverage.prefer_baked(real, made, ["tx"]).groupBy("tx")
            .agg(F.count("*").alias("n"), F.sum(F.when(F.col("src") == "real", 1).otherwise(0)).alias("real")))


@query("st1_union_extracts", """
    select fid, count(*) as n from (select fid from {fx_footprints} where x0_cm < 3500 union all select fid from {fx_footprints} where x0_cm > 2500) u group by 1""")
def st1(spark, sf):
    f = fixture(spark, sf, "fx_footprints")
    parts = [f.filter("x0_cm < 3500").select("fid"), f.filter("x0_cm > 2500").select("fid")]
    return coverage.union_all(parts).groupBy("fid").agg(F.count("*").alias("n"))


@query("st2_distinct_tiles", "select distinct tx, ty from {fx_coverage}")
def st2(spark, sf):
    return coverage.distinct_tiles(fixture(spark, sf, "fx_coverage"), ["tx", "ty"])


@query("st3_manifest_difference", """
    select layer, tx, ty, 'not on disk' as finding from (select * from {fx_coverage} except all select * from {fx_disk}) a
    union all select layer, tx, ty, 'not listed' from (select * from {fx_disk} except all select * from {fx_coverage}) b""")
def st3(spark, sf):
    return coverage.manifest_difference(fixture(spark, sf, "fx_coverage"), fixture(spark, sf, "fx_disk"))


@query("sm3_request_dedupe_stream", "select distinct user_id as viewer, user_id % 20 as tile from events")
def sm3_stream(spark, sf):
    asks = lambda e: e.select(F.col("user_id").alias("viewer"), (F.col("user_id") % 20).alias("tile"), "ts")
    return drained(spark, sf, lambda e: streaming.dedupe_requests(asks(e), ["viewer", "tile"], "ts", "10000 days")).select("viewer", "tile")


@query("sm6_deferred_release_stream", """
    select i.user_id as viewer, i.event_id as seq, epoch_us(g.ts) as opened_us from events i join events g
    on i.user_id = g.user_id and i.event_type = 'click' and g.event_type = 'signup' and g.ts between i.ts - interval 12 hours and i.ts + interval 12 hours""")
def sm6_stream(spark, sf):
    def build(e):
        items = e.filter("event_type = 'click'").select(F.col("user_id").alias("viewer"), F.col("event_id").alias("seq"), "ts")
        gates = e.filter("event_type = 'signup'").select(F.col("user_id").alias("viewer"), F.col("ts").alias("opened"))
        return streaming.release_when_open(items, gates, "viewer", "ts", "opened", "12 hours", "10000 days").filter("opened is not null")

    return drained(spark, sf, build).select("viewer", "seq", F.unix_micros("opened").alias("opened_us"))
