"""Percentiles by radix refinement against sorted values."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tilescape.operators import footprints, voxels
from tilescape.operators.percentiles import percentiles, scale_of, with_percentiles

WANTED = {"low": 0.05, "mid": 0.5, "top": 0.999, "least": 0.0, "most": 1.0}


def plain(values, share):
    at = (len(values) - 1) * share
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


def test_unquantised_heights_with_a_hot_key(spark):
    rnd = random.Random(3)
    rows = [(1, rnd.gauss(8.0, 3.0), 1) for _ in range(20000)] + [(1, 5.25, 1)] * 3000
    rows += [(2, v, 1) for v in (-3.5, -0.0, 0.0, 1e-320, -1e300, 1e300, 7.0)] + [(3, 4.0, 1)] + [(4, float(i), i + 1) for i in range(9)]
    rows += [(5, None, 4), (5, float("nan"), 4), (5, 2.0, 2)] + [(6, None, 1)]
    df = spark.createDataFrame(rows, "fid long, h double, n long").repartition(8)
    got = {r.fid: r for r in percentiles(df, ["fid"], WANTED).collect()}
    want = {}
    for fid, h, n in rows:
        if h is not None and h == h:
            want.setdefault(fid, []).extend([h] * n)
    assert set(got) == set(want)
    for fid, values in want.items():
        values.sort()
        assert got[fid].n_total == len(values)
        for name, share in WANTED.items():
            assert got[fid][name] == plain(values, share), (fid, name)
    assert with_percentiles(df, ["fid"], {"mid": 0.5}).count() == len(rows) - 1  # key 6 knows no value


def test_no_window_of_a_key_holds_its_values(spark):
    """Bins of the first pass, and bins inside one bin in the second, for half a million different heights."""
    rows = spark.range(500_000).select((F.rand(5) * 40 - 2).alias("h"))
    bins = rows.select(F.floor(scale_of(F.col("h")) * 16).alias("c"), F.floor(scale_of(F.col("h")) * 2 ** 20).alias("f"))
    assert bins.select("c").distinct().count() < 2000
    assert bins.groupBy("c").agg(F.countDistinct("f").alias("n")).agg(F.max("n")).first()[0] <= 65536
    assert bins.groupBy("f").count().agg(F.max("count")).first()[0] < 50


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=60))
def test_scale_never_falls(spark, values):
    more = sorted({w for v in values for w in (v, math.nextafter(v, math.inf), math.nextafter(v, -math.inf), *(float(np.ldexp(1.0, k)) for k in (0, 1, 7, 29)))})
    df = spark.createDataFrame([(i, v) for i, v in enumerate(more)], "i long, v double")
    scales = [r.s for r in df.select("i", scale_of(F.col("v")).alias("s")).orderBy("i").collect()]
    assert all(a <= b for a, b in zip(scales, scales[1:]))


def test_roofs_and_ranges_of_unquantised_points(spark):
    rnd = random.Random(9)
    heights = [rnd.uniform(0, 1) for _ in range(200)] + [rnd.uniform(6, 11) for _ in range(800)]
    hist = spark.createDataFrame([(7, h, 1, rnd.random(), 0.0, 1.0, 1.0, 0.0) for h in heights], "fid long, h double, n long, sx double, sy double, sxx double, syy double, sxy double")
    got = footprints.roof_profiles(hist, ["fid"]).collect()
    ordered = sorted(heights)
    ground = plain(ordered, 0.05)
    body = [h for h in ordered if h > ground + 2.0]
    top = [h for h in body if h >= plain(body, 0.95)]
    assert len(got) == 1 and (got[0].ground, got[0].eave, got[0].ridge) == (ground, plain(body, 0.15), plain(top, 0.5))
    assert (got[0].structure, got[0].top) == (len(body), len(top))
    points = spark.createDataFrame([(1, h) for h in heights], "tx long, z double")
    r = voxels.vertical_range(points, 0.5).collect()
    assert [x.origin for x in r] == [pytest.approx(plain(ordered, 0.01) - 1.0)]


def test_no_values(spark):
    assert percentiles(spark.createDataFrame([], "fid long, h double, n long"), ["fid"], WANTED).count() == 0
