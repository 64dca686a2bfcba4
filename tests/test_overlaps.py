"""The interval-overlap join against plain Python."""

import random

import pytest

from ledgerlens.operators.traces import interrupted_outputs, overlaps


@pytest.mark.parametrize("bin_ms", [1, 7, 50, 10_000])
def test_every_pair_once(spark, bin_ms):
    r = random.Random(bin_ms)
    make = lambda n: [(i, r.choice([1, 1, 1, 2, None]), s := r.randint(-60, 60), s + r.choice([0, 1, 5, 30, -2])) for i in range(n)]
    left, right = make(60) + [(100, 1, -60, 60), (101, 1, None, 5)], make(50) + [(100, 1, -7, 7), (100, 1, -7, 7), (102, 1, 3, None)]
    schema = "id long, user long, start_ms long, end_ms long"
    got = [(x.l_id, x.r_id, x.overlap_ms) for x in overlaps(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["user"], bin_ms).collect()]
    full = lambda t: t[1] is not None and t[2] is not None and t[3] is not None and t[2] < t[3]
    want = [(a[0], b[0], min(a[3], b[3]) - max(a[2], b[2])) for a in filter(full, left) for b in filter(full, right) if a[1] == b[1] and a[2] < b[3] and b[2] < a[3]]
    assert sorted(got) == sorted(want)
    plan = overlaps(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["user"], bin_ms)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_an_output_with_several_stretches_of_speech(spark):
    schema = "turn_id long, user_id long, session_no long, start_ms long, end_ms long"
    played = spark.createDataFrame([(1, 7, 1, 1000, 9000), (2, 7, 1, 20_000, 21_000), (3, 7, 2, 1000, 9000)], schema)
    spoken = spark.createDataFrame([(1, 7, 1, 0, 1500), (1, 7, 1, 3000, 4000), (4, 7, 1, 8999, 12_000), (4, 8, 1, 0, 99_999), (5, 7, 1, 9000, 9500)], schema)
    got = [tuple(x) for x in interrupted_outputs(played, spoken).collect()]
    assert got == [(1, 3, 500 + 1000 + 1, 0)]
