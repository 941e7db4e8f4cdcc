"""Interval algebra: golden cases, and a model of integer points."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelake.operators import intervals as iv
from tracelake.plans.extractors import active, everything, from_config, nothing, spanned

SCHEMA = "episode string, start_ns bigint, end_ns bigint"


def table(spark, pairs):
    return spark.createDataFrame([("e", a, b) for a, b in pairs], SCHEMA)


def pairs(df):
    return sorted((r.start_ns, r.end_ns) for r in df.collect())


@pytest.mark.parametrize(
    "given_, expected",
    [
        ([(40, 44), (11, 19), (17, 30)], [(11, 30), (40, 44)]),  # any order, overlap
        ([(-6, 0), (0, 8)], [(-6, 8)]),  # neighbours
        ([(10, 90), (20, 30), (25, 70)], [(10, 90)]),  # one inside another
        ([(5, 6)] * 3, [(5, 6)]),
        ([], []),
    ],
)
def test_normalize(spark, given_, expected):
    assert pairs(iv.normalize(table(spark, given_))) == expected


def test_algebra(spark):
    day, nights, noon = table(spark, [(600, 2200)]), table(spark, [(0, 700), (2100, 2900)]), table(spark, [(1150, 1250)])
    assert pairs(iv.union(nights, noon)) == [(0, 700), (1150, 1250), (2100, 2900)]
    assert pairs(iv.union(day, nights)) == [(0, 2900)]
    assert pairs(iv.intersect(day, nights)) == [(600, 700), (2100, 2200)]
    assert pairs(iv.intersect(noon, nights)) == [] == pairs(iv.subtract(noon, day))
    assert pairs(iv.subtract(day, noon)) == [(600, 1150), (1250, 2200)]
    assert pairs(iv.subtract(day, nights)) == [(700, 2100)]
    assert iv.summary(nights).first().total_ns == 1500


def test_invalid_interval_fails(spark):
    with pytest.raises(Exception, match="must start before"):
        iv.check(table(spark, [(33, 33)])).collect()


def test_inside_is_half_open(spark):
    events = spark.createDataFrame([("e", t, t) for t in range(100, 120)], "episode string, seq bigint, ts_ns bigint")
    found = iv.inside(events, table(spark, [(90, 102), (110, 113), (119, 400)])).orderBy("ts_ns").collect()
    assert [r.ts_ns for r in found] == [100, 101, 110, 111, 112, 119]


def log(spark, rows):
    return spark.createDataFrame([("e", i, int(t * 10), topic) for i, (topic, t) in enumerate(rows)], "episode string, seq bigint, ts_ns bigint, topic string")


def test_inactivity(spark):
    rows = [("screen", t / 2) for t in range(20)] + [("keyboard", 2.5), ("mouse", 4.0), ("keyboard", 30)]
    assert pairs(iv.inactivity_filter(log(spark, rows), ["screen"], ["keyboard", "mouse"], 7, 40)) == [(25, 40)]
    runs = log(spark, [("s", t) for t in (3.0, 3.4, 3.8, 7.7, 8.6, 20.0)])
    assert pairs(iv.activity(runs, ["s"], 9)) == [(30, 38), (77, 86)]
    assert pairs(iv.activity(log(spark, [("s", 4.2)]), ["s"], 9)) == []


def test_toggles(spark):
    assert pairs(iv.toggles(log(spark, [("f", 1), ("f", 2), ("f", 3.5)]), F.col("topic") == "f")) == [(10, 20)]
    with pytest.raises(Exception, match="pause"):
        iv.toggles(log(spark, [("f", 1), ("p", 2)]), F.lit(True), F.col("topic") == "p").collect()


def test_extractors(spark):
    ev = log(spark, [("a", 1), ("a", 2), ("b", 5), ("a", 9)])
    assert pairs(everything()(ev)) == [(10, 90)] and pairs(nothing()(ev)) == []
    assert pairs((everything() - active(["a"], 10))(ev)) == [(20, 90)]
    assert (active(["a"], 10) & spanned(["b"])).text == "(active(['a'], 10) & spanned(['b']))"
    assert pairs(from_config("everything")(ev)) == [(10, 90)]
    with pytest.raises(ValueError, match="unknown"):
        from_config("other")


span = st.tuples(st.integers(0, 12), st.integers(1, 5)).map(lambda x: (x[0], x[0] + x[1]))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(span, max_size=5), st.lists(span, max_size=5))
def test_algebra_equals_point_sets(spark, left, right):
    points = lambda ps: {t for a, b in ps for t in range(a, b)}
    a, b = table(spark, left), table(spark, right)
    for got, want in ((iv.union(a, b), points(left) | points(right)), (iv.intersect(a, b), points(left) & points(right)), (iv.subtract(a, b), points(left) - points(right))):
        found = pairs(got)
        assert points(found) == want
        assert all(x[1] < y[0] for x, y in zip(found, found[1:], strict=False))
