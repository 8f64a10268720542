"""Rates: fixed cases with named wrong answers, random series, relations, determinism and plans."""

import random

import pytest
from pyspark.sql import functions as F

from gridweave.functions import sql, walk
from gridweave.operators import folds
from gridweave.operators import samples as S
from gridweave.operators.counter import ResetPolicy
from gridweave.operators.rate import ts_rate
from gridweave.plans.grid import Grid
from gridweave.plans.roles import Roles

from .oracle import equal, rate

SCHEMA = "series_id long, ts long, value double, start_ts long"
# name, grid, window, samples, expected, a wrong answer that a likely mistake would give
CASES = [
    ("both ends closed", (200, 200, 1), 100, [(100, 999), (101, 10), (200, 40)], [0.30303030303030304], 0.4),
    ("reset inside", (205, 205, 1), 205, [(5, 10), (65, 20), (125, 5), (185, 15)], [0.1388888888888889], 0.027777777777777776),
    ("equal times", (112, 112, 1), 108, [(10, 1000), (10, 700), (70, 4000)], [50.0], 37.5),
    ("zero crossing", (125, 125, 1), 125, [(100, 1), (110, 50), (120, 101)], [1.008], 1.2),
    ("one sample with its start", (110, 110, 1), 60, [(100, 5, 80)], [0.125], None),
    ("one sample", (100, 100, 1), 100, [(50, 10)], [None], None),
    ("start without a drop", (35, 35, 1), 30, [(10, 10), (20, 15, 25), (30, 20)], [1.0], 0.5),
    ("windows under the cadence", (30, 90, 30), 20, [(30, 10), (60, 20), (90, 35)], [None] * 3, None),
    ("sweep", (1000, 1300, 15), 80, [(1000, 100), (1060, 180)], [None] * 4 + [4 / 3] * 2 + [None] * 15, None),
    ("two samples", (60, 60, 1), 60, [(30, 10), (59, 40)], [0.6839080459770115], None),
    ("empty window", (1800, 1800, 1), 300, [(0, 0), (300, 300)], [None], None),
    ("steps", (60, 300, 30), 300, [(60 * i, 10 * (i + 1)) for i in range(6)], [0.05, 0.06666666666666667, 0.08333333333333333, 0.1, 0.11666666666666668, 0.13333333333333333] + [0.16666666666666666] * 3, None),
    ("half interval", (1000, 1000, 1), 1000, [(900, 100), (950, 110)], [0.025], 0.2),
    ("clamp at zero", (120, 120, 1), 120, [(100, 1), (110, 11)], [0.175], 0.20833333333333334),
    ("reset before the window", (100, 200, 50), 100, [(30, 100), (80, 90), (130, 50), (180, 60)], [1.8, 1.0, 0.2], None),
    ("not a number", (100, 100, 1), 100, [(10, 5), (50, float("nan")), (90, 9)], [rate([(10, 5.0, None), (50, float("nan"), None), (90, 9.0, None)], 100, 100)], None),
]


def frame(spark, series):
    """series: {id: [(t, v[, st])]}"""
    return spark.createDataFrame([(k, s[0], float(s[1]), s[2] if len(s) > 2 else None) for k, ss in series.items() for s in ss], SCHEMA)


def lists(df):
    return {r["series_id"]: list(r["values"]) for r in df.collect()}


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_case(spark, case):
    _, grid, window, samples, want, wrong = case
    got = lists(ts_rate(frame(spark, {1: samples}), Grid(*grid), window, shape="lists"))
    values = got.get(1, [None] * len(want))
    assert len(values) == len(want) and all(equal(a, b) for a, b in zip(values, want))
    assert wrong is None or not equal(values[0], wrong)
    walked = walk.rates([(s[0], float(s[1]), s[2] if len(s) > 2 else None) for s in samples], Grid(*grid), window)
    assert all(equal(a, b) for a, b in zip(walked, want))


def made(seed, series=40, n=12, start=True):
    r = random.Random(seed)
    out = {}
    for k in range(series):
        t, v, rows = 0, float(r.randint(0, 5000)), []
        for _ in range(r.randint(1, n)):
            t += r.choice([0, 1, 5, 15, 15, 15, 40, 90])
            v = float(r.randint(0, 20)) if r.random() < 0.15 else v + r.randint(0, 50)
            rows.append((t, v, t - r.randint(-2, 60) if start and r.random() < 0.2 else None))
        out[k] = rows
    return out


GRID = Grid(0, 400, 10)


def test_against_the_oracle(spark):
    series = made(0xC0FFEE, 200)
    got = lists(ts_rate(frame(spark, series), GRID, 75, shape="lists"))
    for k, rows in series.items():
        want = [rate(rows, at, 75) for at in GRID]
        values = got.get(k, [None] * GRID.count)
        assert all(equal(a, b, max(1.0, abs(b or 0))) for a, b in zip(values, want)), k


def test_order_partitions_and_chunks_change_no_bit(spark, monkeypatch):
    series = made(7, 60, 40)
    df = frame(spark, series)
    want = lists(ts_rate(df, GRID, 75, shape="lists"))
    for n in (1, 3, 7):
        assert lists(ts_rate(df.repartition(n).orderBy(F.rand(n)), GRID, 75, shape="lists")) == want
    monkeypatch.setattr(S, "CHUNK_POINTS", 4)
    monkeypatch.setattr(S, "CHUNK_REACHES", 1)
    assert lists(ts_rate(df, GRID, 75, shape="lists")) == want


def test_relations(spark):
    series = made(11, 40, 20, start=False)
    base = lists(ts_rate(frame(spark, series), GRID, 75, shape="lists"))
    shifted = {k: [(t + 1000, v) for t, v, _ in rows] for k, rows in series.items()}
    assert lists(ts_rate(frame(spark, shifted), Grid(1000, 1400, 10), 75, shape="lists")) == base
    scaled = {k: [(t, v * 8) for t, v, _ in rows] for k, rows in series.items()}
    assert lists(ts_rate(frame(spark, scaled), GRID, 75, shape="lists")) == {k: [None if x is None else x * 8 for x in v] for k, v in base.items()}
    doubled = {k: rows + rows for k, rows in series.items()}
    assert lists(ts_rate(frame(spark, doubled), GRID, 75, shape="lists")) == base
    beyond = {k: rows + [(10_000, 1.0, None), (-500, 3.0, None)] for k, rows in series.items()}
    assert lists(ts_rate(frame(spark, beyond), GRID, 75, shape="lists")) == base


def test_forms_agree(spark):
    series = made(5, 30, 25)
    df = frame(spark, series).select("series_id", F.timestamp_micros("ts").cast("timestamp_ntz").alias("ts"), "value", F.timestamp_micros("start_ts").cast("timestamp_ntz").alias("start_ts"))
    want = lists(ts_rate(df, GRID, 75, shape="lists"))
    sql.register(spark)
    got = spark.sql("SELECT * FROM ts_rate(TABLE(SELECT * FROM {d}), timestamp_micros(0), timestamp_micros(400), 10, 75)", d=df)
    assert lists(got) == want
    tick = lambda c: f"unix_micros(CAST({c} AS timestamp))"
    agg = spark.sql(f"SELECT series_id, ts_rate_agg_st({tick('ts')}, value, {tick('start_ts')}, 0, 400, 10, 75) AS values FROM {{d}} GROUP BY series_id", d=df)
    assert lists(agg) == want


def test_walk_holds_one_window():
    w = walk.RateWalk(Grid(0, 100_000, 10), 100)
    for t in range(0, 100_000, 5):
        w.feed(t, float(t))
    assert len(w.end()) == 10_001 and w.most <= 22


def test_nulls_and_empty_series(spark):
    df = spark.createDataFrame([(1, 10, 1.0, None), (1, 20, None, None), (1, None, 3.0, None), (1, 30, 4.0, None), (2, 9_000, 1.0, None), (None, 10, 1.0, None), (None, 20, 5.0, None)], SCHEMA)
    got = lists(ts_rate(df, Grid(40, 40, 1), 40, shape="lists"))
    assert set(got) == {1, None} and got[1][0] is not None
    kept = {r["series_id"]: r["values"] for r in ts_rate(df, Grid(40, 40, 1), 40, shape="lists", keep_empty=True).collect()}
    assert set(kept) == {1, 2, None} and kept[2] is None
    unbound = lists(ts_rate(df, Grid(40, 40, 1), 40, shape="lists", push=False))
    assert unbound == got
    assert ts_rate(df.limit(0), Grid(40, 40, 1), 40).count() == 0


def test_several_key_columns(spark):
    df = frame(spark, {1: [(10, 1), (20, 4)], 2: [(10, 5), (20, 6)]}).withColumn("host", F.concat(F.lit("h"), "series_id"))
    got = ts_rate(df, Grid(30, 30, 1), 30, Roles(("host", "series_id")))
    assert got.columns == ["host", "series_id", "ts", "value"] and got.count() == 2


@pytest.mark.parametrize(
    ("call", "said"),
    [
        (lambda d: Grid(0, 10, 0), "step must be positive"),
        (lambda d: Grid(10, 0, 1), "end must be >= start"),
        (lambda d: Grid(0, 10, 3), "step must evenly divide end - start"),
        (lambda d: Grid.of(None, 10, 1), "must not be NULL"),
        (lambda d: Grid.of("x" and F.lit(1), 10, 1), "must be a constant expression"),
        (lambda d: ts_rate(d, Grid(0, 10, 1), 0), "window must be positive"),
        (lambda d: ts_rate(d, Grid(0, 10, 1), None), "must not be NULL"),
        (lambda d: ts_rate(d.drop("value"), Grid(0, 10, 1), 5), "must project columns named 'series_id', 'ts' and 'value'"),
        (lambda d: ts_rate(d.withColumn("ts", F.lit("x")), Grid(0, 10, 1), 5), "'ts' column must be TIMESTAMP"),
        (lambda d: ts_rate(d.withColumn("value", F.lit(1)), Grid(0, 10, 1), 5), "'value' column must be DOUBLE"),
        (lambda d: ts_rate(d.withColumn("start_ts", F.lit("x")), Grid(0, 10, 1), 5), "'start_ts' column must be TIMESTAMP"),
        (lambda d: ts_rate(d, Grid(0, 10, 1), 5, edge="LOOKBACK"), "no edge mode"),
        (lambda d: folds.over_time(d, "nothing", Grid(0, 10, 1), 5), "no fold"),
        (lambda d: folds.over_time(d, "deriv", Grid(0, 10, 1), 5, edge="ANCHOR"), "no edge mode"),
        (lambda d: ResetPolicy("WRAP"), "highest value"),
    ],
)
def test_errors(spark, call, said):
    with pytest.raises(ValueError, match=said.replace("(", r"\(")):
        call(frame(spark, {1: [(1, 1)]}))


@pytest.mark.parametrize(
    ("query", "said"),
    [
        ("SELECT ts_grid_index(timestamp'2024-01-01', timestamp'2024-01-01', 0)", "step must be positive"),
        ("SELECT * FROM ts_grid(timestamp'2024-01-01', timestamp'2024-01-02', 7)", "step must evenly divide end - start"),
        ("SELECT * FROM ts_grid(timestamp'2024-01-02', timestamp'2024-01-01', 1)", "end must be >= start"),
        ("SELECT * FROM ts_grid(NULL, timestamp'2024-01-01', 1)", "must not be NULL"),
        ("SELECT * FROM ts_rate(TABLE(SELECT 1 AS x), timestamp'2024-01-01', timestamp'2024-01-01', 1, 1)", "must project columns named"),
        ("SELECT * FROM ts_rate(TABLE(SELECT 1 AS series_id, timestamp'2024-01-01' AS ts, 1 AS value), timestamp'2024-01-01', timestamp'2024-01-01', 1, 1)", "'value' column must be DOUBLE"),
        ("SELECT * FROM ts_rate(TABLE(SELECT 1 AS x), timestamp'2024-01-01')", "expected .TABLE relation, grid_start, grid_end, grid_step, window."),
        ("SELECT * FROM ts_rate(TABLE(SELECT 1 AS series_id, timestamp'2024-01-01' AS ts, 1D AS value), timestamp'2024-01-01', timestamp'2024-01-01', 1, 0)", "window must be positive"),
    ],
)
def test_sql_errors(spark, query, said):
    sql.register(spark)
    with pytest.raises(Exception, match=said):
        spark.sql(query).collect()


def test_grid_index(spark):
    from gridweave.operators.grids import grid_index

    big = (1 << 63) - 1
    cases = [(5, 0, 1, 5), (-1_000_000, 0, 1_000_000, -1), (-1_500_000, 0, 1_000_000, -2), (0, 0, 7, 0), (2_999_999, 0, 1_000_000, 2), (big, -big - 1, 1_000_000_000, 18446744073), (None, 0, 1, None), (3, None, 1, None)]
    df = spark.createDataFrame(cases, "t long, s long, step long, want long")
    got = df.withColumn("got", grid_index(F.col("t"), F.col("s"), F.col("step"))).collect()
    assert [r["got"] for r in got] == [c[3] for c in cases]
    over = spark.createDataFrame([(big, -big - 1, 1)], "t long, s long, step long")
    with pytest.raises(Exception, match="overflows BIGINT"):
        over.select(grid_index(F.col("t"), F.col("s"), F.col("step"))).collect()


def test_plan(spark):
    """One exchange, by series and chunk; the bounds reach the scan, and no column is read that plays no part."""
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    out = ts_rate(e, Grid.of("2024-01-10", "2024-01-12", 86_400_000_000), 86_400_000_000, Roles("user_id"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("\n") > 0
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,2024-01-09T00:00), LessThanOrEqual(ts,2024-01-12T00:00), IsNotNull" in out._jdf.queryExecution().executedPlan().verboseStringWithOperatorId() or "GreaterThanOrEqual(ts,2024-01-09T00:00)" in plan
    assert "props" not in plan and "event_type" not in plan and "Python" not in plan


def test_drop_policy(spark):
    got = lists(ts_rate(frame(spark, {1: [(10, 5), (20, 9), (30, 2), (40, 11)]}), Grid(50, 50, 1), 50, what="increase", policy=ResetPolicy("DROP"), shape="lists"))
    want = lists(ts_rate(frame(spark, {1: [(10, 5), (20, 9), (40, 11)]}), Grid(50, 50, 1), 50, what="increase", shape="lists"))
    assert got == want
