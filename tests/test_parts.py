"""Sources, streams, compositions and windows of one's own."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridweave.functions import histograms as H, patterns, walk
from gridweave.operators import compose, folds, hist, pattern, resample, series, windows
from gridweave.plans import queries_more
from gridweave.plans.grid import Grid, carries, contains, scan_bounds
from gridweave.plans.roles import PROFILES, Profile, Roles, profile, set_profile
from gridweave.sources import grid as grid_source
from gridweave.sources import samples as sample_source
from gridweave.streaming import folds as streaming

from .conftest import TESTDATA

SCHEMA = "series_id long, ts long, value double"


def test_grid_rules():
    g = Grid.of("2024-01-01", "2024-01-02", 3_600_000_000)
    assert g.count == 25 and g.at(24) == g.end and g.index_of(g.start - 1) == -1 and list(Grid(0, 4, 2)) == [0, 2, 4]
    assert not contains(10, 5, 5) and contains(10, 5, 10) and contains(10, 5, 6) and not contains(10, 5, 11)
    assert carries(10, 5, 5) and not carries(10, 5, 4) and not carries(10, 5, 8, True)
    assert scan_bounds(100, 200, 10, 5, "EXTRAPOLATE") == (90, 200) and scan_bounds(100, 200, 10, 5, "ANCHOR") == (85, 200) and scan_bounds(100, 200, 10, 5, "SMOOTH") == (85, 205)


def test_profiles():
    set_profile(Profile("mine", Roles("host", "at", "v")))
    assert profile("mine").roles.keys == ("host",) and "default" in PROFILES


def test_grid_source(spark):
    grid_source.register(spark)
    df = spark.read.format("ts_grid").options(start="2024-01-01", end="2024-01-03", step="86400000000").load()
    assert [str(r["ts"])[:10] for r in df.collect()] == ["2024-01-01", "2024-01-02", "2024-01-03"]
    with pytest.raises(Exception, match="must not be NULL"):
        spark.read.format("ts_grid").options(start="2024-01-01").load().collect()


def test_samples_are_written_and_read(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("series_id"), "ts", "value")
    for days in (True, False):
        path = str(tmp_path / f"s{days}")
        sample_source.write_samples(e, path, days=days)
        df, roles = sample_source.read_samples(spark, path)
        assert df.count() == e.count() and roles.keys == ("series_id",)


def test_stale_markers_are_found_by_their_bits(spark):
    marker = struct.unpack("<d", struct.pack("<Q", sample_source.STALE_BITS))[0]
    table = pa.table({"series_id": pa.array([1, 1, 1, 1]), "value": pa.array([1.0, float("nan"), None, 2.0])})
    df = spark.createDataFrame(table.to_pandas(), "series_id long, value double")
    assert [r["stale"] for r in sample_source.decode_stale(df).collect()] == [False] * 4
    bits = np.array([marker], float).view(np.int64)[0]
    assert bits in (sample_source.STALE_BITS, sample_source.STALE_BITS | 1 << 51)


def test_downsample(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 5, 3.0), (1, 10, 2.0), (1, 11, None), (2, 3, 9.0)], SCHEMA)
    got = {(r["series_id"], r["ts"]): tuple(r)[2:] for r in sample_source.downsample(df, 10).collect()}
    assert got == {(1, 0): (2, 4.0, 1.0, 3.0, 1.0, 3.0), (1, 10): (1, 2.0, 2.0, 2.0, 2.0, 2.0), (2, 0): (1, 9.0, 9.0, 9.0, 9.0, 9.0)}


def test_stream_windows_and_rates(spark, tmp_path):
    second = 1_000_000
    rows = [(k, t * second, float(t * (k + 1) % 70)) for k in range(3) for t in range(1000, 1300, 7)]
    df = spark.createDataFrame(rows, "k long, t long, v double").select("k", F.timestamp_micros("t").alias("ts"), "v")
    for i, part in enumerate(df.randomSplit([0.5, 0.5], 3)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counted = streaming.windowed(stream(), "ts", "1000 seconds", "60 seconds", None, ["k"], F.count(F.lit(1)).alias("n"))
    q = counted.writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM counted").first()[0] == len(rows)

    out = streaming.rate_stream(stream(), "k", "ts", "v", "400 seconds", 60 * second, 20 * second)
    later = spark.createDataFrame([(9, 3000 * second, 1.0)], "k long, t long, v double").select("k", F.timestamp_micros("t").alias("ts"), "v")
    q = out.writeStream.outputMode("append").format("memory").queryName("rated").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    later.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    got = {(r["k"], int(r["at"].timestamp() * second)): r["value"] for r in spark.sql("SELECT * FROM rated").collect()}
    for k in range(3):
        samples = [(t, v, None) for kk, t, v in rows if kk == k]
        grid = Grid(1000 * second, 1340 * second, 20 * second)
        want = {grid.at(i): x for i, x in enumerate(walk.rates(samples, grid, 60 * second)) if x is not None}
        mine = {at: x for (kk, at), x in got.items() if kk == k}
        assert mine == want


def test_lookback_and_stale(spark):
    df = spark.createDataFrame([(1, 10, 1.0, False), (1, 20, 2.0, True), (1, 40, 4.0, False)], SCHEMA + ", stale boolean")
    at = lambda mode, lookback=15: {r["ts"]: r["value"] for r in resample.resample(df, Grid(5, 60, 5), lookback, mode=mode).collect()}
    assert at("LOOKBACK") == {10: 1.0, 15: 1.0, 40: 4.0, 45: 4.0, 50: 4.0, 55: 4.0}
    assert at("NEXT") == {5: 1.0, 25: 4.0, 30: 4.0, 35: 4.0}
    assert at("INTERPOLATE", 100) == {10: 1.0, 40: 4.0}


def test_random_folds_against_lists(spark):
    r = random.Random(4)
    rows = [(k, t, float(r.randint(-9, 9))) for k in range(5) for t in sorted(r.sample(range(400), 60))]
    df = spark.createDataFrame(rows, SCHEMA)
    grid, window = Grid(0, 400, 20), 55
    got = {name: {(x["series_id"], x["ts"]): x["value"] for x in folds.over_time(df, name, grid, window, **p).collect()} for name, p in (("mad_over_time", {}), ("quantile_over_time", {"phi": 0.3, "method": "R3"}), ("mode_over_time", {}), ("monotone_over_time", {"kind": "descent"}), ("active_duration_over_time", {"max_gap": 6, "tail": "EXTEND"}))}
    for k in range(5):
        for at in grid:
            w = [(t, v) for kk, t, v in rows if kk == k and at - window < t <= at]
            if not w:
                assert all((k, at) not in g for g in got.values())
                continue
            v = np.array([x for _, x in w])
            assert got["mad_over_time"][k, at] == pytest.approx(np.median(np.abs(v - np.median(v))))
            assert got["mode_over_time"][k, at] == min(set(v), key=lambda x: (-(v == x).sum(), x))
            assert got["monotone_over_time"][k, at] == pytest.approx(-np.minimum(np.diff(v), 0).sum())
            assert got["quantile_over_time"][k, at] == sorted(v)[max(1, min(len(v), round(0.3 * len(v)))) - 1]
            ends = [b for b, _ in w[1:]] + [at]
            assert got["active_duration_over_time"][k, at] == sum(min(t + 6, e, at) - t for (t, _), e in zip(w, ends))


def test_windows_of_ones_own(spark):
    df = spark.createDataFrame([(1, t, float(t)) for t in range(0, 100, 5)], SCHEMA)
    spans = spark.createDataFrame([(1, 0, 10), (1, 7, 52), (1, 500, 600), (1, 0, 10)], "series_id long, window_start long, window_end long")
    out = windows.window_fold(df, spans, [folds.Member.of("sum_over_time", "s"), folds.Member.of("changes", "c")])
    assert {(r["window_start"], r["window_end"]): (r["s"], r["c"]) for r in out.collect()} == {(0, 10): (15.0, 1.0), (7, 52): (float(sum(range(10, 55, 5))), 8.0), (500, 600): (None, None)}


def test_asof_with_a_hot_key(spark):
    r = random.Random(8)
    left = [(0, t) for t in sorted(r.sample(range(5000), 300))]
    right = [(0, t, float(t)) for t in sorted(r.sample(range(5000), 200))]
    l, rr = spark.createDataFrame(left, "k long, ts long"), spark.createDataFrame(right, "k long, ts long, v double")  # noqa: E741
    for direction, pick in (("backward", lambda t: max((u for _, u, _ in right if t - 40 <= u <= t), default=None)), ("forward", lambda t: min((u for _, u, _ in right if t <= u <= t + 40), default=None))):
        got = {x["ts"]: x["matched_ts"] for x in compose.asof_join(l, rr, ["k"], "ts", ["v"], direction, 40).collect()}
        assert got == {t: pick(t) for _, t in left}


def test_calendar_days_follow_the_clock(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-03-31 22:30:00' AS ts UNION ALL SELECT timestamp_ntz'2024-03-31 21:30:00'")
    got = sorted(str(r[0]) for r in df.select(compose.calendar_bucket("ts", "DAY", "Europe/Berlin")).collect())
    assert got == ["2024-03-30 23:00:00", "2024-03-31 22:00:00"]


def test_pattern_rows_and_measures(spark):
    e = spark.createDataFrame([(1, i, c, float(i)) for i, c in enumerate("ABBCXAB")], "k long, ts long, c string, v double")
    define = {x: F.col("c") == x for x in "ABC"}
    one = pattern.match_pattern(e, ["k"], "ts", "A B+ C", define, 10, {"n": ("COUNT", "B", None), "top": ("MAX", None, "v"), "mean": ("AVG", "U", "v")}, {"U": ["A", "B"]}).collect()
    assert [(r["match_start"], r["match_end"], r["n"], r["top"], r["mean"]) for r in one] == [(0, 3, 2, 3.0, 1.0)]
    rows = pattern.match_pattern(e, ["k"], "ts", "A {- B+ -} C", define, 10, rows="ALL WITH UNMATCHED").collect()
    assert sorted((r["ts"], r["classifier"]) for r in rows if r["match_number"]) == [(0, "A"), (3, "C")] and len(rows) == 5
    with pytest.raises(ValueError, match="WITHIN"):
        pattern.match_pattern(e, ["k"], "ts", "A", define, None)


@pytest.mark.parametrize("text", ["A B+? C", "^ A | B C", "A B* $ | C A", "{- A -} B?", "A (B | C)* C"])
@pytest.mark.parametrize("skip", ["PAST LAST ROW", "TO NEXT ROW"])
def test_a_hot_partition_is_matched_by_runs(spark, monkeypatch, text, skip):
    monkeypatch.setattr(pattern, "RUNS", 3)
    r = random.Random(4)
    t, events = 0, []
    for _ in range(400):
        t += r.choice([1, 1, 2, 3, 30])
        events.append((0, t, r.choice("ABC")))
    tree, times, kinds = patterns.parse(text), [t for _, t, _ in events], [c for *_, c in events]
    want = patterns.find_all(tree, len(events), lambda v, i, taken: kinds[i] == v, times, 12, skip)
    df = spark.createDataFrame([*events, (0, None, "A"), (None, 5, "A")], "k long, ts long, c string")
    define = {x: F.col("c") == x for x in "ABC"}
    one = pattern.match_pattern(df, ["k"], "ts", text, define, 12, skip=skip, stretch=100).where("k = 0").collect()
    assert sorted((x["match_number"], x["match_start"], x["match_end"]) for x in one) == [(n, times[m[0][0]], times[m[-1][0]]) for n, m in enumerate(want, 1)]
    assert len({x["match_number"] for x in one}) > 1 or "^" in text
    rows = pattern.match_pattern(df, ["k"], "ts", text, define, 12, rows="ALL", skip=skip, stretch=100).where("k = 0").collect()
    assert sorted((x["match_number"], x["ts"], x["classifier"]) for x in rows) == sorted((n, times[i], v) for n, m in enumerate(want, 1) for i, v, left_out in m if not left_out)


def test_sequences_of_many_conditions(spark):
    e = spark.createDataFrame([(1, t, n) for t, n in enumerate([0, 11, 3, 99, 7, 0, 3])] + [(2, 0, 99)], "k long, ts long, n long")
    many = [F.col("n") == i for i in range(12)]
    asked = {"(?1)(?12)": True, "(?4)(?12)": False, "(?1).(?4)": True, "(?1).*(?8)": True, "(?12).+(?1)": True, "(?12)(?1)": False}
    for text, want in asked.items():
        assert {r["k"]: r["matched"] for r in pattern.sequence_match(e, ["k"], "ts", text, many).collect()} == {1: want, 2: False}
    assert {r["k"]: r["n"] for r in pattern.sequence_count(e, ["k"], "ts", "(?1).*(?4)", many).collect()} == {1: 2, 2: 0}


def test_series_of_nulls(spark):
    df = spark.createDataFrame([(1, [None, 1.0, None, 3.0]), (2, [None, None]), (3, None)], "k long, a array<double>")
    for name in ("fill_forward", "fill_linear", "znorm", "ema", "fill_spline", "acf", "fit_2lines", "changepoints"):
        p = {"alpha": 0.5} if name == "ema" else {}
        assert df.select(series.series(name, "a", **p)).count() == 3
    got = df.where("k = 1").select(series.series("fill_linear", "a").alias("x")).first()["x"]
    assert got == [None, 1.0, 2.0, 3.0]


def test_cells_are_added_in_order_of_time(spark):
    """Sums of doubles do not depend on the order of rows or on how they are split, so ties in later steps do not either."""
    rows = [(1, 0, 5, 0.1), (1, 0, 6, 0.2), (1, 0, 7, 0.3), (1, 10, 12, 0.3), (1, 10, 15, 0.6000000000000001), (1, 20, 21, None), (2, 20, 22, 1.0), (2, 20, 22, None)]
    for split in (rows, rows[::-1], rows[1::2] + rows[::2]):
        for parts in (1, 3):
            df = spark.createDataFrame(spark.sparkContext.parallelize(split, parts), "k long, ts long, at long, value double")
            got = {r["k"]: r["values"] for r in series.make_series(df, Grid(0, 20, 10), ["k"], order="at").collect()}
            assert got == {1: [0.1 + 0.2 + 0.3, 0.3 + 0.6000000000000001, None], 2: [None, None, 1.0]}
    whole = series.make_series(df.select("k", "ts", F.lit(2).cast("long").alias("value")), Grid(0, 20, 10), ["k"]).collect()
    assert {r["k"]: r["values"] for r in whole} == {1: [6, 4, 2], 2: [None, None, 4]}


def test_histogram_rate(spark):
    df = spark.createDataFrame([(1, t, float(1 + t % 7)) for t in range(0, 205, 5)], SCHEMA)
    running = hist.from_values(df, Grid(20, 200, 20), 1000).withColumnRenamed("value", "h")
    out = hist.hist_over_time(running, "increase", Grid(100, 200, 20), 60, Roles(value="h")).collect()
    assert out and all(r["value"]["count"] == pytest.approx(12, rel=0.01) for r in out)


@pytest.mark.parametrize("edge", ["EXTRAPOLATE", "ANCHOR", "SMOOTH"])
@pytest.mark.parametrize("is_delta", [False, True])
def test_windows_of_histograms_change_together_as_apart(monkeypatch, edge, is_delta):
    """Windows of one layout, of mixed scales and without samples; in one block and in many."""
    r = np.random.default_rng(5)

    def window(scale):
        t = [int(x) for x in sorted(r.choice(np.arange(901, 1001), r.integers(1, 5), replace=False))]
        spots = [(880, 1)] * (edge != "EXTRAPOLATE" and r.random() < 0.6) + [(x, 0) for x in t] + [(1010, 2)] * (edge == "SMOOTH" and r.random() < 0.6)
        made = [H.from_values([float(x) for x in r.normal(0, 5, r.integers(0, 12))], int(r.integers(-1, 3)) if scale is None else scale) for _ in spots]
        return [{"t": x, "role": role, "v": H.pack(h)} for (x, role), h in zip(spots, made)]

    samples = [window(None if i % 9 == 0 else i % 3 - 1) for i in range(120)] + ([[{"t": 880, "role": 1, "v": H.pack(H.from_values([1.0]))}]] if edge != "EXTRAPOLATE" else [])
    a = pa.array(samples, pa.list_(pa.struct([("t", pa.int64()), ("role", pa.int32()), ("v", hist._STRUCT)])))
    want = [hist._change_of(w, 1000, 100, edge, is_delta) for w in samples]
    for cells in (2_000_000, 300):
        monkeypatch.setattr(hist, "CELLS", cells)
        got = hist.changes(a, pa.array([1000] * len(samples)), 100, edge, is_delta, 0.5).to_pylist()
        for g, h in zip(got, want):
            assert (g is None) == (h is None)
            for k, x in H.pack(H.scaled(h, 0.5)).items() if h else ():
                assert g[k] == pytest.approx(x, rel=1e-12, abs=1e-12), k
    assert hist.changes(a[:0], pa.array([], pa.int64()), 100, edge, is_delta, 0.5).to_pylist() == []


def test_states_finish_to_the_folds(spark):
    from gridweave.operators import states
    from pyspark.sql import types as T

    r = random.Random(12)
    rows = [(k, t, float("nan") if r.random() < 0.1 else float(r.randint(-9, 9))) for k in range(4) for t in sorted(r.sample(range(-50, 400), 80))]
    df = spark.createDataFrame(rows, SCHEMA)
    grid = Grid(0, 380, 20)
    parts = [states.states(df.where(f"pmod(ts, 3) = {i}"), grid) for i in range(3)]
    got = states.finished(states.merged(*parts), grid, 60, time=T.LongType()).collect()
    for name in states.FINAL:
        want = {(x["series_id"], x["ts"]): x["value"] for x in folds.over_time(df, name, grid, 60).collect()}
        mine = {(x["series_id"], x["ts"]): x[name] for x in got}
        assert set(mine) == set(want) and all(mine[k] == want[k] or (np.isnan(mine[k]) and np.isnan(want[k])) for k in want), name
    with pytest.raises(ValueError, match="whole number of steps"):
        states.finished(parts[0], grid, 50)


def test_bounds_of_top_values_hold_where_the_sketch_is_full(spark):
    df = spark.sql("SELECT 1L AS series_id, id AS ts, CAST(CASE WHEN id % 3 = 0 THEN id % 7 WHEN id > 17000 AND id % 3 = 1 THEN -1 ELSE id END AS DOUBLE) AS value FROM range(1, 20000, 1, 1)")
    (row,) = folds.over_time(df, "approx_top_k_over_time", Grid(20_000, 20_000, 1), 20_000, k=10, most=100).collect()
    exact = {r["value"]: r["count"] for r in df.groupBy("value").count().collect()}
    assert all(e["count_lo"] <= exact[e["key"]] <= e["count_hi"] for e in row["value"])
    assert any(e["count_hi"] > exact[e["key"]] for e in row["value"])


def test_top_values_are_found_where_none_is_frequent(spark):
    """Counts under the sketch's error still give k values, each with its count between its bounds."""
    df = spark.sql("SELECT 1L AS series_id, id AS ts, CAST(id % 5000 AS STRING) AS value FROM range(1, 20000, 1, 3)")
    (row,) = folds.over_time(df, "approx_top_k_over_time", Grid(20_000, 20_000, 1), 20_000, k=10, most=64).collect()
    exact = {r["value"]: r["count"] for r in df.groupBy("value").count().collect()}
    assert len(row["value"]) == 10 and all(0 < e["count_lo"] <= exact[e["key"]] <= e["count_hi"] for e in row["value"])
    # Values once each: now and then the sketch drops all that it tracks, here in one part or in several.
    for parts in (1, 3):
        once = spark.range(1, 400, 1, parts).selectExpr("1L AS series_id", "id AS ts", "CAST(id AS STRING) AS value")
        rows = folds.over_time(once, "approx_top_k_over_time", Grid(90, 390, 1), 90, k=10, most=64).collect()
        assert len(rows) == 301 and all(r["value"] and all(e["count_lo"] == 1 <= e["count_hi"] for e in r["value"]) for r in rows)


def test_few_distinct_values_are_told_apart(spark):
    """Six values whose hashes begin with the same 13 bits, which one register of a larger sketch took for one value."""
    alike = [3255.0, 11244.0, 17440.0, 24391.0, 38325.0, 49591.0]
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate([*alike, 3255.0], 1)], "series_id long, ts long, value double")
    assert [r["value"] for r in folds.over_time(df, "approx_distinct_over_time", Grid(10, 10, 1), 10).collect()] == [6]
    many = spark.sql("SELECT 1L AS series_id, id AS ts, CAST(id % 9000 AS DOUBLE) AS value FROM range(1, 20000, 1, 3)")
    (row,) = folds.over_time(many, "approx_distinct_over_time", Grid(20_000, 20_000, 1), 20_000).collect()
    assert abs(row["value"] - 9000) <= 0.05 * 9000


def test_running_compositions_of_a_hot_key_are_spread_and_equal(spark):
    """One key with all rows: results do not depend on how long a stretch is, and no task has more than a part of the rows."""
    from pyspark.sql import functions as F

    from gridweave.operators import compose

    rows = spark.range(0, 4000, 1, 4).select(F.lit("hot").alias("k"), F.col("id").alias("i"), (F.col("id") * 37 + (F.col("id") % 11) * 5 + F.when(F.col("id") % 97 == 0, 900).otherwise(0)).alias("ts"), (F.col("id") * 7919 % 1009).cast("double").alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(None, 9001, 5, 1.0), (None, 9002, 7, None)], "k string, i long, ts long, v double"))

    def all_of(stretch):
        say = lambda df, *c: sorted((tuple(r) for r in df.select(*c).collect()), key=repr)
        spans = rows.withColumn("te", F.col("ts") + F.col("v").cast("long"))
        left, right = rows.where("i % 3 = 0 OR k IS NULL").drop("v"), rows.where("i % 97 = 1").drop("i")
        joined = [say(compose.asof_join(left, right, ["k"], "ts", ["v"], d, stretch=stretch), "i", "v") for d in ("backward", "forward", "nearest")]
        return [
            say(compose.sessions(rows, ["k"], "ts", 60, stretch=stretch), "i", "session_id"), say(compose.remove_resets(rows, ["k"], "ts", "v", stretch=stretch), "i", "total"),
            say(compose.running_sum(rows, ["k"], "ts", "v", stretch=stretch), "i", "total"), say(compose.union_length(spans, ["k"], "ts", "te", stretch=stretch), "k", "ticks"), *joined,
        ]

    whole = all_of(1 << 40)
    assert all_of(1000) == whole and all_of(50_000) == whole
    out = compose.running_sum(rows, ["k"], "ts", "v", stretch=1000)
    tasks = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert "Window" in out._jdf.queryExecution().executedPlan().toString() and max(tasks) < 4000
