
import math
import os

import pytest

from hitgrid.streaming import adaptive

GOOD = {"n": 24, "m1": 2.0}
INF = math.inf


def turn(state, times=1, *, w=48.0, tau=math.nan, alarm=False, now=100.0, left=0, max_z=0.0, z=0.0, insufficient=False, degraded=False, fired=False, sig=0, rel_y=0.1, rel_m1=0.02, moments=GOOD, **fields):
    s = adaptive.AdaptiveState(w=w, state=state, tau=tau, alarm=alarm, left=left, **fields)
    c = adaptive.AdaptiveConfig()
    for _ in range(times):
        adaptive._transition(s, c, now, max_z, z, insufficient, degraded, fired, sig, rel_y, rel_m1, moments)
    return s


@pytest.mark.parametrize(
    ("state", "given", "to"),
    [
        ("Warmup", {"alarm": True, "insufficient": True}, "Hold"),  # the alarm comes first
        ("Warmup", {"insufficient": True, "max_z": 9.0}, "LowRate"),
        ("Warmup", {"max_z": 6.0}, "Hold"),
        ("Warmup", {"max_z": 3.0}, "Track"),
        ("Warmup", {"max_z": 1.0}, "Poisson"),  # the window is full and quiet
        ("Warmup", {"max_z": 1.0, "left": 90}, "Warmup"),  # it isn't full
        ("Warmup", {"max_z": 1.0, "z": 4.0}, "Warmup"),  # the chosen gate isn't quiet
        ("Warmup", {"max_z": 1.0, "moments": {"n": 1, "m1": 2.0}}, "Warmup"),
        ("Poisson", {"alarm": True}, "Hold"),
        ("Poisson", {"insufficient": True, "degraded": True}, "LowRate"),
        ("Poisson", {"degraded": True, "max_z": 9.0}, "Degraded"),
        ("Poisson", {"max_z": 6.0}, "Hold"),
        ("Poisson", {"max_z": 3.5}, "Track"),
        ("Poisson", {"max_z": 2.9}, "Poisson"),
        ("Track", {"alarm": True, "degraded": True}, "Hold"),
        ("Track", {"degraded": True, "insufficient": True}, "Degraded"),
        ("Track", {"insufficient": True}, "LowRate"),
        ("Track", {"fired": True, "max_z": 9.0}, "Hold"),
        ("Track", {"rel_y": 1.5, "max_z": 9.0}, "Expand"),
        ("Track", {"rel_y": 0.2, "max_z": 9.0}, "Contract"),
        ("Track", {"rel_y": 0.7, "max_z": 9.0}, "Track"),
        ("Track", {"rel_y": 0.7, "max_z": 1.0}, "Poisson"),
        ("Expand", {"rel_y": 1.5, "max_z": 9.0, "w": 20.0}, "Expand"),
        ("Expand", {"rel_y": 0.9}, "Track"),
        ("Expand", {"rel_y": 5.0, "w": 240.0}, "Track"),
        ("Contract", {"rel_y": 0.9}, "Track"),
        ("Contract", {"rel_y": 0.01, "rel_m1": 0.001, "w": 12.0}, "Track"),
        ("Contract", {"rel_y": 0.3, "w": 200.0}, "Contract"),
        ("Hold", {"fired": True}, "Hold"),
        ("Hold", {"quiet_until": 101.0}, "Hold"),
        ("Hold", {"quiet_until": 100.0}, "Track"),
        ("LowRate", {"sig": -1}, "LowRate"),
        ("LowRate", {"sig": 2}, "Track"),
        ("Degraded", {"clean": 5}, "Degraded"),
        ("Degraded", {"clean": 6}, "Track"),
        ("Degraded", {"mismatches": 3}, "Degraded"),
        ("Track", {"mismatches": 3, "rel_y": 0.7, "max_z": 9.0}, "Degraded"),
    ],
)
def test_two_requests_lead_to(state, given, to):
    once = turn(state, 1, **given)
    assert once.state == state  # one request never suffices
    assert turn(state, 2, **given).state == to


def test_requests_of_two_states_in_turn_lead_nowhere():
    s, c = adaptive.AdaptiveState(w=48.0, state="Track"), adaptive.AdaptiveConfig()
    for to in ("Hold", "Expand") * 4:
        adaptive.request(s, c, to, 0.0)
    assert s.state == "Track"


def test_window_bounds_by_state():
    """tau 20: its bound is 60. Track and Expand go down to the window's own floor of 12, Contract to 60."""
    few = {"rel_y": 0.05, "rel_m1": 0.01}
    s, c = adaptive.AdaptiveState(w=64.0, tau=20.0), adaptive.AdaptiveConfig()
    adaptive.adapt(s, c, 0.05, 0.01, False, 0.5, 2.0)
    assert s.w == pytest.approx(60.8 * 0.5)  # 64 * 0.95, then a quarter of it is asked for, half is allowed
    s.w = 64.0
    adaptive.adapt(s, c, 0.05, 0.01, True, 0.5, 2.0)
    assert s.w == 60.0
    assert turn("Contract", w=64.0, tau=20.0, **few).w == 60.0
    assert turn("Expand", w=64.0, tau=20.0, **few).w == pytest.approx(60.8 * 0.8)
    assert turn("Poisson", w=13.0, tau=20.0).w == 60.0 == turn("Hold", w=13.0, tau=20.0, fired=True).w
    s.w = 100.0
    adaptive.adapt(s, c, 0.04, 0.009, False, 0.5, 2.0)  # the pre-check first: 0.9, then 0.95
    assert s.w == pytest.approx(100 * 0.9 * 0.95 * 0.5)
    s.w = 100.0
    adaptive.adapt(s, c, 0.3, 0.0, False, 0.5, 2.0)  # 1.2, then 1.3, nine times asked for, twice allowed, 240 at most
    assert s.w == 240.0
    s.w = 50.0
    adaptive.adapt(s, c, INF, 0.01, False, 0.5, 2.0)  # without an estimate only the steps count
    assert s.w == pytest.approx(50 * 1.2 * 1.3)


def test_entry_actions_and_cadence():
    c = adaptive.AdaptiveConfig()
    s = turn("Track", 2, alarm=True, w=30.0, tau=20.0, pending_gate=3)
    assert (s.state, s.alarm, s.pending_gate, s.w, s.beta) == ("Hold", False, -1, 60.0, 0.1)
    assert s.quiet_until == 100.0 + max(5 * 0.1 * 60.0, 4 * 60.0)
    s = turn("Track", 2, insufficient=True, gate=4, w=5.0)
    assert (s.state, s.gate, s.w, s.beta) == ("LowRate", 0, 12.0, 0.1)
    s = turn("Warmup", 2, max_z=4.0)
    assert (s.state, s.beta) == ("Track", 0.5)
    live = adaptive.AdaptiveConfig(cadence=None)
    assert adaptive.stride(s, live) == 24.0 and adaptive.stride(s, c) == 6.0
    s.beta, s.w = 0.1, 4.0
    assert adaptive.stride(s, live) == 1.0
    s = turn("LowRate", 1, sig=-1, w=220.0, gate=3)
    assert (s.w, s.gate) == (240.0, 0)
    assert turn("Degraded", 1, alarm=True).alarm is False


def test_tau_fit_without_a_fit():
    import numpy as np

    t = np.array([1.0, 2, 4, 8])
    assert math.isnan(adaptive.fit_tau(t, np.array([1.0, -1, -1, -1]), np.ones(4))[0])
    tau, rms = adaptive.fit_tau(t, np.array([1.0, 1.001, 1.002, 1.0]), np.ones(4))
    assert math.isnan(tau) and rms == 0.5
    # One value within six deviations of the median is too few.
    assert math.isnan(adaptive.fit_tau(t[:2], np.array([1.0, 9.0]), np.ones(2))[0]) is False


def test_live_engine_steps_by_beta(spark):
    rows = [("a", k, 3 + (25 if k % 31 == 0 else 0)) for k in range(400)]
    out = adaptive.run_engine(spark.createDataFrame(rows, "run_id string, bin long, n long"), adaptive.AdaptiveConfig(cadence=None)).orderBy("step").collect()
    assert len(out) > 10
    for a, b in zip(out, out[1:], strict=False):
        assert b.t - a.t == pytest.approx(max(1.0, (0.5 if a.state == "Track" else 0.1) * a.w))


def test_pending_requests_in_batches_and_in_a_stream(spark, tmp_path):
    """The newest probe wins, a final outranks probes of later batches, too; batch and stream say the same."""
    from hitgrid.streaming import requests

    batches = [[("a", 0, "probe"), ("a", 1, "probe"), ("b", 0, "probe")], [("a", 2, "probe"), ("b", 3, "final"), ("b", 1, "final")], [("a", 5, None), ("b", 9, "probe")], [("b", 10, "final"), ("a", 7, "final"), ("a", 8, "probe")]]
    pending, want = {}, []
    for k, batch in enumerate(batches):
        touched = set()
        for run, seq, kind in batch:
            if kind is not None:
                pending[run] = max(pending.get(run, (False, -1)), (kind == "final", seq))
                touched.add(run)
        want += [(run, k, "final" if pending[run][0] else "probe", pending[run][1]) for run in touched]
    rows = spark.createDataFrame([(r, k, s, kind) for k, batch in enumerate(batches) for r, s, kind in batch], "run_id string, trigger int, idx long, request string")
    assert sorted(tuple(r[c] for c in ("run_id", "trigger", "request", "idx")) for r in requests.latest_wins(rows, ["run_id"], "trigger").collect()) == sorted(want)
    assert requests.latest_wins(rows.limit(0), ["run_id"], "trigger").count() == 0
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, "run_id string, idx long, request string").coalesce(1).write.parquet(str(tmp_path / "in" / f"p={k}"))
        for file in (tmp_path / "in" / f"p={k}").glob("*.parquet"):
            os.utime(file, (1_000_000 + 10 * k, 1_000_000 + 10 * k))
    stream = spark.readStream.schema("run_id string, idx long, request string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    said = []
    running = requests.stream_latest_wins(stream, ["run_id"]).writeStream.outputMode("update").foreachBatch(lambda df, k: said.extend((r.run_id, k, r.request, r.idx) for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).start()
    running.processAllAvailable()
    running.stop()
    # A batch that changed nothing for a run may name it again.
    last = {}
    for run, k, *r in sorted(said):
        last[run, k] = tuple(r)
    assert all(last[run, k] == (kind, seq) for run, k, kind, seq in want)


def test_fixed_windows_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    """Gaps of several windows, other channels, late rows, events on the edges, and the forced last window."""
    import random

    from hitgrid.streaming import fixed

    rng = random.Random(3)
    window, gate, idle = 10_000_000, 1_000_000, 60_000_000
    times = {"a": sorted(rng.sample(range(500_000, 9_000_000), 8)) + [10_500_000, 41_000_000, 41_000_001, 52_400_000], "b": [3_000_000, 3_000_000, 13_000_000, 43_000_000]}
    rows = [(run, t, rng.randint(1, 17)) for run, ts in times.items() for t in ts]
    batches = [[r for r in rows if lo <= r[1] < hi] for lo, hi in ((0, 12_000_000), (12_000_000, 42_000_000), (42_000_000, 99_000_000))]
    moved = batches[0].pop(3)  # comes late, within what is allowed
    batches[1].append(moved)
    batches += [[("z", 300_000_000, 1)], [("z", 300_000_001, 1)]]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, "run_id string, ts_us long, channel int").selectExpr("*", "timestamp_micros(ts_us) ts").coalesce(1).write.parquet(str(tmp_path / "in" / f"p={k}"))
        for file in (tmp_path / "in" / f"p={k}").glob("*.parquet"):
            os.utime(file, (1_000_000 + 10 * k, 1_000_000 + 10 * k))
    stream = spark.readStream.schema("run_id string, ts_us long, channel int, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = fixed.stream_fixed_windows(stream, window, gate, 15, "40 seconds", idle)
    running = out.writeStream.format("memory").queryName("fixed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    running.processAllAvailable()
    running.stop()
    names = [x.split()[0] for x in fixed.WINDOWS.split(", ")]
    plain = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in names))
    got = sorted(plain(r) for r in spark.table("fixed").filter("run_id <> 'z'").collect())
    batch = fixed.fixed_windows(spark.createDataFrame(rows, "run_id string, ts_us long, channel int"), window, gate, 15).collect()
    assert got == sorted(map(plain, batch)) and sum(r[5] + r[6] == 0 for r in got) >= 3
    # By hand: pushes that summarise every passed window, then a forced step behind the last event.
    for run, ts in times.items():
        own = [r for r in got if r[0] == run]
        ends = [ts[0] + window * (k + 1) for k in range(len(own) - 1)] + [ts[-1] + 1]
        assert [r[3] for r in own] == ends and [r[4] for r in own] == [False] * (len(own) - 1) + [True]
        assert sum(r[5] for r in own) + sum(r[6] for r in own) == len(ts)


def test_hold_horizon_is_five_strides_or_four_bounds():
    c = adaptive.AdaptiveConfig()
    for tau, w in ((float("nan"), 48.0), (30.0, 48.0), (2.0, 239.0)):
        s = adaptive.AdaptiveState(w=w)
        s.state, s.tau = "Track", tau
        for _ in range(2):
            adaptive.request(s, c, "Hold", 100.0)
        bound = max(c.floor, 3 * tau) if tau == tau else c.floor
        assert s.state == "Hold" and s.quiet_until == pytest.approx(100 + max(5 * 0.1 * max(w, bound), 4 * bound))


def test_engine_says_how_long_a_hold_is_quiet(spark):
    """Steady counts, then bursts that make it hold: every step in Hold names the horizon of its entry."""
    rows = [("a", k, 40 if 200 < k % 400 < 215 else 3 + k % 3) for k in range(1200)]
    out = adaptive.run_engine(spark.createDataFrame(rows, "run_id string, bin long, n long"), adaptive.AdaptiveConfig(z_hold=0.5, z_track=0.4, z_min=0.1, ph_threshold=0.5)).orderBy("step").collect()
    assert all((r.quiet_until is not None) == (r.state == "Hold") for r in out)
    held = [r for r in out if r.state == "Hold"]
    assert held and all(r.quiet_until > 0 for r in held)


def test_rows_behind_the_watermark_are_dropped_and_counted(spark, tmp_path):
    from hitgrid.streaming import late

    schema = "ts timestamp, run_id string"
    for k, seconds in enumerate(([1, 2, 3], [30, 31], [32], [4, 5, 33], [80], [81])):
        spark.createDataFrame([(s, "a") for s in seconds], "s long, run_id string").selectExpr("timestamp_seconds(s) ts", "run_id").coalesce(1).write.parquet(str(tmp_path / "in" / f"p={k}"))
        for file in (tmp_path / "in" / f"p={k}").glob("*.parquet"):
            os.utime(file, (1_000_000 + 10 * k, 1_000_000 + 10 * k))  # files come in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    counts = late.windowed_counts(stream, "ts", "10 seconds", "10 seconds", ["run_id"])
    running = counts.writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    running.processAllAvailable()
    lost = late.dropped_rows(running)
    running.stop()
    assert sorted((r.window.start.timestamp(), r.n) for r in spark.table("late").collect()) == [(0.0, 3), (30.0, 4)] and lost >= 1
