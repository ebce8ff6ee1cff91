"""Golden values, invariances and streaming twins of the list-mode operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitgrid.functions import values as V
from hitgrid.operators import bins as B
from hitgrid.operators import curves, islands, learning
from hitgrid.sources import listmode
from hitgrid.streaming import adaptive, episodes, rate


def poisson(rate_, seconds, seed=1):
    rng, t, out = random.Random(seed), 0.0, []
    while (t := t + rng.expovariate(rate_)) < seconds:
        out.append(("r", int(t * 1e6), rng.randint(1, 15)))
    return out


def clustered(rate_, seconds, seed=2):
    rng, t, out = random.Random(seed), 0.0, []
    while (t := t + rng.expovariate(rate_)) < seconds:
        out += [("r", int((t + rng.random() * 2e-3) * 1e6), rng.randint(1, 15)) for _ in range(rng.randint(1, 6))]
    return out


def detections(spark, rows):
    return spark.createDataFrame(rows, "run_id string, ts_us long, channel int")


def ladder(spark, rows, window=10_000_000):
    return B.ladder(detections(spark, rows), 500, window, window, [1000, 2000, 4000, 8000, 16000])


def test_tiny_window(spark):
    """Four hits, one on channel 0, in ten gates of 100 us: mean multiplicity 0.3 of the accepted three."""
    rows = detections(spark, [("r", 0, 1), ("r", 10, 1), ("r", 150, 2), ("r", 200, 0)])
    inside = rows.filter(F.col("channel").between(1, 15))
    gates = B.gate_counts(B.sliding_windows(B.base_bins(inside, 100, False), 100, 1000, 1000), 100, 1000, 1000, [100])
    m = B.factorial_moments(B.moment_sums(gates, 1000)).first()
    assert (m.m1, m.m2, m.n_gates) == (0.3, 0.2, 10)
    assert inside.count() == 3


def test_poisson_has_no_correlation_and_clusters_have(spark):
    flat = ladder(spark, poisson(2000, 9.99)).filter("valid").collect()
    assert flat and all(abs(r.y) < 4 * r.sigma_y for r in flat)
    assert max(r.z for r in ladder(spark, clustered(800, 9.99)).filter("valid").collect()) > 6


def test_ladder_does_not_depend_on_partitions(spark):
    rows = clustered(300, 5)
    a = ladder(spark, rows).orderBy("gate_us").collect()
    b = B.ladder(detections(spark, rows).repartition(7), 500, 10_000_000, 10_000_000, [1000, 2000, 4000, 8000, 16000]).orderBy("gate_us").collect()
    assert [(r.gate_us, r.m1, r.y, r.sigma_y) for r in a] == [(r.gate_us, r.m1, r.y, r.sigma_y) for r in b]


def test_two_runs_are_two_runs(spark):
    one, two = poisson(200, 5, 3), [("s", t, c) for _, t, c in clustered(100, 5, 4)]
    both = {(r.run_id, r.gate_us): r.y for r in ladder(spark, one + two).collect()}
    apart = {(r.run_id, r.gate_us): r.y for rows in (one, two) for r in ladder(spark, rows).collect()}
    assert both == apart


def test_delta_method_matches_finite_differences():
    y = lambda m1, m2: (m2 - m1 * m1) / m1
    m1, m2, h = 2.0, 4.5, 1e-6
    assert abs((y(m1 + h, m2) - y(m1 - h, m2)) / (2 * h) - (-m2 / m1**2 - 1)) < 1e-6
    assert abs((y(m1, m2 + h) - y(m1, m2 - h)) / (2 * h) - 1 / m1) < 1e-6


def test_windows_refuse_row_explosion(spark):
    with pytest.raises(ValueError):
        B.sliding_windows(spark.range(1).withColumnRenamed("id", "bin"), 1, 1000, 1)


def test_asof(spark):
    left = spark.createDataFrame([("a", 0), ("a", 5), ("a", 10), ("b", 7)], "k string, t long")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 9, "y"), ("a", 9, "z"), ("c", 0, "q")], "k string, s long, v string")
    got = {(r.k, r.t): r.v for r in islands.asof(left, right, ["k"], "t", "s", ["v"]).collect()}
    assert got == {("a", 0): None, ("a", 5): "x", ("a", 10): "z", ("b", 7): None}


def test_segments_and_streaks(spark):
    rows = spark.createDataFrame([("r", k, s) for k, s in enumerate("AABBBAC")], "run string, t long, s string")
    got = [(r.s, r.start, r.end, r.n) for r in islands.segments(rows, ["run"], "t", "s").orderBy("start").collect()]
    assert got == [("A", 0, 2, 2), ("B", 2, 5, 3), ("A", 5, 6, 1), ("C", 6, 6, 1)]
    streak = islands.streak_lengths(rows.withColumn("b", F.col("s") == "B"), ["run"], ["t"], "b").orderBy("t").collect()
    assert [r.streak for r in streak] == [0, 0, 1, 2, 3, 0, 0]


def test_clamped_cusum_is_the_fold(spark):
    rng = random.Random(5)
    steps = [rng.uniform(-1, 1) for _ in range(300)]
    rows = spark.createDataFrame([("r", k, x) for k, x in enumerate(steps)], "run string, t long, x double")
    got = [r.cusum for r in islands.clamped_cusum(rows, ["run"], ["t"], F.col("x")).orderBy("t").collect()]
    want, c = [], 0.0
    for x in steps:
        want.append(c := max(0.0, c + x))
    assert np.allclose(got, want)


def test_listmode_lines(spark):
    lines = spark.createDataFrame([("0,1",), ("10 1",), ("1.5\t2",), ("200",), ("# c",), ("",), ("-5,1",), ("x,y",)], "value string")
    assert [(r.ts_us, r.channel) for r in listmode.parse_lines(lines, default_channel=1).collect()] == [(0, 1), (10, 1), (1500000, 2), (200, 1), (None, None), (None, None), (None, None), (None, None)]


def test_packed_words(spark):
    row = listmode.unpack_words(listmode.pack_words(spark.createDataFrame([(123456, 3)], "ts_us long, channel long")).select("word")).first()
    assert (row.ts_us, row.channel) == (123456, 3)


def test_lmx_files(spark, tmp_path):
    import struct

    def rec(mask, ticks):
        return struct.pack("<II", mask, ticks)

    head = b"BinaryDataClockTickLength 10\nInternalScaler 100\nBinaryDataFollows\n"
    (tmp_path / "a.lmx").write_bytes(head + rec(1, 5) + rec(1 << 14 | 2, 9) + rec(0, 1) + rec(4, 3) + rec(0, 0xFFFFFFFF) + rec(1, 99))
    got = sorted((r.ts_ticks, r.channel) for r in listmode.read_lmx(spark, str(tmp_path / "*.lmx")).collect())
    assert got == [(5, 1), (9, 2), (9, 15), (12, 3)]


def test_resolve_columns(spark):
    df = spark.createDataFrame([(1, 2)], "`Channel 1` int, DURATION_S int")
    out = listmode.resolve_columns(df, {"c1": ["Channel1", "channel 1"], "duration_s": []})
    assert out.first().asDict() == {"c1": 1, "duration_s": 2}
    with pytest.raises(ValueError, match="missing columns: x"):
        listmode.resolve_columns(df, {"x": []})


def test_values_with_uncertainty(spark):
    row = spark.range(1).select(V.divide(V.value(F.lit(10.0), F.lit(1.0)), V.value(F.lit(4.0), F.lit(0.4))).alias("q"), V.divide(V.value(F.lit(1.0), F.lit(0.1)), V.value(F.lit(0.0), F.lit(1.0))).alias("z")).first()
    assert row.q.value == 2.5 and abs(row.q.stdev - 2.5 * 0.02**0.5) < 1e-12 and row.z.value is None


def scored(spark, n=400):
    rng = random.Random(9)
    rows = []
    for _ in range(n):
        p = rng.random()
        rows.append((round(p, 3), int(rng.random() < p)))
    return spark.createDataFrame(rows, "p double, y int"), rows


def test_curves_and_areas(spark):
    df, rows = scored(spark)
    got = curves.areas(curves.curve(df)).first()
    pairs = [(a, b) for a, ya in rows if ya for b, yb in rows if not yb]
    want = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    assert abs(got.roc_auc - want) < 1e-9 and 0 < got.pr_auc <= 1


def test_isotonic_is_monotone_and_bounded(spark):
    df, rows = scored(spark)
    blocks = curves.isotonic(df).orderBy("x").collect()
    assert all(a.y < b.y for a, b in zip(blocks, blocks[1:], strict=False)) and sum(b.n for b in blocks) == len(rows)
    assert all(0 <= b.y <= 1 for b in blocks)


def test_platt_is_finite(spark):
    df, _ = scored(spark)
    a, b = curves.platt(df.withColumn("x", V.clamp_logit(F.col("p"))))
    assert 0.5 < a < 2 and abs(b) < 1


def test_splits_are_disjoint_and_stable(spark):
    rows = spark.range(1000).withColumn("y", F.col("id") % 3).withColumn("g", F.col("id") % 20)
    one = {r.id for r in learning.stratified_split(rows, "id", "y", 0.2).filter("holdout").collect()}
    two = {r.id for r in learning.stratified_split(rows.repartition(9), "id", "y", 0.2).filter("holdout").collect()}
    assert one == two and len(one) == 67 + 67 + 67
    groups = learning.group_split(rows, "g", 0.2).groupBy("g").agg(F.countDistinct("holdout").alias("n"), F.max("holdout").alias("h")).collect()
    assert all(r.n == 1 for r in groups) and sum(r.h for r in groups) == 4


def test_tau_is_recovered():
    t = np.array([0.5, 1, 2, 4, 8, 16, 32]) * 1e-3
    tau, rms = adaptive.fit_tau(t, 2 * (1 - np.exp(-t / 3e-3)), np.full(7, 0.05))
    assert abs(tau - 3e-3) < 3e-4 and rms < 0.05
    assert np.isnan(adaptive.fit_tau(t, np.full(7, 1.0), np.full(7, 0.1))[0])


def test_gate_needs_two_votes_and_hold_freezes_it():
    c, s = adaptive.AdaptiveConfig(), adaptive.AdaptiveState(w=48.0, state="Track")
    adaptive.choose_gate(s, c, 3, False)
    assert s.gate == 0
    adaptive.choose_gate(s, c, 3, False)
    assert s.gate == 3
    s.state = "Hold"
    for _ in range(5):
        adaptive.choose_gate(s, c, 1, False)
    assert s.gate == 3


def test_state_needs_two_requests():
    c, s = adaptive.AdaptiveConfig(), adaptive.AdaptiveState(w=48.0)
    adaptive.request(s, c, "Track", 0.0)
    assert s.state == "Warmup"
    adaptive.request(s, c, "Hold", 1.0)
    adaptive.request(s, c, "Hold", 2.0)
    assert s.state == "Hold" and s.w >= c.floor


def policy(rows):
    s, c = episodes.PolicyState(), episodes.PolicyConfig()
    return [d for r in rows if (d := episodes.policy_step(s, c, *r))]


def test_policy_starts_after_debounce_and_ends_on_recovery():
    calm, odd = (10.0, 6.0, False, "Single", 1.0, 0.5, False), (10.0, 6.0, True, "Single", 1.0, 0.5, False)
    got = policy([calm, odd, calm, odd, odd, calm, calm])
    assert [d["decision"] for d in got] == ["Start", "End"] and got[0]["counts"] == 20.0


def test_policy_final_request_and_unknown():
    odd = (30.0, 6.0, True, "Single", 1.0, 0.5, False)
    got = policy([odd] * 10)
    assert got[-1]["request"] == "final" and got[-1]["decision"] == "Publish"
    far = (30.0, 6.0, True, "Single", 1.0, 0.5, True)
    got = policy([far] * 10)
    assert got[-1]["reason"] == "UNKNOWN_OOD" and any(d["decision"] == "Refuse" for d in got)


def test_rate_controller_stream_is_its_batch_twin(spark, tmp_path):
    rng = random.Random(4)
    rows = [("a", k, rng.randint(0, 9)) for k in range(60) if k % 7] + [("b", k, 30) for k in range(40)]
    schema = "run_id string, bin long, n long"
    batch = rate.control_runs(spark.createDataFrame(rows, schema)).orderBy("run_id", "t").collect()
    for part, chosen in enumerate(([r for r in rows if r[1] < 25], [r for r in rows if r[1] >= 25])):
        spark.createDataFrame(chosen, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    running = rate.control_stream(stream).writeStream.format("memory").queryName("twin").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    running.processAllAvailable()
    running.stop()
    got = spark.table("twin").orderBy("run_id", "t").collect()
    assert [(r.run_id, r.t, r.n, r.state, round(r.w, 9)) for r in got] == [(r.run_id, r.t, r.n, r.state, round(r.w, 9)) for r in batch]


def test_fixed_windows_stream_is_its_batch_twin(spark, tmp_path):
    rows = detections(spark, poisson(20, 30)).withColumn("ts", F.timestamp_micros("ts_us"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    count = lambda df: df.groupBy(F.window("ts", "5 seconds"), "run_id").agg(F.count(F.lit(1)).alias("n"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 second")
    running = count(stream).writeStream.format("memory").queryName("fixed").outputMode("complete").start()
    running.processAllAvailable()
    running.stop()
    assert sorted((r.window.start, r.n) for r in spark.table("fixed").collect()) == sorted((r.window.start, r.n) for r in count(rows).collect())


def test_adaptive_engine_stream_is_its_batch_twin(spark, tmp_path):
    rng = random.Random(6)
    rows = [("a", k, rng.randint(0, 6) + (20 if k % 31 == 0 else 0)) for k in range(400) if k % 11] + [("b", k, 1) for k in range(0, 300, 9)]
    schema = "run_id string, bin long, n long"
    batch = adaptive.run_engine(spark.createDataFrame(rows, schema)).orderBy("run_id", "step").collect()
    for part, (low, high) in enumerate(((0, 70), (70, 210), (210, 400))):
        spark.createDataFrame([r for r in rows if low <= r[1] < high], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    running = adaptive.stream_engine(stream).writeStream.format("memory").queryName("engine").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    running.processAllAvailable()
    running.stop()
    got = spark.table("engine").orderBy("run_id", "step").collect()
    key = lambda r: (r.run_id, r.step, r.state, round(r.w, 9), r.gate, round(r.y, 9))
    assert list(map(key, got)) == list(map(key, batch)) and len(got) > 80


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "sigma_y" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_moment_sums_of_large_gates(spark):
    """Thousands of events in a gate: products of the third order pass the range of a long."""
    gates = spark.createDataFrame([("a", 0, 50, k, n) for k, n in enumerate([10_000, 9_000, 3])], "run_id string, win long, gate_us long, gate_idx long, n long")
    got = B.moment_sums(gates, 150).first()
    falls = [(n, n * (n - 1), n * (n - 1) * (n - 2)) for n in (10_000, 9_000, 3)]
    for k in range(3):
        assert got[f"s{k + 1}"] == pytest.approx(sum(f[k] for f in falls), rel=1e-12)
        for j in range(k, 3):
            assert got[f"q{k + 1}{j + 1}"] == pytest.approx(sum(f[k] * f[j] for f in falls), rel=1e-12)


def test_features_of_known_vectors(spark):
    from hitgrid.plans import channels

    names = [f"c{k}" for k in range(1, 16)]
    df = spark.createDataFrame([tuple([2] * 15), tuple([0] * 15), (*[0] * 14, 8)], ", ".join(f"{c} int" for c in names))
    even, none, last = channels.features(df, F.lit(1.0)).collect()
    assert even.entropy == pytest.approx(np.log(15), abs=1e-7) and even.gini == pytest.approx(14 / 15) and even.anisotropy == pytest.approx(0) and even.dipole == pytest.approx(7)
    assert (none.total, none.entropy, none.gini, none.anisotropy, none.dipole) == (0, 0, 1, 0, 0)
    assert last.gini == pytest.approx(0) and last.anisotropy == pytest.approx(14 / 225) and last.dipole == pytest.approx(14)
    assert channels.features(df, F.lit(1.0), positions=[k - 7 for k in range(15)]).collect()[0].dipole == pytest.approx(0)


def test_y_family_and_errors_against_finite_differences(spark):
    """Every member, its derivatives by central differences, and its error, in plain Python; odd gates and few cycles."""
    import math
    import random

    from hitgrid.functions import feynman

    def cum(m):
        m1, m2, m3, m4 = m
        return [m1, m2 - m1**2 / 2, m3 - m2 * m1 + m1**3 / 3, m4 - m3 * m1 + m2 * m1**2 - m2**2 / 2 - m1**4 / 4]

    formulas = {f"y{k + 1}": lambda m, k=k: cum(m)[k] for k in range(4)} | {"ym": lambda m: 2 * m[1] / m[0] - m[0]}
    formulas |= {f"y{k}f": lambda m, k=k: cum(m)[k - 1] / m[0] for k in (2, 3, 4)} | {f"ysm{k}": lambda m, k=k: cum(m)[k - 1] / m[0] ** k for k in (2, 3, 4)}
    formulas["ybeta"] = lambda m: 3 * (m[0] ** 2 - 2 * m[1]) ** 2 / (4 * (m[0] ** 3 - 3 * m[0] * m[1] + 3 * m[2]) * m[0])
    assert list(formulas) == feynman.MEMBERS
    rng = random.Random(6)
    data = [[rng.uniform(0.5, 3) for _ in range(8)] + [float(rng.choice([1, 2, 30]))] for _ in range(12)] + [[0.0] * 8 + [5.0]]
    rows = spark.createDataFrame(data, ", ".join([*(f"m{k} double" for k in range(1, 9)), "cycles double"]))
    gate = F.lit(2e9)
    rows = feynman.with_variances(rows)
    slopes = [c for c in rows.columns if c.startswith("d")]
    got = rows.select("*", *[c.alias(n) for n, c in feynman.y_family(gate).items()], *[c.alias(n) for n, c in feynman.y_sigma(gate, F.col("cycles")).items()], *[c.alias("c" + n) for n, c in feynman.y_sigma(gate, F.col("cycles"), False).items()]).collect()
    for r in got[:-1]:
        m = [r[f"m{k}"] for k in range(1, 5)]
        c = {k: r[f"m{k}"] for k in range(1, 9)}
        # The covariance of binomial counts: products of C(n, i) and C(n, j) are sums of C(n, k).
        mixed = lambda i, j: sum(math.comb(k, i) * math.comb(i, k - j) * c[k] for k in range(max(i, j), i + j + 1)) - c[i] * c[j]  # noqa: B023, E731
        for name, f in formulas.items():
            scale = 0.5 if name in ("y1", "y2", "y3", "y4") else 2.0 ** (int(name[-1]) - 1) if name.startswith("ysm") else 1.0
            assert r[name] == pytest.approx(f(m) * scale, rel=1e-9, abs=1e-12)
            steps = [[(f([x + h * (k == i) for k, x in enumerate(m)]) - f([x - h * (k == i) for k, x in enumerate(m)])) / (2 * h) for h in (1e-5,)][0] for i in range(4)]
            for i in range(4):
                if f"d{i + 1}_{name}" in slopes:
                    assert r[f"d{i + 1}_{name}"] == pytest.approx(steps[i], rel=1e-4, abs=1e-4)
                else:
                    assert abs(steps[i]) < 1e-6
            exact = [r[f"d{i + 1}_{name}"] if f"d{i + 1}_{name}" in slopes else 0.0 for i in range(4)]
            var = sum(exact[i] * exact[j] * mixed(i + 1, j + 1) for i in range(4) for j in range(4))
            for prefix, per in (("sigma_", math.sqrt(max(r.cycles - 1, 0))), ("csigma_", r.cycles - 1)):
                want = -1.0 * (scale if name.startswith("ysm") else 1.0) if r.cycles < 2 else 0.0 if var < 0 else math.sqrt(var) / per * scale
                assert r[prefix + name] == pytest.approx(want, rel=1e-6)
    assert all(got[-1][n] == 0 for n in feynman.MEMBERS)
