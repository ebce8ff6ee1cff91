"""Value ranges within groups against brute force, and round trips through files."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitgrid.operators import curves, learning, ranges
from hitgrid.sources import files, sinks


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "a", "b", None]), rng.choice([0.5, 1.5, rng.random() * 9, rng.random() * 9]), k, rng.randint(0, 50)) for k in range(400)]
    return data, spark.createDataFrame(data, "g string, x double, id long, v long").repartition(5)


def groups(data):
    out = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_places_within_groups(rows):
    data, df = rows
    want = {r[2]: k for own in groups(data).values() for k, r in enumerate(own)}
    assert {r.id: r.place for r in ranges.places(df, "x", ["id"], keys=["g"]).collect()} == want


def test_row_before_and_greatest_before(rows):
    data, df = rows
    got = ranges.greatest_before(ranges.before(df, ["g"], "x", {"pid": "id", "pv": "v"}, ["id"]), ["g"], "x", "v", "top", ["id"]).collect()
    want = {}
    for own in groups(data).values():
        for k, r in enumerate(own):
            want[r[2]] = (own[k - 1][2] if k else None, own[k - 1][3] if k else None, max((o[3] for o in own[:k]), default=None))
    assert {r.id: (r.pid, r.pv, r.top) for r in got} == want


def test_percentiles_within_groups(rows):
    data, df = rows
    got = {r.g: r for r in ranges.percentiles(df, ["g"], "x", {"p25": 0.25, "p50": 0.5, "p90": 0.9}).collect()}
    for g, own in groups(data).items():
        assert [got[g].p25, got[g].p50, got[g].p90] == pytest.approx(list(np.percentile([r[1] for r in own], [25, 50, 90])))
    whole = ranges.percentiles(df, [], "x", {"p50": 0.5}).collect()
    assert [r.p50 for r in whole] == pytest.approx([np.median([r[1] for r in data])])
    assert ranges.percentiles(df.limit(0), ["g"], "x", {"p50": 0.5}).count() == 0


def test_part_of_is_a_binary_place(spark):
    df = spark.range(1000).select((F.col("id") % 97).cast("double").alias("x"))
    part = df.select("x", ranges.part_of(df, "x").alias("p")).distinct().orderBy("x").collect()
    assert [r.p for r in part] == sorted(r.p for r in part) and len({r.p for r in part}) > 2


@pytest.mark.parametrize("part_rows", [1_000_000, 300, 10, 2, 1])
def test_parts_follow_the_rows(spark, monkeypatch, part_rows):
    """One to four steps of the lookup; nulls, ties, keys beyond 2 ** 53 and below zero."""
    monkeypatch.setattr(ranges, "PART_ROWS", part_rows)
    monkeypatch.setattr(ranges, "FANOUT", 8)
    rng = random.Random(9)
    data = [(k, rng.choice([None, 7, 7, 2**60 + rng.randint(0, 5), rng.randint(-(10**6), 10**6), rng.randint(-(10**6), 10**6)])) for k in range(3000)]
    df = spark.createDataFrame(data, "id long, x long").repartition(6)
    got = df.select("id", "x", ranges.part_of(df, "x").alias("p")).collect()
    ordered = sorted(got, key=lambda r: (r.x is not None, r.x or 0, r.id))
    assert [r.p for r in ordered] == sorted(r.p for r in got)
    assert len({r.p for r in got}) >= (3 if part_rows > 2 else 8**3 if part_rows == 1 else 8**2)
    want = {r.id: k for k, r in enumerate(ordered)}
    assert {r.id: r.place for r in ranges.places(df, "x", ["id"]).collect()} == want
    assert df.limit(0).select(ranges.part_of(df.limit(0), "x")).count() == 0


def test_trailing_counts_with_a_width_for_each_row(spark):
    """A hot run, ties, nulls, widths of 0 and beyond all."""
    rng = random.Random(5)
    data = [("hot" if k % 3 else rng.choice(["a", None]), rng.choice([None, 5, 5, rng.randint(0, 300)]), rng.choice([None, 0, 1, 40, 1000]), k) for k in range(400)]
    df = spark.createDataFrame(data, "g string, t long, w long, id long").repartition(5)
    got = {r.id: r.trailing for r in ranges.trailing_counts(df, ["g"], "t", F.col("w"), ["id"]).collect()}
    for g, t, w, k in data:
        want = 0 if t is None or w is None else sum(x[1] is not None and x[0] == g and t - w <= x[1] < t for x in data)
        assert got.get(k, 0) == want


@pytest.mark.parametrize("keep", [0.5, 0.99, 0.9999])
def test_exponential_mean_is_the_fold(spark, keep):
    rng = random.Random(6)
    data = [("hot" if k % 4 else "b", k * 7 % 3001, rng.randint(0, 1000)) for k in range(3001)]
    df = spark.createDataFrame(data, "g string, t long, n long").repartition(6)
    got = {(r.g, r.t): r.ewma for r in ranges.exponential_mean(df, ["g"], "t", F.col("n"), keep).collect()}
    assert len(got) == len(data)
    for g in ("hot", "b"):
        mean = 0.0
        for _, t, n in sorted(x for x in data if x[0] == g):
            mean = keep * mean + (1 - keep) * n
            assert got[g, t] == pytest.approx(mean, rel=1e-9, abs=1e-9)


def test_schedules_cover_clamp_and_are_checked(spark):
    """Many rows with gaps; times before, between and behind them; faults by name."""
    import bisect

    from hitgrid.operators import schedule

    rng = random.Random(7)
    plan, at = [], 100
    for k in range(3000):
        end = at + rng.randint(1, 9)
        plan.append((float(at), float(end), f"s{k}", k))
        at = end + rng.choice([0, 0, 5])
    table = spark.createDataFrame(plan, "a double, b double, state string, w int").repartition(4)
    schedule.check(table, "a", "b")
    asked = [(k, float(rng.randint(0, at + 200))) for k in range(2000)] + [(2000, plan[-1][1]), (2001, plan[5][1]), (2002, plan[5][0])]
    rows = spark.createDataFrame(asked, "id int, t double").repartition(3)
    got = {r.id: (r.state, r.w, r.covered) for r in schedule.covering(rows, "t", table, "a", "b", ["state", "w"], ["id"]).collect()}
    starts = [p[0] for p in plan]
    assert len(got) == len(asked)
    for k, t in asked:
        row = plan[0] if t < plan[0][0] else plan[-1] if t >= plan[-1][1] else plan[bisect.bisect_right(starts, t) - 1]
        covered = t < row[1] or row is plan[-1] or t < plan[0][0]
        assert got[k] == ((row[2], row[3], True) if covered else (None, None, False))
    for bad, fault in (([(0.0, 5.0), (4.0, 6.0)], "overlap"), ([(0.0, 5.0), (6.0, 6.0)], "empty"), ([(0.0, None)], "empty")):
        with pytest.raises(ValueError, match=fault):
            schedule.check(spark.createDataFrame(bad, "a double, b double"), "a", "b")
    with pytest.raises(ValueError, match="no rows"):
        schedule.check(table.limit(0), "a", "b")


def test_isotonic_knots_and_their_lines(spark):
    rng = random.Random(8)
    data = [(round(0.1 + 0.8 * rng.random(), 3),) for _ in range(600)]
    df = spark.createDataFrame([(p, int(rng.random() < p)) for (p,) in data], "p double, y int").repartition(4)
    xs, ys = curves.knots(curves.isotonic(df)).first()
    assert xs[0] == 0 and xs[-1] == 1 and ys[0] == ys[1] and ys[-1] == ys[-2] and xs == sorted(xs) and ys == sorted(ys)
    asked = [0.0, 1.0, -1.0, 2.0, *xs, *[rng.random() for _ in range(200)]]
    got = spark.createDataFrame([(k, p) for k, p in enumerate(asked)], "k int, p double").select("k", curves.interpolated(F.col("p"), xs, ys).alias("v")).collect()
    for r in got:
        assert r.v == pytest.approx(float(np.interp(asked[r.k], xs, ys)), abs=1e-12)
    one = spark.range(1).select(curves.interpolated(F.lit(0.3), [0.5], [0.7]).alias("a"), curves.interpolated(F.lit(0.3), [], []).alias("b")).first()
    assert (one.a, one.b) == (0.7, 0.3) and curves.knots(df.limit(0).select(F.col("p").alias("x"), F.col("p").alias("y"))).count() == 0


def test_whitening_and_mahalanobis_against_numpy(spark):
    from hitgrid.plans import reports

    rng = np.random.default_rng(9)
    data = []
    for _ in range(40):
        a = rng.normal(size=(3, 3))
        c, x = a @ a.T, rng.normal(size=3)
        data.append([c[0, 0], c[1, 1], c[2, 2], c[0, 1], c[0, 2], c[1, 2], *x])
    data.append([1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 3.0])  # singular
    names = ["a", "b", "c", "d", "e", "f", "x1", "x2", "x3"]
    df = spark.createDataFrame([[float(v) for v in r] for r in data], ", ".join(f"{n} double" for n in names))
    order = [F.col(n) for n in names[:6]]
    out = df.withColumns(reports.cholesky3(*order))
    z = reports.whitened3((F.col("x1"), F.col("x2"), F.col("x3")), {k: F.col(k) for k in ("l11", "l21", "l31", "l22", "l32", "l33")})
    rows = out.select("*", *[v.alias(f"z{k}") for k, v in enumerate(z, 1)], reports.least_eigenvalue(*order).alias("least")).collect()
    for r in rows:
        c = np.array([[r.a, r.d, r.e], [r.d, r.b, r.f], [r.e, r.f, r.c]])
        x = np.array([r.x1, r.x2, r.x3])
        assert r.least == pytest.approx(np.linalg.eigvalsh(c)[0], abs=1e-7)
        if r.l33 is None:
            assert np.linalg.matrix_rank(c) < 3
            continue
        assert np.linalg.cholesky(c) == pytest.approx(np.array([[r.l11, 0, 0], [r.l21, r.l22, 0], [r.l31, r.l32, r.l33]]), abs=1e-9)
        assert [r.z1, r.z2, r.z3] == pytest.approx(list(np.linalg.solve(np.linalg.cholesky(c), x)), rel=1e-6)
        assert r.z1**2 + r.z2**2 + r.z3**2 == pytest.approx(x @ np.linalg.inv(c) @ x, rel=1e-6)


def test_dealt_out_labels_show_a_leak(spark):
    """A fair control ends near chance. Where test rows stand among the training rows, with their labels, dealing the labels out still hides nothing but the leak itself: a copied label column."""
    from hitgrid.plans.learning import shuffled_label_control

    rng = random.Random(10)
    data = [(k, rng.random(), int(rng.random() < 0.5)) for k in range(800)]
    rows = spark.createDataFrame([(k, x, int(x > 0.5), int(x > 0.5)) for k, x, _ in data], "id long, x double, y int, copy int")
    train, test = rows.filter("id < 600"), rows.filter("id >= 600")
    right = lambda df: df.selectExpr("avg(cast((cast(p >= 0.5 as int) = y) as double)) a").first().a
    assert right(learning.probabilities(learning.classifier(train, ["x"], "y", trees=5, depth=3), test)) > 0.95
    assert 0.3 < right(shuffled_label_control(train, test, ["x"], "id", "y", 31, trees=5, depth=3)) < 0.7
    # A leak: the dealt labels' order is known to a feature of the test rows and of the training rows.
    dealt = learning.shuffled(train, "id", "y", 31)
    leaky = dealt.withColumn("x", F.col("y") + 0.0).drop("copy")
    model = learning.classifier(leaky, ["x"], "y", trees=5, depth=3)
    assert right(learning.probabilities(model, test.withColumn("x", F.col("y") + 0.0))) > 0.95


def test_grouped_auc_is_the_area_of_the_curve(spark):
    rng = random.Random(8)
    data = [(g, round(rng.random(), 2), int(rng.random() < 0.4)) for g in ("a", "b") for _ in range(300)]
    df = spark.createDataFrame(data, "g string, p double, y int")
    got = {r.g: r.roc_auc for r in learning.grouped_auc(df, ["g"]).collect()}
    for g in got:
        assert got[g] == pytest.approx(curves.areas(curves.curve(df.filter(F.col("g") == g))).first().roc_auc)


def test_permutation_importance_finds_the_feature(spark):
    rng = random.Random(5)
    data = [(k, rng.random(), rng.random()) for k in range(400)]
    df = spark.createDataFrame([(k, a, b, int(a > 0.5)) for k, a, b in data], "id long, a double, b double, y int")
    model = learning.classifier(df, ["a", "b"], "y", trees=5, depth=3)
    got = {r.feature: r["drop"] for r in learning.permutation_importance(model, df, ["a", "b"], "id", "y").collect()}
    assert set(got) == {"a", "b"} and got["a"] > 0.3 > abs(got["b"]) * 3
    wide = df.withColumn("c", F.col("a"))  # no tree asks for it
    assert {r.feature: r["drop"] for r in learning.permutation_importance(learning.classifier(wide, ["a", "b"], "y", trees=5, depth=3), wide, ["a", "b", "c"], "id", "y").collect()}["c"] == 0
    a, b = learning.calibration(model, df, "y")
    calibrated = learning.probabilities(model, df, calibration=(a, b))
    assert calibrated.filter("(p >= 0.5) = (y = 1)").count() > 390


def test_windows_of_all_formats(spark, tmp_path):
    record = {"RunId": "r1", "index": 3, "t_start": "1.5", "counts": "x"}
    (tmp_path / "a.ndjson").write_text(json.dumps(record) + "\n{broken\n")
    (tmp_path / "b.json").write_text(json.dumps([record | {"RunId": "r2"}]))
    (tmp_path / "d.json").write_text("\n".join(json.dumps(record | {"RunId": f"r{k}"}) for k in (4, 5)))
    (tmp_path / "c.csv").write_text("run_id,window_index,t_start,n\nr3,4,2.5,7\n")
    got = files.read_windows(spark, str(tmp_path), {"run_id": "string", "window_index": "long", "t_start": "double", "total_counts": "long"}).collect()
    assert sorted(tuple(r) for r in got if r.run_id) == [("r1", 3, 1.5, None), ("r2", 3, 1.5, None), ("r3", 4, 2.5, 7), ("r4", 3, 1.5, None), ("r5", 3, 1.5, None)]
    assert sum(r.run_id is None for r in got) == 1


def test_csv_files_under_their_own_headers(spark, tmp_path):
    """Other orders, spellings and columns; leading zeros; a byte order mark, blank first lines, quoted values, short lines, empty files."""
    import csv

    texts = {
        "a.csv": "run_id,window_index,t_start,total_counts\n007,1,0.5,10\n008,2,1.5,20\n",
        "sub/b.csv": "total_counts,run_id,extra\n99,008,\"x, y\"\n98,0010\n",
        "c.csv": "\ufeffrun_id,index\n007,3\n",
        "d.csv": "\n\nIndex,RUN_ID,counts\n4,009,40\n",
        "e.csv": "",
        "f.csv": "run_id,index\n",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    kinds = {"run_id": "string", "window_index": "long", "t_start": "double", "total_counts": "long"}
    want = []
    for text in texts.values():
        lines = list(csv.reader(text.lstrip("\ufeff").strip("\n").splitlines()))
        names = [n.lower() for n in (lines or [[]])[0]]
        for line in lines[1:]:
            row = dict(zip(names, line, strict=False))
            pick = lambda *of: next((row[o] for o in of if o in row), None)  # noqa: B023, E731
            number = lambda v, f: None if v is None else f(v)
            want.append((pick("run_id"), number(pick("window_index", "index"), int), number(pick("t_start"), float), number(pick("total_counts", "counts"), int)))
    got = [tuple(r) for r in files.read_windows(spark, str(tmp_path), kinds).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) == 6
    back = files.read_csv(spark, str(tmp_path))
    assert {r.extra for r in back.collect()} == {None, "x, y"} and all(t == "string" for _, t in back.dtypes)


def test_a_file_for_each_run(spark, tmp_path):
    for name, size in (("r1.csv", 50), ("r1.json", 5), ("r2.csv", 5), ("run_id=r2/x.csv", 50), ("r3.txt", 9)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x" * size)
    got = {r.run_id: (r.path.rsplit("/", 1)[1], r.size) for r in files.discover_runs(spark, str(tmp_path)).collect()}
    assert got == {"r1": ("r1.json", 5), "r2": ("r2.csv", 5)}


def test_manifest_needs_its_columns(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Run_ID,group,usable\n1,g,true\n2,h,false\n")
    kinds = {"run_id": "long", "covariance_group_id": "string", "usable_for_covariance": "boolean"}
    aliases = {"covariance_group_id": ["group"], "usable_for_covariance": ["usable"]}
    assert [tuple(r) for r in files.read_manifest(spark, str(tmp_path), kinds, aliases, "usable_for_covariance").collect()] == [(1, "g", True)]
    with pytest.raises(ValueError, match="covariance_group_id"):
        files.read_manifest(spark, str(tmp_path), kinds, {"usable_for_covariance": ["usable"]})


def test_prefix_groups_take_the_longest_prefix(spark, tmp_path):
    for name in ("dual_a.csv", "dual_far_b.csv", "none.csv"):
        (tmp_path / name).write_text(f"id\n{name}\n")
    got = files.read_groups(spark, str(tmp_path), {"dual_": "dual", "dual_far_": "far"}).collect()
    assert sorted((r.grp, r.id) for r in got) == [("dual", "dual_a.csv"), ("far", "dual_far_b.csv")]


def test_event_log_and_rollover(spark, tmp_path):
    det = spark.createDataFrame([("r", 100 - k, k % 3 + 1, k) for k in range(50)], "run_id string, ts_us long, channel long, event_id long")
    log = sinks.event_log(det, ["run_id"], "ts_us", ["event_id"], ["ts_us"])
    sinks.write_lines(log, str(tmp_path / "log"), F.col("line"), ["run_id"])
    back = sorted((json.loads(r.value) for r in sinks.read_lines(spark, str(tmp_path / "log")).collect()), key=lambda x: x["index"])
    assert [x["index"] for x in back] == list(range(1, 51)) and [x["ts_us"] for x in back] == list(range(51, 101))
    parts = sinks.rollover(det, 8 / sinks.EVENTS_PER_MB).groupBy("file_no").agg(F.count("*").alias("n"), F.max("ts_us").alias("t")).orderBy("file_no").collect()
    assert [r.n for r in parts] == [8] * 6 + [2] and [r.t for r in parts] == sorted(r.t for r in parts)


def test_events_without_props_keep_their_lines(spark, tmp_path):
    from hitgrid.plans.reports import fn_json

    spark.createDataFrame([(2, None), (8, '{"k": 4}')], "event_id long, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(tuple(r) for r in fn_json(spark, str(tmp_path)).select("event_id", "line", F.coalesce("k", F.lit(-1.0)), F.coalesce("value", F.lit(-1.0))).collect())
    assert got == [(2, 1, -1.0, -1.0), (2, 3, -1.0, 1500.0), (8, 1, 4.0, -1.0), (8, 3, -1.0, 1500.0)]


def counted(spark, seen):
    """A column function that counts the rows it is asked for."""

    def look(x):
        seen.add(1)
        return x

    return F.udf(look, "double").asNondeterministic()


def test_coverage_looks_at_windows_once(spark):
    from hitgrid.plans.scoring import coverage

    seen = spark.sparkContext.accumulator(0)
    rows = spark.range(120).select((F.col("id") % 2).alias("grp"), (F.col("id") % 24).alias("run"), counted(spark, seen)(F.col("id") % 7 + 1.0).alias("m1"), (F.col("id") % 5 + 1.0).alias("m2"), (F.col("id") % 3 + 1.0).alias("m3"))
    assert len(coverage(rows, ["grp"]).collect()) == 8
    assert seen.value == 120


def test_percentiles_look_at_values_once(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = spark.range(101).select((F.col("id") % 1).alias("g"), counted(spark, seen)(F.col("id") * 1.0).alias("x"))
    assert [tuple(r) for r in ranges.percentiles(rows, ["g"], "x", {"a": 0.5, "b": 0.905}).collect()] == [(0, 50.0, 90.5)]
    assert seen.value == 101


def test_areas_look_at_scores_once(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = spark.range(60).select((F.col("id") % 3).alias("g"), counted(spark, seen)(F.col("id") / 60).alias("p"), (F.col("id") >= 30).cast("int").alias("y"))
    found = learning.grouped_auc(rows, ["g"], part=F.floor(F.col("p") * 4)).collect()
    assert {r.g: r.roc_auc for r in found} == {0: 1.0, 1: 1.0, 2: 1.0} and seen.value == 60
