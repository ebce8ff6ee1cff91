"""Sources and sinks. Text, words and names are made from the driver's tables in Spark and read back by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranges
from ..registry import query
from ..sources import files, listmode
from ..sources.sinks import EVENTS_PER_MB, event_log, listmode_rows, read_lines, rollover, write_lines
from ..tables import new_path
from .moments import LADDER_SQL
from .views import DETECTIONS, HOUR, detections, table
from .windows import _W


@query(f"WITH {DETECTIONS} SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts_us END AS ts_us, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 0 ELSE channel END AS channel FROM det")
def src_listmode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with three kinds of separators, comments and missing channels."""
    return _parsed(spark, sf_dir, 0)


@query(f"WITH {DETECTIONS} SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts_us END AS ts_us, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 1 ELSE channel END AS channel FROM det")
def src_listmode_default_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, 1)


def _parsed(spark: SparkSession, sf_dir: str, default: int) -> DataFrame:
    i, t, c = F.col("event_id"), F.col("ts_us").cast("string"), F.col("channel").cast("string")
    line = F.when(i % 10 == 0, F.concat(F.lit("# "), t)).when(i % 3 == 0, t).when(i % 3 == 1, F.concat(t, F.lit(","), c)).otherwise(F.concat(t, F.lit("\t"), c, F.lit(" # hit")))
    return listmode.parse_lines(detections(spark, sf_dir).select("event_id", line.alias("value")), default_channel=default).select("event_id", "ts_us", "channel")


@query(f"WITH {DETECTIONS} SELECT event_id, ts_us - min(ts_us) OVER () AS ts_us, channel FROM det")
def src_packed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = detections(spark, sf_dir)
    start = det.agg(F.min("ts_us").alias("t0"))
    rel = det.join(F.broadcast(start)).select("event_id", (F.col("ts_us") - F.col("t0")).alias("ts_us"), "channel")  # one row
    return listmode.unpack_words(listmode.pack_words(rel).select("event_id", "word")).select("event_id", "ts_us", "channel")


@query("SELECT p_partkey, CAST(p_partkey AS DOUBLE) AS id, CAST(p_size AS DOUBLE) AS x, -CAST(p_size % 7 AS DOUBLE) AS y, p_size % 5 + 0.5::DOUBLE AS z FROM part")
def src_filename_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id and place from a file's name."""
    name = F.format_string("/data/run12/p%d_%d.0_-%d_%d.5.csv", "p_partkey", F.col("p_size"), F.col("p_size") % 7, F.col("p_size") % 5)
    rows = table(spark, sf_dir, "part").select("p_partkey", listmode.file_numbers(name).alias("n"))
    return rows.select("p_partkey", *[F.element_at("n", k).alias(c) for k, c in enumerate(("id", "x", "y", "z"), 1)])


@query(f"SELECT run_id, idx AS window_index, idx * 21600.0::DOUBLE AS t_start, n AS total_counts, CASE WHEN idx % 6 = 4 THEN NULL ELSE state END AS rt_state, lpad(CAST(idx AS VARCHAR), 8, '0') AS code FROM (WITH {_W} SELECT * FROM steps)")
def src_windows_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window records in files of three formats, their fields under several spellings, read back as one table.

    CSV files differ in their headers: other orders of the columns, and some have no state. Codes keep their leading zeros.
    """
    from .windows import steps

    rows = steps(spark, sf_dir).select("run_id", "idx", (F.col("idx") * 21600.0).alias("start"), "n", "state", F.lpad(F.col("idx").cast("string"), 8, "0").alias("code"))
    folder = new_path(spark, "windows")
    rows.filter("idx % 3 = 0").select(F.col("run_id").alias("RunId"), F.col("idx").alias("WindowIndex"), F.col("start").alias("TStart"), F.col("n").alias("TotalCounts"), F.col("state").alias("RtState"), "code").write.json(f"{folder}/a")
    rows.filter("idx % 6 = 1").select("run_id", F.col("idx").alias("index"), F.col("start").alias("start_s"), F.col("n").alias("counts"), "state", "code").write.option("header", "true").csv(f"{folder}/b/1")
    rows.filter("idx % 6 = 4").select("code", F.col("n").alias("total_counts"), F.col("run_id").alias("RunId"), F.col("idx").alias("WindowIndex"), F.col("start").alias("TStart")).write.option("header", "true").csv(f"{folder}/b/2")
    line = F.to_json(F.struct("run_id", F.col("idx").alias("window_index"), F.col("start").alias("t_start"), F.col("n").alias("total_counts"), F.col("state").alias("rt_state"), "code"))
    rows.filter("idx % 3 = 2").select(line.alias("value")).write.option("compression", "none").text(f"{folder}/c")
    kinds = {"run_id": "string", "window_index": "long", "t_start": "double", "total_counts": "long", "rt_state": "string", "code": "string"}
    lines = read_lines(spark, f"{folder}/c").select(F.from_json("value", ", ".join(f"{c} {t}" for c, t in kinds.items())).alias("r")).select("r.*")
    return files.read_windows(spark, f"{folder}/[ab]", kinds).unionByName(lines)


@query("SELECT CAST(c_nationkey AS VARCHAR) AS run_id, CASE WHEN bool_or(c_acctbal > 9000) THEN 'json' ELSE 'csv' END AS ext FROM customer GROUP BY 1")
def src_run_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of runs in a folder, some in two formats: one of each run is chosen."""
    folder = new_path(spark, "runs")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("run_id"), "c_custkey", "c_acctbal")
    rows.filter("c_acctbal > 9000").repartition("run_id").write.partitionBy("run_id").json(f"{folder}/a")
    rows.repartition("run_id").write.partitionBy("run_id").option("header", "true").csv(f"{folder}/b")
    return files.discover_runs(spark, folder).select("run_id", F.regexp_extract("path", r"\.(\w+)$", 1).alias("ext"))


@query("SELECT c_custkey AS run_id, c_nationkey AS covariance_group_id FROM customer WHERE c_acctbal > 0")
def src_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest as CSV, its required columns under other spellings, unusable runs left out."""
    path = new_path(spark, "manifest")
    table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("Run_ID"), F.col("c_nationkey").alias("group_id"), (F.col("c_acctbal") > 0).alias("usable")).write.option("header", "true").csv(path)
    kinds = {"run_id": "long", "covariance_group_id": "int", "usable_for_covariance": "boolean"}
    manifest = files.read_manifest(spark, path, kinds, {"covariance_group_id": ["group_id"], "usable_for_covariance": ["usable"]}, "usable_for_covariance")
    return manifest.drop("usable_for_covariance")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS total_counts, CASE WHEN l_partkey % 2 = 0 THEN 'dual' ELSE 'single' END AS mode, CASE l_returnflag WHEN 'N' THEN 30.0::DOUBLE WHEN 'R' THEN 45.0::DOUBLE END AS duration_s FROM lineitem")
def src_eval_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    duration = F.when(F.col("l_returnflag") == "N", 30.0).when(F.col("l_returnflag") == "R", 45.0)
    rows = table(spark, sf_dir, "lineitem").withColumns({"TotalCounts": F.col("l_quantity"), "Duration_s": duration, "mode": F.when(F.col("l_partkey") % 2 == 0, "dual").otherwise("single")})
    return listmode.resolve_columns(rows, {"l_orderkey": [], "l_partkey": [], "l_suppkey": [], "l_linenumber": [], "total_counts": ["totalcounts"], "mode": [], "duration_s": []})


@query("SELECT 'A' AS grp, CAST(p_partkey AS BIGINT) AS id, p_retailprice AS v FROM part UNION ALL SELECT 'B', s_suppkey, s_acctbal FROM supplier")
def src_file_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two prefix groups as one table with their group; a third prefix has none."""
    folder = new_path(spark, "groups")
    for prefix, (t, k, v) in {"single_": ("part", "p_partkey", "p_retailprice"), "dual_": ("supplier", "s_suppkey", "s_acctbal"), "other_": ("region", "r_regionkey", "r_regionkey")}.items():
        table(spark, sf_dir, t).select(F.col(k).alias("id"), F.col(v).alias("v")).write.option("header", "true").csv(f"{folder}/{prefix}{t}")
    return files.read_groups(spark, folder, {"single_": "A", "dual_": "B"}).select("grp", F.col("id").cast("long").alias("id"), F.col("v").cast("double").alias("v"))


@query(f"WITH {DETECTIONS} SELECT run_id, count(*) AS events, count(DISTINCT ts_us // {HOUR}) AS steps, sha256('edge=trailing;hours=1') AS config_hash FROM det GROUP BY 1")
def snk_replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = detections(spark, sf_dir).groupBy("run_id", F.expr(f"ts_us div {HOUR}").alias("hr")).agg(F.count(F.lit(1)).alias("n"))
    return det.groupBy("run_id").agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("steps")).withColumn("config_hash", F.sha2(F.lit("edge=trailing;hours=1").cast("binary"), 256))


@query(f"{LADDER_SQL} SELECT run_id, CAST(win AS BIGINT) AS win, CAST(count(*) AS BIGINT) AS gates, CAST(max(gate_us) AS BIGINT) AS widest, round(sum(y), 6) AS sum_y, CAST(count(z) AS BIGINT) AS valid FROM ys GROUP BY ALL")
def snk_rt_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON line for each step, its gates as arrays in the order of the ladder (a fixed number of gates), written and read back."""
    from .moments import ladder

    gates = F.sort_array(F.collect_list(F.struct("gate_us", "n_gates", F.col("y"), F.col("sigma_y"), F.col("z"))))
    rows = ladder(spark, sf_dir).groupBy("run_id", "win").agg(gates.alias("gates"))
    path = new_path(spark, "rt-windows")
    write_lines(rows, path, F.to_json(F.struct("run_id", "win", "gates")))
    read = spark.read.schema("run_id string, win long, gates array<struct<gate_us: long, n_gates: long, y: double, sigma_y: double, z: double>>").json(path)
    total = F.aggregate("gates", F.lit(0.0), lambda a, g: a + g["y"])
    valid = F.size(F.filter("gates", lambda g: g["z"].isNotNull())).cast("long")
    return read.select("run_id", "win", F.size("gates").cast("long").alias("gates"), F.element_at("gates", -1)["gate_us"].alias("widest"), F.round(total, 6).alias("sum_y"), valid.alias("valid"))


@query(f"""WITH {DETECTIONS} SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY ts_us, event_id) AS index, ts_us, channel FROM det""")
def snk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log: an index in each run, the line and its content hash, written a folder a run and read back; lines that don't match their hash fail the query."""
    log = event_log(detections(spark, sf_dir), ["run_id"], "ts_us", ["event_id"], ["ts_us", "channel", "value"])
    path = new_path(spark, "events")
    write_lines(log, path, F.concat_ws(" ", "content_hash", "line"), ["run_id"])
    read = read_lines(spark, path).select(F.substring("value", 1, 64).alias("hash"), F.expr("substring(value, 66)").alias("line"))
    fine = F.assert_true(F.col("hash") == F.sha2(F.col("line").cast("binary"), 256), F.lit("a line doesn't match its hash"))
    parsed = read.withColumn("fine", fine.isNull()).filter("fine").select(F.from_json("line", "run_id string, index long, ts_us long, channel long").alias("r"))
    return parsed.select("r.*")


@query("SELECT event_type AS run_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS line_no, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY event_type) AS t_us, user_id % 15 AS channel0 FROM events")
def snk_listmode_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times from each run's first event and channels from 0, as CSV in a folder a run, and read back."""
    path = new_path(spark, "listmode")
    listmode_rows(detections(spark, sf_dir)).write.partitionBy("run_id").option("header", "true").csv(path)
    return spark.read.schema("line_no long, t_us long, channel0 long, run_id string").option("header", "true").csv(path).select("run_id", "line_no", "t_us", "channel0")


@query("SELECT event_type AS run_id, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 512 AS file_no, event_id FROM events")
def snk_run_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acquisition files of a target size, here of 512 events, written a folder a file and read back."""
    path = new_path(spark, "rollover")
    rollover(detections(spark, sf_dir), 512 / EVENTS_PER_MB).select("run_id", "file_no", "event_id", "ts_us", "channel").repartition("run_id", "file_no").write.partitionBy("run_id", "file_no").parquet(path)
    return spark.read.parquet(path).select("run_id", F.col("file_no").cast("long").alias("file_no"), "event_id")


def _le(value):
    """Four bytes, the lowest first."""
    digits = F.lpad(F.hex(value), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)]))


@query(f"WITH {DETECTIONS} SELECT run_id, ts_us // {24 * HOUR} AS day, (ts_us % {24 * HOUR}) // 1000 AS ticks, channel FROM det")
def src_lmx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary run files, one a run and day as the acquisition rolls over, decoded again."""
    det = detections(spark, sf_dir).withColumns({"day": F.expr(f"ts_us div {24 * HOUR}"), "ticks": F.expr(f"(ts_us % {24 * HOUR}) div 1000")})
    record = F.concat(_le(F.expr("shiftleft(1L, cast(channel - 1 as int))")), _le(F.col("ticks")))
    # A file holds 4,096 records at most.
    placed = ranges.places(det, "ticks", ["event_id"], keys=["run_id", "day"]).withColumn("file_no", F.expr("place div 4096"))
    held = placed.groupBy("run_id", "day", "file_no").agg(F.sort_array(F.collect_list(F.struct("ticks", "event_id", F.hex(record).alias("raw")))).alias("rows"))
    head = F.concat(F.lit("BinaryDataClockTickLength 1000\nInternalScaler "), F.size("rows").cast("string"), F.lit("\nBinaryDataFollows\n")).cast("binary")
    tail = F.concat(_le(F.lit(0)), F.unhex(F.lit("FFFFFFFF")))
    content = F.concat(head, F.unhex(F.array_join(F.transform("rows", lambda x: x["raw"]), "")), tail)
    runs = held.select(F.concat_ws("/", "run_id", F.col("day").cast("string"), F.col("file_no").cast("string")).alias("path"), content.alias("content"))
    hits = listmode.decode_lmx(runs)
    return hits.select(F.split("path", "/")[0].alias("run_id"), F.split("path", "/")[1].cast("long").alias("day"), F.col("ts_ticks").alias("ticks"), F.col("channel").cast("long").alias("channel"))


@query(f"WITH {DETECTIONS} SELECT run_id, ts_us // {24 * HOUR} AS day, 86400.0::DOUBLE AS duration_s, count(*)::DOUBLE AS total, count(*) FILTER (channel = 7)::DOUBLE AS c7 FROM det GROUP BY ALL")
def src_count_vectors_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count vectors as CSV lines with one spelling of the header, read back by another."""
    from .channels import count_vectors

    rows = count_vectors(spark, sf_dir)
    line = F.to_csv(F.struct(*[f"c{k}" for k in range(1, 16)], F.lit(86400.0)))
    header = ", ".join(f"`Channel {k}` DOUBLE" for k in range(1, 16)) + ", Duration_S DOUBLE"
    read = rows.select("run_id", "day", F.from_csv(line, header).alias("r")).select("run_id", "day", "r.*")
    found = listmode.resolve_columns(read, {"run_id": [], "day": [], "duration_s": [], **{f"c{k}": [f"Channel{k}", f"Channel {k}"] for k in range(1, 16)}})
    total = sum((F.col(f"c{k}") for k in range(1, 16)), F.lit(0.0))
    return found.select("run_id", "day", "duration_s", total.alias("total"), "c7")


@query(f"WITH {_W} SELECT run_id, idx, n, round(center, 6) AS center, state, label FROM steps")
def snk_window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat CSV rows of the windows, written and read back."""
    from .windows import steps

    path = new_path(spark, "window-metrics")
    steps(spark, sf_dir).select("run_id", "idx", "n", F.round("center", 6).alias("center"), "state", "label").write.option("header", "true").csv(path)
    return spark.read.schema("run_id string, idx long, n long, center double, state string, label string").option("header", "true").csv(path)


@query()
def snk_validation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group summary, coverage and covariance comparison, written partitioned by report and read back as one long table."""
    from .scoring import agg_ci_coverage, agg_cov_compare, agg_cov_elementwise

    parts = {"coverage": agg_ci_coverage(spark, sf_dir), "compare": agg_cov_compare(spark, sf_dir), "elementwise": agg_cov_elementwise(spark, sf_dir)}
    path = new_path(spark, "validation")
    for name, df in parts.items():
        df.select(F.col("grp").cast("string").alias("grp"), F.to_json(F.struct(*[c for c in df.columns if c != "grp"])).alias("line")).write.parquet(f"{path}/report={name}")
    return spark.read.parquet(path).select("report", "grp", "line")


@query()
def win_monotone_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An offset for each file of a run that starts before the file ahead of it ended: a fold over the files, of which there are few."""
    det = detections(spark, sf_dir).withColumn("file_no", F.expr(f"ts_us div {5 * 24 * HOUR}")).withColumn("clock", F.expr(f"ts_us % {3 * 24 * HOUR}"))
    spans = det.groupBy("run_id", "file_no").agg(F.min("clock").alias("lo"), F.max("clock").alias("hi"))

    def fold(pdf):
        pdf = pdf.sort_values("file_no")
        offset, last, out = 0, None, []
        for lo, hi in zip(pdf["lo"], pdf["hi"], strict=True):
            offset = last - lo if last is not None and lo + offset < last else offset
            last = hi + offset
            out.append(offset)
        return pdf[["run_id", "file_no"]].assign(offset_us=out)

    return spans.groupBy("run_id").applyInPandas(fold, "run_id string, file_no long, offset_us long")
