"""Readers of list-mode data: text lines, packed words, LMX files, windows and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_lines(lines: DataFrame, line: str = "value", default_channel: int = 0) -> DataFrame:
    """Adds ts_us and channel of `time[,channel]` lines: whole microseconds or seconds with a fraction; separators are comma, tab and space.

    Comments (#) and blank lines give nulls; so do negative times.
    """
    text = F.trim(F.regexp_replace(line, "#.*$", ""))
    parts = F.split(text, r"[,\t ]+")
    time = F.get(parts, F.lit(0))
    micros = F.when(time.rlike(r"^\d+$"), time.cast("long")).when(time.rlike(r"^\d*\.\d+$"), F.round(time.cast("double") * 1e6).cast("long"))
    channel = F.coalesce(F.get(parts, F.lit(1)).try_cast("long"), F.lit(default_channel).cast("long"))
    return lines.withColumn("ts_us", micros).withColumn("channel", F.when(micros.isNotNull(), channel))


def read_listmode(spark: SparkSession, path: str, default_channel: int = 0) -> DataFrame:
    """(run_id, ts_us, channel): a run is a file."""
    rows = parse_lines(spark.read.text(path).withColumn("run_id", F.input_file_name()), default_channel=default_channel)
    return rows.filter("ts_us is not null").select("run_id", "ts_us", "channel")


def unpack_words(df: DataFrame, word: str = "word") -> DataFrame:
    """Adds ts_us and channel of packed words: time in 10 ns ticks above five bits of channel."""
    return df.withColumns({"ts_us": F.expr(f"shiftrightunsigned({word}, 5) div 100"), "channel": F.col(word).bitwiseAND(31)})


def pack_words(df: DataFrame, ts: str = "ts_us", channel: str = "channel") -> DataFrame:
    return df.withColumn("word", F.shiftleft(F.col(ts) * 100, 5).bitwiseOR(F.col(channel)))


def little_endian(data: Column, start: Column, size: int = 4) -> Column:
    """An unsigned number from the bytes of a binary column at a 1-based place."""
    return F.conv(F.hex(F.concat(*[F.substring(data, start + (size - 1 - k), F.lit(1)) for k in range(size)])), 16, 10).cast("long")


def read_lmx(spark: SparkSession, path: str, channels: int = 32) -> DataFrame:
    """LMX files of a path, decoded. A file is one row until its records explode; files are bounded by the acquisition's rollover."""
    return decode_lmx(spark.read.format("binaryFile").load(path).select("path", "content"), channels)


def lmx_headers(files: DataFrame) -> DataFrame:
    """(path, tick_ns, scaler, fifo_lost) of (path, content); null where the header lacks a line."""
    text = F.decode("content", "ISO-8859-1")
    head = F.substring(text, F.lit(1), F.instr(text, "BinaryDataFollows"))
    number = lambda name: F.regexp_extract(head, rf"(?m)^{name}\D*(\d+)", 1).try_cast("long")
    return files.select("path", number("BinaryDataClockTickLength").alias("tick_ns"), number("InternalScaler").alias("scaler"), number("FifoLostCounts").alias("fifo_lost"))


def decode_lmx(files: DataFrame, channels: int = 32) -> DataFrame:
    """(path, record, ts_ticks, channel) of (path, content): an ASCII header up to BinaryDataFollows, then records of a channel mask and ticks.

    A zero mask is a marker: ticks 1 adds the segment before to the offset, 0xFFFFFFFF ends the file. Records stop at
    InternalScaler + 2.
    """
    mark = F.lit("BinaryDataFollows")
    text = F.decode("content", "ISO-8859-1")
    at = F.instr(text, "BinaryDataFollows")
    head = F.substring(text, F.lit(1), at)
    scaler = F.regexp_extract(head, r"InternalScaler\D*(\d+)", 1).cast("long")
    body_start = at + F.length(mark) + F.regexp_count(F.substring(text, at + F.length(mark), F.lit(2)), F.lit("[\r\n]"))
    n = F.floor((F.length("content") - body_start + 1) / 8)
    rows = files.select("path", "content", body_start.alias("b"), F.least(n, F.coalesce(scaler, n) + 2).cast("int").alias("n")).filter("n > 0")
    rows = rows.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.alias("record"), F.substring("content", F.col("b") + i * 8, F.lit(8)).alias("raw")))).alias("r"))
    rows = rows.select("path", "r.record", little_endian(F.col("r.raw"), F.lit(1)).alias("mask"), little_endian(F.col("r.raw"), F.lit(5)).alias("ticks"))
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("record")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    is_mark = F.col("mask") == 0
    rows = rows.withColumns({"ended": F.max((is_mark & (F.col("ticks") == 0xFFFFFFFF)).cast("int")).over(upto), "before": F.lag(F.when(~is_mark, F.col("ticks"))).over(w)})
    rows = rows.withColumn("offset", F.sum(F.when(is_mark & (F.col("ticks") == 1), F.coalesce("before", F.lit(0))).otherwise(0)).over(upto))
    hits = rows.filter((F.col("ended") == 0) & ~is_mark)
    lit = F.filter(F.sequence(F.lit(1), F.lit(channels)), lambda c: F.getbit(F.col("mask"), c - 1) == 1)
    return hits.select("path", "record", (F.col("ticks") + F.col("offset")).alias("ts_ticks"), F.explode(lit).alias("channel"))


def resolve_columns(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """The canonical columns, each from the first of its spellings (letter case aside) that df has; a missing one fails with the list."""
    known = {c.lower(): c for c in df.columns}
    found = {name: next((known[s.lower()] for s in [name, *spellings] if s.lower() in known), None) for name, spellings in aliases.items()}
    if missing := [name for name, c in found.items() if c is None]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in found.items()])


def file_numbers(path: Column) -> Column:
    """All numbers in a path's last part."""
    return F.transform(F.regexp_extract_all(F.element_at(F.split(path, "/"), -1), F.lit(r"([-+]?\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))


def first_file_per_run(files: DataFrame, extensions: Sequence[str] = ("ndjson", "jsonl", "json", "csv")) -> DataFrame:
    """One file of each run: by the order of extensions, then exact name, size (largest first) and path. Columns: run_id, path, size."""
    from pyspark.sql import Window

    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, extensions)), ext), F.lit(0)), F.lit(99))
    exact = F.when(F.regexp_extract("path", r"([^/]+)\.[^.]*$", 1) == F.col("run_id"), 0).otherwise(1)
    w = Window.partitionBy("run_id").orderBy(rank, exact, F.desc("size"), "path")
    return files.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
