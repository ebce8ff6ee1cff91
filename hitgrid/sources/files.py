"""Readers of folders: window records, manifests and prefix groups from NDJSON, JSON and CSV files, and the choice of a file for each run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .listmode import first_file_per_run, resolve_columns

#: Extensions in the order of preference.
EXTENSIONS = ("ndjson", "jsonl", "json", "csv")
#: Canonical window columns and their other spellings.
WINDOW_ALIASES = {
    "run_id": ["RunId", "run"], "window_index": ["WindowIndex", "index"], "t_start": ["window_start_s", "TStart", "start_s"], "t_end": ["window_end_s", "TEnd", "end_s"],
    "total_counts": ["TotalCounts", "counts", "n"], "rt_state": ["RtState", "state"],
}


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size) of all files under a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"))


def read_records(spark: SparkSession, folder: str, ext: str, columns: Sequence[str] = ()) -> DataFrame:
    """All files of an extension under a folder, with their `path`. Broken JSON lines give rows of nulls; CSV files as by `read_csv`. No files: no rows, and only the given columns."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{ext}")
    if list_files(spark, folder).filter(F.lower("path").endswith(f".{ext}")).isEmpty():
        return spark.createDataFrame([], ", ".join([*(f"`{c}` string" for c in columns), "path string"]))
    if ext == "csv":
        return read_csv(spark, folder)
    if ext == "json":
        found = _json_of_both_kinds(spark, folder)
    else:
        found = files.option("mode", "PERMISSIVE").json(folder)
    return found.withColumn("path", F.input_file_name())


def csv_headers(spark: SparkSession, folder: str) -> DataFrame:
    """(path, header), a row for each CSV file under a folder that has a line: its first one that isn't blank, without a byte order mark."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(folder)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    first = lines.filter((F.col("block") == 0) & (F.trim("value") != "")).groupBy("path").agg(F.min_by("value", "at").alias("header"))
    return first.withColumn("header", F.regexp_replace("header", "^\ufeff", ""))


def read_csv(spark: SparkSession, folder: str, order: bool = False) -> DataFrame:
    """All CSV files under a folder, each under its own header, and their `path`: all columns are strings.

    A column is known by its name, letter case aside, wherever it stands in a file; a file without it gives nulls, and of a
    name that stands twice the first counts. Values past a header are left out, short lines end in nulls. Headers take one line.
    Files meet their headers by path; only the names of columns come to the driver. With order, `line` orders the lines of a file: where
    their block begins, and their place in it; it is the same in every run and for any number of tasks.
    """
    headers = csv_headers(spark, folder)
    width = headers.agg(F.max(F.regexp_count("header", F.lit(","))).alias("n")).first()["n"]
    if width is None:
        return spark.createDataFrame([], "path string")
    places = [f"_c{k}" for k in range(width + 1)]
    schema = ", ".join(f"{c} string" for c in places)
    named = headers.withColumn("h", F.from_csv("header", schema)).select("path", F.array(*[F.trim(f"h.{c}") for c in places]).alias("names"))
    columns = named.select(F.explode("names").alias("name")).filter("name <> ''").groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("name")).orderBy("key").collect()
    named = named.select("path", F.transform("names", F.lower).alias("names"))
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").option("header", "true").option("enforceSchema", "true").csv(folder)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.array(*places).alias("values"), place.alias("line")).join(named, "path")
    pick = lambda key: F.try_element_at("values", F.nullif(F.array_position("names", F.lit(key)), F.lit(0)).cast("int"))
    return rows.select(*[pick(r["key"]).alias(r["name"]) for r in columns if r["key"] not in ("path", *["line"] * order)], "path", *["line"] * order)


def _json_of_both_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Files of one JSON value, an array or an object over several lines, and files of a value a line. Only file names come to the driver."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder)
    spread = F.bool_or(F.trim("value").rlike(r"^(\[|\{\s*$)"))
    kinds = text.groupBy(F.input_file_name().alias("path")).agg(spread.alias("spread")).collect()
    out = None
    for flag in (True, False):
        paths = [r["path"] for r in kinds if bool(r["spread"]) == flag]
        if paths:
            part = spark.read.option("mode", "PERMISSIVE").option("multiLine", str(flag).lower()).json(paths)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], "path string")


def read_windows(spark: SparkSession, folder: str, kinds: dict[str, str], aliases: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Window records of all NDJSON, JSONL, JSON and CSV files under a folder, as the columns of kinds (name: type), under whatever spelling they come.

    A file without a column that kinds has gives nulls there; a value that doesn't fit its type is null.
    """
    aliases = aliases or WINDOW_ALIASES
    out = None
    for ext in EXTENSIONS:
        rows = read_records(spark, folder, ext)
        known = {c.lower(): c for c in rows.columns}
        part = rows.select(*[_first_of([known[s.lower()] for s in [c, *aliases.get(c, [])] if s.lower() in known], t).alias(c) for c, t in kinds.items()])
        out = part if out is None else out.unionByName(part)
    return out


def _first_of(columns: Sequence[str], kind: str) -> Column:
    """The first of these columns with a value: files spell a field in one way each, so all but one are null."""
    return F.coalesce(*[F.col(f"`{c}`").cast("string") for c in columns], F.lit(None).cast("string")).try_cast(kind)


def discover_runs(spark: SparkSession, folder: str, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """(run_id, path, size): one file for each run of a folder, by extension, exact name, size and path. A run is a folder `run_id=...` or else a file's stem."""
    files = list_files(spark, folder).filter(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*extensions))
    named = F.regexp_extract("path", r"run_id=([^/]+)/", 1)
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)
    return first_file_per_run(files.withColumn("run_id", F.when(named != "", named).otherwise(stem)), extensions)


def read_manifest(spark: SparkSession, folder: str, kinds: dict[str, str], aliases: dict[str, Sequence[str]], usable: str | None = None) -> DataFrame:
    """A manifest in CSV, JSON or JSON lines with the columns of kinds, all of them required; with usable, only rows where that column holds."""
    frames = [f for ext in EXTENSIONS if len((f := read_records(spark, folder, ext)).columns) > 1]
    if not frames:
        raise FileNotFoundError(f"no manifest in {folder}")
    out = None
    for rows in frames:
        resolve_columns(rows, {name: aliases.get(name, []) for name in kinds})  # fails with the names that no file has
        known = {c.lower(): c for c in rows.columns}
        part = rows.select(*[_first_of([known[s.lower()] for s in [c, *aliases.get(c, [])] if s.lower() in known], t).alias(c) for c, t in kinds.items()])
        out = part if out is None else out.unionByName(part)
    return out.filter(F.col(usable)) if usable else out


def read_groups(spark: SparkSession, folder: str, prefixes: dict[str, str], ext: str = "csv") -> DataFrame:
    """All files of an extension whose folder or name starts with a prefix, with `grp`, the prefix's group; others don't count."""
    rows = read_records(spark, folder, ext)
    part = F.regexp_extract("path", rf"([^/]+)/[^/]*\.{ext}$", 1)
    name = F.element_at(F.split("path", "/"), -1)
    group = F.lit(None).cast("string")
    for prefix, value in sorted(prefixes.items(), key=lambda x: len(x[0])):  # the longest prefix wins
        group = F.when(name.startswith(prefix) | part.startswith(prefix), F.lit(value)).otherwise(group)
    return rows.withColumn("grp", group).filter("grp is not null").drop("path")
