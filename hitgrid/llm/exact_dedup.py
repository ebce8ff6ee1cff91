"""Exact deduplication by skew-safe combining.

Stage 1 deduplicates inside each task, stage 2 merges the survivors of a digest within salts, stage 3
combines the winners of the salts. Every stage groups by the whole content (losslessly compressed), so
equal digests alone never make two texts equal, and a text that fills a third of all rows reaches
stage 2 as one row per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, keyed, written

SALTS = 16
_BATCH = 4 << 20


def _normal(column: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(column, ""))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text", _BATCH):
        texts = _normal(batch.column("text")).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())], ["row_key", "digest"])


def _local_winners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stage 1: per slice of rows one row for each content, with its largest key and its number of rows."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in by_bytes(batches, "text", _BATCH):
        best: dict[str, list[int]] = {}
        for text, key in zip(_normal(batch.column("text")).to_pylist(), batch.column("row_key").to_pylist(), strict=True):
            if (got := best.get(text)) is None:
                best[text] = [key, 1]
            else:
                got[0], got[1] = max(got[0], key), got[1] + 1
        raw = [t.encode() for t in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array([hashlib.sha256(t).digest() for t in raw], pa.binary()), pa.array([pack(t) for t in raw], pa.binary()), pa.array([v[0] for v in best.values()], pa.int64()), pa.array([v[1] for v in best.values()], pa.int64())],
            ["digest", "content", "last_key", "n"],
        )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), a row per row of docs.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row
    with the largest id stays, a null id being less than all others; of several rows with that id one stays.
    Every row is judged, repeated ones too. keep_id is the id of the row that stays. Extra columns don't go on.
    An empty table gives no rows.
    """
    rows, plain = keyed(docs, id_col, F.col(text_col).alias("text"))
    source = rows.select("row_key", "text")
    local = source.mapInArrow(_local_winners, "digest binary, content binary, last_key long, n long")
    salted = local.withColumn("salt", F.pmod(F.xxhash64("last_key"), F.lit(salts))).groupBy("digest", "content", "salt").agg(F.max("last_key").alias("last_key"), F.sum("n").alias("n"))
    groups = salted.groupBy("digest", "content").agg(F.max("last_key").alias("keep_key"), F.sum("n").alias("group_size"))
    # One row per content from here on; the content itself isn't needed any more, unless a digest stands for two.
    groups = written(groups.select("digest", "keep_key", "group_size"), "exact-groups")
    clashes = groups.groupBy("digest").count().filter("count > 1").limit(1).count()
    if clashes:
        raise ArithmeticError("two different texts have the same SHA-256 digest")
    judged = source.mapInArrow(_digests, "row_key long, digest binary").join(groups, "digest")
    judged = judged.select("row_key", "keep_key", "group_size", F.lower(F.hex("digest")).alias("text_sha256"))
    if plain:
        ids = dict(docs.dtypes)[id_col]
        return judged.select(F.col("row_key").cast(ids).alias(id_col), F.col("keep_key").cast(ids).alias("keep_id"), "group_size", (F.col("row_key") == F.col("keep_key")).alias("kept"), "text_sha256")
    names = rows.select("row_key", id_col)
    keepers = names.select(F.col("row_key").alias("keep_key"), F.col(id_col).alias("keep_id"))
    out = judged.join(names, "row_key").join(keepers, "keep_key")
    return out.select(id_col, "keep_id", "group_size", (F.col("row_key") == F.col("keep_key")).alias("kept"), "text_sha256")

