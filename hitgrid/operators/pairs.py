"""Counts with the metadata of their pairs, by whichever key both tables have."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys in the order in which they are looked for.
JOIN_KEYS = ["pair_id", "pairid", "pair", "id", "index", "row"]


def shared_key(a: Sequence[str], b: Sequence[str], keys: Sequence[str] = JOIN_KEYS) -> tuple[str, str] | None:
    """The first key that both lists of columns have, letter case aside, as both spell it."""
    left, right = ({c.lower(): c for c in x} for x in (a, b))
    return next(((left[k], right[k]) for k in keys if k in left and k in right), None)


def with_metadata(counts: DataFrame, metadata: DataFrame, order: Sequence[str] = ("path", "line"), keys: Sequence[str] = JOIN_KEYS) -> DataFrame:
    """counts with the columns of metadata for the same key, values compared without letter case. Of repeated keys the last row counts, in the order of the columns `order`
    (which don't go on); rows without a key or without metadata go. Fails where no key is shared. Columns of metadata that counts has, too, are those of counts."""
    found = shared_key(counts.columns, metadata.columns, keys)
    if found is None:
        raise ValueError(f"no shared key: one of {', '.join(keys)}")
    mine, theirs = found
    have = {c.lower() for c in counts.columns}
    columns = [c for c in metadata.columns if c not in order and c.lower() not in have]
    last = metadata.filter(F.col(theirs).isNotNull()).groupBy(F.lower(F.col(theirs).cast("string")).alias("_key")).agg(F.max_by(F.struct(*columns) if columns else F.lit(1), F.struct(*order)).alias("_m"))
    rows = counts.withColumn("_key", F.lower(F.col(mine).cast("string"))).join(last, "_key")
    return rows.select(*counts.columns, *[f"_m.{c}" for c in columns])
