"""Line deduplication in DataFrame operations only.

Lines are exploded as 128-bit hashes of their normalised form with their positions, once, into a table. From it
distinct documents are counted for each hash, and each document gets a mask of its frequent lines, by which the other
lines are put together again in order. Line texts themselves are never shuffled apart from their document.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, keyed, written


def lines_of(text: Column) -> Column:
    """The lines of a text, split at \\n; null or empty: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def stripped(line: Column) -> Column:
    """The line without `[\\x20\\x09-\\x0D]` at both ends; most lines have none and skip the slow trim."""
    return F.when(reduce(or_, [f(c) for c in SPACES for f in (line.startswith, line.endswith)]), F.btrim(line, F.lit(SPACES))).otherwise(line)


def folded(line: Column) -> Column:
    """Equal for two lines just if they are equal after lower-casing A-Z.

    Plain ASCII is lower-cased. Other lines are read as one character a byte, which `lower` folds much faster than
    `translate` would. That turns lead bytes C2-DE of two-byte characters into E2-FE as well, but a character's number of
    further bytes tells these from real E2-F4, so different lines stay different.
    """
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(F.lower(F.decode(line.cast("binary"), "ISO-8859-1")))


def drop_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with the text of the remaining lines, joined by \\n, and `n_lines` (before) and `n_dropped`.

    A line goes, everywhere, if its key has at least min_chars code points and stands in at least min_docs
    documents. A document is an id: rows that repeat an id count once, rows without an id each for
    themselves; every row is kept and judged. All other columns stay; input columns named n_lines or
    n_dropped are replaced. Where all lines go, the text is empty. An empty table gives no rows.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col, "n_lines", "n_dropped", "row_key")]
    rows, plain = keyed(docs, id_col, text_col, *others)
    document = {} if plain else {"doc": F.col(id_col), "lone": F.when(F.col(id_col).isNull(), F.col("row_key"))}
    found = rows.select("row_key", *(c.alias(n) for n, c in document.items()), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    key = stripped(F.col("line"))
    same = folded(key)
    # Keys that are too short to go have no second hash and meet nothing; the first one spreads them.
    fits = F.length(key) >= min_chars
    hashes = {"h1": F.when(fits, F.xxhash64(same)).otherwise(F.xxhash64("row_key", "pos")), "h2": F.when(fits, F.xxhash64(F.lit(1), same))}
    found = written(found.select("row_key", *document, "pos", *(h.alias(n) for n, h in hashes.items())), "lines")
    per_document = found.filter("h2 is not null").groupBy("h1", "h2", *(document or ["row_key"])).agg(F.lit(1).alias("one"))
    frequent = per_document.groupBy("h1", "h2").agg(F.count("one").alias("n")).filter(F.col("n") >= min_docs)
    # Read back from tables, both sides of the join are dealt out by it alone, and a hot line can be split among tasks.
    frequent = written(frequent.select("h1", "h2", F.lit(True).alias("gone")), "frequent-lines")
    gone = F.sort_array(F.collect_list(F.struct("pos", F.col("gone").isNotNull().alias("gone"))))["gone"]
    masks = found.join(frequent, ["h1", "h2"], "left").groupBy("row_key").agg(F.count(F.lit(1)).alias("n_lines"), F.count("gone").alias("n_dropped"), F.when(F.count("gone") > 0, gone).alias("mask"))
    kept = F.filter(lines_of(F.col(text_col)), lambda line, i: ~F.col("mask")[i])
    text = F.when(F.col("mask").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(kept, "\n"))
    order = [c for c in docs.columns if c in (id_col, text_col, *others)]
    return rows.join(masks, "row_key").select(*(F.col(c) if c != text_col else text.alias(c) for c in order), "n_lines", "n_dropped")
