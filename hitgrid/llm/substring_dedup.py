"""Substring deduplication by content-defined chunks.

1. A gear hash rolls over the bytes; a word starts a new chunk where the hash before it is the least of CUT_SPAN neighbours.
   So cuts depend on nearby content alone, an insertion moves none but those around it, and chunks have 1 to CUT_SPAN words.
2. Stretches of CHUNKS chunks are deduplicated by digest. Each window of MIN_WORDS words is named by the least digest of the
   stretches deep inside it; windows side by side with one name travel as one row. Equal windows hold equal chunks there,
   whatever surrounds them, so what a stretch without a second place names is done.
3. Behind a repeated stretch, rows that are equal as a whole are compared by their first one; what is left, the ends of
   repeated passages, window by window. Of equal windows the first (by key, then position) stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import by_bytes, discard, keyed, mix64, ranges, span_hashes, text_bytes, word_spans, written

#: Words of a passage from which it goes.
MIN_WORDS = 51
#: Of so many neighbouring word starts at least one is a cut.
CUT_SPAN = 4
#: Chunks of a stretch: ten words on average, so that few stretches are common phrases.
CHUNKS = 4
#: Bytes that the gear hash remembers; no more words than that.
GEAR_BYTES = 8
#: Words of over LONG bytes (scripts without spaces, encoded data) are cut up, so that about MIN_RUN bytes of them count as MIN_WORDS words.
LONG, MIN_RUN = 64, 128
_SLICE = 3 << 19
_GEAR = (mix64(np.arange(1001, 1257, dtype=np.uint64)) >> np.uint64(20)).astype(np.uint32)


def gear(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rolling hash of the GEAR_BYTES bytes before each place: h = (h << 1) + GEAR[byte], the older ones shifted out by a mask."""
    h = np.zeros(len(at), np.uint32)
    for k in range(GEAR_BYTES):
        before = at - 1 - k
        h += np.where(before >= 0, _GEAR[raw[np.maximum(before, 0)]], np.uint32(0)) << np.uint32(k)
    return h


def chunk_cuts(hashes: np.ndarray, span: int = CUT_SPAN) -> np.ndarray:
    """Whether each place is a cut: its hash is the least of some `span` neighbouring places, the first of equal ones.

    Any `span` neighbours hold a cut, and nothing further away than span - 1 places decides on one.
    """
    n = len(hashes)
    if n < span:
        return np.zeros(n, bool)
    # Earlier places win ties, so the hash and the place decide together.
    mixed = (hashes.astype(np.uint64) << np.uint64(31)) | np.arange(n, dtype=np.uint64)
    least = _sliding(mixed, span, np.minimum) & np.uint64((1 << 31) - 1)
    cut = np.zeros(n, bool)
    cut[least.astype(np.int64)] = True
    return cut


def cut_span(min_words: int) -> int:
    """CUT_SPAN, or less where windows are so short that they might hold no stretch that is settled inside."""
    return max(1, min(CUT_SPAN, (min_words - GEAR_BYTES + 2) // (CHUNKS + 3)))


def passage_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_spans, with long words cut up by their content: before every character of several bytes, and some others by the last four bytes."""
    starts, ends, first = word_spans(raw, offsets)
    long = ends - starts > LONG
    if not long.any():
        return starts, ends, first
    at = ranges(starts[long] + 3, (ends - starts)[long] - 3)
    h = sum(_GEAR[raw[at - k]] << np.uint32(k) for k in range(4))
    share = np.uint32(256 * MIN_WORDS // MIN_RUN)
    cut = at[(raw[at] >= 0xC0) | ((raw[at] < 0x80) & (((h >> np.uint32(8)) & np.uint32(255)) < share))]
    starts, ends = np.sort(np.append(starts, cut)), np.sort(np.append(ends, cut))
    return starts, ends, np.searchsorted(starts, offsets)


def _sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over every `width` neighbours (len(x) - width + 1 values)."""
    size = 1
    while 2 * size <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: size - width], x[width - size :]) if size < width else x


def _names(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_words: int) -> np.ndarray:
    """For each window of words (len(starts) - min_words + 1) the least digest of the stretches that its own bytes settle.

    A cut is settled by the hashes of span - 1 places to each side, and these by GEAR_BYTES bytes before them. So the
    stretch that starts `first` to `last` words into the window is settled, and of these places one at least is a cut.
    """
    span, chunks = cut_span(min_words), min(CHUNKS, min_words)
    first, last = (GEAR_BYTES + span - 1, min_words - (chunks + 1) * span) if span > 1 else (0, min_words - chunks)
    cuts = np.append(np.flatnonzero(chunk_cuts(gear(raw, starts), span)), len(starts))
    digests = np.full(len(starts), ~np.uint64(0))
    if len(cuts) > chunks:
        digests[cuts[:-chunks]] = span_hashes(raw, starts[cuts[:-chunks]], ends[cuts[chunks:] - 1])
    least = _sliding(digests, last - first + 1, np.minimum)
    return least[first : first + len(starts) - min_words + 1]


def _seeds(min_words: int):
    """Runs of windows with one name: the first one's first word, the name, the number and digests of the windows, and 2 where some of these are equal, else 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", _SLICE):
            raw, offsets = text_bytes(batch.column("text"))
            starts, ends, first = passage_words(raw, offsets)
            count = np.maximum(np.diff(first) - min_words + 1, 0)
            at = ranges(first[:-1], count)
            if not len(at):
                continue
            seed = _names(raw, starts, ends, min_words)[at]
            text = np.repeat(np.arange(len(count)), count)
            cuts = np.flatnonzero(np.concatenate([[True], (seed[1:] != seed[:-1]) | (text[1:] != text[:-1]), [True]]))
            digests = span_hashes(raw, starts[at], ends[at + min_words - 1])
            own = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            order = np.lexsort((digests, own))
            same = (own[order][1:] == own[order][:-1]) & (digests[order][1:] == digests[order][:-1])
            times = np.ones(len(cuts) - 1, np.int64)
            times[own[order][1:][same]] = 2
            head = cuts[:-1]
            keys = batch.column("row_key").to_numpy(zero_copy_only=False)[text[head]]
            listed = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(digests.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array((at - first[text])[head].astype(np.int32)), pa.array(seed[head].view(np.int64)), listed, pa.array(times)], ["row_key", "ord", "seed", "windows", "times"])

    return run


_SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
_NEW = [StructField("n_words", LongType()), StructField("n_repeated", LongType()), StructField("removed", _SPANS), StructField("removed_bytes", LongType())]
_NEW_ARROW = {"n_words": pa.int64(), "n_repeated": pa.int64(), "removed": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "removed_bytes": pa.int64()}


def _cut_out(min_words: int, text_col: str, names: list[str]):
    """Takes the repeats out of the texts; the other columns go through as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text_col, _SLICE):
            raw, offsets = text_bytes(batch.column(text_col))
            starts, ends, first = passage_words(raw, offsets)
            listed = batch.column("repeats")
            rows = zip(first[:-1].tolist(), first[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
            texts, words, dups, spans = [], [], [], []
            for k, (a, b, start, end) in enumerate(rows):
                data = raw[start:end].tobytes()
                words.append(b - a)
                if not listed[k].is_valid:
                    texts.append(data.decode())
                    dups.append(0)
                    spans.append([])
                    continue
                flags = np.zeros(b - a + 1, np.int64)
                at, n = (listed[k].values.field(c).to_numpy(zero_copy_only=False) for c in ("ord", "n"))
                np.add.at(flags, at, 1)
                np.add.at(flags, at + n + min_words - 1, -1)
                gone = np.cumsum(flags)[:-1] > 0
                own = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                cuts = [(int(starts[a + s] - start), int(ends[a + e - 1] - start)) for s, e in own.reshape(-1, 2).tolist()]
                kept, at = [], 0
                for s, e in cuts:
                    kept.append(data[at:s])
                    at = e
                texts.append(b"".join([*kept, data[at:]]).decode())
                dups.append(int(gone.sum()))
                spans.append([{"start": s, "end": e} for s, e in cuts])
            new = {text_col: texts, "n_words": words, "n_repeated": dups, "removed": spans, "removed_bytes": [sum(x["end"] - x["start"] for x in s) for s in spans]}
            kinds = {**_NEW_ARROW, text_col: pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(new[c], kinds[c]) if c in new else batch.column(c) for c in names], names)

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of docs with the remaining text, and n_words, n_repeated, removed (byte spans of the old text), removed_bytes.

    n_words counts the words of the text, n_repeated those that go. A word goes where min_words words with it, bytes
    and spaces alike, stand as one piece in an earlier row (in the order of ids, nulls first; rows of one id in any order)
    or earlier in its own. Null texts come back empty. Every row stays, also where all of its text goes. Input
    columns with the names of new ones are replaced. An empty table gives no rows.
    """
    made = ("n_words", "n_repeated", "removed", "removed_bytes", "row_key", "repeats")
    others = [c for c in docs.columns if c not in (id_col, text_col, *made)]
    rows, _ = keyed(docs, id_col, text_col, *others)
    source = rows.select("row_key", F.col(text_col).alias("text"))
    found = source.mapInArrow(_seeds(min_words), "row_key long, ord int, seed long, windows array<long>, times long")
    # From tables, so that the join alone deals out both sides and a hot seed can be split among tasks.
    several = written(found.groupBy("seed").agg(F.sum("times").alias("n")).filter("n > 1").select("seed"), "shared-chunks")
    found = written(found.join(several, "seed").withColumns({"digest": F.xxhash64("windows"), "n": F.size("windows")}), "shared-windows")
    runs = found.groupBy("seed", "digest").agg(F.min(F.struct("row_key", "ord", "times")).alias("owner"), F.count(F.lit(1)).alias("rows"))
    runs = written(runs.select("seed", "digest", "owner.*", "rows").withColumnsRenamed({"row_key": "owner_key", "ord": "owner_ord"}), "window-runs")
    first = (F.col("row_key") == F.col("owner_key")) & (F.col("ord") == F.col("owner_ord"))
    whole = found.select("seed", "digest", "row_key", "ord", "n").join(runs.filter("rows > 1").select("seed", "digest", "owner_key", "owner_ord"), ["seed", "digest"]).filter(~first)
    # Chunks with different runs around them: the first of each run holds all there is to compare.
    mixed = written(runs.groupBy("seed").agg(F.sum("times").alias("n")).filter("n > 1").select("seed"), "mixed-chunks")
    heads = runs.join(mixed, "seed").select("seed", F.col("owner_key").alias("row_key"), F.col("owner_ord").alias("ord"))
    single = found.select("seed", "row_key", "ord", "windows").join(heads, ["seed", "row_key", "ord"]).select("seed", "row_key", "ord", F.posexplode("windows").alias("at", "window"))
    single = written(single.select("seed", "window", "row_key", (F.col("ord") + F.col("at")).alias("ord")), "single-windows")
    owners = single.groupBy("seed", "window").agg(F.min(F.struct("row_key", "ord")).alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("seed", "window", "owner")
    owners = written(owners, "window-owners")
    later = single.join(owners, ["seed", "window"]).filter((F.col("row_key") != F.col("owner.row_key")) | (F.col("ord") != F.col("owner.ord")))
    repeats = whole.select("row_key", "ord", "n").unionByName(later.select("row_key", "ord", F.lit(1).alias("n")))
    repeats = written(repeats.groupBy("row_key").agg(F.collect_list(F.struct("ord", "n")).alias("repeats")), "repeats")
    discard(several, found, runs, mixed, single, owners)
    order = [c for c in docs.columns if c in (id_col, text_col, *others)]
    schema = StructType([rows.schema[c] for c in order] + _NEW)
    return rows.join(repeats, "row_key", "left").select(*order, "repeats").mapInArrow(_cut_out(min_words, text_col, schema.names), schema)
