"""Phrase collocations: frequent word n-grams by mergeable Misra-Gries summaries, then exact counts and scores.

Texts become lots of some megabytes: a dictionary of words and a sequence of codes. The n-grams of a lot are counted in
its task and dealt out by hash. Each hash partition merges them into one Misra-Gries summary whose capacity exceeds its
mass divided by the threshold, so that no frequent n-gram is lost, and tells every lot which of its n-grams survived (one
bit for each). In the second pass the lots count these alone, by their text; the sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_array, by_bytes, discard, lower_bytes, mix64, ranges, small_batches, span_hashes, text_bytes, word_spans, written

#: Bytes of text in a lot, and n-grams in a hash partition. Both bound the memory of a task; a row that travels between the
#: two holds lot / partitions n-grams, so that inputs of many TB take larger ones of both.
LOT_BYTES = 8 << 20
PART_MASS = 1 << 20

#: Between words, and between the pieces that phrases don't cross.
_BETWEEN, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
_BETWEEN[[*b" \t"]] = True
_BETWEEN |= _BREAK

_LOTS = "lot long, lang string, words binary, codes binary, n_words long"


def _make_lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each language of each slice: its distinct words, each with a blank behind it, and the codes of the running text; -1 stands between pieces."""
    lot = TaskContext.get().partitionId() << 33
    for batch in by_bytes(batches, "text", LOT_BYTES):
        raw, offs = text_bytes(batch.column("text"))
        raw = lower_bytes(raw)
        starts, ends, first = word_spans(raw, offs, _BETWEEN)
        if not len(starts):
            continue
        breaks = np.concatenate([[0], np.cumsum(_BREAK[raw])])[starts]
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        new_piece = np.ones(len(starts), bool)
        new_piece[1:] = (breaks[1:] != breaks[:-1]) | (doc[1:] != doc[:-1])
        hashes = span_hashes(raw, starts, ends)
        names, lang = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
        for k, name in enumerate(names):
            own = np.flatnonzero(lang[doc] == k)
            if not len(own):
                continue
            _, at, codes = np.unique(hashes[own], return_index=True, return_inverse=True)
            word = own[at]
            # The gap behind a word becomes a blank: one byte more, overwritten.
            lengths = ends[word] - starts[word]
            into = np.concatenate([[0], np.cumsum(lengths + 1)])
            words = np.full(into[-1], 32, np.uint8)
            words[ranges(into[:-1], lengths)] = raw[ranges(starts[word], lengths)]
            runs = np.insert(codes.astype(np.int32), np.flatnonzero(new_piece[own]), np.int32(-1))
            yield pa.RecordBatch.from_arrays([pa.array([lot]), pa.array([name], pa.string()), pa.array([words.tobytes()], pa.binary()), pa.array([runs.tobytes()], pa.binary()), pa.array([len(own)])], ["lot", "lang", "words", "codes", "n_words"])
            lot += 1


class _Lot:
    """The distinct n-grams of a lot, in the order of their hashes."""

    def __init__(self, lang: str, words: bytes, codes: bytes, sizes: range) -> None:
        self.raw = np.frombuffer(words, np.uint8)
        self.ends = np.flatnonzero(self.raw == 32)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])
        self.codes = np.frombuffer(codes, np.int32)
        hashes = span_hashes(self.raw, self.starts, self.ends)
        name = np.frombuffer(lang.encode(), np.uint8)
        seed = span_hashes(name, np.array([0]), np.array([len(name)]))[0] if len(name) else np.uint64(0)
        word, inside = hashes[self.codes], self.codes >= 0  # the value at -1 is not used
        one, fits, found, where, size = mix64(word ^ seed), inside, [], [], []
        for m in sizes:
            fits = fits[:-1] & inside[m - 1 :]
            one = mix64(one[: len(fits)] * np.uint64(3) + word[m - 1 : m - 1 + len(fits)])
            at = np.flatnonzero(fits)
            found.append(one[at])
            where.append(at)
            size.append(np.full(len(at), m, np.int8))
        self.hashes, first, self.counts = np.unique(np.concatenate(found), return_index=True, return_counts=True)
        self.at, self.size = np.concatenate(where)[first], np.concatenate(size)[first]

    def texts(self, chosen: np.ndarray, m: int) -> pa.Array:
        """The phrases of m words at these places of the running text."""
        return self.spelled(self.codes[self.at[chosen][:, None] + np.arange(m)])

    def spelled(self, codes: np.ndarray) -> pa.Array:
        """Texts of rows of codes: every word with its blank, the last one without."""
        starts, lengths = self.starts[codes], self.ends[codes] - self.starts[codes] + 1
        lengths[:, -1] -= 1
        offsets = np.concatenate([[0], np.cumsum(lengths.sum(axis=1))])
        return binary_array(self.raw[ranges(starts.ravel(), lengths.ravel())], offsets, pa.string())


def _part_bounds(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where the n-grams of each hash partition begin: parts are ranges of the upper half of the hash."""
    part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))


class Summary:
    """A Misra-Gries summary: keys in order and counts. `missing` bounds what any key's count may lack."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.missing = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, missing: int = 0) -> None:
        """Adds another summary, with what its counts may lack, or a stretch of the stream. What goes beyond the capacity is paid for by all:
        the largest count that has no place is taken from every key."""
        self.missing += missing
        self.keys, inverse = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        self.counts = np.bincount(inverse, np.concatenate([self.counts, counts]), len(self.keys)).astype(np.int64)
        if len(self.keys) > self.capacity:
            at = len(self.counts) - self.capacity - 1
            paid = int(np.partition(self.counts, at)[at])
            self.missing += paid
            self.counts -= paid
            self.keys, self.counts = self.keys[self.counts > 0], self.counts[self.counts > 0]

    def at_least(self, threshold: int) -> np.ndarray:
        """Keys whose true count may reach the threshold; all that do are among them while the capacity exceeds mass / threshold."""
        return self.keys[self.counts + self.missing >= threshold]


def _keys(packed: bytes) -> np.ndarray:
    """The lower 40 bits of hashes, of five bytes each."""
    wide = np.zeros((len(packed) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def _survivors(lots: DataFrame, sizes: range, min_count: int, parts: int) -> DataFrame:
    """(lot, marks): for each hash partition, a bit for each n-gram of the lot that may be frequent."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lot = _Lot(row["lang"], row["words"], row["codes"], sizes)
                bounds = _part_bounds(lot.hashes, parts)
                some = np.flatnonzero(np.diff(bounds))
                if not len(some):
                    continue
                packed = lot.hashes.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
                counts = lot.counts.astype("<u4").tobytes()
                spans = [(int(bounds[p]), int(bounds[p + 1])) for p in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([row["lot"]] * len(some)), pa.array([packed[5 * a : 5 * b] for a, b in spans], pa.binary()), pa.array([counts[4 * a : 4 * b] for a, b in spans], pa.binary())],
                    ["part", "lot", "hashes", "counts"],
                )

    def merge(group: pa.Table) -> pa.Table:
        keys = [_keys(x) for x in group.column("hashes").to_pylist()]
        counts = [np.frombuffer(x, "<u4").astype(np.int64) for x in group.column("counts").to_pylist()]
        summary = Summary(int(sum(c.sum() for c in counts)) // min_count + 1)
        ends = np.cumsum(list(map(len, keys)))
        held = 0
        for k in range(len(keys)):  # merges of about a capacity each
            if ends[k] - (ends[held - 1] if held else 0) >= summary.capacity or k == len(keys) - 1:
                summary.merge(np.concatenate(keys[held : k + 1]), np.concatenate(counts[held : k + 1]))
                held = k + 1
        found = summary.at_least(min_count)
        marks = []
        for x in keys:
            at = np.minimum(np.searchsorted(found, x), max(len(found) - 1, 0))
            marks.append(np.packbits(found[at] == x).tobytes() if len(found) else bytes(-(-len(x) // 8)))
        return pa.table({"lot": group.column("lot"), "part": group.column("part"), "mark": pa.array(marks, pa.binary())})

    dealt = lots.select("lot", "lang", "words", "codes").mapInArrow(deal, "part int, lot long, hashes binary, counts binary")
    marked = dealt.groupBy("part").applyInArrow(merge, "lot long, part int, mark binary")
    return marked.groupBy("lot").agg(F.collect_list(F.struct("part", "mark")).alias("marks"))


def frequent_ngrams(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", max_words: int = 3, min_count: int = 10) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, n), (lang, total)): exact counts of all n-grams of 1 to max_words words with n >= min_count, and of all words.

    Words stand inside pieces between `.,;:!?` and line ends; A-Z counts as a-z. Null texts are empty, a null language is
    `und`, as where lang_col is None. Every row counts, copies too; ids are not read. Both tables are written.
    """
    small_batches(docs.sparkSession)
    sizes = range(2, max_words + 1)
    lang = F.lit(None) if lang_col is None else F.col(lang_col)
    plain = docs.select(F.coalesce(lang.cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    lots = written(plain.mapInArrow(_make_lots, _LOTS), "collocation-lots")
    totals = written(lots.groupBy("lang").agg(F.sum("n_words").alias("total")), "collocation-totals")
    mass = (totals.agg(F.sum("total")).first()[0] or 0) * len(sizes)
    parts = int(-(-mass // PART_MASS)) or 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lot = _Lot(row["lang"], row["words"], row["codes"], sizes)
                words = np.bincount(lot.codes[lot.codes >= 0], minlength=len(lot.starts))
                out = [(1, lot.spelled(np.arange(len(words))[:, None]), words)]
                bounds, marks = _part_bounds(lot.hashes, parts), {m["part"]: m["mark"] for m in row["marks"] or []}
                kept = np.zeros(len(lot.hashes), bool)
                for p, mark in marks.items():
                    a, b = int(bounds[p]), int(bounds[p + 1])
                    kept[a:b] = np.unpackbits(np.frombuffer(mark, np.uint8), count=b - a)
                for m in sizes:
                    chosen = np.flatnonzero(kept & (lot.size == m))
                    if len(chosen):
                        out.append((m, lot.texts(chosen, m), lot.counts[chosen]))
                for m, texts, counts in out:
                    table = pa.table({"lang": pa.array([row["lang"]] * len(texts), pa.string()), "phrase": texts, "words": pa.array(np.full(len(texts), m, np.int32)), "n": pa.array(counts.astype(np.int64))})
                    yield from table.to_batches(max_chunksize=1 << 16)

    marked = lots.join(_survivors(lots, sizes, min_count, parts), "lot", "left") if len(sizes) else lots.withColumn("marks", F.lit(None).cast("array<struct<part:int,mark:binary>>"))
    counted = marked.select("lot", "lang", "words", "codes", "marks").mapInArrow(count, "lang string, phrase string, words int, n long")
    phrases = written(counted.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count), "collocation-phrases")
    discard(lots)
    return phrases, totals


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", max_words: int = 3, min_count: int = 10, contained: int = 50, top: int | None = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of 2 to max_words words that occur a >= min_count times in a language, best first.

    A cut behind the first k words has the counts l and r of both parts and the score floor(1000000 * a * a / (l * r)); the
    lowest-scoring cut counts, of several the first. Phrases inside a longer one of at least `contained` per cent of their
    count go. Ranks go by score, then a (both descending), then the phrase in the order of its bytes; `top` phrases of each
    language stay (all where it is None). n is the number of words of the language. Arithmetic is exact for counts below
    10 ** 16. Texts without words give nothing, an empty table no rows.
    """
    phrases, totals = frequent_ngrams(docs, text_col, lang_col, max_words, min_count)
    a = phrases.filter(F.col("words") > 1).select("lang", "phrase", "words", F.col("n").alias("a"))
    word = F.split("phrase", " ")
    cut = a.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.withColumns({"first": F.array_join(F.slice(word, F.lit(1), F.col("k")), " "), "rest": F.array_join(F.slice(word, F.col("k") + 1, F.col("words") - F.col("k")), " ")})
    for part, count in (("first", "l"), ("rest", "r")):
        cut = cut.join(phrases.select("lang", F.col("phrase").alias(part), F.col("n").alias(count)), ["lang", part])
    big = "cast({0} as decimal(16,0)) * cast({1} as decimal(16,0))"
    score = F.expr(f"cast(1000000 as decimal(7,0)) * ({big.format('a', 'a')}) div ({big.format('l', 'r')})")
    worst = cut.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = a.filter(F.col("words") > 2).select("lang", "a", word.alias("w"), "words")
    inside = inside.withColumn("m", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)))
    longer = inside.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    left = worst.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < contained * F.col("a"), F.lit(True)))
    ranked = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
