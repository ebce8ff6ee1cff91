"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The trie and the scores are built once on the driver from a vocabulary file and broadcast (their size is
that of the vocabulary). Tasks cut their texts where no piece can reach across, run one Viterbi for all
distinct segments of a slice side by side with array operations, and write ids back for every text.
The white-space marker is held as a plain space, so a marker character that stands in a text itself
matches no piece and travels as bytes: decoding gives back every text exactly.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_array, by_bytes, ranges, small_batches, text_bytes
from .segments import cut_before, encode_segments

MARK = "▁"
#: Added to the least score for a character that no piece covers.
UNKNOWN = -10.0
_SLICE = 3 << 20
#: Bytes of a stretch without blanks from which on places are looked for that no piece reaches across.
_LONG = 64


@dataclass(frozen=True)
class Pieces:
    """A vocabulary as arrays: a double-array trie over bytes, scores, and the bytes of each id."""

    base: np.ndarray
    check: np.ndarray
    leaf: np.ndarray  # id of the piece that ends at a node, else -1
    score: np.ndarray
    byte_ids: np.ndarray  # 256 ids
    raw: np.ndarray  # bytes of all ids, one after the other
    starts: np.ndarray
    widths: np.ndarray
    unknown: float


def read_vocabulary(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a .model file; types: 1 normal, 2 unknown, 3 control, 6 byte."""

    def varint(b: bytes, at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (b[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if b[at - 1] < 128:
                return out, at

    def fields(b: bytes) -> Iterator[tuple[int, bytes | int]]:
        at = 0
        while at < len(b):
            key, at = varint(b, at)
            if key & 7 == 0:
                value, at = varint(b, at)
            else:
                if key & 7 == 2:
                    n, at = varint(b, at)
                else:
                    n = 8 if key & 7 == 1 else 4
                value, at = b[at : at + n], at + n
            yield key >> 3, value

    out = []
    for number, value in fields(Path(path).read_bytes()):
        if number == 1:
            piece = dict(fields(value))
            out.append((piece[1].decode(), float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0]), piece.get(3, 1)))
    return out


def log_scores(vocabulary: list[tuple[str, float, int]]) -> np.ndarray:
    """Log probabilities of the pieces by Zipf's law over their order of scores (a BPE file scores by rank); ties by id."""
    raw = np.array([s for _, s, _ in vocabulary])
    rank = np.empty(len(raw), np.int64)
    rank[np.argsort(-raw, kind="stable")] = np.arange(len(raw))
    return -np.log(rank + 2.0) - np.log(np.log(len(raw) + 2.0))


def build(vocabulary: list[tuple[str, float, int]], scores: np.ndarray) -> Pieces:
    normal = [(text.replace(MARK, " ").encode(), i) for i, (text, _, kind) in enumerate(vocabulary) if kind in (1, 4) and text]
    if bad := [p for p, _ in normal if b" " in p.lstrip(b" ")]:
        raise ValueError(f"pieces with a marker after other characters can't be cut at markers: {bad[:3]}")
    byte_ids = np.full(256, -1, np.int64)
    held = [b""] * len(vocabulary)
    for i, (text, _, kind) in enumerate(vocabulary):
        if kind == 6:
            byte_ids[int(text[3:5], 16)] = i
            held[i] = bytes([int(text[3:5], 16)])
    if (byte_ids < 0).any():
        raise ValueError("byte fallback needs all 256 byte pieces")
    for p, i in normal:
        held[i] = p
    base, check, leaf = _double_array(dict(sorted(normal)))
    widths = np.array([len(x) for x in held], np.int64)
    kept = scores[[i for _, i in normal]]
    return Pieces(base, check, leaf, scores.astype(np.float64), byte_ids, np.frombuffer(b"".join(held), np.uint8), np.cumsum(widths) - widths, widths, float(kept.min()) + UNKNOWN)


def _double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check, leaf: the child of node s by byte b is t = base[s] + b where check[t] == s. words: sorted."""
    tree: list[dict[int, int]] = [{}]
    ends = [-1]
    for word, i in words.items():
        node = 0
        for b in word:
            if b not in tree[node]:
                tree[node][b] = len(tree)
                tree.append({})
                ends.append(-1)
            node = tree[node][b]
        ends[node] = i
    size = 16 * len(tree) + 4096
    base, check, leaf = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken = bytearray(size)
    taken[0], low, todo = 1, 1, deque([(0, 0)])
    while todo:
        node, at = todo.popleft()
        leaf[at] = ends[node]
        if not (children := tree[node]):
            continue
        keys = sorted(children)
        start, tries = max(low - keys[0], 1), 0
        while any(taken[start + k] for k in keys):
            start, tries = start + 1, tries + 1
        # A crowded stretch is left behind for good, so building takes time in proportion to the vocabulary.
        low = max(low, start + keys[0] - 16) if tries > 32 else low
        base[at] = start
        for k in keys:
            taken[start + k], check[start + k] = 1, at
            todo.append((children[k], start + k))
    used = max(i for i in range(size) if taken[i]) + 257
    return base[:used], check[:used], leaf[:used]


def viterbi(p: Pieces, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best ids of n segments and the number of ids of each. Of equal scores the shorter last piece wins."""
    sizes = np.diff(offsets)
    total = len(raw)
    order = np.argsort(sizes, kind="stable")
    best, back, piece = np.full(total + 1, -np.inf), np.zeros(total + 1, np.int32), np.full(total + 1, -1, np.int32)
    # One cell for each place after the first of a segment: cell = offset + position; position 0 scores 0.
    starts_char = (raw & 0xC0) != 0x80
    char_end = np.append(np.flatnonzero(starts_char), total)
    length_at = np.zeros(total, np.int64)
    length_at[char_end[:-1]] = np.diff(char_end)
    ordered = offsets[:-1][order]
    ordered_sizes = sizes[order]
    longest = int(sizes.max(initial=0))
    for i in range(longest):
        live = np.searchsorted(ordered_sizes, i, side="right")
        at = ordered[live:] + i  # this place in every segment that has it
        end = ordered[live:] + ordered_sizes[live:]
        now = np.zeros(len(at)) if i == 0 else best[at - 1]
        on = np.isfinite(now) & starts_char[at]
        at, end, now = at[on], end[on], now[on]
        if not len(at):
            continue
        single, first_width = np.zeros(len(at), bool), length_at[at]
        node, where, which = np.zeros(len(at), np.int32), at.copy(), np.arange(len(at))
        while len(which):
            nxt = p.base[node] + raw[where]
            ok = (p.check[nxt] == node) & (p.base[node] > 0)
            which, node, where = which[ok], nxt[ok], where[ok] + 1
            hit = p.leaf[node]
            ends_here = hit >= 0
            if ends_here.any():
                w, e, h = which[ends_here], where[ends_here], hit[ends_here]
                single[w[e - at[w] == first_width[w]]] = True
                gain = now[w] + p.score[h]
                better = gain > best[e - 1]
                cells = e[better] - 1
                best[cells], back[cells], piece[cells] = gain[better], at[w[better]], h[better]
            inside = where < end[which]
            which, node, where = which[inside], node[inside], where[inside]
        lone = ~single
        cells = at[lone] + first_width[lone] - 1
        gain = now[lone] + p.unknown
        better = gain > best[cells]
        cells = cells[better]
        best[cells], back[cells], piece[cells] = gain[better], at[lone][better], -1
    return _trace(p, raw, offsets, back, piece)


def _trace(p: Pieces, raw: np.ndarray, offsets: np.ndarray, back: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks the places where pieces of the best path start, all segments one step at a time."""
    begins = np.full(len(raw), -2, np.int32)
    end, first = offsets[1:].copy(), offsets[:-1]
    todo = np.flatnonzero(end > first)
    while len(todo):
        cells = end[todo] - 1
        begins[back[cells]] = piece[cells]
        end[todo] = back[cells]
        todo = todo[end[todo] > first[todo]]
    at = np.flatnonzero(begins != -2)
    width = np.diff(np.append(at, len(raw)))
    ids = begins[at].astype(np.int64)
    as_bytes = ids < 0
    count = np.where(as_bytes, width, 1)
    out = np.repeat(ids, count)
    fill = np.repeat(as_bytes, count)
    out[fill] = p.byte_ids[raw[ranges(at[as_bytes], width[as_bytes])]]
    ends = np.concatenate([[0], np.cumsum(count)])
    return out.astype(np.int32), np.diff(ends[np.searchsorted(at, offsets)])


def sure_cuts(p: Pieces, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places within the spans [start, end) that no piece of the vocabulary reaches across: the best path passes through each, so both sides can be coded alone.

    Every place of all spans walks the trie at once. Where pieces overlap all the way (one letter, over and over) there are none.
    """
    at = ranges(starts, ends - starts)
    at = at[(raw[at] & 0xC0) != 0x80]
    if not len(at):
        return at
    end = ends[np.searchsorted(starts, at, side="right") - 1]
    reach = np.minimum(np.append(at[1:], end[-1]), end)  # the character itself
    which, node, where = np.arange(len(at)), np.zeros(len(at), np.int32), at.copy()
    while len(which):
        nxt = p.base[node] + raw[where]
        ok = (p.check[nxt] == node) & (p.base[node] > 0)
        which, node, where = which[ok], nxt[ok], where[ok] + 1
        hit = p.leaf[node] >= 0
        reach[which[hit]] = np.maximum(reach[which[hit]], where[hit])
        inside = where < end[which]
        which, node, where = which[inside], node[inside], where[inside]
    return at[1:][np.maximum.accumulate(reach)[:-1] <= at[1:]]


def encode_column(p: Pieces, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """ids and n + 1 offsets of a string column; null counts as empty, an empty text has no ids. A text gets one marker in front."""
    raw, offsets = text_bytes(column)
    full = np.diff(offsets) > 0
    raw = np.insert(raw, offsets[:-1][full], 0x20)
    offsets = offsets + np.concatenate([[0], np.cumsum(full)])
    places = np.flatnonzero((raw[1:] == 0x20) & (raw[:-1] != 0x20)) + 1
    cuts, first = cut_before(raw, offsets, places)
    # A long stretch without blanks would take a step for each of its bytes.
    bounds = np.append(cuts, len(raw)) if not len(cuts) or cuts[-1] != len(raw) else cuts
    long = np.flatnonzero(np.diff(bounds) > _LONG)
    if len(long):
        cuts, first = cut_before(raw, offsets, np.union1d(places, sure_cuts(p, raw, bounds[long], bounds[long + 1])))
    return encode_segments(lambda r, o: viterbi(p, r, o), raw, cuts, first)


def decode_ids(p: Pieces, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of the texts that the ids stand for: markers are spaces, the first one goes."""
    widths = p.widths[ids]
    raw = p.raw[ranges(p.starts[ids], widths)]
    ends = np.concatenate([[0], np.cumsum(widths)])[offsets]
    lead = ends[:-1][(ends[1:] > ends[:-1])]
    lead = lead[raw[lead] == 0x20]
    keep = np.ones(len(raw), bool)
    keep[lead] = False
    return raw[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def load(path: str) -> Pieces:
    vocabulary = read_vocabulary(path)
    return build(vocabulary, log_scores(vocabulary))


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>), a row per row; null and empty texts have no ids. Ids may be null or repeat. Extra columns don't go on. No rows give no rows."""
    small_batches(docs.sparkSession)
    kind, shared = dict(docs.dtypes)[id_col], docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", _SLICE):
            ids, offsets = encode_column(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, pieces: Pieces, id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """Adds `text` (or, as digest, `text_sha256`) to rows with ids; null ids give an empty text."""
    small_batches(encoded.sparkSession)
    kind, shared = dict(encoded.dtypes)[id_col], encoded.sparkSession.sparkContext.broadcast(pieces)
    name = "text_sha256" if digest else "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                listed = part.column("ids")
                if listed.null_count:
                    listed = listed.fill_null([])
                ids, offsets = listed.flatten().to_numpy(zero_copy_only=False).astype(np.int32), listed.offsets.to_numpy().astype(np.int64)
                raw, ends = decode_ids(shared.value, ids, offsets - offsets[0])
                texts = binary_array(raw, ends, pa.binary() if digest else pa.string())
                if digest:
                    texts = pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts])
                yield pa.RecordBatch.from_arrays([part.column("id"), listed, texts], ["id", "ids", name])

    rows = encoded.select(F.col(id_col).alias("id"), "ids")
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, {name} string").withColumnRenamed("id", id_col)
