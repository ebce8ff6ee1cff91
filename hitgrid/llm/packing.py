"""Hierarchical packing of token ids into windows of several lengths.

Each task tokenises and packs its own rows, slice by slice, so nothing is shuffled and no text leaves
its task. A document's full windows stand alone; its rest is routed to the smallest tier that holds it.
The tiers are packed from the longest down, and what is left open in a long window is filled from the
shorter tiers, by whole rests where one fits exactly enough and by cutting the last one else. The
sequences of a slice are dealt to step groups of equal cost.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, small_batches
from .segments import bpe_encoder, encode_bpe

TIERS = (1024, 512, 256, 128)
_SLICE = 4 << 20

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length int, step_id long"

#: (document in the slice, start, length)
Piece = tuple[int, int, int]


def pack(lengths: np.ndarray, tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Sequences of pieces that hold every token of documents of these lengths once.

    Every sequence is as long as a tier, but for the last tokens: they go to sequences of smaller
    powers of two, so nothing needs padding. Tiers are powers of two, the longest first.
    """
    top = tiers[0]
    full = [[(d, s, top)] for d, n in enumerate(lengths.tolist()) for s in range(0, n - n % top, top)]
    rests: dict[int, list[tuple[int, Piece]]] = {t: [] for t in tiers}
    for d, n in enumerate(lengths.tolist()):
        if r := n % top:
            rests[min(t for t in tiers if t >= r)].append((r, (d, n - r, r)))
    for held in rests.values():
        held.sort()
    sequences = full

    def take(room: int, below: tuple[int, ...]) -> Piece | None:
        """The longest rest that fits, from the longest tier that has one; else a cut off the shortest rest that doesn't."""
        for t in below:
            if held := rests[t]:
                k = bisect_right(held, (room, (1 << 62, 0, 0))) - 1
                if k >= 0:
                    return held.pop(k)[1]
        for t in reversed(below):
            if rests[t]:
                n, (d, s, _) = rests[t].pop(0)
                left = (n - room, (d, s + room, n - room))
                home = rests[min(x for x in tiers if x >= left[0])]
                home.insert(bisect_right(home, left), left)
                return d, s, room
        return None

    for i, tier in enumerate(tiers):
        below = tiers[i:] if i + 1 == len(tiers) else tiers[i + 1 :]
        while rests[tier]:
            _, piece = rests[tier].pop()
            row, room = [piece], tier - piece[2]
            while room and (more := take(room, below) or take(room, (tier,))):
                row.append(more)
                room -= more[2]
            sequences += [row] if not room else _powers(row)
    return sequences


def _powers(row: list[Piece]) -> list[list[Piece]]:
    """The same tokens in sequences whose lengths are different powers of two, the longest first."""
    out, rest = [], row
    while left := sum(p[2] for p in rest):
        room, now = 1 << (left.bit_length() - 1), []
        while room:
            d, s, n = rest[0]
            used = min(n, room)
            now.append((d, s, used))
            rest = [(d, s + used, n - used), *rest[1:]] if used < n else rest[1:]
            room -= used
        out.append(now)
    return out


def step_groups(lengths: list[int], step_tokens: int) -> list[int]:
    """A step for each sequence: the longest first, each to the step with the least cost so far (the square of the length, as attention has it), then the fewest tokens."""
    steps = max(1, -(-sum(lengths) // step_tokens))
    heap = [(0, 0, k) for k in range(steps)]
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        cost, tokens, k = heapq.heappop(heap)
        out[i] = k
        heapq.heappush(heap, (cost + lengths[i] ** 2, tokens + lengths[i], k))
    return out


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, tiers: tuple[int, ...] = TIERS, step_tokens: int = 8192) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, step_id), a row per piece.

    A document is its ids and `end_id`; null and empty texts are `end_id` alone. Null and repeated ids
    are packed as they come, each row on its own. Extra columns don't go on. An empty table gives no rows. sequence_id holds the
    partition and a number in it. tokenizer: path of a vocabulary file, the same on all executors.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sequence, step = bpe_encoder(tokenizer), TaskContext.get().partitionId() << 36, TaskContext.get().partitionId() << 36
        for batch in by_bytes(batches, "text", _SLICE):
            ids, offsets = encode_bpe(encoder, batch.column("text"))
            n = np.diff(offsets) + 1
            stream, ends = np.full(len(ids) + len(n), end_id, "<u4"), offsets + np.arange(len(offsets))
            inside = np.ones(len(stream), bool)
            inside[ends[1:] - 1] = False
            stream[inside] = ids
            view = memoryview(stream.tobytes())
            sequences = pack(n, tiers)
            sizes = [sum(p[2] for p in s) for s in sequences]
            steps = step_groups(sizes, step_tokens)
            rows: list[tuple] = []
            for k, pieces in enumerate(sequences):
                at = 0
                for d, s, m in pieces:
                    a = 4 * int(ends[d] + s)
                    rows.append((d, s, m, zlib.crc32(view[a : a + 4 * m]), sequence + k, at, sizes[k], step + steps[k]))
                    at += m
            sequence, step = sequence + len(sequences), step + max(steps, default=0) + 1
            d, s, m, crc, seq, at, size, grp = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(d)), pa.array(s), pa.array(m), pa.array(crc), pa.array(n[d]), pa.array(seq), pa.array(at), pa.array(size.astype(np.int32)), pa.array(grp)], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_id"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, {PIECES}").withColumnRenamed("id", id_col)
