"""Encodes texts by their distinct segments.

A tokenizer that never joins across certain places gives the same ids for a text as for the segments
between those places. Natural text repeats its segments, so each slice of rows is cut there, its distinct
segments are encoded once, and the ids are dealt out to all of them with array operations.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa

from .common import binary_array, ranges, text_bytes

#: Maps distinct segments (one buffer and its n + 1 offsets) to all their ids and the number of ids of each.
Encode = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def encode_segments(encode: Encode, raw: np.ndarray, cuts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids and the n + 1 offsets of n texts. cuts: the m + 1 ends of segments in raw; first: each text's first segment, n + 1 values."""
    if len(cuts) < 2:
        return np.zeros(0, np.int32), np.zeros(len(first), np.int64)
    coded = binary_array(raw, cuts).dictionary_encode()
    ids, widths = encode(*text_bytes(coded.dictionary))
    place = coded.indices.to_numpy(zero_copy_only=False)
    lengths = widths[place]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return ids[ranges((np.cumsum(widths) - widths)[place], lengths)], ends[first]


def cut_before(raw: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts and first segments, as encode_segments takes them: texts are cut before each place of `at`."""
    marked = np.zeros(len(raw) + 1, bool)
    marked[at] = True
    marked[offsets] = True
    cuts = np.flatnonzero(marked)
    return cuts, np.searchsorted(cuts, offsets)


_SURE = np.zeros(256, bool)  # a byte that ends or starts a character which is surely no white space
_SURE[0x21:0x7F] = True
_LEAD = np.zeros(256, bool)  # first bytes of characters of which none is white space
_LEAD[0xC3:0xE0] = True


def bpe_places(raw: np.ndarray) -> np.ndarray:
    """Places of single spaces between two characters that are no white space.

    The byte-level pattern starts a token at each of these. Where a neighbour might be Unicode white
    space there is no cut, which only makes a segment longer.
    """
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(raw[1:-1] == 0x20) + 1
    before, after = raw[at - 1], raw[at + 1]
    lead = _LEAD[raw[np.maximum(at - 2, 0)]] & (before >= 0x80) & (before < 0xC0)
    return at[(_SURE[before] | lead) & (_SURE[after] | _LEAD[after])]


def bpe_encoder(path: str) -> Encode:
    """The byte-level BPE of a public vocabulary file (JSON) of the `tokenizers` library.

    Segments that begin with a single space and end with no white space can stand side by side in one
    text without changing their tokens; these are encoded together by `tiktoken` with the same
    vocabulary, all others one by one by `tokenizers`.
    """
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    spec = json.loads(Path(path).read_text())
    ranks = {_unmapped(token): i for token, i in spec["model"]["vocab"].items()}
    special = [t["content"].encode() for t in spec["added_tokens"]]
    fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    widths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        widths[i] = len(token)

    def encode(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        padded, sizes = np.concatenate([np.zeros(2, np.uint8), raw, np.zeros(2, np.uint8)]), np.diff(offsets)
        head, tail = padded[offsets[:-1] + 2], offsets[1:] + 1
        second, last = padded[offsets[:-1] + 3], padded[tail]
        side = (sizes > 1) & (head == 0x20) & (_SURE[second] | _LEAD[second]) & (_SURE[last] | (_LEAD[padded[tail - 1]] & (last >= 0x80)))
        data = raw.tobytes()
        for k in np.flatnonzero(side).tolist() if any(t in data for t in special) else []:
            side[k] = not any(t in data[offsets[k] : offsets[k + 1]] for t in special)
        lengths = np.zeros(len(sizes), np.int64)
        joined = raw[np.repeat(side, sizes)]
        ids = np.array(fast.encode_ordinary(joined.tobytes().decode()), np.int32)
        lengths[side] = np.diff(np.searchsorted(np.cumsum(widths[ids]), np.cumsum(sizes[side]), side="right"), prepend=0)
        alone = np.flatnonzero(~side).tolist()
        single = tokenizer.encode_batch([data[offsets[k] : offsets[k + 1]].decode() for k in alone], add_special_tokens=False)
        lengths[alone] = [len(e.ids) for e in single]
        out, starts = np.zeros(int(lengths.sum()), np.int32), np.cumsum(lengths) - lengths
        out[ranges(starts[side], lengths[side])] = ids
        for k, e in zip(alone, single, strict=True):
            out[starts[k] : starts[k] + lengths[k]] = e.ids
        return out, lengths

    return encode


#: Fixed value: the split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _unmapped(token: str) -> bytes:
    """The bytes of a token in a byte-level vocabulary: printable Latin-1 stands for itself, the others for code points from 256 on."""
    return bytes(_BYTES[c] for c in token)


_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {chr(b): b for b in _PLAIN} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}


def encode_bpe(encoder: Encode, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """ids and offsets of a string column; null counts as empty."""
    raw, offsets = text_bytes(column)
    cuts, first = cut_before(raw, offsets, _inside(offsets, bpe_places(raw)))
    return encode_segments(encoder, raw, cuts, first)


def _inside(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places whose two neighbours lie in the same text."""
    k = np.searchsorted(offsets, at, side="right") - 1
    return at[(at > offsets[k]) & (at + 1 < offsets[k + 1])]
