"""N-gram Jaccard self-join by prefix filtering under several global token orders.

1. Each task turns its texts into sets of shingle hashes and deals them out, packed, by hash. Where the
   hashes meet, their document frequencies are counted, and the shared ones go back, packed, to their documents.
2. Every order puts rare shingles first; a shingle of one document alone can't match, so a document whose
   prefix holds only such is done. That leaves documents of which at least four fifths stand elsewhere, too.
   Equal sets become one class.
3. Classes that share a prefix shingle under the first order form families, found by stars and contraction,
   not by pairs. A family of many blocks is taken apart again, into the classes of each prefix shingle. In such a
   group, cut into blocks, candidates must share prefix shingles under every order; only those are verified, by
   exact intersection, and only links that join two components go on.

A shingle in many documents of one task is announced by its count alone, so no task gathers a hot one's
documents. The number of packed groups follows the bytes of the table alone, so a group stays small at any size. Blocks
bound what one task holds; a set is copied at most MAX_BLOCKS times for its family, or for each of its prefix
shingles once a block of those who share it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, discard, keyed, lower_bytes, mix64, span_hashes, text_bytes, word_spans, written
from .components import connected_components

WIDTH = 5
ORDERS = 3
#: From so many documents of one packed lot on, a shingle is announced by its count.
HEAVY = 64
#: Documents of a block, about.
BLOCK = 256
#: Families of more blocks go by their prefix shingles.
MAX_BLOCKS = 16
#: Bytes of text behind a packed group, about.
PART_BYTES = 4 << 20
_SLICE, _LOT = 3 << 19, 600_000
_TOP = np.uint8(255)  # of document frequencies, which are told apart below it
#: Shingle hashes have 56 bits: seven bytes travel for each.
_HASH_MASK = np.uint64((1 << 56) - 1)
_SALTS = mix64(np.arange(101, 101 + 64, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """A sorted array of distinct shingle hashes for each text: runs of `width` words, or all words if they are fewer."""
    raw = lower_bytes(raw)
    starts, ends, first = word_spans(raw, offsets)
    words = span_hashes(raw, starts, ends)
    n = len(words)
    joined = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        joined += words[k : n - width + 1 + k] * _SALTS[k] if n >= width else np.uint64(0)
    joined = mix64(joined ^ np.uint64(width))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(joined[a : b - width + 1] & _HASH_MASK))
        elif b > a:
            out.append(mix64((words[a:b] * _SALTS[: b - a]).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(b - a)) & _HASH_MASK)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    if not len(tokens):
        return 0, 0
    return tuple(int(x) for x in np.array([mix64(tokens).sum(dtype=np.uint64), mix64(tokens ^ _SALTS[7]).sum(dtype=np.uint64)], np.uint64).view(np.int64))


def need(n: int) -> int:
    """Common shingles that a set of n needs at least with any set of similarity 0.8."""
    return (4 * n + 4) // 5


_SENT = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("docs", pa.binary()), ("tokens", pa.binary()), ("more", pa.binary())])
_SENT_SQL = "part int, kind byte, docs binary, tokens binary, more binary"
#: kind: shingles with their documents; documents with size and digest; announced shingles; heavy shingles of documents.
_PAIRS, _META, _SAID, _SURE = range(4)


def _row(part: int, kind: int, docs: np.ndarray, tokens: np.ndarray, more: np.ndarray | None = None) -> tuple:
    return part, kind, np.diff(docs, prepend=0).tobytes(), np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8)[:, :7].tobytes(), b"" if more is None else more.tobytes()


def _tokens(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(blob, np.uint8).reshape(-1, 7)
    return out.reshape(-1).view(np.uint64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)


def _docs(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, np.int64))


def _dealt(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(part, columns) for every part, rows in their order."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    columns = [c[order] for c in columns]
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
        yield int(part[a]), *(c[a:b] for c in columns)


def _home(docs: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(docs.view(np.uint64)) % np.uint64(parts)).astype(np.uint16 if parts < 65536 else np.int32)


def _deal(parts: int, width: int):
    def lot(docs: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple]:
        sizes = np.array([len(s) for s in sets], np.int64)
        digests = np.array([_digest(s) for s in sets], np.int64).reshape(-1, 2)
        meta = np.column_stack([sizes, digests])
        for part, d, m in _dealt(_home(docs, parts), docs, meta):
            yield _row(part, _META, d, np.zeros(0, np.uint64), m)
        tokens, owner = np.concatenate(sets), np.repeat(docs, sizes)
        order = np.argsort(tokens)
        ordered = tokens[order]
        cuts = np.append(np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])), len(ordered)) if len(ordered) else np.zeros(1, np.int64)
        count = np.diff(cuts)
        heavy = np.zeros(len(tokens), bool)
        heavy[order] = np.repeat(count >= HEAVY, count)
        for part, t in _dealt(_home(said := ordered[cuts[:-1]][count >= HEAVY], parts), said):
            yield _row(part, _SAID, np.zeros(0, np.int64), t)
        for part, d, t in _dealt(_home(owner[heavy], parts), owner[heavy], tokens[heavy]):
            yield _row(part, _SURE, d, t)
        light = ~heavy
        for part, d, t in _dealt(_home(tokens[light], parts), owner[light], tokens[light]):
            yield _row(part, _PAIRS, d, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[np.ndarray] = []
        sets: list[np.ndarray] = []
        held = 0
        for batch in by_bytes(batches, "text", _SLICE):
            made = shingle_sets(*text_bytes(batch.column("text")), width)
            docs.append(batch.column("row_key").to_numpy(zero_copy_only=False))
            sets += made
            held += sum(map(len, made))
            if held >= _LOT:
                yield _batch(list(lot(np.concatenate(docs), sets)))
                docs, sets, held = [], [], 0
        if docs:
            yield _batch(list(lot(np.concatenate(docs), sets)))

    return run


def _count(homes: int):
    """Document frequencies of the shingles of one part; the shared ones go back to their documents."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_pylist()
        docs, tokens, more = (table[c].to_pylist() for c in ("docs", "tokens", "more"))
        out = [(part, k, d, t, m) for part, k, d, t, m in zip(table["part"].to_pylist(), kinds, docs, tokens, more, strict=True) if k == _META]
        out = [r for row in out for r in _redeal(row, homes)]
        for k, d, t in zip(kinds, docs, tokens, strict=True):
            if k == _SURE:
                d, t = _docs(d), _tokens(t)
                out += [_row(part, _PAIRS, dd, tt, np.full(len(tt), _TOP)) for part, dd, tt in _dealt(_home(d, homes), d, t)]
        pairs = [i for i, k in enumerate(kinds) if k == _PAIRS]
        if pairs:
            t = np.concatenate([_tokens(tokens[i]) for i in pairs])
            d = np.concatenate([_docs(docs[i]) for i in pairs])
            said = np.unique(np.concatenate([_tokens(tokens[i]) for i, k in enumerate(kinds) if k == _SAID] or [np.zeros(0, np.uint64)]))
            order = np.argsort(t)
            t, d = t[order], d[order]
            cuts = np.append(np.flatnonzero(np.append(True, t[1:] != t[:-1])), len(t))
            count = np.diff(cuts)
            df = np.repeat(np.minimum(count, 254), count).astype(np.uint8)
            if len(said):
                df[said[np.minimum(np.searchsorted(said, t), len(said) - 1)] == t] = _TOP
            shared = df >= 2
            out += [_row(part, _PAIRS, dd, tt, ff) for part, dd, tt, ff in _dealt(_home(d[shared], homes), d[shared], t[shared], df[shared])]
        if not out:
            return pa.Table.from_batches([], _SENT)
        return pa.Table.from_batches([_batch(out)])

    return run


def _redeal(row: tuple, homes: int) -> list[tuple]:
    d, m = _docs(row[2]), np.frombuffer(row[4], np.int64).reshape(-1, 3)
    return [_row(part, _META, dd, np.zeros(0, np.uint64), mm) for part, dd, mm in _dealt(_home(d, homes), d, m)]


_SETS = "row_key long, n long, d1 long, d2 long, prefixes array<array<long>>, tokens binary"
_SETS_ARROW = pa.schema([("row_key", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("prefixes", pa.list_(pa.list_(pa.int64()))), ("tokens", pa.binary())])


def _gather(table: pa.Table) -> pa.Table:
    """Documents of one home: prefixes under every order, where a match is possible."""
    meta_docs, metas, docs, tokens, dfs = [], [], [], [], []
    for k, d, t, m in zip(*(table[c].to_pylist() for c in ("kind", "docs", "tokens", "more")), strict=True):
        if k == _META:
            meta_docs.append(_docs(d))
            metas.append(np.frombuffer(m, np.int64).reshape(-1, 3))
        else:
            docs.append(_docs(d))
            tokens.append(_tokens(t))
            dfs.append(np.frombuffer(m, np.uint8))
    if not metas:
        return pa.Table.from_batches([], _SETS_ARROW)
    meta_docs, metas = np.concatenate(meta_docs), np.concatenate(metas)
    docs, tokens, dfs = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((docs, np.int64), (tokens, np.uint64), (dfs, np.uint8)))
    order = np.argsort(docs, kind="stable")
    docs, tokens, dfs = docs[order], tokens[order], dfs[order]
    begin, end = np.searchsorted(docs, meta_docs), np.searchsorted(docs, meta_docs, side="right")
    prefixes, held = [], []
    for n, a, b in zip(metas[:, 0].tolist(), begin.tolist(), end.tolist(), strict=True):
        left = n - need(n) + 1 - (n - (b - a))  # what is left of the prefix after the shingles that no one shares
        if n == 0 or left <= 0:
            prefixes.append(None)
            held.append(None)
            continue
        t, f = tokens[a:b], dfs[a:b]
        prefixes.append([t[np.lexsort((mix64(t ^ _SALTS[20 + k]), f))[:left]].view(np.int64) for k in range(ORDERS)])
        held.append(np.sort(t).tobytes())
    return pa.Table.from_arrays([pa.array(meta_docs), *(pa.array(metas[:, k]) for k in range(3)), pa.array(prefixes, _SETS_ARROW.field("prefixes").type), pa.array(held, pa.binary())], schema=_SETS_ARROW)


class _Union:
    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> None:
        """All of others and i become one component, named by its least member."""
        names = np.unique(self.root[np.append(others, i)])
        self.root[np.isin(self.root, names)] = names[0]


def _bits(sets: list[np.ndarray]) -> np.ndarray:
    """A bit for each (set, value) whose value stands in two sets at least."""
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    known, code, times = np.unique(values, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    shared = (times > 1)[code]
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[shared]
    at = place[code[shared]]
    width = max(1, -(-int((times > 1).sum()) // 64))
    out = np.zeros((len(sets), width * 8), np.uint8)
    np.bitwise_or.at(out, (rows, at >> 3), (1 << (at & 7)).astype(np.uint8))
    return out.view(np.uint64)


def link(sizes: np.ndarray, prefixes: list[list[np.ndarray]], sets: list[np.ndarray], side: np.ndarray | None = None) -> np.ndarray:
    """The root of each set (an index) by links of similarity 0.8 among them; with side, only pairs of different sides count.

    A pair is a candidate if its sizes allow it and it shares a prefix shingle under every order, and is
    verified if it isn't connected yet.
    """
    m = len(sizes)
    union = _Union(m)
    full = _bits(sets)
    filters = [_bits([p[k] for p in prefixes]) for k in range(len(prefixes[0]))] if m else []
    for i in range(1, m):
        ok = (union.root[:i] != union.root[i]) & (5 * np.minimum(sizes[:i], sizes[i]) >= 4 * np.maximum(sizes[:i], sizes[i]))
        if side is not None:
            ok &= side[:i] != side[i]
        at = np.flatnonzero(ok)
        for f in filters:
            if len(at):
                at = at[(f[at] & f[i]).any(axis=1)]
        if len(at):
            common = np.bitwise_count(full[at] & full[i]).sum(axis=1, dtype=np.int64)
            at = at[100 * common >= 80 * (sizes[at] + sizes[i] - common)]
            if len(at):
                union.join(i, at)
    return union.root


def _verify(table: pa.Table) -> pa.Table:
    """Links as stars (a, b) in each pair of blocks of a family."""
    by, families, low, high, block, keys, sizes = (table[c].to_numpy() for c in ("by", "family", "low", "high", "block", "row_key", "n"))
    order = np.lexsort((keys, block, high, low, families, by))
    prefixes, tokens = table["prefixes"].to_pylist(), table["tokens"].to_pylist()
    a, b = [], []
    names = np.column_stack([by, families, low, high])[order]
    cuts = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
    for own in np.split(order, cuts):
        if len(own) < 2:
            continue
        side = block[own] if low[own[0]] != high[own[0]] else None
        roots = link(sizes[own], [[np.array(p, np.int64).view(np.uint64) for p in prefixes[k]] for k in own], [np.frombuffer(tokens[k], np.uint64) for k in own], side)
        moved = np.flatnonzero(roots != np.arange(len(own)))
        a.append(keys[own[moved]])
        b.append(keys[own[roots[moved]]])
    return pa.table({"a": pa.array(np.concatenate(a) if a else np.zeros(0, np.int64)), "b": pa.array(np.concatenate(b) if b else np.zeros(0, np.int64))})


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, key_col: str | None = None) -> DataFrame:
    """(id, n_shingles, component_id, row_key, kept), a row per row of docs.

    Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; a set holds the distinct runs of `width` words,
    of shorter texts all words as one, of null and empty texts nothing: these are linked with nothing. Sets link
    when 100 * intersection >= 80 * union; component_id is the least id that links reach (nulls aside), and kept marks one
    row of each component, that with the least id. Ids that repeat or are null: every row is one node, and of a
    least id's rows the first by row_key is kept. Extra columns don't go on. An empty table gives no rows.
    key_col: the row_key of `keyed`, if the rows are numbered already.
    """
    rows, plain = keyed(docs, id_col, F.col(text_col).alias("text"), key_col=key_col)
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-size // PART_BYTES))
    dealt = rows.select("row_key", "text").mapInArrow(_deal(2 * n, width), _SENT_SQL)
    counted = dealt.groupBy("part").applyInArrow(_count(n), _SENT_SQL)
    sets = written(counted.groupBy("part").applyInArrow(_gather, _SETS), "shingle-sets")

    able = sets.filter("tokens is not null")
    classes = written(able.groupBy("n", "d1", "d2").agg(F.min("row_key").alias("rep")), "classes")
    reps = written(able.join(classes.select(F.col("rep").alias("row_key")), "row_key", "left_semi").select("row_key", "n", "prefixes", "tokens"), "class-sets")

    postings = reps.select("row_key", F.explode(F.element_at("prefixes", 1)).alias("token"))
    hubs = written(postings.groupBy("token").agg(F.min("row_key").alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "hubs")
    stars = postings.join(hubs, "token").filter("row_key <> hub").select(F.col("row_key").alias("a"), F.col("hub").alias("b"))
    families = connected_components(stars)

    sizes = written(families.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "family-sizes")
    members = families.join(sizes, "root").select(F.col("node").alias("row_key"), F.col("root").alias("family"), "blocks")
    whole = members.filter(F.col("blocks") <= MAX_BLOCKS).withColumn("by", F.lit(0))
    apart = members.filter(F.col("blocks") > MAX_BLOCKS).select("row_key").join(postings, "row_key").join(hubs, "token")
    apart = apart.select("row_key", F.col("token").alias("family"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), F.lit(1).alias("by"))
    placed = whole.unionByName(apart).withColumn("block", F.pmod(F.xxhash64("row_key"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # Small groups share a unit, each pair of blocks of a large one is a unit of its own.
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    unit = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("by", "family"), F.lit(4 * n))).otherwise(F.xxhash64("by", "family", low, high)).alias("unit")
    placed = placed.select("row_key", unit, "by", "family", low, high, "block")
    work = placed.join(reps, "row_key").select("unit", "by", "family", "low", "high", "block", "row_key", "n", "prefixes", "tokens")
    links = written(work.groupBy("unit").applyInArrow(_verify, "a long, b long"), "links")

    found = connected_components(links)
    least = written(found.groupBy("root").agg(F.min("node").alias("component_key")), "component-names")
    named = written(found.join(least, "root").select(F.col("node").alias("rep"), "component_key"), "named")
    known = classes.join(named, "rep", "left").select("n", "d1", "d2", F.coalesce("component_key", "rep").alias("component_key"))
    known = written(known, "class-components")
    discard(classes, reps, hubs, families, sizes, links, found, least, named)
    done = able.select("row_key", "n", "d1", "d2").join(known, ["n", "d1", "d2"]).select("row_key", "n", "component_key")
    lone = sets.filter("tokens is null").select("row_key", "n", F.col("row_key").alias("component_key"))
    out = done.unionByName(lone)
    if plain:
        kind = dict(docs.dtypes)[id_col]
        return out.select(F.col("row_key").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.col("component_key").cast(kind).alias("component_id"), "row_key", (F.col("row_key") == F.col("component_key")).alias("kept"))
    out = written(out.join(rows.select("row_key", id_col), "row_key"), "jaccard-rows")
    names = written(out.groupBy("component_key").agg(F.min(id_col).alias("component_id"), F.min(F.struct(F.col(id_col).isNull(), id_col, "row_key"))["row_key"].alias("first_key")), "jaccard-names")
    return out.join(names, "component_key").select(id_col, F.col("n").alias("n_shingles"), "component_id", "row_key", (F.col("row_key") == F.col("first_key")).alias("kept"))
