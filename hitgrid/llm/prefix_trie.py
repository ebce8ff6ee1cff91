"""Prefix trie of conversations: shared beginnings, what they save, and where conversations end.

Conversations are paths of turn digests. Splitters from a bounded sample of paths deal them out to sorted shards. A node
whose members lie in two shards or more is a prefix of a splitter's path: the trie of these paths, the skeleton, is
broadcast. Each shard finishes all other nodes in one pass over its sorted rows and gives partial aggregates for the
skeleton's, which a reduction and one fold over the (bounded) skeleton combine.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, small_batches, written

#: Bytes of a turn's digest. Equal digests count as equal turns.
WIDTH = 16
#: Turns of all splitters together, at most: it bounds the broadcast skeleton to 4 MB of digests.
SKELETON_TURNS = 1 << 18
#: Sampled paths, about; conversations in a shard, about.
SAMPLE, SHARD_ROWS = 1 << 14, 1 << 16
#: Conversation ids in one packed row of a skeleton node's ends.
_ENDS = 4096

_PATHS = "conv_id long, path binary, sizes binary"
_NODE = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: What a shard says. node: a finished node, `skeleton` its parent's number if that is in the skeleton; part: what the shard adds to a
#: skeleton node; ends: conversations that end at one, in order.
_SAID = "kind string, skeleton int, shard int, seq long, ids string, size long, " + _NODE
_NOTHING = hashlib.sha256().hexdigest()


def conversation_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): a row per conversation, its turns' digests (16 bytes each) and code points (8 bytes each) in order.

    Turns go by `turn` (nulls first), ties by role, then text. Null roles and texts are empty. Rows without a conv_id belong
    to no conversation. Repeated rows are turns of their own. A conversation's digests, not its texts, are one value.
    """
    small_batches(conversations.sparkSession)
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = ((c, r, t) for b in batches for c, r, t in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True))
        for found in _chunks((c, *_path(own)) for c, own in groupby(turns, key=lambda x: x[0])):
            yield _batch(found, _PATHS)

    return rows.mapInArrow(run, _PATHS)


def _path(turns: Iterator[tuple[int, str, str]]) -> tuple[bytes, bytes]:
    path, sizes = bytearray(), []
    for _, role, text in turns:
        said = role.encode("utf-8", "surrogatepass")
        path += hashlib.sha256(len(said).to_bytes(8, "little") + said + text.encode("utf-8", "surrogatepass")).digest()[:WIDTH]
        sizes.append(len(text))
    return bytes(path), np.array(sizes, "<i8").tobytes()


def _chunks(rows: Iterator[tuple], n: int = 4096) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == n:
            yield held
            held = []
    if held:
        yield held


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), names, strict=True)], [n for n, _ in names])


def graft(paths: DataFrame, root: Column, turns: Column, longest: int) -> DataFrame:
    """paths rebuilt: the first `turns` turns (at most `longest`) of the conversation `root` (all if fewer, none if absent), then the own ones behind the first `turns`."""
    cut = lambda c, width, n: F.substring(c, F.lit(1), F.lit(width) * n)
    behind = lambda c, width, n: F.substring(c, F.lit(width) * n + 1, F.greatest(F.octet_length(c) - F.lit(width) * n, F.lit(0)))
    heads = paths.select(F.col("conv_id").alias("root"), cut(F.col("path"), WIDTH, F.lit(longest)).alias("head"), cut(F.col("sizes"), 8, F.lit(longest)).alias("head_sizes"))
    own = paths.withColumns({"root": root, "turns": turns.cast("int")}).join(heads, "root", "left")
    glued = lambda own, head, width: F.concat(F.coalesce(cut(F.col(head), width, F.col("turns")), F.lit(b"")), behind(F.col(own), width, F.col("turns")))
    return own.select("conv_id", glued("path", "head", WIDTH).alias("path"), glued("sizes", "head_sizes", 8).alias("sizes"))


@dataclass
class _Splitters:
    """Sorted (path, conv_id) keys, and the skeleton: node number by path, root 0, parents before children."""

    keys: list[tuple[bytes, int]]
    nodes: dict[bytes, int] = field(default_factory=dict)
    parents: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        # A node's key is the path of its parent's number and its own digest: bytes stay in proportion to nodes.
        self.parents = [-1]
        for path, _ in self.keys:
            at = 0
            for k in range(0, len(path), WIDTH):
                at = self.child(at, path[k : k + WIDTH], True)

    def child(self, node: int, digest: bytes, make: bool = False) -> int:
        key = node.to_bytes(4, "little") + digest
        found = self.nodes.get(key, -1)
        if found < 0 and make:
            found = self.nodes[key] = len(self.parents)
            self.parents.append(node)
        return found


def choose_splitters(paths: DataFrame, shards: int) -> _Splitters:
    """Up to shards - 1 keys that part a sample evenly. Their paths hold SKELETON_TURNS turns at most: every splitter has an equal
    allowance, and one that is longer waits for several. So very long paths make fewer shards, never another result."""
    n = paths.count()
    shards = max(shards, -(-n // SHARD_ROWS))
    place = F.xxhash64("conv_id") / F.lit(float(1 << 64)) + 0.5
    sample = written(paths.filter(place < F.lit(SAMPLE / max(n, 1))).select("path", "conv_id"), "trie-sample")
    step = max(sample.count() / shards, 1.0)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, due, allowance = 0, step, 0.0
        for b in batches:
            for path, conv_id in zip(b.column("path").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if seen >= due:
                    allowance, due = allowance + SKELETON_TURNS / shards, due + step
                    if len(path) // WIDTH <= allowance:
                        allowance -= len(path) // WIDTH
                        yield _batch([(path, conv_id)], "path binary, conv_id long")
                seen += 1

    chosen = sample.coalesce(1).sortWithinPartitions("path", "conv_id").mapInArrow(thin, "path binary, conv_id long")
    keys = sorted((bytes(r["path"]), r["conv_id"]) for r in chosen.collect())  # bounded by SKELETON_TURNS
    discard(sample)
    return _Splitters(keys)


class _Frame:
    """An open node of a shard's walk: what its finished children and its own ends add up to."""

    __slots__ = ("number", "size", "n", "least", "children", "leaves", "saved", "ends", "seq", "rows")

    def __init__(self, number: int, size: int) -> None:
        self.number, self.size, self.n, self.least = number, size, 0, None
        self.children = self.leaves = self.saved = self.seq = 0
        self.ends, self.rows = [] if number >= 0 else None, []

    def counts(self, conv_id: int, n: int) -> None:
        self.n += n
        self.least = conv_id if self.least is None else min(self.least, conv_id)


class _Walk:
    """One pass over a shard in the order of (path, conv_id): a node is finished as soon as a row leaves it."""

    def __init__(self, shard: int, splitters: _Splitters) -> None:
        self.shard, self.splitters, self.path = shard, splitters, b""
        self.stack = [_Frame(0, 0)]

    def add(self, conv_id: int, path: bytes, sizes: bytes) -> Iterator[tuple]:
        low, high = 0, min(len(path), len(self.path)) // WIDTH
        while low < high:  # turns in common
            mid = (low + high + 1) // 2
            low, high = (mid, high) if path[: mid * WIDTH] == self.path[: mid * WIDTH] else (low, mid - 1)
        while len(self.stack) > low + 1:
            yield from self.close()
        lengths = np.frombuffer(sizes, "<i8")
        for k in range(low, len(path) // WIDTH):
            above = self.stack[-1].number
            self.stack.append(_Frame(self.splitters.child(above, path[k * WIDTH : (k + 1) * WIDTH]) if above >= 0 else -1, int(lengths[k])))
        self.path = path
        top = self.stack[-1]
        top.counts(conv_id, 1)
        if top.number < 0:  # a hash for what ends here, in bounded memory
            top.ends = top.ends or hashlib.sha256()
            top.ends.update(b",%d" % conv_id if top.n > 1 else b"%d" % conv_id)
        else:
            top.ends.append(str(conv_id))
            if len(top.ends) == _ENDS:
                yield self.ends(top)

    def ends(self, top: _Frame) -> tuple:
        row = ("ends", top.number, self.shard, top.seq, ",".join(top.ends), None, *[None] * 8)
        top.ends, top.seq = [], top.seq + 1
        return row

    def close(self) -> Iterator[tuple]:
        """Finishes the top node. Its children's rows waited for its least conversation."""
        depth = len(self.stack) - 1
        done = self.stack.pop()
        above = self.stack[-1] if self.stack else None
        if done.number >= 0:
            if done.ends:
                yield self.ends(done)
            yield ("part", done.number, self.shard, None, None, done.size, depth, done.least, None, done.n, done.children, done.leaves, done.saved, None)
            return
        for row in done.rows:
            yield ("node", None, None, None, None, None, row[0], row[1], done.least, *row[2:])
        leaves, saved = done.leaves or 1, done.saved + (done.n - 1) * done.size
        own = (depth, done.least, done.n, done.children, leaves, saved, done.ends.hexdigest() if done.ends else _NOTHING)
        if above.number >= 0:
            yield ("node", above.number, None, None, None, None, own[0], own[1], None, *own[2:])
        else:
            above.rows.append(own)
        above.counts(done.least, done.n)
        above.children += 1
        above.leaves += leaves
        above.saved += saved

    def finish(self) -> Iterator[tuple]:
        while self.stack:
            yield from self.close()


def prefix_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """A row per node, a distinct beginning of a path (the root has none): conv_id (its least member), depth, parent_conv_id (the
    parent's conv_id), n_convs (members), n_children, n_leaves (childless nodes in its subtree, itself included), saved_tokens (over
    its subtree: (n_convs - 1) * code points of the node's last turn), ends_sha256 (of the members that end here, ascending,
    joined by commas).

    paths: (conv_id, path, sizes) of `conversation_paths`, ids distinct. Conversations without turns are members of the root
    alone. Equal paths are told apart by their ids, so a hot conversation lies in many shards. An empty table gives no rows.
    """
    spark = paths.sparkSession
    splitters = choose_splitters(paths, shards or partitions(spark))
    shared = spark.sparkContext.broadcast(splitters)
    n = len(splitters.keys) + 1

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value.keys
        for b in batches:
            shard = [bisect_right(keys, key) for key in zip(b.column("path").to_pylist(), b.column("conv_id").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *b.columns], ["shard", *b.schema.names])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def said() -> Iterator[tuple]:
            open_walk = None
            for b in batches:
                for shard, conv_id, path, sizes in zip(*(b.column(c).to_pylist() for c in ("shard", "conv_id", "path", "sizes")), strict=True):
                    if open_walk is None or shard != open_walk.shard:
                        if open_walk:
                            yield from open_walk.finish()
                        open_walk = _Walk(shard, shared.value)
                    yield from open_walk.add(conv_id, path, sizes)
            if open_walk:
                yield from open_walk.finish()

        for found in _chunks(said()):
            yield _batch(found, _SAID)

    dealt = paths.select("conv_id", "path", "sizes").mapInArrow(assign, "shard int, " + _PATHS).repartition(n, "shard").sortWithinPartitions("shard", "path", "conv_id")
    said = written(dealt.mapInArrow(walk, _SAID), "trie-shards")
    skeleton = written(_skeleton(said, shared), "trie-skeleton")
    columns = [x.split()[0] for x in _NODE.split(", ")]
    above = F.broadcast(skeleton.select(F.col("number").alias("skeleton"), F.col("conv_id").alias("above")))  # at most SKELETON_TURNS rows
    rest = said.filter("kind = 'node'").join(above, "skeleton", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return skeleton.select(*columns).unionByName(rest.select(*columns))


def _skeleton(said: DataFrame, shared) -> DataFrame:
    """The skeleton's nodes: partial aggregates are reduced by node, then one fold adds children to parents."""
    parts = said.filter("kind = 'part'").groupBy("skeleton").agg(*(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.min("conv_id").alias("conv_id"), F.max("size").alias("size"), F.max("depth").alias("depth"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = {r["skeleton"]: r for b in batches for r in b.to_pylist()}
        parents = shared.value.parents
        for k in sorted(nodes, reverse=True):  # children before parents
            r = nodes[k]
            r["n_leaves"] = r["n_leaves"] or 1
            r["saved_tokens"] += (r["n_convs"] - 1) * r["size"]
            if k:
                up = nodes[parents[k]]
                for c in ("n_convs", "n_leaves", "saved_tokens"):
                    up[c] += r[c]
                up["n_children"] += 1
                up["conv_id"] = min(x for x in (up["conv_id"], r["conv_id"]) if x is not None)
        rows = ((k, r["depth"], r["conv_id"], nodes[parents[k]]["conv_id"] if k else None, r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for k, r in nodes.items())
        for found in _chunks(rows):
            yield _batch(found, "number int, " + _NODE.removesuffix(", ends_sha256 string"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, ids) for b in batches for k, ids in zip(b.column("skeleton").to_pylist(), b.column("ids").to_pylist(), strict=True))

        def hashes() -> Iterator[tuple[int, str]]:
            for node, own in groupby(rows, key=lambda x: x[0]):
                ends = hashlib.sha256()
                for k, (_, ids) in enumerate(own):
                    ends.update(("," if k else "").encode() + ids.encode())
                yield node, ends.hexdigest()

        for found in _chunks(hashes()):
            yield _batch(found, "number int, ends_sha256 string")

    folded = parts.coalesce(1).mapInArrow(fold, "number int, " + _NODE.removesuffix(", ends_sha256 string"))
    ends = said.filter("kind = 'ends'").select("skeleton", "shard", "seq", "ids").repartition("skeleton").sortWithinPartitions("skeleton", "shard", "seq")
    return folded.join(ends.mapInArrow(digest, "number int, ends_sha256 string"), "number", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NOTHING)))
