"""Connected components of an edge table, by contraction in rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of edges (a, b), long ids; root is one node of the component, not always the least.

    In each round every node moves to the neighbour that comes first in that round's order, edges follow their
    ends and loops go. The first order is that of the ids, which settles stars at once; the later ones are
    hashes, so that long chains shrink by a constant share a round. Empty edges give no rows.
    """
    rest = written(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    moves: list[DataFrame] = []
    for k in range(MAX_ROUNDS):
        if rest.isEmpty():
            break
        rank = F.xxhash64(F.lit(k), "b") if k else F.lit(0)
        own = F.xxhash64(F.lit(k), "a") if k else F.lit(0)
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.least(F.min(F.struct(rank.alias("r"), F.col("b").alias("n"))), F.first(F.struct(own.alias("r"), F.col("a").alias("n"))))
        move = written(both.groupBy("a").agg(first["n"].alias("to")).select(F.col("a").alias("node"), "to"), "moves")
        moves.append(move)
        ends = [move.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b")]
        moved = rest.join(ends[0], "a").join(ends[1], "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).filter("a <> b")
        last, rest = rest, written(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        discard(last)
    else:
        raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")
    if not moves:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = moves[0].select("node", F.col("to").alias("root"))
    for move in moves[1:]:
        out = out.join(move.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    out = written(out, "components")
    discard(rest, *moves)
    return out
