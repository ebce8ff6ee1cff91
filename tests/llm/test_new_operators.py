"""Phrase collocations, quality classifier and conversation prefix trie against brute force; odd tables, hot groups, bounds that bite."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hitgrid.llm import collocations, prefix_trie, quality, queries

SF = "/root/testdata/sf0.001"

# ---- collocations


def brute_collocations(rows, max_words=3, min_count=10, contained=50, top=2000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, max_words + 1):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        inside = {p: max((b for q, b in some.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))), default=0) for p in some}
        rated = []
        for p, a in some.items():
            if not (inside[p] and 100 * inside[p] >= contained * a):
                score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rated.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, t.decode(), -a, n1, n2, total[lang], -s) for i, (s, a, t, n1, n2) in enumerate(sorted(rated)[:top])]
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def collocated(df, **options):
    return sorted(tuple(r[c] for c in COLUMNS) for r in collocations.collocations(df, **options).collect())


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["en", "de", "", None]), st.one_of(st.none(), st.text(alphabet="aB é\t.,\n\x0b", max_size=60))), min_size=1, max_size=25))
def test_collocations_are_those_of_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert collocated(df, min_count=2, top=5) == brute_collocations(rows, min_count=2, top=5)


def test_collocations_of_many_lots_parts_and_longer_phrases(spark, monkeypatch):
    """Small lots and hash partitions, so that summaries overflow and merge; phrases of up to five words; a hot language and phrase."""
    import random

    monkeypatch.setattr(collocations, "LOT_BYTES", 3000)
    monkeypatch.setattr(collocations, "PART_MASS", 500)
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    rows = [(rng.choice(["en"] * 9 + ["xx"]), " ".join(rng.choice(["big red dog ran home", "of the", *rng.choices(words, k=4)]) for _ in range(40)) + rng.choice(".,") + "ends here") for _ in range(120)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    got = collocated(df, max_words=5, min_count=6)
    assert got == brute_collocations(rows, max_words=5, min_count=6) and len(got) > 20
    assert collocated(df.limit(0)) == [] and collocated(spark.createDataFrame([("en", "a"), ("en", None), (None, "...")], "lang string, text string")) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=400), st.integers(2, 12), st.integers(1, 50))
def test_summaries_keep_every_frequent_key(keys, threshold, step):
    """Merged in any pieces: no frequent key is lost, and no more keys stay than the capacity."""
    summary = collocations.Summary(len(keys) // threshold + 1)
    for k in range(0, len(keys), step):
        part, n = np.unique(np.array(keys[k : k + step], np.uint64), return_counts=True)
        other = collocations.Summary(len(keys) // threshold + 1)
        other.merge(part, n)
        summary.merge(other.keys, other.counts, other.missing)
        assert len(summary.keys) <= summary.capacity
    assert {k for k, n in Counter(keys).items() if n >= threshold} <= set(summary.at_least(threshold).tolist())


def test_collocation_scores_beyond_64_bits(spark):
    """The same expression on counts of 10 ** 15."""
    a, n1, n2 = 999_999_999_999_989, 999_999_999_999_999, 999_999_999_999_997
    got = spark.createDataFrame([(a, n1, n2)], "a long, l long, r long").select(F.expr("cast(1000000 as decimal(7,0)) * (cast(a as decimal(16,0)) * cast(a as decimal(16,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))").alias("s")).first()
    assert got.s == 1_000_000 * a * a // (n1 * n2)


def test_op11_extra_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.select("lang", "text", F.lit("x").alias("lot"), F.lit(1).alias("words"), F.lit("p").alias("phrase"))
    assert collocated(odd) == brute_collocations([(r.lang, r.text) for r in docs.collect()])


# ---- quality


def test_op12_quality_classifier(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = queries.op12_quality_classifier(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    right = [r.predicted == labels[r.doc_id] for r in held]
    assert len(held) > 60 and sum(right) / len(right) > 0.95
    bad = [r.predicted for r in held if labels[r.doc_id] == 0]
    assert bad and sum(bad) / len(bad) < 0.35


def brute_score(model, text):
    """By the docstring of features, one feature at a time."""
    raw = re.sub(rb"[ \t\n\x0b\x0c\r]+", b" ", text.encode())
    buckets = []
    for n in (3, 4):
        for i in range(len(raw) - n + 1):
            gram = int.from_bytes(raw[i : i + n], "big") ^ (n * 0x9E3779B1 & 0xFFFFFFFF)
            buckets.append((gram * 2654435761 & 0xFFFFFFFF) >> 17)
    words = re.findall(rb"[^ ]+", raw)
    hashes = []
    for k, w in enumerate(words):
        h = int(quality.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
        hashes.append(1 if k and w == words[k - 1] else h)
    mix = lambda x: int(quality.mix64(np.array([x & (1 << 64) - 1], np.uint64))[0])
    buckets += [(h >> 40) % quality.BUCKETS for h in hashes] + [(mix(a * 3 + b) >> 40) % quality.BUCKETS for a, b in zip(hashes, hashes[1:], strict=False)]
    z = (model.vectors[buckets].astype(float).mean(axis=0) if buckets else np.zeros(quality.DIM)) @ model.output + model.bias
    return float(np.exp(z[1] - z.max()) / np.exp(z - z.max()).sum())


def test_quality_scores_are_the_softmax_of_mean_vectors(spark):
    texts = ["good words here", "bad%%% bad%%% bad%%%", "", None, " \t\n", "x", "ab", "one one one two", "é ü 漢字", "A b\x0bc", "long words " * 60_000]
    rng = np.random.default_rng(1)
    model = quality.QualityModel(rng.normal(0, 1, (quality.BUCKETS, quality.DIM)).astype(np.float32), rng.normal(0, 1, (quality.DIM, 2)), np.array([0.2, -0.3]))
    rows = spark.createDataFrame([(None if k % 3 == 0 else k % 4, t, 1.0, "z") for k, t in enumerate(texts * 2)], "doc_id long, text string, score double, label string").repartition(3)
    got = quality.score_quality(rows, model)
    assert got.columns == ["doc_id", "score"]
    found = Counter(round(r.score, 9) for r in got.collect())
    assert found == Counter(round(brute_score(model, t or ""), 9) for t in texts * 2)
    assert quality.score_quality(rows.limit(0), model).count() == 0


def test_quality_labels_that_are_missing_odd_or_one_sided(spark):
    docs = spark.createDataFrame([(k, f"{'fine words of text' if k % 2 else '!!! ### %%%'} {k}") for k in range(40)] + [(None, "fine"), (3, "fine words again"), (5, None)], "doc_id long, text string")
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, extra string")
    share = lambda model: float(quality.score_quality(docs, model).first().score)
    assert share(quality.fit_quality(docs, table([]), F.col("quality"))) == 0.5
    assert share(quality.fit_quality(docs, table([(1, 1, ""), (3, 1, ""), (None, 0, ""), (7, 5, ""), (7, None, "")]), F.col("quality"))) == 0.75
    some = table([(k, k % 2, "") for k in range(30)] + [(1, 1, ""), (999, 0, "")])
    model = quality.fit_quality(docs, some, F.col("quality"), sample=10)
    got = quality.score_quality(docs, model).filter("doc_id >= 30").collect()
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in got)
    again = quality.fit_quality(docs.repartition(5), some, F.col("quality"), sample=10)
    assert np.array_equal(model.vectors, again.vectors) and np.array_equal(model.bias, again.bias)


# ---- prefix trie


def brute_trie(talks):
    """talks: conv_id -> [(role, text), ...], already rebuilt."""
    members = defaultdict(list)
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []

    def below(node):
        return [node, *(x for c in children[node] for x in below(c))]

    for node, own in members.items():
        subtree = below(node)
        ends = sorted(c for c in own if len(talks[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children[node]), sum(not children[x] for x in subtree), sum((len(members[x]) - 1) * len(x[-1][1]) for x in subtree if x), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(df):
    return sorted((tuple(r[c] for c in TRIE) for r in df.collect()), key=repr)


def turns_of(rows):
    talks = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            talks[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in talks.items()}


def rebuilt(talks):
    out = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = talks.get(c - c % 100, [])[:h] + own[h:]
    return out


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 7), st.sampled_from([100, 103, 105, 207])), st.one_of(st.none(), st.integers(0, 9)), st.sampled_from(["user", "assistant", None, ""]), st.sampled_from(["a", "b", "", None, "é漢"])), min_size=1, max_size=60), st.integers(1, 9))
def test_trie_is_that_of_brute_force(spark, rows, shards):
    """Null conversations, turns, roles and texts; ties and repeated rows; absent roots; any number of shards."""
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    paths = prefix_trie.conversation_paths(df)
    assert trie(prefix_trie.prefix_trie(paths, shards)) == brute_trie(turns_of(rows))
    grafted = prefix_trie.graft(paths, F.col("conv_id") - F.col("conv_id") % 100, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6, 5)
    assert trie(prefix_trie.prefix_trie(grafted, shards)) == brute_trie(rebuilt(turns_of(rows)))


@pytest.mark.parametrize("budget", [1 << 18, 60, 3])
def test_trie_of_hot_and_long_conversations(spark, monkeypatch, budget):
    """A third of all conversations are equal, all share a first turn, one has 300 turns; splitters beyond the skeleton's bound are left out; ends fill many packed rows."""
    monkeypatch.setattr(prefix_trie, "SKELETON_TURNS", budget)
    monkeypatch.setattr(prefix_trie, "_ENDS", 7)
    rows = [(c, t, "user", f"{'hot' if c % 3 == 0 else c % 11 + t % 3} {t}" if t else "hello") for c in range(240) for t in range(c % 3 * 2 + 2 if c % 3 else 4)] + [(1000, t, "user", f"long {t}" if t else "hello") for t in range(300)]
    paths = prefix_trie.conversation_paths(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    splitters = prefix_trie.choose_splitters(paths, 12)
    assert sum(len(p) // prefix_trie.WIDTH for p, _ in splitters.keys) <= budget and (len(splitters.keys) > 5 or budget < 1000)
    got, want = trie(prefix_trie.prefix_trie(paths, 12)), None
    by_key = {(r[0], r[1]): r for r in got}
    talks = turns_of(rows)
    long = talks.pop(1000)
    want = {(r[0], r[1]): r for r in brute_trie(talks | {1000: long[:30]})}  # the recursion of the brute force ends there
    assert len(got) == len(want) + 270
    for key, r in want.items():
        assert by_key[key] == r or (key[0] == 1000 and key[1] == 30)
    assert by_key[1000, 300][3:6] == (1, 0, 1)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, path string, extra int")
    assert trie(prefix_trie.prefix_trie(prefix_trie.conversation_paths(empty))) == []
    only = spark.createDataFrame([(5, b"", b""), (2, b"", b"")], "conv_id long, path binary, sizes binary")
    assert trie(prefix_trie.prefix_trie(only)) == [(2, 0, None, 2, 0, 1, 0, hashlib.sha256(b"2,5").hexdigest())]


def test_op13_clashing_columns(spark):
    conversations = spark.read.parquet(f"{SF}/conversations.parquet")
    odd = conversations.withColumns({"path": F.lit("x"), "sizes": F.lit(1), "shard": F.lit(2), "kind": F.lit("part")})
    talks = turns_of([(r.conv_id, r.turn, r.role, r.text) for r in conversations.collect()])
    assert trie(prefix_trie.prefix_trie(prefix_trie.conversation_paths(odd))) == brute_trie(talks)
