"""Operators on texts against brute force, with nulls, empty and odd texts, repeated rows and empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hitgrid.llm import chat, exact_dedup, language_id, line_dedup, ngram_jaccard, packing, substring_dedup, unigram, url_filter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, row_key string, n_lines int"


def docs(spark, texts, ids=None):
    """A table with columns that clash with names the operators make."""
    return spark.createDataFrame([(i, t, "en", "s", "x", 7) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


LINES = ["Common line", " common LINE ", "", "rare é", "\tCOMMON line\r"]
TEXTS = [None, "", " \n\t", "one two", "A b c d e f g h", "a B c d e f g h", "É f", "é f"] + [f"{LINES[k % 5]}\nown {k}\n{LINES[(k + 1) % 5]}" for k in range(15)]


# ---- exact dedup


@pytest.mark.parametrize("ids", [None, "repeated"])
def test_exact_dedup(spark, ids):
    keys = [k % 9 if k % 4 else None for k in range(len(TEXTS))] if ids else list(range(len(TEXTS)))
    got = exact_dedup.exact_dedup(docs(spark, TEXTS, keys)).collect()
    assert len(got) == len(TEXTS)
    groups = Counter((t or "").translate(LOWER) for t in TEXTS)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): n for t, n in groups.items()}
    assert all(r.group_size == by_hash[r.text_sha256] for r in got)
    assert Counter(r.text_sha256 for r in got if r.kept) == dict.fromkeys(by_hash, 1)
    largest = {}
    for k, t in zip(keys, TEXTS, strict=True):
        name = hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()
        largest[name] = max(largest.get(name, -1), -1 if k is None else k)
    for r in got:
        assert (-1 if r.keep_id is None else r.keep_id) == largest[r.text_sha256]
        assert not r.kept or r.doc_id == r.keep_id


def test_exact_dedup_largest_id_stays_whatever_the_others_are(spark):
    """One repeated or null id elsewhere doesn't change the rule."""
    rows = [(9, "same"), (1, "SAME"), (5, "z"), (5, "q"), (None, "same"), (None, "n"), (None, "n"), (3, "x" * 200_000), (4, "x" * 200_000)]
    got = exact_dedup.exact_dedup(docs(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == Counter([(9, 9, 3, True), (1, 9, 3, False), (None, 9, 3, False), (5, 5, 1, True), (5, 5, 1, True), (None, None, 2, True), (None, None, 2, False), (3, 4, 2, False), (4, 4, 2, True)])


# ---- line dedup


def drop_lines(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    seen = defaultdict(set)
    for i, (d, t) in enumerate(rows):
        for x in (t or "").split("\n"):
            seen[key(x)].add(("row", i) if d is None else d)
    gone = {k for k, v in seen.items() if k and len(v) >= least}
    return sorted(((d, "\n".join(x for x in (t or "").split("\n") if key(x) not in gone)) for d, t in rows), key=repr)


@pytest.mark.parametrize("ids", [None, [k % 7 if k % 5 else None for k in range(len(TEXTS))]])
def test_line_dedup(spark, ids):
    ids = ids or list(range(len(TEXTS)))
    got = line_dedup.drop_frequent_lines(docs(spark, TEXTS, ids), min_docs=4)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == drop_lines(list(zip(ids, TEXTS, strict=True)), 4)


def test_line_dedup_of_a_long_text(spark):
    """50,000 lines, half of them frequent: the work is linear in the lines."""
    import time

    text = "\n".join(f"own {k}" if k % 2 else f"often {k % 1000}" for k in range(50_000))
    began = time.time()
    got = line_dedup.drop_frequent_lines(docs(spark, [text, *["\n".join(f"Often {k}" for k in range(0, 1000, 2))] * 3]), min_docs=3).orderBy("doc_id").collect()
    assert (got[0].n_lines, got[0].n_dropped, got[0].text) == (50_000, 25_000, "\n".join(f"own {k}" for k in range(1, 50_000, 2)))
    assert got[1].text == "" and time.time() - began < 60


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=4), st.text(alphabet="aAéÉãÃð\xd0\u00d7ÀàЀаАЁ\U00010400\ud7ff", max_size=4)), min_size=2, max_size=2))
def test_folding_by_bytes_keeps_lines_apart(pair):
    fold = lambda t: t.encode(errors="surrogatepass").decode("latin-1").lower()
    assert (fold(pair[0]) == fold(pair[1])) == (pair[0].translate(LOWER) == pair[1].translate(LOWER))


# ---- n-gram Jaccard


def jaccard(texts, width=5):
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for t in texts]
    sets = [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set() for w in words]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [(k, len(sets[k]), root[k]) for k in range(len(texts))]


def family(n, words=60):
    base = [f"w{k}" for k in range(words)]
    return [" ".join(w if (k * 7 + i) % (9 + k % 40) else f"x{k}{i}" for i, w in enumerate(base)) for k in range(n)]


def test_jaccard_components(spark, monkeypatch):
    texts = TEXTS + family(70) + [" ".join(family(1)[0].split()[:k]) for k in range(45, 60)] + ["x " * 3000]
    got = ngram_jaccard.jaccard_components(docs(spark, texts))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == jaccard(texts)
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 8)  # families over several blocks
    monkeypatch.setattr(ngram_jaccard, "HEAVY", 4)
    monkeypatch.setattr(ngram_jaccard, "PART_BYTES", 1000)
    got = ngram_jaccard.jaccard_components(docs(spark, texts))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == jaccard(texts)
    monkeypatch.setattr(ngram_jaccard, "MAX_BLOCKS", 2)  # families taken apart by their prefix shingles, these again over several blocks
    got = ngram_jaccard.jaccard_components(docs(spark, texts))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == jaccard(texts)


def test_jaccard_odd_ids(spark):
    texts = ["a b c d e f"] * 3 + ["q r s t u v", None]
    got = ngram_jaccard.jaccard_components(docs(spark, texts, [5, 5, None, 2, None])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == [(-1, 0, -1), (-1, 2, 5), (2, 2, 2), (5, 2, 5), (5, 2, 5)]
    assert sum(r.kept for r in got) == 3


def test_jaccard_pairs_need_every_filter():
    import numpy as np

    sets = [np.arange(10, dtype=np.uint64), np.arange(10, dtype=np.uint64), np.arange(1, 11, dtype=np.uint64)]
    far = [[s[:1] for _ in range(2)] for s in sets]
    assert list(ngram_jaccard.link(np.array([10, 10, 10]), far, sets)) == [0, 0, 2]  # the third shares no prefix
    near = [[s[1:3], s[4:6]] for s in sets]
    assert list(ngram_jaccard.link(np.array([10, 10, 10]), near, sets)) == [0, 0, 0]


# ---- substring dedup


def test_substring_dedup(spark):
    passage = " ".join(f"passage{k * 37 % 101}" for k in range(60))
    texts = [" ".join(f"clean{k}x{j}" for j in range(80)) for k in range(6)]
    with_it = [t[: 90 + 31 * k] + " " + passage + " " + t[90 + 31 * k :] for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(docs(spark, [*with_it, *[f"other {t[::-1]}" for t in texts], None, "", "é" * 50])).collect()}
    assert got[0].text == with_it[0] and got[0].removed_bytes == 0
    for k in range(1, 6):
        assert passage not in got[k].text and got[k].removed_bytes > len(passage) / 2
        assert with_it[k].startswith(got[k].text[:80]) and all(f"clean{k}x{j} " in got[k].text for j in range(5))
    for k in range(6, 12):
        assert got[k].removed_bytes == 0
    assert (got[12].text, got[13].text, got[14].text) == ("", "", "é" * 50)


def test_substring_cuts_resist_insertions():
    import numpy as np

    rng = np.random.default_rng(3)
    data = np.where(rng.random(9000) < 0.2, 32, rng.integers(97, 123, 9000)).astype(np.uint8)
    moved = np.concatenate([data[:3000], np.frombuffer(b" new words here ", np.uint8), data[3000:]])

    def cuts(raw):
        starts, _, _ = substring_dedup.passage_words(raw, np.array([0, len(raw)]))
        at = np.flatnonzero(substring_dedup.chunk_cuts(substring_dedup.gear(raw, starts)))
        assert np.diff(at).max() <= substring_dedup.CUT_SPAN
        return set(starts[at].tolist())

    a, b = cuts(data), cuts(moved)
    assert {x for x in a if x < 2900} == {x for x in b if x < 2900} and {x + 16 for x in a if x > 3100} == {x for x in b if x > 3116}


def test_substring_exact_windows(spark):
    """Short and long words, whole passages to their ends, no mosaics of short ones, and the copies of a text without spaces."""
    import random

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    prose = lambda n, size=None: " ".join(word(size or rng.randint(2, 9)) for _ in range(n))
    texts, want = [], {}
    for k in range(120):
        passage = prose(51, k % 3 + 1)
        a, b, c, d = (prose(rng.randint(5, 90)) for _ in range(4))
        want[len(texts) + 1] = [(len(c) + 1, len(c) + 1 + len(passage))]
        texts += [f"{a} {passage} {b}", f"{c} {passage} {d}"]
    parts = [prose(50) for _ in range(4)]
    texts += [f"{prose(9)} {p} {prose(9)}" for p in parts]
    want[len(texts)] = []  # each part is repeated, the whole isn't
    texts.append(" ".join(parts))
    dense = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(200))
    want[len(texts) + 1] = [(30, 30 + len(dense.encode()))]
    texts += [dense, "丁" * 10 + dense]
    rows = substring_dedup.dedup_substrings(docs(spark, texts)).collect()
    assert {r.doc_id: [tuple(x) for x in r.removed] for r in rows if r.doc_id in want or r.removed} == want


@pytest.mark.parametrize("width", [3, 12, 26, 51])
def test_substring_windows_as_by_brute_force(spark, width):
    """Few words, so that windows repeat within and across texts, overlap, and share chunks in different surroundings. Null and repeated ids."""
    import random

    rng = random.Random(9)
    pieces = [" ".join(rng.choice("abcdef") * rng.randint(1, 3) for _ in range(rng.randint(1, 7 + width // 2))) for _ in range(14)]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(120)] + ["a " * 90, "b a " * 60]

    def gone(rows):
        seen, want = set(), []
        for t in rows:
            words = [m.span() for m in re.finditer(r"[^ ]+", t)]
            flags = [False] * len(words)
            for i in range(len(words) - width + 1):
                if (piece := t[words[i][0] : words[i + width - 1][1]]) in seen:
                    flags[i : i + width] = [True] * width
                seen.add(piece)
            edges = [i for i in range(len(words) + 1) if (i < len(words) and flags[i]) != (i > 0 and flags[i - 1])]
            want.append([(words[a][0], words[b - 1][1]) for a, b in zip(edges[::2], edges[1::2], strict=True)])
        return want

    want = gone(texts)
    rows = substring_dedup.dedup_substrings(docs(spark, texts), min_words=width).collect()
    assert sum(map(bool, want)) > 30
    assert {r.doc_id: [tuple(x) for x in r.removed] for r in rows} == dict(enumerate(want))
    # Every third row has no id and comes first; equal texts keep the one with the least id.
    ids = [None if k % 3 == 0 else 500 - k for k in range(len(texts))]
    rows = substring_dedup.dedup_substrings(docs(spark, texts, ids), min_words=width).collect()
    order = sorted((k for k in range(len(texts)) if ids[k] is not None), key=lambda k: ids[k])
    assert sum(r.doc_id is None for r in rows) == 41 and rows[0].lang == "en"
    alone = substring_dedup.dedup_substrings(docs(spark, [texts[k] for k in order], [ids[k] for k in order]), min_words=width).collect()
    assert [[tuple(x) for x in r.removed] for r in sorted(alone, key=lambda r: r.doc_id)] == gone([texts[k] for k in order])


# ---- chat


ROLES = st.sampled_from(["system", "user", "assistant", "tool", None, "<|end|>"])
SAID = st.one_of(st.none(), st.text(max_size=40), st.lists(st.sampled_from(["<|turn|>", "[INST]", "</s>", "<\\|", "<", "\\", "word ", "<<SYS>>", "[/INST]", "\n"]), max_size=6).map("".join))


@settings(max_examples=200, deadline=None)
@given(SAID)
def test_escape_round_trip(text):
    held = chat.escape(text or "")
    assert chat.unescape(held) == (text or "")
    assert not re.search(r"<\||\[/?INST\]|</?s>", held)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(ROLES, SAID), min_size=1, max_size=30))
def test_windows_hold_each_turn_once(turns):
    talk, out = chat._Conversation(20, 2, 8), []
    for role, text in turns:
        if done := talk.add(role or "", text or "", chat.count_tokens(text or "")):
            out.append(done)
    out.append(talk.close())
    new = [t for w in out for t in chat.read_turns(w["text"])[w["n_context"] :]]
    assert new == [(r or "", t or "") for r, t in turns]
    assert [chat.unescape(w["text"][a:b]) for w in out for a, b in zip(w["loss_starts"], w["loss_ends"], strict=True)] == [t or "" for r, t in turns if r == "assistant"]
    for w in out:
        assert w["n_tokens"] <= 20 or w["n_new"] == 1
        if turns[0][0] == "system" and w["window"]:
            assert chat.read_turns(w["text"])[0] == ("system", turns[0][1] or "")


def test_digest_chats(spark):
    rows = [(k % 5 if k % 5 else None, k // 5, ["system", "user", "assistant", None][k % 4], [f"text {k} " * 60, None, ""][k % 3], "extra") for k in range(60)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    got = {r.conv_id: r for r in chat.digest_chats(chat.format_chats(table)).collect()}
    assert len(got) == 5
    for conv in got:
        own = sorted(((t, r or "", x or "") for c, t, r, x, _ in rows if c == conv))
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256("".join(x for _, r, x in own if r == "assistant").encode()).hexdigest()
    assert chat.digest_chats(chat.format_chats(table.limit(0))).count() == 0


# ---- SentencePiece


@pytest.fixture(scope="module")
def pieces():
    return unigram.load(public_tokenizers.path("piece_bpe_32k.model"))


ODD = ["", None, " ", "  a", "a  b ", "▁x ▁", "日本語 🎉 x", "\n\t", "a" * 300, "é ü", "The quick brown fox", "x" * 3000 + " y"]


def test_unigram_round_trip(spark, pieces):
    table = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    encoded = unigram.encode(table, pieces)
    assert [r.text for r in unigram.decode(encoded, pieces).orderBy("doc_id").collect()] == [t or "" for t in ODD]


def test_unigram_is_the_best_path(pieces):
    import numpy as np

    vocabulary = unigram.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    scores = unigram.log_scores(vocabulary)
    known = {t.replace("▁", " "): (scores[i], i) for i, (t, _, kind) in enumerate(vocabulary) if kind == 1}
    for text in ["hello world", "été naïve", " spaces   in between", "日本 mixed ☃ text", "don't stop", "aaaaaaaaaa"]:
        full = " " + text
        best = [0.0] + [-1e18] * len(full)
        for i in range(len(full)):
            for j in range(i + 1, min(len(full), i + 16) + 1):
                if full[i:j] in known:
                    best[j] = max(best[j], best[i] + known[full[i:j]][0])
            if full[i] not in known:
                best[i + 1] = max(best[i + 1], best[i] + pieces.unknown)
        raw = np.frombuffer(full.encode(), np.uint8)
        ids, _ = unigram.viterbi(pieces, raw, np.array([0, len(raw)]))
        total, k = 0.0, 0
        while k < len(ids):
            if vocabulary[ids[k]][2] == 6:  # the bytes of one character
                first = int(vocabulary[ids[k]][0][3:5], 16)
                k += 1 if first < 128 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                total += pieces.unknown
            else:
                total += scores[ids[k]]
                k += 1
        assert abs(total - best[-1]) < 1e-9


# ---- packing


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = [*ODD, "don't 's a\nb\u00a0c d", "x <|endoftext|> y", *[f"word {k} " * (k * 3) for k in range(60)]]
    path = public_tokenizers.path("byte_bpe_50k.json")
    table = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, start int")
    rows = packing.pack_documents(table, path).collect()
    ids = [e.ids + [0] for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) and r.doc_tokens == len(ids[r.doc_id])
    for k, own in by_doc.items():
        assert sorted(x for r in own for x in range(r.start, r.start + r.length)) == list(range(len(ids[k])))
    assert len(by_doc) == len(texts)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        total = sum(r.length for r in own)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert total & (total - 1) == 0 and total <= 1024 and {r.sequence_length for r in own} == {total}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=60))
def test_pack_covers_every_token_once(lengths):
    import numpy as np

    out = packing.pack(np.array(lengths, np.int64))
    seen = Counter((d, x) for s in out for d, a, n in s for x in range(a, a + n))
    assert seen == Counter((d, x) for d, n in enumerate(lengths) for x in range(n))
    assert all((t := sum(p[2] for p in s)) & (t - 1) == 0 and t <= 1024 for s in out)
    steps = packing.step_groups([sum(p[2] for p in s) for s in out], 8192)
    load = Counter()
    for s, k in zip(out, steps, strict=True):
        load[k] += sum(p[2] for p in s) ** 2
    assert not load or max(load.values()) - min(load.values()) <= 1024**2 or len(load) < max(steps) + 1


# ---- URL filter


def test_url_filter(spark):
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("com/fr/", "allow")]
    urls = {1: "http://A.Example.ORG/es/x?y", 2: "http://b.org", 3: "http://b.org/", 4: None, 5: "", 6: "no scheme", 7: "x://h.com/fr/#f", 8: "http://notcom/fr/", 9: "http://É.COM/fr/"}
    many = [(100 + k, f"http://{'casino-win' if k % 2 else 'garden-shop'}{k % 7}.example.net/en/{k}") for k in range(60)] + [(200, "http://casino-winner.example.net/en/1"), (201, "http://garden-shopping.example.net/en/1")]
    pages = spark.createDataFrame([(k, u, "h") for k, u in [*urls.items(), *many]], "page_id long, url string, host string")
    labelled = url_filter.labelled_urls(pages, words=["casino"])
    got = {r.page_id: r for r in url_filter.filter_urls(pages, rules, labelled).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[2].rule is None and got[3].rule == "org/" and (got[4].host, got[4].path) == ("", "") == (got[6].host, got[6].path)
    assert got[7].rule == "com/fr/" and got[8].rule is None and got[9].rule == "com/fr/" and got[9].host == "É.com"
    assert got[200].verdict == "block" and got[201].verdict == "allow"  # not in the labelled table under these names
    assert url_filter.filter_urls(pages.limit(0), rules, labelled.limit(0)).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab1é\U0001F600/\n", max_size=9), min_size=1, max_size=8))
def test_url_grams_as_by_brute_force(spark, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", url_filter.ngrams(F.col("t"), (3, 5), "h").alias("g")).collect()
    for r in rows:
        full = f"^{texts[r.k]}$"
        assert r.g == [f"h{n}:{full[i : i + n]}" for n in (3, 5) for i in range(len(full) - n + 1)]


def best_rule(url, rules):
    """By the docstrings, in plain Python."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].lower()
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    says = {}
    for rule, verdict in rules:
        if rule is not None and verdict is not None:
            says[rule] = max(verdict, says.get(rule, ""))
    fits = [r for r in says for h, slash, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(slash + p)]
    rule = min(fits, key=lambda r: (-len(r), r), default=None)
    return rule, says.get(rule)


RULE_HOSTS = ["", "com", "a.com", "b.a.com", "acom", "org", "x.org", "net", "a.", "."]


@settings(max_examples=6, deadline=None)
@given(
    st.lists(st.tuples(st.one_of(st.none(), st.tuples(st.sampled_from(RULE_HOSTS), st.sampled_from(["", "/", "/a", "/ab", "/a/b", "/ab/c", "/abcd", "/é"])).map("".join)), st.sampled_from(["allow", "block", None])), max_size=20),
    st.lists(st.tuples(st.sampled_from(RULE_HOSTS), st.sampled_from(["", "/", "/a", "/ab", "/abc", "/a/b", "/ab/cd", "/b", "/é?q", "#f"])).map(lambda x: "http://" + "".join(x)), min_size=1, max_size=30),
)
def test_url_rules_of_a_table_and_of_a_list_are_those_of_plain_python(spark, rules, urls):
    """Rules without a slash, repeated ones with other verdicts, nulls; both ways agree with brute force."""
    pages = spark.createDataFrame([(k, u) for k, u in enumerate([*urls, None, "x"])], "page_id int, url string")
    none = spark.createDataFrame([], "host string, path string, label double")
    for given_rules in (rules, spark.createDataFrame(rules, "rule string, verdict string")):
        for r in url_filter.filter_urls(pages, given_rules, none).collect():
            rule, verdict = best_rule([*urls, None, "x"][r.page_id], rules)
            assert (r.rule, r.verdict) == (rule, verdict or "allow")


@pytest.mark.parametrize("n", [0, url_filter.MAX_RULES, url_filter.MAX_RULES + 100])
def test_url_rules_on_both_sides_of_the_switch(spark, n):
    import random

    rng = random.Random(n)
    rules = [(rng.choice(RULE_HOSTS) + rng.choice(["", "/", "/a"]) + "".join(rng.choice("ab/.") for _ in range(k % 6)), rng.choice(["allow", "block"])) for k in range(n)]
    urls = [f"http://{rng.choice(RULE_HOSTS)}/{''.join(rng.choice('ab/.') for _ in range(k % 7))}" for k in range(120)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = url_filter.filter_urls(pages, rules, spark.createDataFrame([], "host string, path string, label double")).collect()
    assert len(got) == len(urls) and all((r.rule, r.verdict) == (x[0], x[1] or "allow") for r in got for x in [best_rule(urls[r.page_id], rules)])


def test_url_filter_odd_tables(spark):
    """Very long URLs in linear time, null and repeated ids, rules of equal length, and verdicts as by the model's own weights."""
    import time

    urls = [(None, "http://a.example.org/es/1"), (7, "http://casino.example.net/en/9"), (7, "http://casino.example.net/en/9"), (8, "http://x.y/" + "long/" * 20_000), (9, None)]
    urls += [(100 + k, f"http://{'casino' if k % 2 else 'garden'}{k % 5}.example.net/en/{k}") for k in range(40)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    rules = [("y/ab", "allow"), ("y/aa", "allow"), ("example.org/es/", "block"), ("example.org/", "allow")]
    labelled = spark.createDataFrame([(f"{'casino' if k % 2 else 'garden'}{k}.example.net", f"/en/{k}", float(k % 2)) for k in range(30)], "host string, path string, label double")
    began = time.time()
    got = url_filter.filter_urls(pages, rules, labelled).collect()
    assert time.time() - began < 90 and len(got) == len(urls)
    assert [r.verdict for r in got if r.page_id is None] == ["block"] and [r.verdict for r in got if r.page_id == 7] == ["block", "block"]
    assert {r.host for r in got if r.page_id == 9} == {""} and all(r.verdict == ("block" if r.page_id % 2 else "allow") for r in got if (r.page_id or 0) >= 100)
    # The probability by hand: the mean of hashed n-grams is what the model's weights say.
    import math

    model = url_filter.fit(labelled)
    hashing, weights = model.stages
    for r in got[-3:]:
        grams = {hashing.indexOf(f"{m}{n}:{t[i : i + n]}") for m, n, t in [("h", n, f"^{r.host}$") for n in (3, 4, 5)] + [("p", 3, "^" + re.sub("[0-9]", "0", r.path) + "$")] for i in range(len(t) - n + 1)}
        assert r.p_block == pytest.approx(1 / (1 + math.exp(-weights.intercept - sum(weights.coefficients[g] for g in grams))))


# ---- language ID


def test_language_id(spark):
    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    held = docs_.filter("doc_id % 3 = 0")
    hidden = held.withColumn("lang", docs_["lang"].substr(0, 0))  # no declaration: the text and the host decide
    train = docs_.filter("doc_id % 3 <> 0").unionByName(hidden)
    got = language_id.identify(train, declared=train["lang"], host=train["source"])
    good = got.join(held.select("doc_id", "lang"), "doc_id").selectExpr("avg(cast(lang = lang_id as double)) a", "avg(cast(accepted as double)) k").first()
    assert good.a > 0.97 and good.k > 0.98
    odd = spark.createDataFrame([(1, None, None, None), (2, "", "en", ""), (2, "", "en", ""), (3, "1234 5678", "xx", "h")], "doc_id long, text string, lang string, source string")
    out = language_id.identify(odd, declared=odd["lang"], host=odd["source"]).collect()
    assert len(out) == 4 and not any(r.accepted for r in out)
    assert language_id.identify(odd.limit(0)).count() == 0


def test_language_id_knows_rare_languages_and_declarations(spark):
    """Over 64 languages, most of a few rows beside two of many; declarations of a single row each."""
    import random

    rng = random.Random(4)
    vocabulary = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(60)] for _ in range(72)]
    text = lambda k, n=40: " ".join(rng.choice(vocabulary[k]) for _ in range(n))
    rows = [(f"l{k}", text(k)) for k in range(72) for _ in range(60 if k < 2 else 6)]
    table = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(table, declared=table["lang"]).collect()}
    assert len(got) == len(rows) and all(got[i].lang_id == lang and got[i].accepted for i, (lang, _) in enumerate(rows))
    # Each row has a spelling of its own: the table of declarations holds them all, and each row still comes out once.
    spelt = spark.createDataFrame([(i, text(i % 2, 20), f"x{i}" if i >= 200 else f"l{i % 2}") for i in range(230)], "doc_id long, text string, lang string")
    out = language_id.identify(spelt, declared=spelt["lang"]).collect()
    assert sorted(r.doc_id for r in out) == list(range(230))


def plain_language_id(rows, temper=0.25, smoothing=20.0, min_grams=8):
    """(lang_id, p) of every row (text, declared, host, suffix) by the docstrings, in plain Python; all rows are in the sample."""
    import math
    from collections import Counter, defaultdict

    from hitgrid.llm.common import mix64

    def grams(text):
        out, raw = [], re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
        for k, c in enumerate(raw):
            letter = 97 <= c <= 122 or c >= 128
            if letter or k == 0 or 97 <= raw[k - 1] <= 122 or raw[k - 1] >= 128:
                out.append(c if letter else 32)
        line = [32, 32, *out, 32, 32]
        wide = [line[i] << 16 | line[i + 1] << 8 | line[i + 2] for i in range(len(out) + 2)]
        return [int(mix64(np.array([g], np.uint64))[0]) % language_id.BUCKETS for g in wide if g != 0x202020]

    bags = [Counter(grams(r[0])) for r in rows]
    held = defaultdict(Counter)
    for bag, (text, declared, *_) in zip(bags, rows, strict=True):
        lang = re.sub(r"^([a-z]{2,8})[-_].*$", r"\1", (declared or "").strip().lower())
        if lang and text and bag:
            held[lang].update(bag)
    langs, n = sorted(held), language_id.BUCKETS
    q = Counter({b: 1 + 0.05 * sum(sum(c.values()) for c in held.values()) / n for b in range(n)})
    for c in held.values():
        q.update(c)
    all_q = sum(q.values())
    scores = [{k: temper * sum(c * math.log((held[k][b] + n * q[b] / all_q) / (sum(held[k].values()) + n)) for b, c in bag.items()) for k in langs} for bag in bags]

    def share(logs):
        most = max(logs.values())
        total = sum(math.exp(v - most) for v in logs.values())
        return {k: math.exp(v - most) / total for k, v in logs.items()}

    told, hosts, ends, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), Counter()
    for s, bag, (_, declared, host, suffix) in zip(scores, bags, rows, strict=True):
        told[declared or ""], hosts[host, suffix], ends[suffix]  # noqa: B018 - keys without a sure text count, too
        if sum(bag.values()) >= min_grams:
            for table in (told[declared or ""], hosts[host, suffix], ends[suffix], whole):
                table.update(share(s))
    out = []
    for s, (_, declared, host, suffix) in zip(scores, rows, strict=True):
        z = {}
        for k in langs:
            top = (whole[k] + 1) / (sum(whole.values()) + len(langs))
            parent = (ends[suffix][k] + smoothing * top) / (sum(ends[suffix].values()) + smoothing)
            prior = (hosts[host, suffix][k] + smoothing * parent) / (sum(hosts[host, suffix].values()) + smoothing)
            z[k] = s[k] + math.log(prior) + math.log((told[declared or ""][k] + 1) / (whole[k] + len(told) + 1))
        p = share(z)
        out.append((min(p, key=lambda k: (-p[k], k)), max(p.values())))
    return out


@pytest.mark.parametrize("block", [128, 2])
def test_language_id_is_the_fused_posterior_of_plain_python(spark, monkeypatch, block):
    """Declarations with regions, null and blank ones, hosts and suffixes, short and empty texts; in one block of languages and in several."""
    import random

    monkeypatch.setattr(language_id, "LANGUAGES", block)
    rng = random.Random(11)
    vocabulary = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 7))) for _ in range(40)] for _ in range(9)]
    rows = []
    for i in range(70):
        k = i % 9
        lang = rng.choice([f"l{chr(97 + k)}", f"L{chr(97 + k)}-XX", f"l{chr(97 + k)}_y", None, " ", f"l{chr(97 + (k + 1) % 9)}"])
        words = rng.choice([0, 1, 2, 3, 30, 60])
        rows.append((rng.choice([None, ""]) if not words else " ".join(rng.choice(vocabulary[k]).title() if rng.random() < 0.2 else rng.choice(vocabulary[k]) for _ in range(words)) + rng.choice(["", " 12.", "!!"]), lang, f"h{rng.randint(0, 4)}.{'ab'[k % 2]}", "ab"[k % 2]))
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, host string, end string")
    got = {r.doc_id: r for r in language_id.identify(table, declared=table["lang"], host=table["host"], suffix=table["end"]).collect()}
    for i, (lang, p) in enumerate(plain_language_id(rows)):
        assert got[i].p == pytest.approx(p, rel=1e-6) and (got[i].lang_id == lang or p < 0.5), i


def test_language_id_of_two_thousand_labels(spark):
    """Time doesn't follow the number of labels; every row still comes out once."""
    import time

    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    took = {}
    for n in (1, 2000):
        table = docs_.withColumn("lang", F.when(F.lit(n) == 1, F.col("lang")).otherwise(F.concat("lang", F.lit("x"), (F.col("doc_id") % n).cast("string"))))
        began = time.time()
        got = language_id.identify(table, declared=table["lang"], host=table["source"]).collect()
        took[n] = time.time() - began
        assert len(got) == docs_.count()
    assert took[2000] < 4 * took[1] + 10


def test_language_id_of_pages(spark):
    """Declared markup language and address suffix come from the page; where text and host are silent, the suffix decides."""
    parts = spark.createDataFrame(
        [("a.B.FR", '<!DOCTYPE html><HTML class=x lang="fr-CA">'), ("b.example.com.", "<html lang=de>"), ("10.0.0.1", "<html><p lang='es'>"), ("localhost", "<htmlx lang='es'>"), (None, None)], "host string, html string"
    ).select(language_id.host_suffix(F.col("host")).alias("s"), language_id.markup_language(F.col("html")).alias("m"))
    assert [tuple(r) for r in parts.collect()] == [("fr", "fr"), ("com", "de"), ("", None), ("", None), ("", None)]
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    host, _ = url_filter.split_url(F.col("url"))
    text = F.regexp_replace("html", r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")
    got = language_id.identify(pages.withColumn("text", text), "page_id", declared=language_id.markup_language(F.col("html")), host=host, suffix=language_id.host_suffix(host))
    both = got.join(pages.select("page_id", language_id.markup_language(F.col("html")).alias("m")), "page_id")
    assert both.count() == pages.count() and both.filter("lang_id = m").count() > 0.9 * pages.count()
    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang in ('fr', 'de') and length(text) > 200").select("doc_id", "text", "lang")
    sited = docs_.select("doc_id", "text", "lang", F.concat(F.col("doc_id").cast("string"), F.lit("."), "lang").alias("host"))
    bare = spark.createDataFrame([(-1, "xq", None, "new.fr"), (-2, "xq", None, "new.de")], "doc_id long, text string, lang string, host string")
    rows = sited.unionByName(bare)
    out = {r.doc_id: r.lang_id for r in language_id.identify(rows, declared=rows["lang"], host=rows["host"], suffix=language_id.host_suffix(rows["host"])).filter("doc_id < 0").collect()}
    assert out == {-1: "fr", -2: "de"}


@pytest.mark.parametrize("run", [lambda d: exact_dedup.exact_dedup(d), lambda d: line_dedup.drop_frequent_lines(d), lambda d: ngram_jaccard.jaccard_components(d), lambda d: substring_dedup.dedup_substrings(d), lambda d: packing.pack_documents(d, public_tokenizers.path("byte_bpe_50k.json"))])
def test_empty_tables(spark, run):
    assert run(docs(spark, ["x"]).limit(0)).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab cé漢9.x", max_size=200), min_size=1, max_size=6))
def test_cuts_in_long_stretches_change_no_piece(texts):
    """Cut or in one, the same pieces."""
    import pyarrow as pa

    pieces = PIECES.setdefault("p", unigram.load(public_tokenizers.path("piece_bpe_32k.model")))
    whole, unigram._LONG = unigram._LONG, 1 << 40
    try:
        one = unigram.encode_column(pieces, pa.array(texts, pa.string()))
    finally:
        unigram._LONG = 3
    try:
        cut = unigram.encode_column(pieces, pa.array(texts, pa.string()))
    finally:
        unigram._LONG = whole
    assert all((a == b).all() for a, b in zip(one, cut, strict=True))


PIECES = {}


def test_five_megabytes_without_a_blank_are_coded_in_seconds(spark):
    import base64
    import random
    import time

    pieces = PIECES.setdefault("p", unigram.load(public_tokenizers.path("piece_bpe_32k.model")))
    text = base64.b64encode(random.Random(1).randbytes(3_750_000)).decode()
    rows = spark.createDataFrame([(1, text), (2, "a b")], "doc_id int, text string")
    began = time.time()
    assert {r.doc_id: r.text for r in unigram.decode(unigram.encode(rows, pieces), pieces).collect()} == {1: text, 2: "a b"}
    assert time.time() - began < 60
