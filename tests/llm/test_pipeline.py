"""The pipeline over the smallest tables, stage by stage."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from hitgrid.llm.common import written

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [documents.count()]
    rows = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = written(stage(spark, rows, SF), name)
        assert rows.columns == documents.columns
        kept.append(rows.count())
        assert rows.filter("n_chars <> length(text)").count() == 0
    assert kept[0] >= kept[1] == kept[2] >= kept[3] == kept[4] > 0.5 * kept[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, SF)
    assert packed.select("doc_id").distinct().count() == kept[-1]


def test_decisions_are_by_row(spark):
    """Null and repeated ids: a rejected row takes no other along, and of equal rows one stays."""
    known = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) > 300")
    good = known.orderBy("doc_id").limit(40).selectExpr("if(doc_id % 2 = 0, null, 5L) AS doc_id", "text", "lang", "source", "n_chars")
    bad = spark.createDataFrame([(None, "1 2", "en", "s", 3), (5, "", "en", "s", 0)], known.schema)
    rows = corpus_pipeline.language_id(spark, good.unionByName(bad), SF)
    assert rows.filter("n_chars > 3").count() == corpus_pipeline.language_id(spark, good, SF).count() > 30
    assert rows.filter("n_chars <= 3").count() == 0
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    copies = spark.createDataFrame([(5, a, "en", "s", 9), (5, a, "en", "s", 9), (None, b, "en", "s", 9), (None, b, "en", "s", 9), (None, a, "en", "s", 9)], known.schema)
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.ngram_jaccard(spark, copies, SF).collect() if r.doc_id) == [(5, a)]
    assert corpus_pipeline.ngram_jaccard(spark, copies, SF).count() == 2


def test_run_is_as_by_brute_force(spark, tmp_path):
    """run() over a small table with null and repeated ids, empty texts and an extra column, against plain Python after the language decision."""
    import re
    from collections import Counter

    from test_text_operators import drop_lines, jaccard

    known = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(120)
    rows = [(None if k % 6 == 0 else 1000 if k % 50 == 1 else r.doc_id, r.text, r.lang, r.source, r.n_chars, "extra") for k, r in enumerate(known.collect())]
    rows += [(7000, None, "en", "s", 0, "x"), (7001, "", None, None, 0, "x"), rows[7], rows[7]]
    spark.createDataFrame(rows, known.select("*").schema.add("row_key", "string")).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.language_id(spark, docs, str(tmp_path)).collect()]
    assert 100 < len(kept) < len(rows) and all(t for _, t in kept)
    kept = drop_lines(kept, 10)
    ordered = sorted(kept, key=lambda x: (x[0] is not None, x[0] or 0))
    components = jaccard([t for _, t in ordered])
    size = lambda k: sum(c[2] == components[k][2] for c in components)
    # Of a group the row with the least id stays, a null id counting as the largest.
    chosen = {}
    for k, (i, t) in enumerate(ordered):
        name = components[k][2]
        if name not in chosen or (i is None, i or 0) < (chosen[name][0] is None, chosen[name][0] or 0):
            chosen[name] = (i, t, size(k))
    got = corpus_pipeline.ngram_jaccard(spark, corpus_pipeline.line_dedup(spark, corpus_pipeline.language_id(spark, docs, SF), SF), SF)
    left = [(r.doc_id, r.text) for r in got.collect()]
    assert Counter(i for i, _ in left) == Counter(i for i, _, _ in chosen.values())
    assert {(i, t) for i, t, n in chosen.values() if n == 1} <= set(left)  # of equal ids in a group any may stay
    cut = [(r.doc_id, r.text) for r in corpus_pipeline.substring_dedup(spark, got, SF).collect()]
    seen, bytes_left = set(), 0
    for _, t in sorted(left, key=lambda x: (x[0] is not None, x[0] or 0)):
        words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        gone = [False] * len(words)
        for a in range(len(words) - 50):
            piece = t[words[a][0] : words[a + 50][1]]
            if piece in seen:
                gone[a : a + 51] = [True] * 51
            seen.add(piece)
        bytes_left += sum(not g for g in gone)
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t in cut) == bytes_left and len(cut) == len(left)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    pieces = packed.collect()
    assert sum(r.start == 0 for r in pieces) == len(cut)
    by = {}
    for r in pieces:
        by.setdefault(r.sequence_id, []).append(r.length)
    assert all(sum(x) <= 1024 for x in by.values())


def test_stages_of_an_empty_table(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_queries_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
