"""One query for each operator, as the driver's contracts ask for them: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, exact_dedup, language_id, line_dedup, media, ngram_jaccard, packing, prefix_trie, quality, substring_dedup, unigram, url_filter

#: The rules of the URL filter's contract.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, URL_RULES, url_filter.labelled_urls(pages))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], conversations.schema)
    return chat.digest_chats(chat.format_chats(conversations.unionByName(more)))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(_table(spark, sf_dir, "documents")).drop("row_key", "kept")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


OP5_SQL = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {LOWER_SQL} AS t FROM documents) WINDOW w AS (PARTITION BY t)
"""


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = unigram.load(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = unigram.encode(_table(spark, sf_dir, "documents"), pieces)
    return unigram.decode(encoded, pieces, digest=True).withColumn("n_ids", F.size("ids").cast("long"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, declared=F.col("lang"), host=F.col("source"), suffix=language_id.host_suffix(F.col("source"))).drop("row_key")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_frequent_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
    SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
    SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), judged AS (
    SELECT doc_id, pos, line, key IN (SELECT key FROM frequent) AS gone FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_payloads(media.store_payloads(_table(spark, sf_dir, "documents")))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER_SQL}, '[.,;:!?
-
]')) AS piece FROM documents
), pieces AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS w FROM texts
), grams AS (
    SELECT lang, m AS words, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM pieces, (VALUES (1), (2), (3)) AS sizes(m)
), counted AS MATERIALIZED (
    SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE words = 1 GROUP BY lang
), frequent AS MATERIALIZED (
    SELECT * FROM counted WHERE f >= 10
), candidates AS MATERIALIZED (
    SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM frequent WHERE words > 1
), halves AS MATERIALIZED (
    SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM candidates, (VALUES (1), (2)) AS ks(k) WHERE k < words
), cuts AS (
    SELECT h.lang, h.phrase, h.a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * h.a * h.a // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM halves h JOIN frequent x ON x.lang = h.lang AND x.phrase = head JOIN frequent y ON y.lang = h.lang AND y.phrase = tail
), worst AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), parts AS (
    SELECT lang, array_to_string(w[s:s + 1], ' ') AS phrase, max(a) AS longer FROM candidates, (VALUES (1), (2)) AS ss(s) WHERE words = 3 GROUP BY ALL
), kept AS (
    SELECT worst.* FROM worst LEFT JOIN parts USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, labels.filter(~quality.held_out(F.col("doc_id"))), F.col("quality"))
    return quality.score_quality(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = prefix_trie.conversation_paths(_table(spark, sf_dir, "conversations"))
    turns = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    rebuilt = prefix_trie.graft(paths, root=F.col("conv_id") - F.col("conv_id") % 100, turns=turns, longest=5)
    return prefix_trie.prefix_trie(rebuilt)


# crc32 bit by bit: DuckDB has no such function.
OP13_SQL = r"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
    SELECT conv_id, conv_id - conv_id % 100 AS root, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
    SELECT ids.conv_id, pos, role, text FROM ids JOIN turns ON turns.conv_id = root AND pos <= h
    UNION ALL
    SELECT ids.conv_id, pos, role, text FROM ids JOIN turns ON turns.conv_id = ids.conv_id AND pos > h
), numbered AS (
    SELECT conv_id, length(text) AS size, md5(length(role) || ':' || role || text) AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth FROM rebuilt
), paths AS (
    SELECT conv_id, depth, size, list(turn) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM numbered
    UNION ALL SELECT conv_id, 0, 0, [] FROM ids
), lengths AS (
    SELECT conv_id, max(depth) AS last FROM paths GROUP BY conv_id
), nodes AS (
    SELECT path, any_value(depth) AS depth, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = last), '')) AS ends_sha256
    FROM paths JOIN lengths USING (conv_id) GROUP BY path
), family AS (
    SELECT p.path, p.depth, p.conv_id, p.n_convs, p.ends_sha256, q.conv_id AS parent_conv_id,
        (SELECT count(*) FROM nodes c WHERE c.depth = p.depth + 1 AND c.path[1:c.depth - 1] = p.path) AS n_children FROM nodes p LEFT JOIN nodes q ON p.depth > 0 AND q.path = p.path[1:p.depth - 1]
), below AS (
    SELECT path, unnest(list_transform(range(0, depth + 1), lambda k: path[1:k])) AS top FROM nodes
)
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, count(*) FILTER (d.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.size)::BIGINT AS saved_tokens, f.ends_sha256
FROM family f JOIN below b ON b.top = f.path JOIN nodes n ON n.path = b.path JOIN family d ON d.path = b.path GROUP BY ALL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_url_filter, op2_chat_format, op3_ngram_jaccard, op4_substring_dedup, op5_exact_dedup, op6_sentencepiece, op7_language_id, op8_line_dedup, op9_packing, op10_media_columns, op11_phrase_collocations, op12_quality_classifier, op13_conversation_prefix_trie)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op8_line_dedup": OP8_SQL, "op11_phrase_collocations": OP11_SQL, "op13_conversation_prefix_trie": OP13_SQL}
