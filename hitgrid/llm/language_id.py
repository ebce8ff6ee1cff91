"""Language identification by Bayesian evidence fusion.

Text likelihoods come from naive Bayes on hashed byte trigrams. They are fused with the declared markup
language, through how often each declaration meets each language of the text, and with priors of the host,
smoothed through its address suffix to the whole corpus. Both are grouped aggregations over all rows; only
the table of trigram weights is fitted on a bounded labelled sample. Nothing grows with languages times rows: the model is
postings, in blocks of a bounded size, and rows carry the languages that they may be in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, discard, keyed, lower_bytes, mix64, text_bytes, written

BUCKETS = 1 << 15
#: Rows of each declared language in the labelled sample.
SAMPLE = 500
#: Languages in a block of the model: its postings, 4 million at most, are broadcast, and a worker holds 32 MB of weights. Texts whose counts are laid out at once.
LANGUAGES, _TEXTS = 128, 32
#: A language this far below the best one, in tempered log likelihood, is impossible: e ** -60.
GAP = 60.0
_SLICE = 1 << 20


@dataclass(frozen=True)
class TextModel:
    """A block of languages: postings of the trigram buckets that their samples hold, and each language's own numbers.

    P(bucket | language) = (count + BUCKETS * q) / (total + BUCKETS), where q is the bucket's share of the whole sample (smoothed, see text_models).
    """

    bucket: np.ndarray  # of each posting
    language: np.ndarray  # of each posting: the language's place in the block
    gain: np.ndarray  # log(1 + count / (BUCKETS * q))
    ids: np.ndarray  # numbers of the block's languages
    floor: np.ndarray  # -log(total + BUCKETS), by language
    common: np.ndarray  # log(BUCKETS * q), by bucket
    usual: np.ndarray  # mean log probability of a trigram, by language
    spread: np.ndarray  # its standard deviation over trigrams

    @cached_property
    def weights(self) -> np.ndarray:
        """Log probabilities, buckets x languages."""
        out = self.common[:, None] + self.floor
        out[self.bucket, self.language] += self.gain
        return out

    def scores(self, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log likelihoods, texts x languages of the block: counts of the buckets that some texts hold, times their weights."""
        n = len(first) - 1
        text = np.repeat(np.arange(n), np.diff(first))
        both, counts = np.unique(text * BUCKETS + grams[first[0] : first[-1]], return_counts=True)
        text, bucket = np.divmod(both, BUCKETS)
        out = np.zeros((n, len(self.ids)))
        for at in range(0, n, _TEXTS):
            some = slice(*np.searchsorted(text, (at, at + _TEXTS)))
            used, place = np.unique(bucket[some], return_inverse=True)
            held = np.zeros((min(_TEXTS, n - at), len(used)))
            held[text[some] - at, place] = counts[some]
            out[at : at + _TEXTS] = held @ self.weights[used]
        return out


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams that hold a letter, and each text's first one (n + 1 values).

    A-Z is lower-cased; runs of anything but letters are one mark each, as are both ends of a text.
    """
    raw = lower_bytes(raw)
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    marked = np.where(letter, raw, np.uint8(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first mark after letters stays
    if len(raw):
        starts = offsets[:-1][offsets[:-1] < len(raw)]
        keep[starts] |= True
    index = np.flatnonzero(keep)
    ends = np.searchsorted(index, offsets)
    packed = marked[index].astype(np.uint32)
    # Two marks between texts keep their trigrams apart.
    gap = np.zeros(len(packed) + 2 * len(offsets), np.uint32) + 32
    at = np.arange(len(packed)) + 2 * (np.searchsorted(ends, np.arange(len(packed)), side="right"))
    gap[at] = packed
    grams = (gap[:-2] << 16) | (gap[1:-1] << 8) | gap[2:]
    some = grams != 0x202020
    first = np.concatenate([[0], np.cumsum(some)])[np.minimum(ends + 2 * np.arange(len(offsets)), len(some))]
    return (mix64(grams[some].astype(np.uint64)) & np.uint64(BUCKETS - 1)).astype(np.int32), first


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of each slice."""
    for batch in by_bytes(batches, "text", _SLICE):
        grams, first = trigrams(*text_bytes(batch.column("text")))
        names, own = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
        both, counts = np.unique(np.repeat(own, np.diff(first)) * BUCKETS + grams[first[0] : first[-1]], return_counts=True)
        lang, bucket = np.divmod(both, BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(names[lang], pa.string()), pa.array(bucket.astype(np.int32)), pa.array(counts.astype(np.int64))], ["lang", "bucket", "n"])


def canonical_language(declared: Column) -> Column:
    """A declaration without what doesn't name the language: lower-cased, blanks stripped, the primary subtag of `en-US` or `en_us`; null where nothing is left."""
    plain = F.lower(F.trim(declared))
    return F.nullif(F.regexp_replace(plain, r"^([a-z]{2,8})[-_][a-z0-9_-]*$", "$1"), F.lit(""))


def sampled_counts(docs: DataFrame, label: Column, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """(lang, bucket, n), a written table: trigram counts of at most `sample` rows of each label, the first by a hash of id and text."""
    from pyspark.sql import Window

    rows = docs.select(label.alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h")).filter("lang is not null and length(text) > 0")
    # The limit runs before the text moves: a hash below the bound that holds about `sample` rows, then the exact rank of those few.
    sizes = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "label-sizes")
    few = rows.join(sizes, "lang").filter((F.col("h") / F.lit(float(1 << 64)) + 0.5) < F.lit(sample + 6 * sample**0.5) / F.col("n")).select("lang", "text", "h")
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("rank") <= sample)
    counts = written(few.select("lang", "text").mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "language-counts")
    discard(sizes)
    return counts


def text_models(counts: DataFrame, languages: DataFrame) -> Iterator[TextModel]:
    """The model in blocks of LANGUAGES languages at most, one after the other: each is broadcast alone.

    languages: (lang, number, block). Beside its block, the driver holds one number for each bucket.
    """
    q = np.zeros(BUCKETS)
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        q[r["bucket"]] = r["n"]
    # Every bucket has a twentieth of an even share and one: codes and addresses in a text are odd, but not that odd.
    q += 1 + 0.05 * q.sum() / BUCKETS
    q /= q.sum()
    base = BUCKETS * q
    for k in range((languages.agg(F.max("block")).first()[0] or 0) + 1):
        held = counts.join(languages.filter(F.col("block") == k), "lang").select("number", "bucket", "n").toArrow()
        number, bucket, n = (held.column(c).to_numpy() for c in ("number", "bucket", "n"))
        order = np.lexsort((number, bucket))  # sums in one order give one model
        number, bucket, n = number[order], bucket[order], n[order].astype(np.float64)
        ids, language = np.unique(number, return_inverse=True)
        total = np.bincount(language, n, len(ids)) + BUCKETS
        # Means over all buckets: as if none were held, and what the held ones change.
        p0, log0 = base[bucket] / total[language], np.log(base[bucket] / total[language])
        p, log = (n + base[bucket]) / total[language], np.log((n + base[bucket]) / total[language])
        shift, weight = np.log(total), BUCKETS / total
        means = [weight * sum(math.comb(m, j) * (q * np.log(base) ** (m - j)).sum() * (-shift) ** j for j in range(m + 1)) + np.bincount(language, p * log**m - p0 * log0**m, len(ids)) for m in (1, 2)]
        yield TextModel(bucket, language.astype(np.int32), np.log1p(n / base[bucket]), ids, -shift, np.log(base), means[0], np.sqrt(np.maximum(means[1] - means[0] ** 2, 0.0)))


def host_suffix(host: Column) -> Column:
    """The address suffix of a host: what follows its last dot, lower-cased; empty for hosts without a dot, with digits alone there (addresses in numbers) and nulls."""
    return F.lower(F.regexp_extract(F.coalesce(host, F.lit("")), r"\.([^.\d][^.]*)\.?$", 1))


def markup_language(html: Column) -> Column:
    """The primary subtag of the lang attribute of the html element, lower-cased; null where there is none."""
    found = F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?is)<html(?=[\s>])[^>]*?\slang\s*=\s*["']?([a-z]{2,8})""", 1)
    return F.nullif(F.lower(found), F.lit(""))


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared: Column | None = None,
    host: Column | None = None,
    suffix: Column | None = None,
    accepted: Sequence[str] | None = None,
    temper: float = 0.25,
    smoothing: float = 20.0,
    min_probability: float = 0.5,
    min_grams: int = 8,
    oddness: float = 2.0,
    sample: int = SAMPLE,
    key_col: str | None = None,
) -> DataFrame:
    """(row_key, id, lang_id, p, text_lang, oddness, accepted), a row per row of docs.

    Every canonical declaration (`canonical_language`) that has text is a language of the model, however many there are.
    lang_id: the language with the highest fused posterior p, of equals the first by name; null where no language could be fitted.
    Evidence: text scores times `temper` (trigrams overlap, so they are not independent), log P(declared | language)
    and log prior(language | host). A prior is its counts plus `smoothing` times its parent's prior: host under
    suffix under corpus. Null declarations, hosts and suffixes are values like others. For pages, `markup_language`
    and `host_suffix` give the declaration and the suffix.
    accepted is false for texts with fewer than min_grams trigrams, for p below min_probability, for languages
    outside `accepted` (all of the model by default), and for texts whose mean score lies more than
    `oddness` + 8 / sqrt(n_grams) standard deviations of a trigram below the usual one: they are in no
    language of the model.
    Languages whose text score lies more than GAP below the best one count as impossible for a text (their share is below
    double precision); the others travel as (language, score) entries, so rows and tables grow with the languages that a
    text may be in, not with all. Empty tables give no rows. Input rows may repeat. key_col: the row_key of `keyed`, if the rows
    are numbered already.
    """
    from pyspark.sql import Window

    spark, blank = docs.sparkSession, F.lit(None).cast("string")
    declared, host = declared if declared is not None else blank, host if host is not None else blank
    suffix = suffix if suffix is not None else blank
    rows, _ = keyed(docs, id_col, F.col(text_col).alias("text"), declared.cast("string").alias("declared"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(suffix.cast("string"), F.lit("")).alias("suffix"), key_col=key_col)
    counts = sampled_counts(rows, canonical_language(F.col("declared")), "text", id_col, sample)
    # Numbers follow the names; there is one row a language.
    number = F.row_number().over(Window.orderBy("lang")) - 1
    languages = written(counts.select("lang").distinct().select("lang", number.alias("number")).withColumn("block", F.expr(f"cast(number div {LANGUAGES} as int)")), "languages")
    n = languages.count()
    meta = rows.select("row_key", F.col(id_col).alias("id"), F.coalesce("declared", F.lit("")).alias("declared"), "host", "suffix", "text")
    if not n:
        discard(counts, languages)
        return rows.select("row_key", F.col(id_col), blank.alias("lang_id"), F.lit(None).cast("double").alias("p"), blank.alias("text_lang"), F.lit(None).cast("double").alias("oddness"), F.lit(False).alias("accepted"))
    blocks = [_score_with(meta, model, temper) for model in text_models(counts, languages)]
    scored = written(_best_of_blocks(blocks), "language-scores")
    discard(counts)
    said, priors = _evidence(scored, languages, n, min_grams, smoothing)
    joined = scored.join(priors, ["host", "suffix"]).join(said, "declared")
    fused = F.transform("langs", lambda x: F.struct((x["score"] + F.element_at("said", x["lang"]) + F.element_at("prior", x["lang"])).alias("z"), x["lang"].alias("lang")))
    # The best one and the sum of e ** (z - best) in one pass.
    start = F.struct(F.lit(float("-inf")).alias("z"), F.lit(-1).alias("lang"), F.lit(0.0).alias("sum"))
    more = lambda a, x: F.when(x["z"] > a["z"], F.struct(x["z"].alias("z"), x["lang"].alias("lang"), (a["sum"] * F.exp(a["z"] - x["z"]) + 1).alias("sum"))).otherwise(F.struct(a["z"].alias("z"), a["lang"].alias("lang"), (a["sum"] + F.exp(x["z"] - a["z"])).alias("sum")))
    out = joined.select("row_key", "id", F.aggregate(fused, start, more).alias("best"), "text_best", "oddness", "n_grams")
    out = out.select("row_key", "id", (1 / F.col("best.sum")).alias("p"), "text_best", "oddness", "n_grams", F.col("best.lang").alias("best"))
    named = out.join(languages.select(F.col("number").alias("best"), F.col("lang").alias("lang_id")), "best").join(languages.select(F.col("number").alias("text_best"), F.col("lang").alias("text_lang")), "text_best")
    fine = (F.col("n_grams") >= min_grams) & (F.col("p") >= min_probability) & (F.col("oddness") <= oddness + 8 / F.sqrt(F.greatest("n_grams", F.lit(1))))
    if accepted is not None:
        fine = fine & F.col("lang_id").isin(*accepted)
    return named.select("row_key", F.col("id").alias(id_col), "lang_id", "p", "text_lang", "oddness", fine.alias("accepted"))


_ENTRY = "struct<lang: int, score: double>"


def _score_with(meta: DataFrame, model: TextModel, temper: float) -> DataFrame:
    """Entries of the block's languages within GAP of its best one, beside the columns of meta, in one pass and without a join."""
    shared, kind = meta.sparkSession.sparkContext.broadcast(model), dict(meta.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in by_bytes(batches, "text", _SLICE):
            grams, first = trigrams(*text_bytes(batch.column("text")))
            n = np.diff(first)
            scores = model.scores(grams, first)
            best = scores.argmax(axis=1)
            top = scores[np.arange(len(scores)), best]
            tempered = scores * temper
            kept = tempered >= (top * temper - GAP)[:, None]
            ends = np.concatenate([[0], np.cumsum(kept.sum(axis=1))])
            entry = pa.StructArray.from_arrays([pa.array(np.broadcast_to(model.ids.astype(np.int32), kept.shape)[kept]), pa.array(tempered[kept])], ["lang", "score"])
            odd = (model.usual[best] - top / np.maximum(n, 1)) / np.maximum(model.spread[best], 1e-9)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row_key", "id", "declared", "host", "suffix")), pa.array(n), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entry), pa.array(model.ids[best].astype(np.int32)), pa.array(top * temper), pa.array(odd)],
                ["row_key", "id", "declared", "host", "suffix", "n_grams", "langs", "text_best", "best", "oddness"],
            )

    return meta.mapInArrow(run, f"row_key long, id {kind}, declared string, host string, suffix string, n_grams long, langs array<{_ENTRY}>, text_best int, best double, oddness double")


def _best_of_blocks(blocks: list[DataFrame]) -> DataFrame:
    """The blocks' entries put together, those within GAP of the best of all, with `best`, the best one's score, and `mass`, the sum of e ** (score - best)."""
    every = reduce(DataFrame.unionByName, blocks)
    if len(blocks) > 1:
        same = ("id", "declared", "host", "suffix", "n_grams")
        every = every.groupBy("row_key").agg(*(F.first(c).alias(c) for c in same), F.flatten(F.collect_list("langs")).alias("langs"), F.max(F.struct("best", (-F.col("text_best")).alias("first"), "oddness")).alias("top"))
        langs = F.array_sort(F.filter("langs", lambda x: x["score"] >= F.col("top.best") - GAP))  # by number
        every = every.select("row_key", *same, langs.alias("langs"), (-F.col("top.first")).alias("text_best"), F.col("top.best").alias("best"), F.col("top.oddness").alias("oddness"))
    return every.withColumn("mass", F.aggregate("langs", F.lit(0.0), lambda a, x: a + F.exp(x["score"] - F.col("best"))))


def _evidence(scored: DataFrame, languages: DataFrame, n: int, min_grams: int, smoothing: float) -> tuple[DataFrame, DataFrame]:
    """((declared, said), (host, suffix, prior)): maps from a language to its log probability, for the languages that a row of the key may be in.

    Counts are sums of the text's own posterior over texts of at least min_grams trigrams. Each is a row for a key and a language; only a key's own
    languages become its map.
    """
    entries = scored.select("declared", "host", "suffix", "n_grams", "best", "mass", F.explode("langs").alias("e"))
    sure = F.when(F.col("n_grams") >= min_grams, F.exp(F.col("e.score") - F.col("best")) / F.col("mass")).otherwise(0.0)
    counted = entries.groupBy("declared", "host", "suffix", F.col("e.lang").alias("lang")).agg(F.sum(sure).alias("c"))
    counted = written(counted, "language-evidence")
    by_language = counted.groupBy("lang").agg(F.sum("c").alias("w"))
    total = counted.agg(F.sum("c")).first()[0] or 0.0
    k = counted.select("declared").distinct().count()
    top = written(by_language.select("lang", "w", ((F.col("w") + 1) / (total + n)).alias("top")), "language-priors")

    def mapped(keys: list[str], name: str, value: Column, df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("lang", F.log(value)))).alias(name))

    told = counted.groupBy("declared", "lang").agg(F.sum("c").alias("c")).join(top, "lang")
    said = mapped(["declared"], "said", (F.col("c") + 1) / (F.col("w") + (k + 1.0)), told)
    hosts = counted.groupBy("host", "suffix", "lang").agg(F.sum("c").alias("c"))
    ends = counted.groupBy("suffix", "lang").agg(F.sum("c").alias("c"))
    sums = lambda df, by: df.groupBy(*by).agg(F.sum("c").alias("all"))
    ends = ends.join(top, "lang").join(sums(ends, ["suffix"]), "suffix").select("suffix", "lang", ((F.col("c") + smoothing * F.col("top")) / (F.col("all") + smoothing)).alias("parent"))
    hosts = hosts.join(ends, ["suffix", "lang"]).join(sums(hosts, ["host", "suffix"]), ["host", "suffix"])
    return said, mapped(["host", "suffix"], "prior", (F.col("c") + smoothing * F.col("parent")) / (F.col("all") + smoothing), hosts)
