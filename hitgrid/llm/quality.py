"""Quality classifier: supervised subword embeddings.

A text is the mean of learned vectors of its hashed features: words, pairs of words and character n-grams. A softmax over
that mean gives the probability of each label. Vectors and output layer are trained together by stochastic gradient descent
in numpy, in one task, on a bounded sample of labelled rows; every text is scored, whole, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_array, by_bytes, discard, mix64, small_batches, span_hashes, text_bytes, word_spans, written

BUCKETS, DIM = 1 << 15, 16
#: Labelled rows of each label in the sample, at most.
SAMPLE = 2000
_SLICE = 1 << 20
_SPACE = np.full(256, False)
_SPACE[[*b" \t\n\x0b\x0c\r"]] = True


def features(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Families of features: (buckets, bounds, short), where text k has buckets[bounds[k]:bounds[k + 1]], the last `short` of
    them void (BUCKETS).

    The 3 and 4 bytes from every place, white space as one blank; words as they are, and pairs of neighbours. A word that
    repeats the one before it is one mark, whatever it is.
    """
    blank = _SPACE[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[offsets[:-1][offsets[:-1] < len(raw)]] = True
    line = np.where(blank, np.uint8(32), raw)[keep].astype(np.uint32)
    bounds = np.concatenate([[0], np.cumsum(keep)])[offsets]
    out = []
    grams = line
    for n in (2, 3, 4):
        grams = (grams[:-1] << np.uint32(8)) | line[n - 1 :] if len(line) >= n else grams[:0]
        if n > 2:
            hashed = (grams ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2654435761) >> np.uint32(32 - 15)
            out.append((_void_ends(hashed, bounds, n - 1), bounds, n - 1))
    starts, ends, first = word_spans(raw, offsets)
    words = span_hashes(raw, starts, ends)
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    same[first[:-1][first[:-1] < len(words)]] = False
    words[same] = 1
    pairs = mix64(words[:-1] * np.uint64(3) + words[1:])
    out.append((((words >> np.uint64(40)) & np.uint64(BUCKETS - 1)).astype(np.int32), first, 0))
    out.append((_void_ends((pairs >> np.uint64(40)) & np.uint64(BUCKETS - 1), first, 1), first, 1))
    return out


def _void_ends(hashed: np.ndarray, bounds: np.ndarray, short: int) -> np.ndarray:
    """Buckets of all places; the last `short` of a text reach into the next one and are void."""
    buckets = np.full(bounds[-1], BUCKETS, np.int32)
    buckets[: len(hashed)] = hashed
    for k in range(1, short + 1):
        at = bounds[1:] - k
        buckets[at[at >= bounds[:-1]]] = BUCKETS
    return buckets


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[k]:bounds[k + 1]], each added up alone, so that equal texts have equal sums."""
    out, some = np.zeros(len(bounds) - 1), np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(values, bounds[some])
    return out


@dataclass(frozen=True)
class QualityModel:
    """Vectors of the buckets, output layer and biases of the two labels, and the log odds that a text without features gets."""

    vectors: np.ndarray  # BUCKETS x DIM, float32
    output: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2

    @property
    def log_odds(self) -> np.ndarray:
        """What a bucket alone adds to the log odds of label 1 (the void one nothing): the mean of vectors goes through a linear layer, so the order of both doesn't matter."""
        return np.append((self.vectors.astype(np.float64) @ self.output) @ np.array([-1.0, 1.0]), 0.0)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct buckets of each text and their counts."""
    for batch in by_bytes(batches, "text", _SLICE):
        families = [(b, np.repeat(np.arange(batch.num_rows), np.diff(bounds))) for b, bounds, _ in features(*text_bytes(batch.column("text")))]
        bucket, text = (np.concatenate(x) for x in zip(*families, strict=True))
        both, counts = np.unique((text * BUCKETS + bucket)[bucket < BUCKETS], return_counts=True)
        ends = np.searchsorted(both, np.arange(batch.num_rows + 1) * BUCKETS)
        buckets, counts = (both % BUCKETS).astype("<i4"), counts.astype("<i4")
        columns = [binary_array(x.view(np.uint8), ends * 4) for x in (buckets, counts)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("h"), *columns], ["id", "label", "h", "buckets", "counts"])


def train_vectors(labels: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 0.5, seed: int = 7) -> QualityModel:
    """Stochastic gradient descent on the log loss, a text at a time. A step on the vectors is divided by the squared weights
    of the text's features, so that a text of any length moves its own mean by the same amount."""
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    output, bias = draw.normal(0, 0.3, (DIM, 2)), np.zeros(2)
    weights = [c / c.sum() for _, c in bags]
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for k in draw.permutation(len(bags)):
            pace, at, w = rate * (1 - done / steps), bags[k][0], weights[k]
            mean = w @ vectors[at]
            z = mean @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = output @ p
            output -= pace * np.outer(mean, p)
            bias -= pace * p
            vectors[at] -= pace * np.outer(w / (w @ w), back)
            done += 1
    return QualityModel(vectors.astype(np.float32), output, bias)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    labels, bags = [], []
    for b in batches:
        for label, buckets, counts in zip(*(b.column(c).to_pylist() for c in ("label", "buckets", "counts")), strict=True):
            if buckets:
                labels.append(label)
                bags.append((np.frombuffer(buckets, "<i4"), np.frombuffer(counts, "<i4").astype(np.float64)))
    if len(set(labels)) == 2:
        model = train_vectors(np.array(labels), bags)
        fields = (model.vectors.astype("<f4"), model.output.astype("<f8"), model.bias.astype("<f8"))
        shares = [labels.count(0), labels.count(1)]
        yield pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in fields), *(pa.array([n]) for n in shares)], ["vectors", "output", "bias", "n0", "n1"])


def fit_quality(docs: DataFrame, labels: DataFrame, label: Column, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> QualityModel:
    """The model from at most `sample` rows of labels of each label (0 or 1; others and null ids are left out), the first by a
    hash of the id. The sample holds both labels alike; the bias then follows their shares among all labelled rows. A label's
    id that several rows of docs have stands for the first by a hash of the text, one that none has for nothing. With fewer
    than two labels the model knows shares alone: (n1 + 1) / (n + 2).
    """
    small_batches(docs.sparkSession)
    rows = labels.select(F.col(id_col).alias("id"), label.cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [rows.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)]
    few = written(chosen[0].unionByName(chosen[1]), "quality-sample")  # at most 2 * sample ids
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few.distinct()), "id")
    bags = texts.withColumn("h", F.xxhash64("id", "text")).select("id", "label", "h", "text").mapInArrow(_bags, f"id {dict(few.dtypes)['id']}, label int, h long, buckets binary, counts binary")
    one = bags.groupBy("id", "label").agg(F.min(F.struct("h", "buckets", "counts")).alias("b")).select("id", "label", "b.*")
    found = one.repartition(1).sortWithinPartitions("h", "id", "label").select("label", "buckets", "counts").mapInArrow(_train, "vectors binary, output binary, bias binary, n0 long, n1 long").first()
    discard(few)
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    odds = float(np.log((n1 + 1) / (n0 + 1)))
    if found is None:
        return QualityModel(np.zeros((BUCKETS, DIM), np.float32), np.zeros((DIM, 2)), np.array([0.0, odds]))
    vectors = np.frombuffer(found["vectors"], "<f4").reshape(BUCKETS, DIM)
    bias = np.frombuffer(found["bias"], "<f8") + np.array([0.0, odds - np.log(found["n1"] / found["n0"])])
    return QualityModel(vectors, np.frombuffer(found["output"], "<f8").reshape(DIM, 2), bias)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score), a row per row of docs: the probability of label 1. Null, empty and blank texts get that of the bias alone.
    Null and repeated ids need no care, each row is judged alone; extra columns don't go on. An empty table gives no rows."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.log_odds, float(model.bias[1] - model.bias[0])))  # BUCKETS values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adds, bias = shared.value
        for batch in by_bytes(batches, "text", _SLICE):
            z, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for buckets, bounds, short in features(*text_bytes(batch.column("text"))):
                z += _sums(adds[buckets], bounds)
                n += np.maximum(np.diff(bounds) - short, 0)
            z = z / np.maximum(n, 1) + bias
            score = 0.5 * (1 + np.tanh(z / 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], [batch.schema.names[0], "score"])

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's text leaves 2 modulo 4; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
