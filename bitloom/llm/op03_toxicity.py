"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is the logistic of a bias and the
weights of its features: its words and their beginnings of PREFIXES bytes, hashed into
BUCKETS. A document's score combines its sentences by noisy-or: 1 - product of
(1 - sentence score). Weights are not negative, so nothing excuses a sentence. Only
document labels train it: the likelihood's gradient reaches each sentence in proportion
to its share in the document's score, so the weights come to mark the sentences that
offend, which locate() returns.

Training takes at most SAMPLE labelled documents and SAMPLE_BYTES of text, those of the smallest hashes; only rows
whose crc32(doc_id as text) mod FOLDS is not HELD_OUT. The FEATURES buckets that tell toxic
from other sampled documents best (by chi-square over document counts, which executors add
up) may have a weight. Scoring covers every sentence of every whole text. A score depends on
the text alone, so rows that repeat an id or a text are scored alike. A document without a word
(null, empty) is scored as one empty sentence. Without labels of both kinds every score is 0.
Equal chi-squares go by bucket. A very long text is scored whole, which takes some 25 times its
size of memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._spark import sample as labelled
from ._spark import table, written

BUCKETS = 1 << 20
PREFIXES = (5, 6, 7, 8, 9)
SAMPLE = 20000
SAMPLE_BYTES = 64 << 20
FEATURES = 4096
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: A feature needs so many toxic documents of the sample.
LEAST_DOCUMENTS = 3
OFFENDING = 0.5

_ENDS = np.isin(np.arange(256), np.frombuffer(b".!?\n", np.uint8))


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def sentences(s: T.Slice) -> tuple[T.Words, np.ndarray, np.ndarray]:
    """Words; the buckets of each, a row a kind of feature; and where, among the words, sentences begin.

    A word that has no longer part than a prefix has bucket BUCKETS, which is none, for it.
    """
    w = T.words(s, T.ALNUM, lower=True)
    mask = np.uint64(BUCKETS - 1)
    size = w.end - w.start
    bucket = np.full((1 + len(PREFIXES), len(size)), BUCKETS, np.int32)
    bucket[0] = (T.HASH[0].ranges(s.buf, w.start, w.end, lower=True) & mask).astype(np.int32)
    for k, n in enumerate(PREFIXES, 1):
        long = np.flatnonzero(size > n)
        bucket[k, long] = (T.HASH[1].ranges(s.buf, w.start[long], w.start[long] + n, lower=True) & mask).astype(np.int32)
    ends = np.zeros(len(s.buf) + 1, np.int64)
    np.cumsum(_ENDS[s.buf], out=ends[1:])
    number = ends[w.start] + w.row()
    new = np.ones(len(number), bool)
    new[1:] = number[1:] != number[:-1]
    return w, bucket, np.flatnonzero(new)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def chosen(bucket: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, most: int = FEATURES) -> np.ndarray:
    """The buckets, sorted, that speak for toxic documents most by chi-square; toxic and clean: documents that have each."""
    a, c = toxic.astype(float), clean.astype(float)
    b, d = n_toxic - a, n_clean - c
    chi = (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1e-9)
    chi[(a * d <= b * c) | (a < LEAST_DOCUMENTS)] = 0
    best = np.lexsort((bucket, -chi))[:most]
    return np.sort(bucket[best[chi[best] > 0]])


def fit(column: np.ndarray, sentence: np.ndarray, bag: np.ndarray, toxic: np.ndarray, features: int, rounds: int = 200, rate: float = 0.2, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """column, sentence: each occurrence of a feature; bag: the document of each sentence; toxic: by document.

    Weights, not negative, and the bias, by projected Adam on the exact gradient of the noisy-or likelihood.
    """
    n, positive = len(toxic), toxic == 1
    w, b = np.full(features, 0.5), -6.0
    m, v = np.zeros(features + 1), np.zeros(features + 1)
    for i in range(1, rounds + 1):
        z = b + np.bincount(sentence, w[column], len(bag))
        total = np.bincount(bag, _softplus(z), n)  # -log of the chance that no sentence offends
        clean = np.exp(-total)
        pull = np.where(positive, -clean / np.maximum(1 - clean, 1e-9), 1.0)
        g = pull[bag] * np.exp(-_softplus(-z))
        grad = np.append(np.bincount(column, g[sentence], features), g.sum()) / n + decay * np.append(w, 0)
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        step = rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        w, b = np.maximum(w - step[:-1], 0), b - step[-1]
    return w, float(b)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by bucket; bucket BUCKETS: all documents. A task holds two counters a bucket."""
    seen = np.zeros((2, BUCKETS + 1), np.int32)
    for b in batches:
        for s in T.slices(b.column("text")):
            toxic = b.column("toxic").slice(s.first, s.rows).to_numpy()
            w, bucket, _ = sentences(s)
            row = np.tile(w.row(), len(bucket))
            own = np.unique(row * (BUCKETS + 1) + bucket.ravel())
            row, bucket = own // (BUCKETS + 1), own % (BUCKETS + 1)
            real = bucket < BUCKETS
            for k in (0, 1):
                seen[k] += np.bincount(bucket[real & (toxic[row] == k)], minlength=BUCKETS + 1).astype(np.int32)
                seen[k, BUCKETS] += (toxic == k).sum()
    some = np.flatnonzero(seen.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[1, some], pa.int64()), pa.array(seen[0, some], pa.int64())], names=["bucket", "toxic", "clean"])


def _bags(batches: Iterator[pa.RecordBatch], features) -> Iterator[pa.RecordBatch]:
    """Of each document its number of sentences, and its occurrences of features: sentence and feature."""
    place = np.full(BUCKETS + 1, -1, np.int32)
    place[features.value] = np.arange(len(features.value))
    for b in batches:
        for s in T.slices(b.column("text")):
            w, bucket, start = sentences(s)
            of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(bucket[0]))))
            first = np.searchsorted(start, w.at)  # first sentence of each row
            k, at = np.nonzero(place[bucket] >= 0)
            order = np.argsort(at, kind="stable")
            k, at = k[order], at[order]
            row = np.searchsorted(w.at, at, "right") - 1
            pairs = np.stack([of[at] - first[row], place[bucket[k, at]]], 1).astype(np.int32)
            edge = np.searchsorted(row, np.arange(s.rows + 1))
            out = [pairs[x:y].tobytes() for x, y in zip(edge, edge[1:])]
            yield pa.RecordBatch.from_arrays([b.column("toxic").slice(s.first, s.rows), pa.array(np.maximum(np.diff(first), 1), pa.int64()), pa.array(out, pa.binary())], names=["toxic", "sentences", "pairs"])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    none = Model(np.zeros(BUCKETS + 1), -np.inf)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    rows = written(labelled(docs, known, "toxic", sample, SAMPLE_BYTES), "op3-sample")
    counts = rows.mapInArrow(_counts, "bucket long, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = counts.where(f"bucket = {BUCKETS} or toxic >= {LEAST_DOCUMENTS}").toArrow()
    bucket, toxic, clean = (counts.column(c).to_numpy() for c in ("bucket", "toxic", "clean"))
    every = bucket == BUCKETS
    if not every.any() or not toxic[every][0] or not clean[every][0]:
        return none
    used = chosen(bucket[~every], toxic[~every], clean[~every], toxic[every][0], clean[every][0])
    given = spark.sparkContext.broadcast(used)
    bags = rows.mapInArrow(lambda batches: _bags(batches, given), "toxic int, sentences long, pairs binary").toArrow()
    n = bags.column("sentences").to_numpy()
    pairs = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in bags.column("pairs").to_pylist()]
    shift = np.repeat(np.cumsum(n) - n, [len(x) for x in pairs])
    flat = np.concatenate([*pairs, np.zeros((0, 2), np.int32)]).astype(np.int64)
    w, bias = fit(flat[:, 1], flat[:, 0] + shift, np.repeat(np.arange(len(n)), n), bags.column("toxic").to_numpy(), len(used))
    weights = np.zeros(BUCKETS + 1)
    weights[used] = w
    return Model(weights, bias)


def _score(batches: Iterator[pa.RecordBatch], model, spans: bool) -> Iterator[pa.RecordBatch]:
    weights, bias = model.value.weights, model.value.bias
    for b in batches:
        for s in T.slices(b.column("text")):
            w, bucket, start = sentences(s)
            z = bias + (np.add.reduceat(weights[bucket].sum(0), start) if len(start) else np.zeros(0))
            row = np.searchsorted(w.at, start, "right") - 1
            total = np.bincount(row, _softplus(z), s.rows) + np.where(w.counts == 0, _softplus(np.float64(bias)), 0.0)
            rest = [c for c in b.schema.names if c != "text"]
            columns = [*(b.column(c).slice(s.first, s.rows) for c in rest), pa.array(-np.expm1(-total))]
            if spans:
                p = np.exp(-_softplus(-z))
                bad, end = np.flatnonzero(p >= OFFENDING), np.append(start[1:], len(bucket[0]))
                at = np.searchsorted(row[bad], np.arange(s.rows + 1))
                texts = [s.buf[w.start[x] : w.end[y - 1]].tobytes().decode() for x, y in zip(start[bad], end[bad])]
                found = pa.StructArray.from_arrays([pa.array(w.start[start[bad]] - s.at[row[bad]]), pa.array(texts, pa.string()), pa.array(p[bad])], names=["byte", "text", "score"])
                columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), found))
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, "score", *["sentences"] * spans])


def score(spark: SparkSession, texts: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """texts: a column text and others; result: rest, a struct of the others, score, and with spans the offending
    sentences: array of (byte, text, score), byte being where its first word begins in the text's UTF-8.
    """
    given = spark.sparkContext.broadcast(model)  # BUCKETS weights, whatever the input
    packed = texts.select(F.struct(*[F.col(f"`{c}`") for c in texts.columns if c != "text"]).alias("rest"), F.col("text").cast("string").alias("text"))
    more = ", sentences array<struct<byte:long,text:string,score:double>>" if spans else ""
    return packed.mapInArrow(lambda batches: _score(batches, given, spans), f"rest {packed.schema['rest'].dataType.simpleString()}, score double{more}")


def locate(spark: SparkSession, texts: DataFrame, model: Model) -> DataFrame:
    """A row for each sentence that offends: rest, a struct of the columns of texts but text, and byte, sentence and sentence_score."""
    each = score(spark, texts, model, spans=True).select("rest", F.explode("sentences").alias("s"))
    return each.select("rest", F.col("s.byte").alias("byte"), F.col("s.text").alias("sentence"), F.col("s.score").alias("sentence_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(spark, docs, table(spark, sf_dir, "labels"))
    return score(spark, docs, model).select("rest.doc_id", held_out(F.col("rest.doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
