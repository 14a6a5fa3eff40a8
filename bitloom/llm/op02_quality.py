"""Quality by line labelling: a linear-chain conditional random field marks lines.

Each line with a word is a place of a sequence, described by binned counts (FEATURES).
The field has two labels, content and boilerplate, weights for every bin and label, and
weights for label pairs. Viterbi decoding labels a document's lines; a document is kept
if lines of content hold SHARE of its words or more, and it passes the base rules.

labels.quality marks documents, not lines. Training takes at most SAMPLE labelled
documents and SAMPLE_BYTES of text, those of the smallest hashes, with all their lines. Lines of
good documents are content. A line of a bad document is first labelled by the odds of its
bins in bad against good documents; the field is fitted to that by its likelihood (forward
and backward sums), labels the bad documents' lines anew, and is fitted again. Everything
else runs over all documents and whole texts.

Null and empty texts have no words: they fail the base rules. Where labels lack good or bad
documents no line is boilerplate. Rows that repeat a doc_id are judged each by its text. A
line's first of equal ones counts as no repeat; equal shares and scores go to content. A very
long text is judged whole, which takes some 25 times its size of memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._spark import sample as labelled
from ._spark import table

SHARE = 0.5
SAMPLE = 3000
SAMPLE_BYTES = 24 << 20
ROUNDS = 2
MIN_WORDS = 20
REPEAT_WIDTH = 8
REPEAT_PERCENT = 30

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122))
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
_BANG = np.arange(256) == 33
_CONTINUED = (np.arange(256) & 0xC0) == 0x80
#: Upper edges of the bins of each feature.
FEATURES = {
    "words": (1, 2, 5, 10, 20, 50),
    "symbols a word": (0.0, 0.1, 0.3, 0.6, 1.0),
    "upper case of letters": (0.02, 0.1, 0.3, 0.7),
    "different of words": (0.1, 0.2, 0.4, 0.6, 0.8),
    "exclamations a word": (0.0, 0.1, 0.3, 0.7),
    "digits a word": (0.0, 0.2, 1.0),
    "characters a word": (2.5, 4.0, 5.5, 7.0, 9.0),
    "short of words": (0.05, 0.15, 0.3, 0.5),
    "stops a word": (0.0, 0.02, 0.1, 0.3),
    "seen before": (0.0,),
    "ends with a stop": (0.0,),
}
BINS = [len(x) + 1 for x in FEATURES.values()]
_OFFSET = np.append(0, np.cumsum(BINS))


@dataclass
class Field:
    """weights: by bin, label; steps: by label, next label. Label 1 is boilerplate."""

    weights: np.ndarray
    steps: np.ndarray


NONE = Field(np.zeros((int(_OFFSET[-1]), 2)), np.zeros((2, 2)))
NONE.weights[:, 0] = 1.0


@dataclass
class Lines:
    """The lines with a word: row, words and feature bins of each; dup: equal to an earlier line of its row."""

    row: np.ndarray
    words: np.ndarray
    bins: np.ndarray
    dup: np.ndarray


def lines(s: T.Slice, w: T.Words, h: np.ndarray) -> Lines:
    breaks = np.flatnonzero(s.buf == 10)
    start = np.sort(np.concatenate([s.at[:-1], breaks + 1]))
    end = np.sort(np.concatenate([breaks, s.at[1:]]))
    first = np.searchsorted(w.start, start)
    n = np.searchsorted(w.start, end) - first
    some = n > 0
    whole_start = start  # of every line; between them only line ends stand, which nothing counts
    start, end, first, n = start[some], end[some], first[some], n[some]
    row = np.searchsorted(s.at, start, "right") - 1
    whole = T.HASH[0].ranges(s.buf, start, np.minimum(end, start + T.LONG_WORD))
    for i in np.flatnonzero(end - start > T.LONG_WORD):
        whole[i] = xxhash.xxh64_intdigest(s.buf[start[i] : end[i]], 1)
    order = np.lexsort((np.arange(len(row)), whole, row))
    dup = np.zeros(len(row), bool)
    dup[order[1:]] = (row[order[1:]] == row[order[:-1]]) & (whole[order[1:]] == whole[order[:-1]])

    def count(kind: np.ndarray) -> np.ndarray:
        """Bytes of a kind in each line with a word."""
        at = np.searchsorted(whole_start, start, "right") - 1
        inside = whole_start[whole_start < len(s.buf)]
        return np.add.reduceat(kind[s.buf], inside, dtype=np.int64)[at] if len(inside) and len(at) else np.zeros(len(at), np.int64)

    line = np.repeat(np.arange(len(n)), n)
    at = T.ranges(first, n)
    size = w.end[at] - w.start[at]
    pair = np.lexsort((h[at], line))
    fresh = np.ones(len(at), bool)
    fresh[1:] = (line[pair][1:] != line[pair][:-1]) | (h[at][pair][1:] != h[at][pair][:-1])
    different = np.bincount(line[pair][fresh], minlength=len(n))
    letters = count(_LETTER)
    values = [
        n,
        count(_SYMBOL) / n,
        count(_UPPER) / np.maximum(letters, 1),
        different / n,
        count(_BANG) / n,
        count(_DIGIT) / n,
        np.bincount(line, size, len(n)) / n,
        np.bincount(line, size <= 3, len(n)) / n,
        count(_STOP) / n,
        dup.astype(int),
        _STOP[s.buf[w.end[first + n - 1] - 1]].astype(int),
    ]
    bins = np.stack([np.searchsorted(edges, v, "left") + o for edges, v, o in zip(FEATURES.values(), values, _OFFSET)], 1) if len(n) else np.zeros((0, len(BINS)), np.int64)
    return Lines(row, n, bins, dup)


def repeated(w: T.Words, h: np.ndarray, width: int = REPEAT_WIDTH) -> np.ndarray:
    """Which words lie in a window of width words that their row holds twice or more."""
    at = T.window_starts(w, width)
    row = np.searchsorted(w.at, at, "right") - 1
    key = T.mix(T.HASH[1].windows(h, at, width) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return T.covered(at[twice], width, int(w.at[-1]))


def by_length(row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For t = 0, 1, ...: the places of the lines that are their row's t-th, and of the lines before them."""
    if not len(row):
        return
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    n = np.diff(np.append(first, len(row)))
    order = np.argsort(-n, kind="stable")
    first, n = first[order], n[order]
    for t in range(int(n[0])):
        at = first[: np.searchsorted(-n, -t, "left")] + t
        yield at, at - 1


def viterbi(row: np.ndarray, bins: np.ndarray, field: Field) -> np.ndarray:
    """The best labels of all rows' lines at once."""
    own = field.weights[bins].sum(1) if len(bins) else np.zeros((0, 2))
    best, back = own.copy(), np.zeros((len(row), 2), np.int8)
    steps = list(by_length(row))
    for at, before in steps[1:]:
        way = best[before][:, :, None] + field.steps
        back[at] = way.argmax(1)
        best[at] += way.max(1)
    label = best.argmax(1).astype(np.int8)
    for at, before in reversed(steps[1:]):
        label[before] = back[at, label[at]]
    return label


def _softmax(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def fit(row: np.ndarray, bins: np.ndarray, label: np.ndarray, rounds: int = 80, rate: float = 0.1, decay: float = 1e-4) -> Field:
    """Maximum likelihood by Adam on exact gradients."""
    field = Field(np.zeros((int(_OFFSET[-1]), 2)), np.zeros((2, 2)))
    steps, n = list(by_length(row)), len(row)
    rest = np.concatenate([at for at, _ in steps[1:]]) if len(steps) > 1 else np.zeros(0, np.int64)
    gold = np.zeros_like(field.weights)
    for k in range(bins.shape[1]):
        np.add.at(gold, (bins[:, k], label), 1)
    gold_steps = np.zeros((2, 2))
    np.add.at(gold_steps, (label[rest - 1], label[rest]), 1)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (field.weights, field.steps)]
    for i in range(1, rounds + 1):
        own = field.weights[bins].sum(1)
        ahead, behind = own.copy(), np.zeros_like(own)
        for at, before in steps[1:]:
            ahead[at] += _softmax(ahead[before][:, :, None] + field.steps, 1)
        for at, before in reversed(steps[1:]):
            behind[before] = _softmax(field.steps + (own[at] + behind[at])[:, None, :], 2)
        total = _softmax(ahead + behind, 1)
        p = np.exp(ahead + behind - total[:, None])
        pair = np.exp(ahead[rest - 1][:, :, None] + field.steps + (own[rest] + behind[rest])[:, None, :] - total[rest][:, None, None]).sum(0)
        expected = np.stack([np.bincount(bins.ravel(), np.repeat(p[:, c], bins.shape[1]), len(gold)) for c in (0, 1)], 1)
        for x, g, m in zip((field.weights, field.steps), ((gold - expected) / n - decay * field.weights, (gold_steps - pair) / n - decay * field.steps), moments):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            x += rate * (m[0] / (1 - 0.9**i)) / (np.sqrt(m[1] / (1 - 0.99**i)) + 1e-8)
    return field


def learn(row: np.ndarray, bins: np.ndarray, bad: np.ndarray) -> Field:
    """row, bins: lines of labelled documents; bad: by line, whether its document is."""
    if not bad.any() or bad.all():
        return NONE
    odds = [np.bincount(bins[bad == b].ravel(), minlength=int(_OFFSET[-1])) + 1.0 for b in (True, False)]
    per = [np.concatenate([x[a:b] / x[a:b].sum() for a, b in zip(_OFFSET, _OFFSET[1:])]) for x in odds]
    label = (bad & (np.log(per[0] / per[1])[bins].sum(1) > 0)).astype(np.int8)
    for k in range(ROUNDS):
        field = fit(row, bins, label)
        if k < ROUNDS - 1:
            label = (viterbi(row, bins, field) * bad).astype(np.int8)
    return field


def _prepared(s: T.Slice) -> tuple[T.Words, np.ndarray, Lines]:
    w = T.words(s)
    h = T.HASH[0].ranges(s.buf, w.start, w.end)
    return w, h, lines(s, w, h)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in T.slices(b.column("text")):
            _, _, found = _prepared(s)
            n = np.bincount(found.row, minlength=s.rows)
            flat = found.bins.astype(np.uint8).tobytes()
            at = np.append(0, np.cumsum(n)) * len(BINS)
            yield pa.RecordBatch.from_arrays([b.column("bad").slice(s.first, s.rows), pa.array([flat[x:y] for x, y in zip(at, at[1:])], pa.binary())], names=["bad", "bins"])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") == 0).alias("bad"))
    rows = labelled(docs, known, "bad", sample, SAMPLE_BYTES).mapInArrow(_features, "bad boolean, bins binary").toArrow()
    flat = [np.frombuffer(x, np.uint8).reshape(-1, len(BINS)) for x in rows.column("bins").to_pylist()]
    n = [len(x) for x in flat]
    if not sum(n):
        return NONE
    return learn(np.repeat(np.arange(len(n)), n), np.concatenate(flat).astype(np.int64), np.repeat(rows.column("bad").to_numpy(), n))


def _judge(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in T.slices(b.column("text")):
            w, h, found = _prepared(s)
            n = w.counts
            size = np.bincount(w.row(), w.end - w.start, s.rows).astype(np.int64)
            inner = np.zeros(len(s.buf) + 1, np.int64)
            np.cumsum(_CONTINUED[s.buf], out=inner[1:])
            symbols = np.zeros(len(s.buf) + 1, np.int64)
            np.cumsum(_SYMBOL[s.buf], out=symbols[1:])
            repeats = T.sums(repeated(w, h), w.at)
            label = viterbi(found.row, found.bins, field)
            share = np.bincount(found.row, found.words * (label == 0), s.rows) / np.maximum(n, 1)
            failed = (n < MIN_WORDS) | (100 * repeats > REPEAT_PERCENT * n)
            out = {
                "n_words": n,
                "word_chars": size - (inner[s.at[1:]] - inner[s.at[:-1]]),
                "n_symbols": symbols[s.at[1:]] - symbols[s.at[:-1]],
                "n_dup_lines": np.bincount(found.row, found.dup, s.rows).astype(np.int64),
                "n_repeat_words": repeats,
                "base_failed": failed,
                "kept": ~failed & (share >= SHARE),
                "content_share": share,
            }
            rest = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c).slice(s.first, s.rows) for c in rest), *(pa.array(x) for x in out.values())], names=[*rest, *out])


VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def judge(texts: DataFrame, field: Field) -> DataFrame:
    """texts: a column text and others; result: rest, a struct of the others, and the columns of VERDICT."""
    packed = texts.select(F.struct(*[F.col(f"`{c}`") for c in texts.columns if c != "text"]).alias("rest"), F.col("text").cast("string").alias("text"))
    return packed.mapInArrow(lambda batches: _judge(batches, field), f"rest {packed.schema['rest'].dataType.simpleString()}, {VERDICT}")


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the base rules or the line labels reject."""
    field = train(spark, docs, labels)
    return judge(docs.select(F.struct("*").alias("doc"), "text"), field).where("kept").select("rest.doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return judge(docs, train(spark, docs, table(spark, sf_dir, "labels"))).select("rest.doc_id", *(c.split()[0] for c in VERDICT.split(", ")))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the base rules count, of every document, without the field's verdict."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return judge(docs, NONE).select("rest.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


SQL_COUNTS = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, line),
dup AS (SELECT doc_id, sum(n - 1) AS n FROM lines GROUP BY doc_id),
win AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM d WHERE len(w) >= 8),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS k FROM twice) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(w) < 20 OR 100 * coalesce(rep.n, 0) > 30 * len(w) AS base_failed
FROM d LEFT JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN rep ON d.doc_id = rep.doc_id
"""
