"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of WINDOW words of the benchmark items; an item of fewer
words is one pattern. Patterns of one length make a class. In a class of length m,
a block is BLOCK consecutive words; the shift table gives for each block of the
patterns how far its last occurrence in a pattern is from the pattern's end, and
m - BLOCK + 1 for every other block. So a document is looked at only at every
(m - BLOCK + 1)th block: where that block is in no pattern, none of the windows
over it can match and all are skipped. Elsewhere the windows over it whose last
block has shift 0 are looked up in the bucket of that suffix block, and a direct
comparison of their words with the bucket's patterns confirms each occurrence.

The benchmark is compiled in blocks of at most BLOCK_BYTES of item text (one item at
least), each a file in the shared folder of about 60 times that size at most: sorted hash
arrays, and patterns as places in one byte buffer. A worker holds LOADED of them at a
time and every document meets every block, so a benchmark of any size takes bounded
memory, in the driver as well.

Null and empty texts have no words, hence no hits; a null item_id counts as ''. Items
that repeat count once. Rows are searched one by one, so rows that repeat an id or a text
get the same result each. A text longer than a slice is searched in pieces that overlap
by a window, so its working set is bounded too, but for its own bytes and hit words.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _files
from . import _text as T
from ._spark import new_path, replaced, table, written

WINDOW = 13
BLOCK = 3
BLOCK_BYTES = 1 << 20
#: Compiled blocks that a worker keeps.
LOADED = 4


@dataclass
class Patterns:
    """One length class. blocks: hashes, sorted, and their shifts; maybe: which low bits of a hash some block has.

    suffix: sorted hashes of the patterns' last blocks; pattern k is text[start[k] : end[k]], words joined by one
    space, and is in the items owners[owned[k] : owned[k + 1]].
    """

    length: int
    width: int
    blocks: np.ndarray
    shifts: np.ndarray
    maybe: np.ndarray
    suffix: np.ndarray
    start: np.ndarray
    end: np.ndarray
    owned: np.ndarray
    owners: np.ndarray

    def shift(self, block: np.ndarray) -> np.ndarray:
        """Of each block hash; length - width + 1 where no pattern has it."""
        out = np.full(len(block), self.length - self.width + 1)
        some = np.flatnonzero(self.maybe[(block & np.uint64(len(self.maybe) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.blocks, block[some]), len(self.blocks) - 1)
        hit = self.blocks[at] == block[some]
        out[some[hit]] = self.shifts[at[hit]]
        return out


@dataclass
class Compiled:
    """Patterns of some items: text is their words, each item's joined by one space."""

    items: list[str]
    text: bytes
    classes: list[Patterns]


def compile_patterns(items: list[tuple[str, bytes]], window: int = WINDOW) -> Compiled:
    raw = [t for _, t in items]
    s = T.Slice(0, len(raw), np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(t) for t in raw], dtype=np.int64)))
    w = T.words(s, T.ALNUM, lower=True)
    size = w.end - w.start
    end = np.cumsum(size + 1) - 1
    start = end - size
    buf = np.full(int(end[-1]) + 1 if len(end) else 0, 32, np.uint8)
    buf[T.ranges(start, size)] = T.LOWER[s.buf[T.ranges(w.start, size)]]
    text = buf.tobytes()
    h = T.HASH[0].ranges(buf, start, end)
    counts, row, classes = w.counts, w.row(), []
    for m in sorted({min(window, int(n)) for n in counts if n}):
        own = (counts >= m) if m == window else (counts == m)
        first = T.ranges(w.at[:-1][own], counts[own] - m + 1)
        known: dict[bytes, int] = {}
        number = np.fromiter((known.setdefault(text[a:b], len(known)) for a, b in zip(start[first].tolist(), end[first + m - 1].tolist())), np.int64, len(first))
        _, example = np.unique(number, return_index=True)
        places, width = first[example], min(BLOCK, m)  # one example of each pattern
        at = places[:, None] + np.arange(m - width + 1)
        block, far = T.HASH[1].windows(h, at.ravel(), width), np.tile(np.arange(m - width, -1, -1), len(places))
        order = np.lexsort((far, block))
        block, far = block[order], far[order]
        new = np.append(True, block[1:] != block[:-1])
        maybe = np.zeros(1 << max(12, int(8 * new.sum()).bit_length()), bool)
        maybe[(block[new] & np.uint64(len(maybe) - 1)).astype(np.int64)] = True
        suffix = T.HASH[1].windows(h, at[:, -1], width)
        pairs = np.unique(np.stack([number, row[first]], 1), axis=0)
        order = np.argsort(suffix, kind="stable")
        n = np.bincount(pairs[:, 0], minlength=len(places))
        begin = np.cumsum(n) - n
        owners = pairs[:, 1][T.ranges(begin[order], n[order])]
        classes.append(Patterns(m, width, block[new], far[new].astype(np.int8), maybe, suffix[order], start[places][order], end[places + m - 1][order], np.append(0, np.cumsum(n[order])), owners))
    return Compiled([name for name, _ in items], text, classes)


def search(s: T.Slice, w: T.Words, h: np.ndarray, p: Patterns, text: bytes) -> Iterator[tuple[int, int, int]]:
    """(row, first word, pattern) of each occurrence."""
    m, width = p.length, p.width
    step, counts = m - width + 1, w.counts
    sampled = np.maximum(counts - width + step, 0) // step  # block starts 0, step, 2 * step, ... in each row
    row = np.repeat(np.arange(s.rows), sampled)
    at = w.at[row] + (T.ranges(np.zeros(s.rows, np.int64), sampled)) * step
    found = np.flatnonzero(p.shift(T.HASH[1].windows(h, at, width)) < step)
    back = np.repeat(np.arange(step), len(found))
    first, r = np.tile(at[found], step) - back, np.tile(row[found], step)
    fits = (first >= w.at[r]) & (first + m <= w.at[r + 1])
    first, r = first[fits], r[fits]
    suffix = T.HASH[1].windows(h, first + (m - width), width)
    zero = np.flatnonzero(p.shift(suffix) == 0)
    low, high = np.searchsorted(p.suffix, suffix[zero]), np.searchsorted(p.suffix, suffix[zero], "right")
    for f, i, a, b in zip(first[zero].tolist(), r[zero].tolist(), low.tolist(), high.tolist()):
        if a < b:
            own = b" ".join(s.buf[x:y].tobytes() for x, y in zip(w.start[f : f + m].tolist(), w.end[f : f + m].tolist())).lower()
            for k in range(a, b):
                if text[p.start[k] : p.end[k]] == own:
                    yield i, f - int(w.at[i]), k


@lru_cache(LOADED)
def _load(uri: str) -> Compiled:
    fs, path = _files.at(uri)
    with fs.open_input_file(path) as f:
        return pickle.loads(f.read())


def pieces(s: T.Slice, size: int, window: int) -> Iterator[tuple[T.Slice, T.Words, int]]:
    """The slice, or a text longer than size in pieces that share window - 1 words: slice, words and number of the first word."""
    if s.rows > 1 or len(s.buf) <= size:
        yield s, T.words(s, T.ALNUM, lower=True), 0
        return
    at, word = 0, 0
    while True:
        end = min(len(s.buf), at + size)
        part = T.Slice(0, 1, s.buf[at:end], np.array([0, end - at]))
        w = T.words(part, T.ALNUM, lower=True)
        n = len(w.start)
        if end < len(s.buf) and n and w.end[-1] == end - at:  # it may go on
            n -= 1
        if end < len(s.buf) and n < window:  # words too long for pieces of this size
            size *= 2
            continue
        yield part, T.Words(w.start[:n], w.end[:n], np.array([0, n])), word
        if end == len(s.buf):
            return
        back = n - window + 1
        at, word = at + int(w.start[back]), word + back


def _find(texts, blocks: list[str], window: int, size: int = T.SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, list[str]]]:
    """Of each text its place, number of words, hit words and items."""
    for s in T.slices(texts, size):
        n_words, parts, items = np.zeros(s.rows, np.int64), defaultdict(list), defaultdict(set)
        for part, w, shift in pieces(s, size, window):
            h = T.HASH[0].ranges(part.buf, w.start, w.end, lower=True)
            n_words = np.maximum(n_words, shift + w.counts)
            for uri in blocks:
                block = _load(uri)
                for p in block.classes:
                    spans = defaultdict(list)
                    for i, f, k in search(part, w, h, p, block.text):
                        spans[i].append(f)
                        items[i].update(block.items[j] for j in p.owners[p.owned[k] : p.owned[k + 1]].tolist())
                    for i, f in spans.items():
                        parts[i].append(np.flatnonzero(T.covered(np.array(f), p.length, int(w.counts[i]))) + shift)
        for i in range(s.rows):
            yield s.first + i, int(n_words[i]), np.unique(np.concatenate(parts[i])) if i in parts else np.zeros(0, np.int64), sorted(items[i])


def _scan(batches: Iterator[pa.RecordBatch], blocks: list[str], window: int, size: int = T.SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first in range(0, len(b), 1000):
            own = b.slice(first, 1000)
            _, n_words, hit, items = zip(*_find(own.column("text"), blocks, window, size))
            yield pa.RecordBatch.from_arrays(
                [own.column("rest"), pa.array(n_words, pa.int64()), pa.array([len(x) for x in hit], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(hit, pa.list_(pa.int64()))],
                names=["rest", "n_words", "n_hit", "items", "hit_words"],
            )


def patterns(spark: SparkSession, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """Files of compiled patterns, each of at most about block_bytes of item texts (one item at least).

    The driver holds one block at a time.
    """
    sized = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, folder, out = -(-2 * total // block_bytes) or 1, new_path(spark, "op9-patterns"), []
    if n > 1:
        sized = written(sized, "op9-items")
    for k in range(n):
        rows = sized.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()
        out.append(f"{folder}/{k:06d}.patterns")
        with _files.Whole(out[-1]) as f:
            f.write(pickle.dumps(compile_patterns([(x.item, x.text.encode()) for x in rows], window)))
    return out


def matches(spark: SparkSession, texts: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """texts has a column text and others; result: rest, a struct of the others, n_words, n_hit, items and the places of the hit words."""
    blocks = patterns(spark, benchmark, window, block_bytes)
    packed = texts.select(F.struct(*[F.col(f"`{c}`") for c in texts.columns if c != "text"]).alias("rest"), "text")
    schema = f"rest {packed.schema['rest'].dataType.simpleString()}, n_words long, n_hit long, items array<string>, hit_words array<long>"
    return packed.mapInArrow(lambda batches: _scan(batches, blocks, window), schema)


CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def cut(text: bytes, hit: np.ndarray) -> bytes:
    """The text without its hit words and what stands between two of them."""
    s = T.Slice(0, 1, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    w = T.words(s, T.ALNUM, lower=True)
    first = hit[np.append(True, np.diff(hit) > 1)]
    last = hit[np.append(np.diff(hit) > 1, True)]
    edges = np.stack([np.append(0, w.end[last]), np.append(w.start[first], len(text))], 1)
    return b"".join(text[a:b] for a, b in edges.tolist())


def _clean(batches: Iterator[pa.RecordBatch], blocks: list[str], window: int) -> Iterator[pa.RecordBatch]:
    """doc, and its new text where it lost words; contaminated documents and those that lose every word go."""
    for b in batches:
        for first in range(0, len(b), 1000):
            own = b.slice(first, 1000)
            texts, stays, new = own.column("text"), np.ones(len(own), bool), [None] * len(own)
            for i, n_words, hit, _ in _find(texts, blocks, window):
                if not len(hit):
                    continue
                if 20 * len(hit) >= n_words:
                    stays[i] = False
                    continue
                text = texts[i].as_py().encode()
                while len(hit):  # what a cut joins may be a window again
                    text = cut(text, hit)
                    ((_, n_words, hit, _),) = _find(pa.array([text.decode()]), blocks, window)
                stays[i], new[i] = n_words > 0, text.decode()
            kept = pa.array(stays)
            yield pa.RecordBatch.from_arrays([own.column("doc").filter(kept), pa.array(new, pa.string()).filter(kept)], names=["doc", "new"])


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs in which no window of the benchmark occurs.

    Documents of which occurrences cover a twentieth or more go; others lose the hit words and
    what stands between them, and n_chars follows. Nulls and texts without a hit stay as they are.
    """
    blocks = patterns(spark, benchmark, window, block_bytes)
    packed = docs.select(F.struct("*").alias("doc"), F.col("text").cast("string").alias("text"))
    schema = f"doc {packed.schema['doc'].dataType.simpleString()}, new string"
    return packed.mapInArrow(lambda batches: _clean(batches, blocks, window), schema).select(replaced(docs, F.col("doc"), F.col("new")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return matches(spark, docs, table(spark, sf_dir, "benchmark")).select(
        "rest.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), F.expr(CONTAMINATED).alias("contaminated")
    )


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
pat AS (SELECT item_id, least(13, len(w)) AS m, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
pats AS (SELECT m, g, list(DISTINCT coalesce(item_id::VARCHAR, '')) AS items FROM pat GROUP BY m, g),
win AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS g FROM d, (SELECT DISTINCT m FROM pats) WHERE len(w) >= m),
occ AS (SELECT doc_id, i, win.m, items FROM win JOIN pats ON win.m = pats.m AND win.g = pats.g),
hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS k FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list_distinct(flatten(list(items)))) AS items FROM occ GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
