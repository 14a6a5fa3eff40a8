"""Substring dedup by recompression.

Every text is parsed bottom-up. The first round replaces runs of one word (RUNS), and
each round pairs, up to a span of words (CAPS), whose left symbol is of the round's left class and whose right symbol is
of its right class, by new symbols. A new symbol's name is a 64-bit hash of what
it replaces, and classes are bits of names: names are global with no shuffle, so
equal substrings get equal symbols, up to some at either end. Each symbol keeps
the span of words that its existence depends on; it is *safe* in a window that
holds this span, since equal windows then hold equal symbols at equal places.

1. One pass over the texts parses them and writes the safe top symbols by document.
2. Symbols of at least two different texts are shared (partial aggregation by name).
3. A window of WIDTH words may repeat only if all its safe symbols are shared. Only
   such windows are verified: a 128-bit hash of their words, the smallest doc_id by
   hash, and a join that gives each its verdict.

Copies of a whole text are represented by their smallest doc_id throughout, so a
large group of copies costs one document. Nothing is sampled or capped: windows
without a safe symbol are verified too.

Nulls, empty texts and texts of fewer than WIDTH words lose nothing. A null doc_id
is neither smaller nor larger than another. Rows that share a doc_id are one
document each; their words are judged against other doc_ids only. A very long text is
parsed whole, which takes some 25 times its size of memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._spark import drop, replaced, table, text_key, written

WIDTH = 50
#: Words that a pair may span, by round; repeated runs are folded in the rounds of RUNS.
CAPS = (12,) * 8
RUNS = (0,)
_FAR = 1 << 40


def parse(names: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top symbols of rows of words: names, and the spans [lo, hi) of words that they depend on."""
    n = len(names)
    x, s, e = names, np.arange(n), np.arange(1, n + 1)
    lo, hi = s.copy(), e.copy()
    first = np.zeros(n + 1, bool)
    first[at[:-1][at[:-1] < at[1:]]] = True
    first[n] = True
    for k, cap in enumerate(CAPS):
        if len(x) < 2:
            break
        if k in RUNS:
            joined = np.zeros(len(x) + 1, bool)  # with the symbol before
            joined[1:-1] = (x[1:] == x[:-1]) & ~first[1:-1]
            head = np.flatnonzero(~joined[:-1])
            tail = np.append(head[1:], len(x)) - 1
            before, after = np.maximum(head - 1, 0), np.minimum(tail + 1, len(x) - 1)
            low = np.where(first[head], -_FAR, np.minimum(lo[before], lo[head]))
            high = np.where(first[tail + 1], _FAR, np.maximum(hi[after], hi[tail]))
            size = (tail - head + 1).astype(np.uint64)
            x = np.where(size > 1, T.mix(x[head] + size * np.uint64(0xA24BAED4963EE407)), x[head])
            s, e, lo, hi = s[head], e[tail], low, high
            first = np.append(first[head], True)
        left = (T.mix(x ^ np.uint64(0x9FB21C651E98DF25 * (k + 1) & (1 << 64) - 1)) >> np.uint64(17)) & np.uint64(1) == 0
        size = e - s
        last = first[1:]
        pair = np.zeros(len(x), bool)
        pair[:-1] = left[:-1] & ~left[1:] & ~last[:-1] & (size[:-1] + size[1:] <= cap)
        second = np.append(False, pair[:-1])
        open_ = size < cap  # else it pairs with nothing, whatever stands beside it
        next_hi = np.where(last, _FAR, np.append(hi[1:], 0))
        back_lo = np.where(first[:-1], -_FAR, np.append(0, lo[:-1]))
        hi = np.where(left & open_, np.maximum(hi, next_hi), hi)
        lo = np.where(~left & open_, np.minimum(lo, back_lo), lo)
        i = np.flatnonzero(pair)
        x, e, lo = x.copy(), e.copy(), lo.copy()
        x[i] = T.mix(x[i] * np.uint64(0xD6E8FEB86659FD93) + (x[i + 1] ^ np.uint64(0xA0761D6478BD642F)))
        e[i], lo[i], hi[i] = e[i + 1], np.minimum(lo[i], lo[i + 1]), np.maximum(hi[i], hi[i + 1])
        kept = ~second
        x, s, e, lo, hi, first = x[kept], s[kept], e[kept], lo[kept], hi[kept], np.append(first[:-1][kept], True)
    return x, lo, hi


def _free(lo: np.ndarray, hi: np.ndarray, w: T.Words, width: int) -> np.ndarray:
    """The windows that hold none of the spans."""
    n = int(w.at[-1])
    fits = hi - lo <= width
    from_ = np.maximum(hi[fits] - width, 0)
    held = T.covered(from_, lo[fits] + 1 - from_, n)
    starts = T.window_starts(w, width)
    return starts[~held[starts]]


def _facts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in T.slices(b.column("text")):
            w = T.words(s)
            x, lo, hi = parse(T.HASH[0].ranges(s.buf, w.start, w.end), w.at)
            loose = _free(lo, hi, w, width)
            loose_rows = np.bincount(np.searchsorted(w.at, loose, "right") - 1, minlength=s.rows) > 0
            safe = hi - lo <= width
            x, row = x[safe], np.searchsorted(w.at, lo[safe], "right") - 1
            order = np.lexsort((x, row))
            x, row = x[order], row[order]
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
            at = np.searchsorted(row[new], np.arange(s.rows + 1))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(s.first, s.rows), b.column("tk").slice(s.first, s.rows), pa.array(w.counts, pa.int64()), pa.array([hashlib.sha256(b" ".join(T.word_list(s.text(i)))).hexdigest() for i in range(s.rows)]), pa.array(loose_rows), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x[new].view(np.int64)))],
                names=["doc_id", "tk", "n_words", "whole", "loose", "symbols"],
            )


def _windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        marks_at, marks = _lists(b.column("shared"))
        part = np.array([int.from_bytes(k[:3], "big") for k in b.column("tk").to_pylist()], np.int64) << 32
        for s in T.slices(b.column("text")):
            w = T.words(s)
            names = T.HASH[0].ranges(s.buf, w.start, w.end)
            x, lo, hi = parse(names, w.at)
            safe = hi - lo <= width
            x, lo, hi = x[safe], lo[safe], hi[safe]
            row = np.searchsorted(w.at, lo, "right") - 1
            # a symbol counts as shared in its row only
            own = slice(marks_at[s.first], marks_at[s.first + s.rows])
            of = np.repeat(np.arange(s.rows), np.diff(marks_at[s.first : s.first + s.rows + 1]))
            unshared = ~np.isin(T.mix(x + row.astype(np.uint64)), T.mix(marks[own] + of.astype(np.uint64)))
            starts = _free(lo[unshared], hi[unshared], w, width)
            r = np.searchsorted(w.at, starts, "right") - 1
            second = T.HASH[1].ranges(s.buf, w.start, w.end)
            place = part[s.first + r] + (starts - w.at[r])
            yield pa.RecordBatch.from_arrays(
                [pa.array(T.HASH[1].windows(names, starts, width).view(np.int64)), pa.array(T.HASH[0].windows(second, starts, width).view(np.int64)), b.column("doc_id").take(pa.array(r + s.first)), pa.array(place, pa.int64())],
                names=["a", "b", "doc_id", "place"],
            )


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and values, as unsigned, of a list column; nulls are empty."""
    column = pa.concat_arrays([column])
    counts = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.append(0, np.cumsum(counts)), np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64)


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The other columns, the words removed, and what is left; null where nothing is."""
    for b in batches:
        rest = [c for c in b.schema.names if c not in ("text", "starts")]
        texts, starts = b.column("text"), b.column("starts")
        kept, removed = [], []
        for i in range(len(b)):
            if not starts[i].is_valid:
                kept.append(None)
                removed.append(0)
                continue
            words = T.word_list((texts[i].as_py() or "").encode())
            gone = T.covered(np.asarray(starts[i].values.to_numpy(), np.int64), width, len(words))
            kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode())
            removed.append(int(gone.sum()))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*rest, "n_removed", "kept"])


def part_of(tk: Column) -> Column:
    """Tells texts under one doc_id apart: the first 24 bits of their key."""
    return F.conv(F.substring(F.hex(tk), 1, 6), 16, 10).cast("long")


def repeats(spark: SparkSession, docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts by row (doc_id, tk, n_words, whole); by text key the smallest doc_id (tk, rep);
    and for the representatives that lose words, where lost windows start (doc_id, tk, starts).

    Each table is deleted as soon as no later step reads it.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("tk"))
    facts = written(
        texts.mapInArrow(lambda batches: _facts(batches, width), "doc_id long, tk binary, n_words long, whole string, loose boolean, symbols array<long>"),
        "op10-facts",
    )
    parsed = facts
    known = parsed.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= width))
    reps = written(known.groupBy("tk").agg(F.min("doc_id").alias("rep"), F.first("loose").alias("loose"), F.first("symbols").alias("symbols")), "op10-reps")
    facts = written(parsed.drop("symbols", "loose"), "op10-facts")
    drop(parsed)
    owners = written(reps.select("tk", "rep"), "op10-owners")
    at = reps.select(F.col("rep").alias("doc_id"), F.explode("symbols").alias("symbol"))
    # a doc_id with two texts holds a symbol twice; that only adds windows to verify
    shared = at.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("symbol")
    marks = at.join(shared, "symbol", "left_semi").groupBy("doc_id").agg(F.collect_list("symbol").alias("shared"))
    wanted = reps.select(F.col("rep").alias("doc_id"), "tk", "loose").join(marks, "doc_id", "left").where("loose or shared is not null").select("doc_id", "tk", "shared")
    windows = written(
        texts.join(wanted, ["doc_id", "tk"]).select("doc_id", "tk", "text", "shared").mapInArrow(lambda batches: _windows(batches, width), "a long, b long, doc_id long, place long"),
        "op10-windows",
    )
    drop(reps)
    firsts = written(windows.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("a", "b", "first"), "op10-firsts")
    place = F.col("place")
    gone = windows.join(firsts, ["a", "b"]).where("first < doc_id").groupBy("doc_id", F.shiftright(place, 32).alias("part")).agg(F.collect_set(place.bitwiseAND(0xFFFFFFFF)).alias("starts"))
    own = owners.select(F.col("rep").alias("doc_id"), "tk", part_of(F.col("tk")).alias("part")).join(gone, ["doc_id", "part"]).select("doc_id", "tk", "starts")
    losses = written(own, "op10-losses")
    for done in (windows, firsts):
        drop(done)
    return facts, owners, losses


def dedup(spark: SparkSession, docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with the words that remain, joined by one space, as the text of each document that loses
    some, and n_chars to match; documents that lose every word go, all others are as they were.
    """
    facts, reps, losses = repeats(spark, docs, width)
    copies = facts.join(reps, "tk").where("rep < doc_id").select("doc_id", "tk", F.lit(None).cast("array<long>").alias("starts"), F.lit(True).alias("copy")).distinct()
    changes = losses.withColumn("copy", F.lit(False)).unionByName(copies)
    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("tk"))
    found = keyed.join(changes, ["doc_id", "tk"], "left").where("copy is null or not copy").select("doc", "doc.text", "starts")
    schema = f"doc {keyed.schema['doc'].dataType.simpleString()}, n_removed long, kept string"
    rest = found.mapInArrow(lambda batches: _cut(batches, width), schema).where("kept is null or kept <> ''")
    return rest.select(replaced(docs, F.col("doc"), F.col("kept")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    facts, reps, losses = repeats(spark, docs)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("tk"), "text")
    cut = keyed.join(losses, ["doc_id", "tk"]).mapInArrow(lambda batches: _cut(batches, WIDTH), "doc_id long, tk binary, n_removed long, kept string")
    left = cut.select("doc_id", "tk", F.col("n_removed").alias("lost"), F.sha2("kept", 256).alias("left_sha")).dropDuplicates(["doc_id", "tk"])
    copy, none = F.col("rep") < F.col("doc_id"), hashlib.sha256(b"").hexdigest()
    return (
        facts.join(reps, "tk", "left")
        .join(left, ["doc_id", "tk"], "left")
        .select(
            "doc_id",
            "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("lost", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy, F.lit(none)).otherwise(F.coalesce("left_sha", "whole")).alias("kept_sha256"),
        )
    )


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS h FROM d WHERE len(w) >= 50),
firsts AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM win JOIN firsts USING (h) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d WHERE doc_id IN (SELECT doc_id FROM gone)),
left_ AS (SELECT doc_id, coalesce(string_agg(x, ' ' ORDER BY k) FILTER (gone.k IS NULL), '') AS t, count(gone.k) AS n FROM words LEFT JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE t END) AS kept_sha256 FROM d LEFT JOIN left_ ON d.doc_id = left_.doc_id
"""
