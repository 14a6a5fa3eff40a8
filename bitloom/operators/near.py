"""Near pairs of trigram sets, by blocks of units in files that executors share.

One narrow pass encodes units: blocks hold the different trigrams of a few thousand units as
numbers into the block's own list of trigrams, and their MinHash bands. A task takes two blocks,
finds pairs that share a band and counts their common trigrams. Nothing is shuffled but keys and
pairs, so disk grows with the units and the pairs found, not with the candidates; the comparisons
of blocks grow as the square of the corpus, and a task holds two blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import minhash
from ..scratch import new_path, written

#: Units and trigrams of both sides in a block, at most; a unit of more trigrams is a block of its own.
UNITS, TRIGRAMS = 1 << 13, 1 << 23
#: Units of a block that are compared with another block at once, and trigrams counted at once.
STRIP, COUNTED = 1 << 8, 1 << 21


def _ragged(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.zeros(len(xs) + 1, np.int64)
    np.cumsum([len(x) for x in xs], out=ends[1:])
    return ends, np.concatenate(xs) if xs else np.zeros(0, np.int64)


def _save(path: str, words: np.ndarray, ordinals: np.ndarray, bands: np.ndarray, s: tuple, t: tuple) -> None:
    fs, at = pafs.FileSystem.from_uri(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))) for ends, ids in (s, t)]
    table = pa.table([pa.array(ordinals), pa.FixedSizeListArray.from_arrays(pa.array(bands.reshape(-1)), bands.shape[1]), *lists], ["ordinal", "bands", "s", "t"])
    packed = {f"{c}.list.element": "DELTA_BINARY_PACKED" for c in "st"}
    pq.write_table(table, at, filesystem=fs, compression="zstd", use_dictionary=False, column_encoding=packed, write_statistics=False)
    pq.write_table(pa.table([pa.array(words)], ["word"]), f"{at}.words", filesystem=fs, compression="zstd", use_dictionary=False, write_statistics=False)


def _load(path: str) -> tuple:
    fs, at = pafs.FileSystem.from_uri(path)
    table = pq.read_table(at, filesystem=fs).combine_chunks()
    words = pq.read_table(f"{at}.words", filesystem=fs).column(0).to_numpy()
    ordinals = table.column("ordinal").to_numpy()
    flat = lambda c: table.column(c).combine_chunks()
    bands = flat("bands").flatten().to_numpy().reshape(len(ordinals), -1)
    return words, ordinals, bands, *((flat(c).offsets.to_numpy().astype(np.int64), flat(c).values.to_numpy()) for c in "st")


def _encode(batches: Iterator[pa.RecordBatch], folder: str, rows: int) -> Iterator[pa.RecordBatch]:
    """(ordinal, k, s, t) to block files, and (block, place, ordinal, k)."""
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, size
        path = f"{folder}/{uuid.uuid4().hex}"
        words, sides = np.zeros(0, np.int64), []
        s, t = (_ragged([x[c] for x in held]) for c in (2, 3))
        words = np.unique(np.concatenate([s[1], t[1]]))
        sides = [(ends, np.searchsorted(words, codes)) for ends, codes in (s, t)]
        _save(path, words, np.array([x[0] for x in held], np.int64), np.stack([x[4] for x in held]), *sides)
        out = pa.RecordBatch.from_arrays([pa.array([path] * len(held)), pa.array(range(len(held)), pa.int32()), pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.binary())], names=["block", "place", "ordinal", "k"])
        held, size = [], 0
        return out

    for b in batches:
        for ordinal, k, source, target in zip(*b.columns):
            s, t = minhash.trigram_codes(source.as_py()), minhash.trigram_codes(target.as_py())
            if held and (len(held) >= UNITS or size + len(s) + len(t) > TRIGRAMS):
                yield flush()
            held.append((ordinal.as_py(), k.as_py(), s, t, minhash.bands_of(s, rows)))
            size += len(s) + len(t)
    if held:
        yield flush()


def _kept(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """(block, places): blocks of those units alone, as files; their paths."""
    for b in batches:
        for path, places in zip(*b.columns):
            words, ordinals, bands, s, t = _load(path.as_py())
            keep = np.sort(np.array(places.as_py(), np.int64))
            of = lambda side: _ragged([side[1][side[0][x] : side[0][x + 1]] for x in keep])  # noqa: B023, E731
            out = f"{folder}/{uuid.uuid4().hex}"
            _save(out, words, ordinals[keep], bands[keep], of(s), of(t))
            yield pa.RecordBatch.from_arrays([pa.array([out])], names=["path"])


def _shared(flags: np.ndarray, side: tuple, others: np.ndarray) -> np.ndarray:
    """For each of the others, how many of its trigrams are flagged."""
    ends, ids = side
    out = np.zeros(len(others), np.int64)
    lens = ends[others + 1] - ends[others]
    upto = np.cumsum(lens)
    at = 0
    while at < len(others):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + COUNTED, "right")))
        n = lens[at:to]
        first = np.cumsum(n) - n
        out[at:to] = np.add.reduceat(flags[ids[np.arange(n.sum()) + np.repeat(ends[others[at:to]] - first, n)]], first, dtype=np.int64)
        at = to
    return out


def _compare(one: tuple, two: tuple, same: bool, threshold: float) -> Iterator[tuple]:
    words, a_ordinals, a_bands, *a_sides = one
    other_words, b_ordinals, b_bands, *b_sides = two
    if not same:
        place = np.searchsorted(words, other_words)
        known = place < len(words)
        known[known] = words[place[known]] == other_words[known]
        as_ours = np.where(known, place, len(words)).astype(np.int32)
        b_sides = [(ends, as_ours[ids]) for ends, ids in b_sides]
    a_n, b_n = ([np.diff(ends) for ends, _ in sides] for sides in (a_sides, b_sides))
    orders = np.argsort(b_bands, axis=0, kind="stable")
    ranked = [b_bands[orders[:, k], k] for k in range(b_bands.shape[1])]
    flags = np.zeros(len(words) + 1, np.uint8)
    for at in range(0, len(a_ordinals), STRIP):
        strip = a_bands[at : at + STRIP]
        met = np.zeros((len(strip), len(b_ordinals)), bool)
        for k, values in enumerate(ranked):
            lo, hi = np.searchsorted(values, strip[:, k]), np.searchsorted(values, strip[:, k], "right")
            for x in np.flatnonzero(hi > lo):
                met[x, orders[lo[x] : hi[x], k]] = True
        for x in range(len(strip)):
            a = at + x
            others = np.flatnonzero(met[x])
            if same:
                others = others[others > a]
            for n, m in zip(a_n, b_n):
                others = others[np.minimum(n[a], m[others]) >= np.maximum(n[a], m[others]) * threshold - 1e-9]
            scores = []
            for side in (0, 1):
                if not len(others):
                    break
                ends, ids = a_sides[side]
                own = ids[ends[a] : ends[a + 1]]
                flags[own] = 1
                both = _shared(flags, b_sides[side], others)
                flags[own] = 0
                score = both / (len(own) + b_n[side][others] - both)
                ok = score >= threshold
                others, scores = others[ok], [s[ok] for s in scores] + [score[ok]]
            if len(others):
                yield np.minimum(a_ordinals[a], b_ordinals[others]), np.maximum(a_ordinals[a], b_ordinals[others]), *scores


def _pairs(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    names = ["a", "b", "source_jaccard", "target_jaccard"]
    path, one = None, None
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if x != path:
                path, one = x, _load(x)
            found, n = [], 0
            for part in _compare(one, one if x == y else _load(y), x == y, threshold):
                found.append(part)
                n += len(part[0])
                if n >= 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=names)
                    found, n = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=names)


def pairs(sides: DataFrame, threshold: float) -> DataFrame:
    """(a, b, source_jaccard, target_jaccard) of the first units by ordinal of each k. sides: ordinal, k (binary), and the texts s and t, not empty."""
    spark = sides.sparkSession
    folder = new_path(spark, "near-blocks")
    folder = folder if "://" in folder else f"file://{folder}"
    rows = minhash.rows_of(threshold)
    units = written(sides.select("ordinal", "k", "s", "t").mapInArrow(lambda b: _encode(b, f"{folder}/all", rows), "block string, place int, ordinal long, k binary"), "near-units")
    first = units.groupBy("k").agg(F.min_by(F.struct("block", "place"), "ordinal").alias("u")).select("u.*")
    blocks = first.groupBy("block").agg(F.collect_list("place").alias("places"))
    kept = written(blocks.repartition(max(1, units.select("block").distinct().count())).mapInArrow(lambda b: _kept(b, f"{folder}/first"), "path string"), "near-kept")
    two = kept.select(F.col("path").alias("x")).crossJoin(kept.select(F.col("path").alias("y"))).where("x <= y")
    n = two.count()
    tasks = two.repartition(min(max(1, n), 4096), F.xxhash64("x", "y")).sortWithinPartitions("x", "y")
    return tasks.mapInArrow(lambda b: _pairs(b, threshold), "a long, b long, source_jaccard double, target_jaccard double")
