"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints: 64 bits by the majority of the XXH64 (seed 42) values of a text's
3-word shingles, repeats included. Distinct fingerprints are linked when they
differ in DISTANCE or fewer bits.

Index. The top of the hierarchy is a masked pattern of which all bits are equal: two
fingerprints that differ in 3 bits agree on one of PARTS parts of any bits, so for each
part a copy of every fingerprint goes to the node of that part's value. A node of more
than NODE fingerprints is split in the same way by parts of the bits that are left, and
so on: 16, 12, 9 and 6 or 7 bits, after which distinct fingerprints can't be more than 2**21.
So no group is unbounded, whatever the texts.

In a node fingerprints stand in Gray order, in which neighbours share most bits: FAN
consecutive ones make a group, FAN groups a group above, up to one. A group has the mask
of the bits on which all below it agree and their pattern there; the bits that a group
shares are factored out of those below. The join walks pairs of groups from the top,
adds up the differences of patterns on the bits that become comparable with each level,
and drops a pair of groups, with everything below, as soon as the sum exceeds 3. Any
other order would give the same links by far more comparisons, since groups in it
straddle places where many bits change at once. Nothing is capped.

Only distinct fingerprints take part, so copies cost nothing; each task reduces
its links to stars, which lose no connection; and components are found by rounds
of large and small stars over tables.

Nulls and texts without a word have fingerprint zero and are linked like any
other. component_id is the smallest doc_id reached; null if only null ids are.
Rows that repeat a doc_id are linked each by its own text. A very long text costs
memory in proportion to its words, some 150 bytes each, its shingles being summed a slice at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._spark import drop, table, text_key, written
from .components import components, local

SHINGLE = 3
DISTANCE = 3
PARTS = DISTANCE + 1
#: A node of more fingerprints is split by another part.
NODE = 1 << 15
#: Parts that a node may have: of 16, 12, 9 and 6 or 7 bits.
DEPTH = 4
FAN = 8
#: Pairs of groups that are compared at once.
PAIRS = 1 << 21
_ALL = np.uint64((1 << 64) - 1)


def fingerprint(text: bytes) -> int:
    """Of one text: 64 counters, summed over slices of a bounded number of shingles."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = end - length
    k = min(SHINGLE, len(words))
    start, end = start[: len(words) - k + 1], end[k - 1 :]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(start), 1 << 16):
        a, b = start[i : i + (1 << 16)].tolist(), end[i : i + (1 << 16)].tolist()
        h = np.fromiter((digest(joined[x:y], 42) for x, y in zip(a, b)), "<u8", len(a))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(start), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in T.slices(b.column("text")):
            found = np.fromiter((fingerprint(s.text(i)) for i in range(s.rows)), np.uint64, s.rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c).slice(s.first, s.rows) for c in ("doc_id", "tk")), pa.array(found.view(np.int64))], names=["doc_id", "tk", "fp"])


def split(v: np.ndarray, done: int, part: int) -> tuple[np.ndarray, int]:
    """v, of which the first done bits are the node's, with one of the PARTS parts of the others next; and the node's bits then."""
    rest = 64 - done
    size = [rest // PARTS + (k < rest % PARTS) for k in range(PARTS)]
    before, own = sum(size[:part]), size[part]
    after = rest - before - own
    low = lambda x, bits: x & np.uint64((1 << bits) - 1)
    head = v & ~np.uint64((1 << rest) - 1)
    mine = low(v >> np.uint64(after), own)
    others = low(v >> np.uint64(after + own), before) << np.uint64(after) | low(v, after)
    return head | mine << np.uint64(rest - own) | others, done + own


def arranged(fp: np.ndarray, copy: int) -> tuple[np.ndarray, int]:
    """Fingerprints as a copy has them, and how many leading bits are its nodes'. copy: the parts by depth as digits, a 1 before."""
    digits, done = [], 0
    while copy > 1:
        copy, digit = divmod(copy, PARTS)
        digits.append(digit)
    for part in reversed(digits):
        fp, done = split(fp, done, part)
    return fp, done


def gray_rank(v: np.ndarray) -> np.ndarray:
    for k in (1, 2, 4, 8, 16, 32):
        v = v ^ (v >> np.uint64(k))
    return v


def _reduce(first: np.ndarray, mask: np.ndarray, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks and patterns of the groups that begin at first."""
    lead = pattern[first]
    apart = np.bitwise_or.reduceat(pattern ^ np.repeat(lead, np.diff(np.append(first, len(pattern)))), first)
    return np.bitwise_and.reduceat(mask, first) & ~apart, lead


def hierarchy(v: np.ndarray, node: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By level from the fingerprints up, masks, patterns and where groups begin among those below; node: where nodes begin in v."""
    levels = [(np.full(len(v), _ALL), v, np.arange(len(v) + 1))]
    size = np.diff(np.append(node, len(v)))
    while True:
        n = -(-size // FAN)
        at = np.cumsum(size) - size
        first = np.repeat(at, n) + FAN * T.ranges(np.zeros(len(n), np.int64), n)
        mask, pattern = _reduce(first, *levels[-1][:2])
        levels.append((mask, pattern, np.append(first, int(size.sum()))))
        size = n
        if (n <= 1).all():
            return levels


def linked(v: np.ndarray, node: np.ndarray, distance: int = DISTANCE, work: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i < j in v, whose nodes begin at node, that are of one node and differ in distance or fewer bits.

    work: gets the number of pairs of groups that are compared.
    """
    if not len(v):
        return
    levels = hierarchy(v, node)
    size = np.diff(np.append(node, len(v)))
    roots = np.flatnonzero(size > 1)
    todo = [(len(levels) - 1, roots, roots, np.zeros(len(roots), np.int64))]
    step = max(1, PAIRS // FAN**2)
    while todo:
        level, a, b, diff = todo.pop()
        if len(a) > step:
            todo.append((level, a[step:], b[step:], diff[step:]))
            a, b, diff = a[:step], b[:step], diff[:step]
        mask, _, first = levels[level]
        low_mask, low, _ = levels[level - 1]
        na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
        per = np.repeat(nb, na)
        i = np.repeat(T.ranges(first[a], na), per)
        j = T.ranges(np.repeat(first[b], na), per)
        up = np.repeat(np.arange(len(a)), na * nb)
        ordered = i < j if level == 1 else i <= j
        i, j, up = i[ordered], j[ordered], up[ordered]
        if work is not None:
            work.append(len(i))
        fresh = low_mask[i] & low_mask[j] & ~(mask[a] & mask[b])[up]  # bits that the groups above can't compare
        d = diff[up] + np.bitwise_count((low[i] ^ low[j]) & fresh)
        near = d <= distance
        if not near.any():
            continue
        if level == 1:
            yield i[near], j[near]
        else:
            todo.append((level - 1, i[near], j[near], d[near]))


def _join(copy: np.ndarray, fp: np.ndarray, distance: int) -> Iterator[pa.RecordBatch]:
    """Rows of whole nodes, in order."""
    for k in np.unique(copy):
        own = fp[copy == k]
        v, bits = arranged(own, int(k))
        top = v >> np.uint64(64 - bits)
        node = np.flatnonzero(np.append(True, top[1:] != top[:-1]))
        for i, j in linked(v, node, distance):
            used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            root = local(len(used), at[: len(i)], at[len(i) :])
            far = np.flatnonzero(root != np.arange(len(used)))
            yield pa.RecordBatch.from_arrays([pa.array(own[used[far]].view(np.int64)), pa.array(own[used[root[far]]].view(np.int64))], names=["a", "b"])


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of (copy, Gray rank). Whole nodes are joined once enough rows are there; the last may go on in the next batch."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for b in batches:
        copy, top = b.column("copy").to_numpy(), b.column("top").to_numpy()
        fp = b.column("fp").to_numpy().view(np.uint64)
        new = np.flatnonzero((copy[1:] != copy[:-1]) | (top[1:] != top[:-1])) + 1
        if held and last != (copy[0], top[0]):
            new = np.append(0, new)
        last = copy[-1], top[-1]
        if len(new) and rows + len(fp) >= 1 << 18:
            cut = int(new[-1])
            yield from _join(*(np.concatenate(x) for x in zip(*held, (copy[:cut], fp[:cut]))), distance)
            held, rows, copy, fp = [], 0, copy[cut:], fp[cut:]
        held.append((copy, fp))
        rows += len(fp)
    if held:
        yield from _join(*(np.concatenate(x) for x in zip(*held)), distance)


def _copies(batches: Iterator[pa.RecordBatch], again: bool) -> Iterator[pa.RecordBatch]:
    """A row for each part; again: of rows that are copies already."""
    for b in batches:
        fps = b.column("fp").to_numpy().view(np.uint64)
        copies = b.column("copy").to_numpy() if again else np.ones(len(fps), np.int32)
        for above in np.unique(copies):
            fp = fps[copies == above]
            for part in range(PARTS):
                copy = int(above) * PARTS + part
                v, bits = arranged(fp, copy)
                top = v >> np.uint64(64 - bits)
                rank = gray_rank(v) ^ np.uint64(1 << 63)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), copy, np.int32)), pa.array(top.view(np.int64)), pa.array(rank.view(np.int64)), pa.array(fp.view(np.int64))], names=["copy", "top", "rank", "fp"])


def nodes(fps: DataFrame, most: int = NODE) -> DataFrame:
    """copy, top (the node's bits), rank (in Gray order) and fp of each fingerprint in each of its nodes.

    A split's list of large nodes is at most the rows by most, so it is broadcast.
    """
    schema, out, depth = "copy int, top long, rank long, fp long", None, 1
    rows = fps.select("fp").mapInArrow(lambda batches: _copies(batches, False), schema)
    while True:
        large = None
        if depth < DEPTH:
            large = written(rows.groupBy("copy", "top").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("copy", "top"), "op1-large")
        if large is None or large.isEmpty():
            return rows if out is None else out.unionByName(rows)
        small = rows.join(F.broadcast(large), ["copy", "top"], "left_anti")
        out = small if out is None else out.unionByName(small)
        rows = rows.join(F.broadcast(large), ["copy", "top"], "left_semi").select("copy", "fp").mapInArrow(lambda batches: _copies(batches, True), schema)
        depth += 1


def groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, tk (text key), fp, root (a fingerprint that stands for the component) and component_id, by row."""
    marked = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("tk"), "text").mapInArrow(_fingerprints, "doc_id long, tk binary, fp long"),
        "op1-fingerprints",
    )
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "op1-distinct")
    pairs = nodes(distinct).repartition("copy", "top").sortWithinPartitions("copy", "rank").select("copy", "top", "fp").mapInArrow(lambda batches: _links(batches, DISTANCE), "a long, b long")
    links = written(pairs, "op1-links")
    stars = components(links)
    rooted = distinct.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "op1-rooted")
    classes = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "op1-classes")
    out = marked.join(written(rooted.join(classes, "root").select("fp", "root", "component_id"), "op1-components"), "fp")
    for done in (distinct, links, stars, rooted, classes):
        drop(done)
    return out


def dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each group: the smallest doc_id's, or where none has an id the smallest text key's."""
    rows = groups(spark, docs)
    own = rows.groupBy("root", "doc_id", "tk").agg(F.count(F.lit(1)).alias("n"))
    stays = written(own.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk", "n")).alias("x")).select("x.doc_id", "x.tk", "x.n"), "op1-stays")
    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), text_key(F.col("text")).alias("key"))
    kept = keyed.join(stays, keyed["id"].eqNullSafe(stays["doc_id"]) & (keyed["key"] == stays["tk"]))
    if stays.where("n > 1").limit(1).count():  # rows that repeat both id and text
        kept = kept.where("n = 1").unionByName(kept.where("n > 1").dropDuplicates(["doc_id", "tk"]))
    return kept.select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
