import random

import numpy as np
import xxhash

from bitloom.llm import op01_simhash as op


def brute(rows):
    def fp(t):
        w = (t or "").encode().lower().split()
        g = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in g]
        return sum((2 * sum(x >> k & 1 for x in h) > len(h)) << k for k in range(64))

    f = [fp(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= 3:
                group[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return sorted(((d, f"{f[i]:016x}", best.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def fixture():
    r = random.Random(3)
    rows, i = [], 0
    for _ in range(15):
        w = [r.choice("aA bé çc dog Ähn of the x".split()) + str(r.randrange(50)) for _ in range(r.randrange(1, 120))]
        for _ in range(r.randrange(1, 8)):
            x = list(w)
            if r.random() < 0.6:
                x[r.randrange(len(x))] = "new"
            rows.append((i, r.choice([" ", "\n", " \t"]).join(x)))
            i += 1
    r.shuffle(rows)
    return rows + [(900, None), (901, ""), (902, "one"), (903, "ONE"), (None, "one"), (904, "one two"), (904, "one two"), (904, "other words here now"), (905, "w " * 30000)]


def test_against_brute_force(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((tuple(x) for x in op.query(spark, str(tmp_path)).collect()), key=str) == brute(rows)


def family():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 64, 40, dtype=np.uint64)
    fp = [*base]
    for b in base:
        for _ in range(30):
            x = int(b)
            for k in r.choice(64, r.integers(1, 6), replace=False):
                x ^= 1 << int(k)
            fp.append(np.uint64(x))
    return np.unique(np.array(fp, np.uint64))


def near(fp):
    return {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if int(fp[i] ^ fp[j]).bit_count() <= 3}


def test_index_finds_every_pair(monkeypatch):
    fp = family()
    want = near(fp)
    for pairs in (op.PAIRS, 64):
        monkeypatch.setattr(op, "PAIRS", pairs)
        found = set()
        for copy in range(op.PARTS, 2 * op.PARTS):
            v, bits = op.arranged(fp, copy)
            order = np.argsort(op.gray_rank(v))
            top = v[order] >> np.uint64(64 - bits)
            node = np.flatnonzero(np.append(True, top[1:] != top[:-1]))
            for a, b in op.linked(v[order], node):
                found |= {tuple(sorted((int(order[x]), int(order[y])))) for x, y in zip(a, b)}
        assert found == want
        whole = {tuple(sorted((int(x), int(y)))) for a, b in op.linked(fp, np.array([0])) for x, y in zip(a, b)}
        assert whole == want  # one node, not even in Gray order


def test_parts_keep_all_bits():
    fp = family()
    for copy in (4, 7, 4 * 6 + 3, 16 * 5 + 4 * 2 + 1, 64 * 7 + 16 * 3 + 4 * 3 + 3):
        v, bits = op.arranged(fp, copy)
        assert bits == {1: 16, 2: 28, 3: 37, 4: 43 if copy % 4 == 3 else 44}[(copy.bit_length() - 1) // 2]
        assert len(np.unique(v)) == len(fp) and (np.bitwise_count(v[:-1] ^ v[1:]) == np.bitwise_count(fp[:-1] ^ fp[1:])).all()


def test_groups_hold_the_bits_that_all_below_share():
    fp = family()
    v = fp[np.argsort(op.gray_rank(fp))]
    node = np.array([0, 1, 300, 309])
    levels = op.hierarchy(v, node)
    assert len(levels[-1][0]) == len(node)
    spans = [(i, i + 1) for i in range(len(v))]
    for mask, pattern, first in levels[1:]:
        spans = [(spans[a][0], spans[b - 1][1]) for a, b in zip(first, first[1:])]
        for m, x, (a, b) in zip(mask, pattern, spans):
            ones, zeros = int(np.bitwise_and.reduce(v[a:b])), int(np.bitwise_and.reduce(~v[a:b]))
            assert int(m) == ones | zeros and int(x) & int(m) == ones


def test_gray_order_prunes_what_another_order_does_not():
    v = np.unique(np.random.default_rng(2).integers(0, 1 << 40, 20000, dtype=np.uint64))

    def work(order):
        done: list[int] = []
        links = sum(len(i) for i, _ in op.linked(v[order], np.array([0]), 3, done))
        return links, sum(done)

    gray, plain, other = (work(x) for x in (np.argsort(op.gray_rank(v)), np.argsort(v), np.random.default_rng(3).permutation(len(v))))
    assert gray[0] == plain[0] == other[0] == work(np.argsort(op.gray_rank(v)))[0]
    assert 1.3 * gray[1] < plain[1] and 4 * gray[1] < other[1] < len(v) ** 2


def test_large_nodes_are_split(spark, monkeypatch):
    fp = family()
    fps = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    monkeypatch.setattr(op, "NODE", 5)
    rows = op.nodes(fps, 5)
    sizes = {(x.copy, x.top): x["count"] for x in rows.groupBy("copy", "top").count().collect()}
    depth = lambda copy: (copy.bit_length() - 1) // 2
    assert max(map(depth, (c for c, _ in sizes))) > 1
    assert all(n <= 5 or depth(c) == op.DEPTH for (c, _), n in sizes.items())
    links = rows.repartition(3, "copy", "top").sortWithinPartitions("copy", "rank").select("copy", "top", "fp").mapInArrow(lambda batches: op._links(batches, 3), "a long, b long").collect()
    place = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    got = op.local(len(fp), np.array([place[x.a] for x in links]), np.array([place[x.b] for x in links]))
    pairs = near(fp)
    want = op.local(len(fp), np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]))
    assert (got == want).all()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op.query(spark, str(tmp_path)).collect() == []


def test_stage_keeps_one_row_of_each_group(spark):
    rows = fixture()
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, root int")
    out = op.dedup(spark, d).collect()
    want = {c for _, _, c in brute(rows)}
    assert len(out) == len(want) + 1 and {x.doc_id for x in out} == want  # one id with texts in two groups
