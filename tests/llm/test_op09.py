import hashlib
import pickle
import random
import re

import numpy as np
import pyarrow as pa

from bitloom.llm import op09_decontaminate as op

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").encode().lower())


def brute(docs, items):
    patterns = {}
    for name, t in items:
        w = words(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if n else ():
            patterns.setdefault(tuple(w[i : i + n]), set()).add("" if name is None else str(name))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in range(1, 14):
            for i in range(len(w) - n + 1):
                if x := patterns.get(tuple(w[i : i + n])):
                    found |= x
                    hit |= set(range(i, i + n))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def fixture():
    r = random.Random(2)
    text = lambda n: " ".join(r.choice(["The", "of", "É", "x1", "and"]) + r.choice(["", "a", "bö"]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 5, 12, 13, 14, 40, 40, 60])] + [(10, None), (11, " .. "), (None, text(20)), (7, text(15))]
    docs = []
    for i in range(60):
        parts = [text(r.randrange(40)) for _ in range(3)]
        for _ in range(r.randrange(3)):
            w = (r.choice(items)[1] or "").split()
            k = r.randrange(len(w) + 1)
            parts.insert(r.randrange(len(parts)), ", ".join(w[k : k + r.randrange(5, 40)]).upper().replace("É", "É"))
        docs.append((i, "\n".join(parts)))
    return docs + [(100, None), (101, ""), (102, "..."), (None, items[8][1]), (102, items[9][1]), (103, (items[9][1] + " q") * 500)], items


def test_against_brute_force(spark, tmp_path):
    docs, items = fixture()
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted((tuple(x) for x in op.query(spark, str(tmp_path)).collect()), key=str) == brute(docs, items)


def test_benchmark_in_blocks(spark):
    docs, items = fixture()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda x: sorted(map(str, x.collect()))
    assert len(op.patterns(spark, b, block_bytes=200)) > 3
    assert rows(op.matches(spark, d, b, block_bytes=200)) == rows(op.matches(spark, d, b))


def test_long_texts_in_pieces(spark):
    docs, items = fixture()
    blocks = op.patterns(spark, spark.createDataFrame(items, "item_id long, text string"))
    texts = pa.array([t for _, t in docs], pa.string())
    whole = [(i, n, hit.tolist(), own) for i, n, hit, own in op._find(texts, blocks, 13)]
    assert any(hit for _, _, hit, _ in whole)
    for size in (1, 60, 300):
        assert [(i, n, hit.tolist(), own) for i, n, hit, own in op._find(texts, blocks, 13, size)] == whole


def test_patterns_are_small():
    r = random.Random(4)
    items = [(str(i), " ".join(r.choice("abcdefgh") + str(r.randrange(5000)) for _ in range(100)).encode()) for i in range(200)]
    assert len(pickle.dumps(op.compile_patterns(items))) < 60 * sum(len(t) for _, t in items)


def test_cut():
    text = b"One, two (three) four. Five"
    assert op.cut(text, np.array([1, 2])) == b"One, ) four. Five"
    assert op.cut(text, np.array([0, 2, 4])) == b", two () four. "


def test_stage(spark):
    docs, items = fixture()
    long = " ".join(f"w{i}" for i in range(600))
    docs += [(200, f"{long}. {items[9][1]}; {long}"), (201, long), (202, f"{long} q1 q2 {items[7][1]} q3 {long}")]
    items = [(i, t) for i, t in items if t and len(t.split()) > 3] + [(20, "q1 q2 q3"), (21, "")]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(i, t, 3, len(t or "")) for i, t in docs], "doc_id long, text string, n_hit int, n_chars int")
    out = op.decontaminate(spark, d, b)
    assert out.dtypes == d.dtypes
    out = out.collect()
    judged = {(i, t): x for (i, t), x in ((p, brute([p], items)[0]) for p in docs)}
    left = {x.doc_id: x.text for x in out}
    for i, t in docs:
        if i is None:
            continue
        _, n, hit, _, _, bad = judged[i, t]
        if not hit:
            assert (i, t) in [(x.doc_id, x.text) for x in out]
        elif bad:
            assert (i, t) not in [(x.doc_id, x.text) for x in out]
    assert left[200] == f"{long}. ; {long}" and left[201] == long and left[202].split() == [*long.split(), *long.split()]
    assert all(x.n_chars == len(x.text or "") and x.n_hit == 3 for x in out)
    assert all(x[2] == 0 for x in brute([(x.doc_id, x.text) for x in out], items))


def test_empty_tables_and_clashing_columns(spark):
    docs, items = fixture()
    none = spark.createDataFrame([], "item_id long, text string")
    d = spark.createDataFrame([(i, t, 3, "x") for i, t in docs], "doc_id long, text string, n_words int, items string")
    assert op.matches(spark, d, none).where("n_hit > 0").count() == 0
    assert op.matches(spark, d, none).select("rest.n_words").distinct().collect()[0][0] == 3
    assert op.decontaminate(spark, d.limit(0), none).count() == 0 and op.decontaminate(spark, d, none).count() == len(docs)
