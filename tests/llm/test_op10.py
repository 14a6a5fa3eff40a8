import hashlib
import random

import pytest

from bitloom.llm import op10_substring as op


def brute(rows, width=50):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture
def docs(spark, tmp_path):
    def make(rows):
        d = spark.createDataFrame(rows, "doc_id long, text string")
        d.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return make


def fixture():
    r = random.Random(5)
    word = lambda: r.choice(["a", "b", "é", "the", "of"]) + r.choice("xyz" * 3 + "é")
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (50, 51, 60, 120, 49, 300)]
    rows = [(i, " \n".join([text(r.randrange(0, 80)), r.choice(shared), text(r.randrange(0, 80)), *([r.choice(shared)] * r.randrange(3))])) for i in range(60)]
    rows += [(100 + i, " ".join(["go"] * n)) for i, n in enumerate((49, 50, 51, 200, 400))]
    rows += [(200 + i, " ".join(["go", "on"] * n)) for i, n in enumerate((24, 25, 26, 100, 200))]
    rows += [(300, shared[3]), (301, shared[3]), (302, shared[4]), (303, shared[4]), (304, None), (305, ""), (306, " \t\x0b "), (307, "x" * 100000), (None, shared[3]), (None, shared[3])]
    rows += [(308, shared[5] + " end"), (308, "start " + shared[5]), (308, "start " + shared[5]), (5, shared[5])]
    return rows


def test_against_brute_force(spark, docs):
    rows = fixture()
    got = sorted((tuple(x) for x in op.query(spark, docs(rows)).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark, docs):
    assert op.query(spark, docs([])).collect() == []


def test_stage_keeps_columns_and_untouched_texts(spark):
    rows = [(i, t, "en", i) for i, t in fixture()[:-1] if i is not None and i < 308]
    d = spark.createDataFrame(rows, "doc_id long, text string, kept string, rep long")
    out = {x.doc_id: x for x in op.dedup(spark, d).collect()}
    want = {x[0]: x for x in brute([r[:2] for r in rows])}
    assert set(out) == {i for i, x in want.items() if x[1] != x[2] or not x[2]}
    for i, x in out.items():
        assert hashlib.sha256(b" ".join((x.text or "").encode().split())).hexdigest() == want[i][3] and x.kept == "en"
