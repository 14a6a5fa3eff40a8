import json
import os
import random
import subprocess
import sys

import test_op01
import test_op09
import test_op10

import corpus_pipeline
from bitloom.llm import op04_pack


def fixture():
    r = random.Random(9)
    word = lambda: "".join(r.choice(["th", "er", "on", "é", "an", "re", "st"]) for _ in range(r.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(30)) for i in range(5)]
    passage = text(70)
    docs = [(i, text(r.randrange(60, 200))) for i in range(40)]
    docs += [(100 + i, docs[i][1]) for i in range(5)] + [(110, docs[7][1] + " end")]
    docs += [(120 + i, text(90) + " " + passage + " " + text(40)) for i in range(4)]
    docs += [(130 + i, text(100) + " " + items[i][1]) for i in range(3)]
    docs += [(140, "short"), (141, None), (142, "go " * 100)]
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in docs], items


def test_stages_against_plain_python(spark, tmp_path):
    docs, items = fixture()
    long_head, long_tail = (" ".join(f"{x}{i}" for i in range(400)) for x in "ab")
    long = f"{long_head}. {items[4][1]} {long_tail}"  # too long for its passage to make it contaminated
    docs.append((150, long, "en", "s", len(long)))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = [d[:2] for d in docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if k == 0:  # without labels the base rules decide
            rows = [(i, t) for i, t in rows if i not in (140, 141, 142)]
        elif k == 1:
            stays = {c for _, _, c in test_op01.brute(rows)}
            rows = [(i, t) for i, t in rows if i in stays]
        elif k == 2:
            left = []
            for i, t in rows:
                gone = next(x for x in test_op10.brute(rows) if x[0] == i)
                if gone[2]:
                    t = [x.text for x in now.where(f"doc_id = {i}").collect()]
                    assert len(t) == 1 and test_op10.brute([(i, t[0])])[0][3] == gone[3]
                    t = t[0]
                left.append((i, t))
            assert rows != left
            rows = left
        else:
            clean = []
            for i, t in rows:
                _, n, hit, _, _, bad = test_op09.brute([(i, t)], items)[0]
                if hit and not bad:
                    assert t == long
                    t = f"{long_head}.  {long_tail}"
                if not bad:
                    clean.append((i, t))
            assert rows != clean and len(clean) > len(rows) - 5
            rows = clean
            assert all(not x[2] for x in test_op09.brute([(x.doc_id, x.text) for x in now.collect()], items))
        assert sorted((x.doc_id, x.text) for x in now.collect()) == sorted(rows), name
        assert now.where("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = op04_pack.pack(spark, now).collect()
    key = lambda x: (x.doc_id, x.start, x.length, x.ids_crc32)
    assert sorted(map(key, packed)) == sorted(map(key, want)) and {x.doc_id for x in packed} == {i for i, _ in rows}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_all_queries_are_registered():
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    out = subprocess.run([sys.executable, "-c", "import json, __spark_entry__ as e; print(json.dumps(list(e.queries())))"], cwd=root, capture_output=True, text=True, check=True)
    names = json.loads(out.stdout.splitlines()[-1])
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)} and "pipeline" in names
