import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from bitloom.llm import _text as T
from bitloom.llm._spark import sample
from bitloom.llm import op02_quality as quality
from bitloom.llm import op03_toxicity as toxicity


def base(text):
    text = text or ""
    words = text.encode().split()
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    grams = {}
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {k for at in grams.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    n = len(words)
    return n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n


def corpus(r, n):
    word = lambda: "".join(r.choice(["th", "er", "on", "é", "an", "re"]) for _ in range(r.randrange(1, 5)))
    sentence = lambda: " ".join(word() for _ in range(r.randrange(4, 15))).capitalize() + "."
    insults = ["moron", "idiot", "scum"]
    docs, labels = [], []
    for i in range(n):
        good, toxic = r.random() < 0.7, r.random() < 0.3
        lines = [" ".join(sentence() for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(2, 8))]
        if not good:
            lines = lines[:1] + [" ".join(word() + r.choice(["%%%", "&&&"]) for _ in range(60)) if r.random() < 0.5 else " | ".join(word() for _ in range(60)) for _ in range(4)]
        if toxic:
            k = r.randrange(len(lines))
            lines[k] += " " + " ".join([word(), r.choice(insults), word()]) + "."
        docs.append((i, "\n".join(lines)))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def write(spark, path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


ODD = [(900, None), (901, ""), (902, " \n\t\n"), (903, "a b c d e f g h\n" * 30), (904, "é ß|#\n\n\né ß|#\r\né ß|#"), (905, "w " * 40000), (None, "one two"), (906, "x\n" * 3000), (906, "again"), (907, "A" * 200000)]


def test_quality(spark, tmp_path):
    r = random.Random(11)
    docs, labels = corpus(r, 500)
    write(spark, tmp_path, docs + ODD, labels[:300] + [(None, 1, 0), (5, None, None), (6, 1, 0)])
    rows = quality.query(spark, str(tmp_path)).collect()
    got = [(x.doc_id, (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed)) for x in rows]
    assert sorted(got, key=str) == sorted(((d, base(t)) for d, t in docs + ODD), key=str)
    assert not any(x.kept for x in rows if x.base_failed)
    right = [x.kept == bool(labels[x.doc_id][1]) for x in rows if x.doc_id is not None and 300 <= x.doc_id < 500 and not x.base_failed]
    assert np.mean(right) > 0.98
    kept = quality.keep_good(spark, spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "1 as kept"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert kept.columns == ["doc_id", "text", "kept"] and kept.count() == sum(x.kept for x in rows)


def test_viterbi_and_likelihood_against_enumeration():
    r = np.random.default_rng(2)
    row = np.array([0, 0, 0, 0, 1, 3, 3, 3])
    bins = np.stack([r.integers(a, b, len(row)) for a, b in zip(quality._OFFSET, quality._OFFSET[1:])], 1)
    field = quality.Field(r.normal(size=(int(quality._OFFSET[-1]), 2)), r.normal(size=(2, 2)))
    got = quality.viterbi(row, bins, field)
    for k in (0, 1, 3):
        at = np.flatnonzero(row == k)
        value = lambda y: sum(field.weights[bins[i], c].sum() for i, c in zip(at, y)) + sum(field.steps[a, b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=len(at)), key=value)
        assert tuple(got[at]) == best
    label = got.astype(np.int8)
    assert (quality.viterbi(row, bins, quality.fit(row, bins, label)) == label).mean() > 0.8


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 0, 1)]])
def test_without_labels_of_both_kinds(spark, tmp_path, labels):
    write(spark, tmp_path, [(1, "Some words here. " * 9), (2, "")], labels)
    assert quality.query(spark, str(tmp_path)).where("doc_id = 1 and base_failed").count() == 1
    assert {x.score for x in toxicity.query(spark, str(tmp_path)).collect()} == {0.0}


def test_toxicity(spark, tmp_path):
    r = random.Random(12)
    docs, labels = corpus(r, 800)
    write(spark, tmp_path, docs + ODD, labels + [(None, 1, 1), (7, None, None)])
    rows = toxicity.query(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs) + len(ODD)
    held = [x for x in rows if x.doc_id is not None and x.doc_id < 800 and x.held_out]
    assert {x.doc_id for x in rows if x.held_out} == {d for d, _ in docs + ODD if d is not None and zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([x.predicted == labels[x.doc_id][2] for x in held]) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in rows)
    d, lab = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    found = toxicity.locate(spark, d, toxicity.train(spark, d, lab)).collect()
    assert np.mean([bool(re.search("moron|idiot|scum", x.sentence)) for x in found]) > 0.9
    texts = dict(docs)
    assert all(texts[x.rest.doc_id].encode()[x.byte :].startswith(x.sentence.encode()) for x in found)


def test_held_out_labels_change_nothing(spark, tmp_path):
    docs, labels = corpus(random.Random(13), 200)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    models = [toxicity.train(spark, d, spark.createDataFrame([(i, q, 1 - t if flip and zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels], "doc_id long, quality int, toxic int")) for flip in (False, True)]
    assert models[0].bias == models[1].bias and (models[0].weights == models[1].weights).all()


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert quality.query(spark, str(tmp_path)).collect() == [] and toxicity.query(spark, str(tmp_path)).collect() == []


def test_slices_do_not_change_results():
    docs = [t for _, t in corpus(random.Random(14), 60)[0]] + [t for _, t in ODD]
    b = pa.RecordBatch.from_arrays([pa.array(docs, pa.string())], names=["text"])
    whole = pa.Table.from_batches(quality._judge([b], quality.NONE))
    old, T.SLICE_BYTES = T.SLICE_BYTES, 500
    T.slices.__defaults__ = (500,)
    try:
        assert pa.Table.from_batches(quality._judge([b], quality.NONE)).equals(whole)
    finally:
        T.SLICE_BYTES, T.slices.__defaults__ = old, (old,)


def test_training_takes_all_lines():
    text = "\n".join(f"Line {k} here." for k in range(200))
    b = pa.RecordBatch.from_pydict({"bad": [True, False, False], "text": [text, "one line", None]})
    assert [len(x) // len(quality.BINS) for y in quality._features([b]) for x in y.column("bins").to_pylist()] == [200, 1, 0]


def plain_score(text, model):
    """Noisy-or over sentences, word by word."""
    sentences, now = [], []
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    for m in re.finditer(rb"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)|[.!?\n]", raw):
        if m.group(1):
            now.append(m.group(1))
        elif now:
            sentences.append(now)
            now = []
    if now or not sentences:
        sentences.append(now)
    hashed = lambda k, w: int(T.HASH[k].ranges(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) % toxicity.BUCKETS
    clean = 1.0
    for own in sentences:
        z = model.bias + sum(model.weights[hashed(0, w)] + sum(model.weights[hashed(1, w[:n])] for n in toxicity.PREFIXES if len(w) > n) for w in own)
        clean *= 1 - 1 / (1 + np.exp(-z))
    return 1 - clean


def test_scores_against_plain_python(spark):
    docs, labels = corpus(random.Random(15), 300)
    docs += [(900, None), (901, ""), (902, "..!"), (903, "one sentence"), (903, "one sentence"), (904, "Two! Moron\nx. " * 300), (None, "Éa IDIOT é.b")]
    d = spark.createDataFrame([(i, t, 0.5, "s") for i, t in docs], "doc_id long, text string, score double, sentences string")
    model = toxicity.train(spark, d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model.weights.any()
    out = toxicity.score(spark, d, model, spans=True).collect()  # with columns of its own names
    assert [(x.rest.doc_id, x.rest.score) for x in out] == [(i, 0.5) for i, _ in docs]
    assert [x.score for x in out] == pytest.approx([plain_score(t, model) for _, t in docs], abs=1e-9)


def test_samples_are_bounded(spark):
    docs = [(k, "x" * 100) for k in range(50)] + [(7, "x" * 90)] * 20 + [(None, "n")]
    known = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1)], "doc_id long, bad int")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert sample(d, known, "bad", 1000, 1 << 20).count() == 50
    assert sample(d, known, "bad", 1000, 1000).count() in (9, 10) and sample(d, known, "bad", 5, 1 << 20).count() <= 5


def test_verdicts_beside_clashing_columns(spark):
    docs, labels = corpus(random.Random(16), 40)
    d = spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id long, text string, kept string, n_words int")
    out = quality.keep_good(spark, d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert out.columns == d.columns and {tuple(x) for x in out.collect()} <= {tuple(x) for x in d.collect()} and out.count()


def test_hashes_of_long_texts(monkeypatch):
    r = np.random.default_rng(4)
    buf = r.integers(97, 123, 5000).astype(np.uint8)
    buf[r.integers(0, 5000, 700)] = 32
    w = T.words(T.Slice(0, 1, buf, np.array([0, 5000])))
    h = T.HASH[0].ranges(buf, w.start, w.end)
    at = r.permutation(len(h) - 9)
    whole = T.HASH[1].windows(h, at, 7)
    mixed = T.HASH[1].windows(h, at, 1 + at % 9)
    monkeypatch.setattr(T, "HASHED", 64)
    assert (T.HASH[0].ranges(buf, w.start, w.end) == h).all()
    assert (T.HASH[1].windows(h, at, 7) == whole).all() and (T.HASH[1].windows(h, at, 1 + at % 9) == mixed).all()
    assert (T.HASH[0].ranges(buf, w.start, w.end)[3] == T.HASH[0].ranges(buf[w.start[3] : w.end[3]], np.array([0]), np.array([w.end[3] - w.start[3]]))).all()
