import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from bitloom.llm import _files, _tokens, op04_pack, op07_token_counts

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
ODD = ["don't", "it's''s", "..'s", "A's", "é%%%", "éx", "<|endoftext|>", "x<|startoftext|>y", "<|ENDOFTEXT|>", "a b", "İSTANBUL", "ΑΣ", "3rd", "12,5", "don''t", "😀!ok", "ﬁ", "x y", "'", "'re'll", "a-b_c", "日本語", "\x00\x01", "a\x1cb", "ß!", "…%%%", "word%%%"]


def fixture():
    r = random.Random(1)
    rows = [(i, " ".join(r.choice([*ODD, "the", "Thonan", "ouon.", "\n"]) for _ in range(r.randrange(60)))) for i in range(60)]
    rows += [(100 + i, " ".join(["go"] * n)) for i, n in enumerate([4094, 4095, 4096, 8191, 9000, 1, 1, 1])]
    return rows + [(200, None), (201, ""), (None, "null id"), (5, "again"), (5, "again")]


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_packing(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op04_pack.query(spark, str(tmp_path)).collect()
    sequences, pieces, want = {}, [], []
    for x in out:
        pieces.append((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens))
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for d, t in rows:
        own = np.array([*ids(t), 2], "<u4")
        for k in range(0, len(own), 4096):
            want.append((d, k, len(own[k : k + 4096]), zlib.crc32(own[k : k + 4096].tobytes()), len(own)))
    assert sorted(pieces, key=str) == sorted(want, key=str)
    assert sorted(sequences) == list(range(len(sequences)))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 4096


def test_places_fill_well():
    r = random.Random(0)
    h = {}
    for _ in range(20000):
        x = min(4096, int(r.lognormvariate(6, 1)) + 1)
        h[x] = h.get(x, 0) + 1
    steps = op04_pack.place(h)
    n = int((steps[:, 3] + steps[:, 2]).max())
    assert sum(k * v for k, v in h.items()) / (4096 * n) > 0.99
    used = np.zeros(n, int)
    for length, _, ranks, first, offset in sorted(steps.tolist(), key=lambda x: -x[0]):
        assert (used[first : first + ranks] == offset).all()
        used[first : first + ranks] += length
    assert used.max() <= 4096 and {k: int(steps[steps[:, 0] == k, 2].sum()) for k in h} == h


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op04_pack.query(spark, str(tmp_path)).collect() == []
    assert op07_token_counts.query(spark, str(tmp_path)).collect() == []


def test_token_counts(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    want = sorted(((d, len(plain.encode(t or "", add_special_tokens=False).ids)) for d, t in rows), key=str)
    assert sorted((tuple(x) for x in op07_token_counts.query(spark, str(tmp_path)).collect()), key=str) == want


def test_scan_of_files_in_small_blocks(spark, tmp_path):
    r = random.Random(4)
    want = []
    for f in range(3):
        tokens, n = [], 0
        for _ in range(40):
            length = r.choice([0, 1, 3, 8, 50])
            tokens += [7] * length + [9]
            want.append((f"{f}.tokens", n, length, True))
            n += 1
        if f:
            tokens += [7] * f
            want.append((f"{f}.tokens", n, f, False))
        np.array(tokens, "<u2").tofile(tmp_path / f"{f}.tokens")
    np.array([5, 5], "<u2").tofile(tmp_path / "3.tokens")
    (tmp_path / "4.tokens").touch()
    want.append(("3.tokens", 0, 2, False))
    for block in (1, 8, 1000):
        assert sorted(tuple(x) for x in op07_token_counts.count_tokens(spark, str(tmp_path), 9, block).collect()) == sorted(want)


def test_a_failed_file_leaves_nothing(tmp_path):
    try:
        with _files.Whole(f"{tmp_path}/a.tokens") as f:
            f.write(b"x")
            raise KeyError
    except KeyError:
        pass
    assert _files.listed(str(tmp_path), "") == []


def test_remembering_is_bounded(monkeypatch):
    import pyarrow as pa

    from bitloom.llm import _text as T

    monkeypatch.setattr(_tokens, "REMEMBERED", 3)
    encoder = _tokens.Encoder(_tokens.default_path(), False)
    for _, text in fixture():
        for s in T.slices(pa.array([text])):
            assert encoder.encode(s)[0].tolist() == ids(text)


def test_clashing_columns(spark, tmp_path):
    rows = [(i, t, 1, 2, "x", "y") for i, t in fixture()]
    d = spark.createDataFrame(rows, "doc_id long, text string, start int, rank int, bucket string, file string")
    assert op04_pack.pack(spark, d).count() >= len(rows)
    folder = f"file://{tmp_path}/tokens"
    order = op07_token_counts.write(spark, d, folder)
    assert order.count() == len(rows) == op07_token_counts.count_tokens(spark, folder).count()


def test_documents_are_whole_and_padding_is_small(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op04_pack.query(spark, str(tmp_path)).collect()
    total = sum(x.length for x in out)
    assert total == sum(len(ids(t)) + 1 for _, t in rows)
    assert 4096 * len({x.sequence_id for x in out}) - total < 4096 + 0.1 * total
