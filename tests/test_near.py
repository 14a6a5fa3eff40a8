import random

import pyarrow as pa
import pytest

from bitloom.functions import minhash
from bitloom.operators import dedupe, near
from bitloom.schema import as_units


def test_blocks_give_the_pairs_of_brute_force(tmp_path, monkeypatch):
    monkeypatch.setattr(near, "UNITS", 7)
    monkeypatch.setattr(near, "STRIP", 3)
    monkeypatch.setattr(near, "COUNTED", 50)
    r = random.Random(5)
    rows = []
    for k in range(60):
        s = list(r.choice(["the quick brown fox jumps over the lazy dog", "кафе 😀 pack my box", "||"]))
        s[r.randrange(len(s))] = r.choice("xyz")
        rows.append((k, bytes([k]), "".join(s), "".join(s)[::-1]))
    grams = lambda s: {s[i : i + 3] for i in range(max(1, len(s) - 2))}
    sets = [(grams(s), grams(t)) for *_, s, t in rows]
    want = {}
    for b in range(60):
        for a in range(b):
            js = tuple(len(p & q) / len(p | q) for p, q in zip(sets[a], sets[b]))
            if min(js) >= 0.7 and a % 5 and b % 5:
                want[a, b] = js
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["ordinal", "k", "s", "t"])
    units = pa.Table.from_batches(near._encode(iter([batch]), f"file://{tmp_path}/all", minhash.rows_of(0.7))).to_pylist()
    assert len({x["block"] for x in units}) == 9
    places = {}
    for x in units:
        if x["ordinal"] % 5:
            places.setdefault(x["block"], []).append(x["place"])
    kept = [x.column(0)[0].as_py() for x in near._kept(iter([pa.RecordBatch.from_arrays([pa.array(list(places)), pa.array(list(places.values()))], names=["block", "places"])]), f"file://{tmp_path}/kept")]
    two = [(x, y) for x in sorted(kept) for y in sorted(kept) if x <= y]
    got = [x for b in near._pairs(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*two)], names=["x", "y"])]), 0.7) for x in b.to_pylist()]
    assert {(x["a"], x["b"]): (x["source_jaccard"], x["target_jaccard"]) for x in got} == want and len(got) == len(want) > 50


def test_no_trigrams_are_joined_to_candidates(spark):
    rows = [(k, "EN", "BG", f"a text of words {k}", f"another text {k}") for k in range(4)]
    found = dedupe.near_pairs(as_units(spark.createDataFrame(rows, "ordinal long, source_lang string, target_lang string, source_text string, target_text string")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and not any("array<" in str(f.dataType.simpleString()) for f in found.schema)
    found.collect()


@pytest.mark.parametrize("text", ["", "a", "ab", "aaaa", "\U0010ffff\U0010ffff\U0010ffff"])
def test_codes_of_short_and_wide_texts(text):
    assert len(minhash.trigram_codes(text)) == max(1, len({text[i : i + 3] for i in range(len(text) - 2)}))
