import random
from collections import Counter

import pytest

from bitloom.operators import analyze
from bitloom.schema import as_units


def units(spark, rows):
    return as_units(spark.createDataFrame([(k, "EN", "BG", s, t) for k, (s, t) in enumerate(rows)], "ordinal long, source_lang string, target_lang string, source_text string, target_text string"))


def by_all_pairs(rows, min_freq, max_terms):
    n = Counter((a, b) for s, t in rows for a in set(s.split()) for b in set(t.split()))
    return sorted(((a, b, k) for (a, b), k in n.items() if k >= min_freq), key=lambda x: (-x[2], x[0], x[1]))[:max_terms]


@pytest.mark.parametrize("skew,min_freq,max_terms", [(0.0, 2, 50), (1.5, 2, 50), (1.5, 3, 7), (1.0, 1, 1), (3.0, 2, 500), (0.3, 9, 20), (1.0, 2, 0)])
def test_terms_are_the_first_of_all_pairs(spark, skew, min_freq, max_terms):
    r = random.Random(17)
    words = ["w" + "".join("abcdefghij"[int(d)] for d in f"{k:03}") for k in range(120)]
    weights = [1 / (k + 1) ** skew for k in range(120)]
    rows = [tuple(" ".join(r.choices(words, weights, k=r.randrange(1, 25))) for _ in "st") for _ in range(150)]
    assert [tuple(x) for x in analyze.terminology(units(spark, rows), min_freq, max_terms).collect()] == by_all_pairs(rows, min_freq, max_terms)


def exploded(node):
    """The most rows that a generator of a plan that ran gave."""
    own = [node.metrics().get("numOutputRows").get().value()] if node.nodeName() == "Generate" else []
    inner = [node.children().apply(k) for k in range(node.children().size())]
    inner += [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else []
    return max([0, *own, *map(exploded, inner)])


def test_pairs_of_rare_words_are_not_made(spark):
    letters = lambda k: "".join("abcdefghij"[int(d)] for d in f"{k:05}")
    rows = [(f"alpha beta {' '.join(letters(k // 2 * 200 + j) for j in range(200))}", f"gamma delta {' '.join(letters(k // 2 * 200 + j) for j in range(200))}") for k in range(40)]
    df = analyze.terminology(units(spark, rows), max_terms=4)
    assert [tuple(x) for x in df.collect()] == [(a, b, 40) for a in ("alpha", "beta") for b in ("delta", "gamma")]
    assert 40 * 202 <= exploded(df._jdf.queryExecution().executedPlan()) < 2 * 40 * 202  # all pairs: 40 * 202 ** 2
