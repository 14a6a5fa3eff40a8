import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bitloom.config import CleanConfig, ConvertOptions, OutputFormat, ValidationConfig
from bitloom.operators import analyze, clean, dedupe, expand, formats, pack, split, validate
from bitloom.schema import as_units


@pytest.fixture
def units(spark):
    def make(*rows, langs=("EN", "BG")):
        """Rows (source, target) or (source, target, source_lang, target_lang)."""
        full = [(k, str(k), *(r[2:] or langs), *r[:2]) for k, r in enumerate(rows)]
        return as_units(spark.createDataFrame(full, "ordinal long, tu_id string, source_lang string, target_lang string, source_text string, target_text string"))

    return make


def texts(df, *columns):
    return [tuple(x[c] for c in columns) if len(columns) > 1 else x[columns[0]] for x in df.orderBy("ordinal").collect()]


def cleaned(units, *sources, **cfg):
    rows = units(*((s, "x") for s in sources))
    return texts(rows.select("ordinal", clean.clean_text(F.col("source_text"), CleanConfig(**cfg)).alias("t")), "t")


def test_clean_steps(units):
    got = cleaned(units, "Price: 29.99, Quantity: 1,000", "The page at %1$s says: %2$d", "a   b c ", "ﬁ ½ é", "x\x0by\x7f", "<b>hi</b> <", "Visit https://example.com now", "Wait...  what?!!", "a ,b;c", "[1] {x} ${y} %s z")
    assert got == ["Price: 29.99, Quantity: 1,000", "The page at says:", "a b c", "fi 1⁄2 é", "xy", "hi <", "Visit https: //example. com now", "Wait. what? !", "a, b; c", "z"]


def test_clean_options(units):
    assert cleaned(units, '<a href="%3$s">P</a> <span title="{0}">x', "a {0} b", preserve_placeholders=True) == ["%3$sP {0}x", "a {0} b"]
    assert cleaned(units, "go https://x.y/z?q=1 now www.a.b", remove_urls=True) == ["go now"]
    assert cleaned(units, "mail a.b@c.org now", remove_emails=True) == ["mail now"]
    assert cleaned(units, "a@b.org +359 888 123 456 DE44500105175407324931 4111 1111 1111 1111", anonymize_pii=True, fix_punctuation=False, pii_mask=r"$1\X") == [r"$1\X $1\X $1\X $1\X"]
    assert cleaned(units, "john@example.com", anonymize_pii=True) == ["john@example. com"]
    assert cleaned(units, " é ", normalize_unicode=False, strip_whitespace=False, normalize_spaces=False) == [" é "]
    assert cleaned(units, "é", unicode_form="NFD") == ["é"]


def test_clean_filters(units):
    u = units(("same", "SAME "), ("", "x"), (None, "x"), ("{0}", "x"), ("a" * 50, "b" * 10), ("good one", "добро"), ("same", "same", "EN", "EN-GB"), ("x", "y", None, None), ("b", "c", "DE", "BG"))
    assert texts(clean.clean(u), "ordinal") == [5, 6, 7, 8]
    assert texts(clean.clean(u, CleanConfig(language_pairs=("en-bg",))), "ordinal") == [5]
    assert texts(clean.clean(u, CleanConfig(max_length_ratio=0, remove_untranslated=False, min_words=2)), "ordinal") == []
    assert texts(clean.clean(u, CleanConfig(lang_detect=True), lambda c: F.when(c == "c", "ru")), "ordinal") == [5, 6, 7]
    assert clean.clean(u).columns == u.columns and clean.clean(u.limit(0)).count() == 0


def test_validation(units):
    u = units(("Hello there", "Здравей там"), ("", ""), ("Hello", "Hello", "EN", "EN"), ("a {0} {10}", "a {0} б"), ("1 2 3 ab", "две три"), ("Hello world", "Zdravey svyat"), ("ab", "абвгдежзийклмн"), (None, "x", None, None))
    got = {x.ordinal: x for x in validate.validate(u).collect()}
    code = lambda k: ([f.code for f in got[k].errors], [f.code for f in got[k].warnings])
    assert code(0) == ([], []) and got[0].is_valid
    assert code(1) == (["empty_source", "empty_target"], [])
    assert code(2) == (["same_lang", "same_text"], [])
    assert code(3)[1] == ["noise_source", "noise_target", "placeholders_missing"] and got[3].warnings[2].value == "10"
    assert code(5) == ([], ["script"]) and code(6) == ([], ["alignment"])
    assert code(7)[0] == ["empty_source", "no_source_lang", "no_target_lang"]
    assert texts(validate.filter_valid(u, include_warnings=False), "ordinal") == [0]
    report = validate.report(u)
    assert (report["total"], report["valid"], report["invalid"]) == (8, 5, 3) and report["valid_pct"] == 62.5
    assert report["error_counts"]["Празен изходен текст"] == 2
    assert validate.report(u.limit(0)) == {"total": 0, "valid": 0, "invalid": 0, "valid_pct": 0.0, "error_counts": {}, "warning_counts": {}}


def test_noise_limit_is_a_double(units):
    u = units(("a" * 28 + "." * 12, "a" * 29 + "." * 11), langs=("EN", "FR"))
    assert [f.code for f in validate.validate(u).first().warnings] == ["noise_source"]


@pytest.mark.parametrize("a,b,want", [("", "", 0.0), ("1", "", 1.0), ("1 2", "2 1", 1.0), ("1 1 2", "1 2", 0.2), ("29.99", "29.99", 0.0), ("29.99", "30.00", 1.0), ("1 2 3", "1 3 2", 2 / 3)])
def test_number_mismatch(units, a, b, want):
    assert units((f"x {a}", f"y {b}")).select(validate.number_mismatch()).first()[0] == want


def test_quality(units):
    u = units(("same text", "same text"), ("good text", "добър текст"), ("", "x"), ("a", "b" * 5), ("n 1", "n 2"))
    assert texts(u.select("ordinal", validate.quality_score().alias("q")), "q") == [10.0, 100.0, 0.0, 40.0, 60.0]
    assert texts(validate.filter_valid(u, ValidationConfig(min_quality_score=60.0)), "ordinal") == [1, 4]


def test_exact_dedupe(units, spark):
    u = units(("Hello   world", "x"), ("Hello\nworld", "x"), ("Hello world", "x", "BG", "EN"), ("HELLO world", "x"), ("Hello world", "x", None, None), ("Hello world", "x", "", ""))
    assert texts(dedupe.dedupe_exact(u), "ordinal") == [0, 2, 3, 4]
    assert texts(dedupe.dedupe_exact(u, case_sensitive=False), "ordinal") == [0, 2, 4]
    assert dedupe.merge([u, u]).count() == 4 and dedupe.merge([u, u], dedupe=False).count() == 12
    two = u.withColumn("file_id", (F.col("ordinal") % 2).cast("string"))
    assert dedupe.dedupe_exact(two, within=["file_id"]).count() == 6


def brute_fuzzy(rows, t):
    grams = lambda s: {s[i : i + 3] for i in range(max(1, len(s) - 2))} if s else set()
    norm = lambda lang, s: grams(lang.upper() + "||" + " ".join(s.split()))
    sets = [(norm("EN", a), norm("BG", b)) for a, b in rows]
    near = lambda x, y: all(len(p & q) / len(p | q) >= t for p, q in zip(x, y))
    kept = []
    for k, s in enumerate(sets):
        if not any(near(sets[j], s) for j in kept):
            kept.append(k)
    return kept


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.85, 1.0])
def test_fuzzy_dedupe_against_brute_force(units, threshold):
    import random

    r = random.Random(3)
    base = ["the quick brown fox jumps over the lazy dog", "pack my box with five dozen liquor jugs", "a😀b", "ab", ""]
    rows = []
    for _ in range(60):
        s = list(r.choice(base))
        for _ in range(r.randrange(4)):
            if s:
                s[r.randrange(len(s))] = r.choice("xyz ")
        rows.append(("".join(s), "".join(s)[::-1] if r.random() < 0.8 else "other"))
    rows += [(rows[0][0], "entirely different")]
    want = brute_fuzzy(rows, threshold)
    assert texts(dedupe.dedupe_fuzzy(units(*rows), threshold, exact=True), "ordinal") == want
    assert texts(dedupe.dedupe_fuzzy(units(*rows), threshold), "ordinal") == want


def test_greedy_keeps_both_ends_of_a_chain(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (10, 12), (11, 12)], "a long, b long")
    assert sorted(x.ordinal for x in dedupe.greedy_removed(pairs).collect()) == [2, 4, 11, 12]


def test_stats(units):
    u = units(("one two", "uno"), ("one two", "uno"), ("three", "tres dos"), ("", "empty"))
    s = analyze.summary(u)
    assert (s["total_units"], s["valid_units"], s["empty_pairs"], s["duplicates_found"]) == (4, 3, 1, 1)
    assert s["source"] == {"avg_chars": 19 / 3, "avg_words": 5 / 3, "max_chars": 7, "max_words": 2, "min_chars": 5, "min_words": 1, "total_chars": 19, "total_words": 5}
    assert s["target"]["total_chars"] == 14 and s["target"]["min_chars"] == 3 and s["target"]["max_chars"] == 8 and s["target"]["total_words"] == 4
    assert s["language_pairs"] == {"EN-BG": 3} and s["readiness"]["token_estimates"]["llama3_estimated_tokens"] == math.floor(9 * 1.35)
    empty = analyze.summary(u.limit(0))
    assert empty["total_units"] == 0 and empty["source"]["avg_chars"] == 0.0 and empty["duplicates_found"] == 0


def test_terms_and_concordance(units):
    u = units(("Machine learning works", "Машинно обучение работи"), ("Deep learning", "Дълбоко обучение"), ("Deep 123 is", "no"))
    assert [tuple(x) for x in analyze.terminology(u).collect()] == [("learning", "обучение", 2)]
    assert [x.id for x in analyze.concordance(u, "LEARN").collect()] == ["0", "1"]
    assert [x.id for x in analyze.concordance(u, "обуч", 1).collect()] == ["0"]
    assert analyze.concordance(u, "").count() == analyze.concordance(u, "l.arn").count() == analyze.concordance(u, "e", 0).count() == 0
    assert texts(analyze.page(u, 1, 1), "ordinal") == [1]


def rows_of(u, fmt, **opts):
    return [x.asDict(True) for x in formats.records(u, fmt, ConvertOptions(**opts)).orderBy("ordinal", "side").drop("ordinal", "side").collect()]


def test_formats(units):
    u = units(("Hello", "Здравей"), ("Hi", "Хей", None, None))
    ask = "Translate the following text from {} to {}."
    assert rows_of(u, "alpaca") == [{"instruction": ask.format("EN", "BG"), "input": "Hello", "output": "Здравей"}, {"instruction": ask.format("source", "target"), "input": "Hi", "output": "Хей"}]
    assert rows_of(u, "alpaca", input_template="{src}")[0]["input"] == "{src}"
    assert rows_of(u, "dpo")[0] == {"prompt": ask.format("EN", "BG") + "\nHello", "chosen": "Здравей", "rejected": "Здр"}
    assert rows_of(u, "prompt_completion")[0] == {"prompt": "Translate from EN to BG: Hello", "completion": "Здравей"}
    assert [x["role"] for x in rows_of(u, "openai")[0]["messages"]] == ["system", "user", "assistant"] and rows_of(u, "openai") == rows_of(u, "chatml")
    assert rows_of(u, "sharegpt")[0]["conversations"][2] == {"from": "gpt", "value": "Здравей"}
    assert rows_of(u, "reasoning")[0]["messages"][2]["content"].endswith("'Hello'. Context: formal translation task.\n\nTranslation: Здравей")
    for template, want in (("{src}>{target_lang}{{}}", "EN>BG{}"), ("{src} {oops}", "{src} {oops}"), ("{", "{"), ("{0}", "{0}")):
        assert rows_of(u, "alpaca", instruction_template=template)[0]["instruction"] == want
    std = rows_of(u, "jsonl", include_id=True, include_metadata=True, source_key="s")
    assert std[1] == {"id": "1", "source_lang": None, "target_lang": None, "s": "Hi", "target": "Хей", "metadata": None}
    both = rows_of(u, "jsonl", bidirectional=True, language_pairs=("en-bg",))
    assert [(x["source_lang"], x["source"]) for x in both] == [("EN", "Hello"), ("BG", "Здравей")]
    assert formats.reverse(u).first().source_text == "Здравей"
    with pytest.raises(ValueError):
        formats.records(u, "xml")


def test_rejected_modes(units):
    text = "one two three four five six seven eight nine ten"
    u = units(("src", text), ("src", ""), ("src", "one"))
    get = lambda mode: [x["rejected"] for x in rows_of(u, "dpo", rejected_mode=mode)]
    assert get("copy_source") == ["src"] * 3 and get("empty") == [""] * 3 and get("unknown") == [text[:24], "", "o"]
    assert Counter(get("scramble")[0].split()) == Counter(text.split()) and get("scramble")[1:] == ["", "one"]
    noise = get("noise")
    assert len(noise[0]) == len(text) and 0 < sum(a != b for a, b in zip(noise[0], text)) <= 4 and noise[1:] == ["", "one"]
    repeated = get("repetition")
    assert len(repeated[0].split()) == 13 and not Counter(text.split()) - Counter(repeated[0].split()) and repeated[1:] == ["", "one"]
    assert get("noise") == noise and get("repetition") == repeated


FEW, MANY = (0.9, 0.05, 0.05), (0.8, 0.1, 0.1)


@pytest.mark.parametrize("n,ratios,want", [(n, FEW if len(w) == 3 else MANY, w[:3]) for n, w in {0: (0, 0, 0), 1: (1, 0, 0), 2: (2, 0, 0), 22: (20, 1, 1), 10: (8, 1, 1, "many"), 25: (20, 3, 2, "many")}.items()])
def test_split_sizes(spark, n, ratios, want):
    assert split.split_sizes(n, *ratios) == want
    got = split.split_counts(split.split(spark.range(n).withColumnRenamed("id", "ordinal"), ratios))
    assert tuple(got[k] for k in split.NAMES) == want


@pytest.mark.parametrize("ratios", [(math.nan, 0.5, 0.5), (0.9, 0.05, 0.0), (1.1, -0.1, 0.0)])
def test_bad_ratios(ratios):
    with pytest.raises(ValueError):
        split.split_sizes(3, *ratios)


def test_stratified_split(units):
    u = units(*([("a", "b")] * 10), *([("a", "b", "EN", None)] * 10))
    got = split.split(u, (0.8, 0.1, 0.1), strata=["source_lang", "target_lang"])
    assert Counter((x.target_lang, x.split) for x in got.collect()) == {(t, s): n for t in ("BG", None) for s, n in (("train", 8), ("validation", 1), ("test", 1))}
    other = split.split(u, (0.8, 0.1, 0.1), seed=1)
    assert {x.ordinal for x in other.where("split = 'test'").collect()} != {x.ordinal for x in split.split(u, (0.8, 0.1, 0.1)).where("split = 'test'").collect()}


def test_pack(units):
    u = units(("Line 1", "Ред 1"), ("Line 2", "Ред 2"), ("x" * 30, "y"), ("a", "b", "DE", "FR"), ("c", "d"))
    assert texts(pack.pack(u, 1000), "source_text") == ["Line 1\nLine 2\n" + "x" * 30 + "\na\nc"]
    assert texts(pack.pack(u, 22), "tu_id", "source_lang", "source_text") == [("0", "EN", "Line 1\nLine 2"), ("2", "EN", "x" * 30), ("3", "DE", "a\nc")]
    assert texts(pack.pack(u, 1000, ["source_lang"]), "tu_id") == ["0", "3"]
    assert pack.pack(u.limit(0)).count() == 0


def test_expansion(spark):
    e = spark.createDataFrame([(0, "BG", [("EN", "e"), ("BG", "b"), ("DE", "d")]), (1, "*ALL*", [("EN", "e"), ("BG", "b")]), (2, "EN", [("EN", "e")]), (3, None, [("EN", "e")]), (4, "EN", [])], "ordinal long, header_lang string, segments array<struct<lang:string,text:string>>")
    plain = texts(expand.expand(e), "source_lang", "target_lang", "source_text", "target_text")
    assert plain == [("BG", "EN", "b", "e"), ("EN", "BG", "e", "b"), ("EN", "EN", "", "e"), (None, None, "", ""), (None, None, "", "")]
    full = texts(expand.expand(e, multilingual=True), "source_lang", "target_lang")
    assert full[:6] == [("EN", "BG"), ("EN", "DE"), ("BG", "EN"), ("BG", "DE"), ("DE", "EN"), ("DE", "BG")] and full[6:] == [x[:2] for x in plain[1:]]


def test_more_pairs_than_ordinals_fail(spark):
    for n in (64, 65):
        e = spark.createDataFrame([(k, "EN", [(f"L{i:02}", "x") for i in range(n)]) for k in range(2)], "ordinal long, header_lang string, segments array<struct<lang:string,text:string>>")
        if n == 64:
            assert expand.expand(e, multilingual=True).select("ordinal").distinct().count() == 2 * 64 * 63
        else:
            with pytest.raises(Exception, match="more than 4096 pairs"):
                expand.expand(e, multilingual=True).collect()


def test_many_numbers_in_a_text(units):
    import random
    from collections import Counter

    r = random.Random(8)
    rows = []
    for n in (0, 1, 5, 10_000):
        a = [str(r.randrange(n + 1)) for _ in range(n)]
        b = a[:]
        r.shuffle(b)
        rows += [(" ".join(a), " ".join(b)), (" ".join(a), " ".join(b[: n // 2] + [str(r.randrange(n + 1)) for _ in range(n // 3)])), (" ".join(a), " ".join(a))]
    want = []
    for s, t in rows:
        a, b = s.split(), t.split()
        apart = sum(abs(Counter(a)[v] - Counter(b)[v]) for v in {*a, *b}) if len(a) < 100 else sum(((Counter(a) - Counter(b)) + (Counter(b) - Counter(a))).values())
        moved = sum(x != y for x, y in zip(a, b)) / len(a) if a else 0
        want.append(0.0 if not a and not b else 1.0 if not a or not b else apart / (len(a) + len(b)) if apart else moved)
    got = [x.m for x in units(*rows).select("ordinal", validate.number_mismatch().alias("m")).orderBy("ordinal").collect()]
    assert got == want
