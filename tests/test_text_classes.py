import unicodedata

import pytest
from pyspark.sql import functions as F

from bitloom.functions import text as T
from bitloom.operators import clean
from bitloom.plans.views import shifted


@pytest.fixture(scope="module")
def characters(spark):
    every = [chr(k) for k in (*range(0xD800), *range(0xE000, 0x11000), 0x1D7FF, 0x1F600, 0x10FFFF)]
    return spark.createDataFrame([(c,) for c in every], "c string").cache()


def test_each_character_is_counted_stripped_and_normalised_as_by_single_matches(characters):
    w = F.concat("c", F.lit("a\n Ж7"), "c", "c")
    was = F.regexp_replace(w, rf"(?U)^{T.SPACE}+|{T.SPACE}+\z", "")
    assert characters.where(T.strip(w) != was).count() == 0
    for x in (T.LETTER, "[A-Za-z]", r"[\x{400}-\x{4FF}]"):
        assert characters.where(T.count_of(w, x) != F.regexp_count(w, F.lit(x))).count() == 0
    for form in ("NFC", "NFKC", "NFD"):
        got = characters.select("c", T.unicode_form(F.concat(F.lit("e"), F.col("c")), form).alias("x")).collect()
        assert [x.c for x in got if x.x != unicodedata.normalize(form, "e" + x.c)] == []
        both = characters.select("c", T.unicode_form(F.concat("c", F.lit("=\u0338e\u0301é\n\u0301o"), "c", F.lit("\u0323\u0302 x\n\u0338"), "c"), form).alias("x")).collect()
        assert [x.c for x in both if x.x != unicodedata.normalize(form, f"{x.c}=\u0338e\u0301é\n\u0301o{x.c}\u0323\u0302 x\n\u0338{x.c}")] == []


def test_vowels_shift_as_by_translate(characters):
    w = F.concat(F.lit("aeiou uoiea xx "), "c", F.lit("AEaa"))
    for by in ("eioua", "uaeio"):
        assert characters.where(shifted(w, "aeiou", by) != F.translate(w, "aeiou", by)).count() == 0


def test_addresses_are_found_as_by_the_pattern_alone(spark):
    d = spark.createDataFrame([(x,) for x in ("a@b.cd e", "x @ y", "", "none", "é.a@b-c.def@g.hi")], "c string")
    assert d.where(clean.without_emails(F.col("c"), "_") != F.regexp_replace("c", clean.EMAIL, "_")).count() == 0


def test_costly_patterns_see_no_whole_text(spark):
    """A negated class of ten ranges takes 950 ns a byte; the normal form's may run over what isn't ASCII only."""
    plan = spark.range(1).select(T.unicode_form(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert "regexp_replace" in plan and "regexp_extract_all" in plan  # and Python gets parts of texts
    assert "regexp_replace" not in spark.range(1).select(T.strip(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()


def test_punctuation_and_control_characters_change_as_by_the_replacements_alone(spark, characters):
    import itertools
    import random

    r = random.Random(6)
    some = [*".,;:!?", " ", "\n", "\x1c", "\x85", " ", "a", "7", "٣", "Ж", "\x07", "<", "{"]
    texts = ["".join(x) for n in range(4) for x in itertools.product(some, repeat=n)] + ["".join(r.choices(some, k=r.randrange(4, 30))) for _ in range(4000)]
    each = F.explode(F.array(*(F.concat(F.lit(a), F.col("c"), F.lit(b)) for a in (".", "!", "x") for b in (".", "!", "x"))))
    d = spark.createDataFrame([(x,) for x in texts], "c string").union(characters.select(each))
    c = F.col("c")
    was = F.regexp_replace(c, r"([.!?])\1+", "$1")
    was = F.regexp_replace(was, rf"(?U){T.SPACE}+([.,;:!?])", "$1")
    was = F.regexp_replace(was, r"(?U)([;:!?])(?=[^\s\x1c-\x1f])|([.,])(?=[^\x1c-\x1f\s\d])", "$1$2 ")
    assert d.where(clean.fix_punctuation(c) != was).count() == 0
    assert d.where(clean._normal(c, clean.CleanConfig(normalize_unicode=False)) != F.regexp_replace(c, clean.CONTROL, "")).count() == 0
    assert d.where(F.trim(T.collapse(c)) != T.strip(T.collapse(c))).count() == 0


def test_targets_are_not_searched_where_the_source_fails(spark):
    """Nor are texts punctuated that have no misplaced mark."""
    from bitloom.schema import as_units

    u = as_units(spark.createDataFrame([(k, "EN", "BG", s, t) for k, (s, t) in enumerate([("x" * 20_000, "y"), ("of the", "и на"), ("de la", "y"), ("abc", "и да , ."), ("<b>", "y"), ("a", "{0}"), ("a", "b" * 9)])], "ordinal long, source_lang string, target_lang string, source_text string, target_text string"))
    asked = []
    out = clean.clean(u, clean.CleanConfig(lang_detect=True), lambda c: asked.append(c) or F.when(c.contains("la"), "fr"))
    assert [(x.ordinal, x.target_text) for x in out.orderBy("ordinal").collect()] == [(1, "и на"), (3, "и да, .")] and len(asked) == 2
    plan = out._jdf.queryExecution().optimizedPlan().toString()  # from its end to its beginning
    first, last = plan.rindex("<= 10000"), plan.index("<= 10000")
    assert first > plan.rindex("Generate", 0, first) > last
