"""DuckDB SQL for the queries of plans/queries.py.

RE2 has no look-ahead and no back-references, so those patterns are written out: repeated
marks one mark at a time, and a space after a mark by two passes, since matches overlap.

Fuzzy pairs are found here by comparing all of about one size, which only small tables allow; the compatibility
forms of Unicode have no SQL.
"""

from __future__ import annotations

from ..functions.language import COMMON
from ..operators import clean as C
from ..operators.validate import MESSAGES
from .views import ENTRIES, ENTRIES_BY_RANK, UNITS_DOC, UNITS_LINE, UNITS_PAGE, UNITS_TURN

WS = r"[\s\x0b\x1c-\x1f]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(e: str, pattern: str, to: str) -> str:
    return f"regexp_replace({e}, {q(pattern)}, {q(to)}, 'g')"


def strip(e: str) -> str:
    return sub(e, rf"^{WS}+|{WS}+$", "")


def collapse(e: str) -> str:
    return sub(e, rf"{WS}+", " ")


def punctuation(e: str) -> str:
    for mark in ".!?":
        e = sub(e, rf"[{mark}]{{2,}}", mark)
    e = sub(e, rf"{WS}+([.,;:!?])", r"\1")
    for _ in range(2):
        e = sub(e, r"([;:!?])([^\s\x0b\x1c-\x1f])", r"\1 \2")
    for _ in range(2):
        e = sub(e, r"([.,])([^\d\s\x0b\x1c-\x1f])", r"\1 \2")
    return e


def re2(java: str) -> str:
    """A pattern of the operators without Java's flag for Unicode classes."""
    return java.replace("(?iU)", "(?i)").replace("(?U)", "")


PII = tuple(re2(x) for x in (C.EMAIL, C.IBAN, C.CARD, C.PHONE))


def clean_text(e: str, *, tags="space", placeholders=True, urls=False, emails=False, punct=True, pii=False) -> str:
    e = strip(e)
    e = sub(e, C.CONTROL, "")
    if tags == "space":
        e = sub(e, "<[^>]+>", " ")
    elif tags == "keep":
        e = f"array_to_string(list_transform(regexp_extract_all({e}, '<[^>]+>|[^<]+|<'), lambda p: CASE WHEN regexp_matches(p, '^<[^>]+>') THEN array_to_string(regexp_extract_all(p, {q(C.TOKENS)}), ' ') ELSE p END), '')"
    if placeholders:
        e = sub(e, C.PLACEHOLDERS, " ")
    if urls:
        e = sub(e, re2(C.URL), " ")
    if emails:
        e = sub(e, C.EMAIL, " ")
    if punct:
        e = punctuation(e)
    if pii:
        for p in PII:
            e = sub(e, p, "[REDACTED]")
    return strip(collapse(e))


def cleaned(source: str = "units", **how) -> str:
    """CTEs: kept (all filters of the default settings) over the units of source."""
    return f"""raw AS (SELECT * FROM {source} WHERE source_text <> '' AND target_text <> ''
  AND NOT (coalesce(source_lang, '') <> '' AND coalesce(target_lang, '') <> '' AND lower(source_lang)[:2] <> lower(target_lang)[:2] AND lower({strip('source_text')}) = lower({strip('target_text')}))),
done AS (SELECT * EXCLUDE (source_text, target_text), {clean_text('source_text', **how)} AS source_text, {clean_text('target_text', **how)} AS target_text FROM raw),
kept AS (SELECT * FROM done WHERE source_text <> '' AND target_text <> '' AND length(source_text) <= 10000 AND length(target_text) <= 10000
  AND greatest(length(source_text), length(target_text))::DOUBLE / greatest(least(length(source_text), length(target_text)), 1) <= 3.0)"""


RATIO = "(greatest(length(source_text), length(target_text))::DOUBLE / greatest(least(length(source_text), length(target_text)), 1))"
LETTER = r"[\p{L}\p{Nl}\p{No}]"


def count(e: str, pattern: str) -> str:
    return f"len(regexp_extract_all({e}, {q(pattern)}))"


def noise(c: str) -> str:
    return f"(1.0::DOUBLE - {count(c, LETTER)}::DOUBLE / length({c}))"


NUMBERS = """nums AS (SELECT *, regexp_extract_all(source_text, '\\d+') AS a, regexp_extract_all(target_text, '\\d+') AS b FROM units),
apart AS (SELECT *, CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE list_sum(list_transform(list_distinct(list_concat(a, b)), lambda v: abs(len(list_filter(a, lambda x: x = v)) - len(list_filter(b, lambda x: x = v))))) END AS m FROM nums),
mism AS (SELECT *, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 0.0::DOUBLE WHEN len(a) = 0 OR len(b) = 0 THEN 1.0::DOUBLE WHEN m > 0 THEN m::DOUBLE / (len(a) + len(b))
  ELSE len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i]))::DOUBLE / len(a) END AS mismatch FROM apart)"""
CYR, LAT = count("target_text", r"[\x{400}-\x{4FF}]"), count("target_text", "[a-zA-Z]")
SCRIPT = f"(lower(coalesce(target_lang, ''))[:2] IN ('bg', 'ru', 'mk', 'uk', 'sr') AND {LAT} > {CYR} AND {LAT} > 3)"
SCORE = f"""CASE WHEN source_text = '' OR target_text = '' THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE
  - CASE WHEN {RATIO} > 3.0 THEN least(30.0::DOUBLE, ({RATIO} - 3.0::DOUBLE) * 10) ELSE 0.0::DOUBLE END - mismatch * 40.0::DOUBLE
  - CASE WHEN lower({strip('source_text')}) = lower({strip('target_text')}) AND source_lang IS DISTINCT FROM target_lang THEN 50.0::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN {SCRIPT} THEN 40.0::DOUBLE ELSE 0.0::DOUBLE END)) END"""
PH = lambda c: f"regexp_extract_all({c}, '\\{{(\\d+)\\}}', 1)"
FLAGS = {
    "empty_source": "source_text = ''",
    "empty_target": "target_text = ''",
    "no_source_lang": "coalesce(source_lang, '') = ''",
    "no_target_lang": "coalesce(target_lang, '') = ''",
    "same_lang": "coalesce(source_lang, '') <> '' AND source_lang = target_lang",
    "same_text": f"source_text <> '' AND target_text <> '' AND {strip('source_text')} = {strip('target_text')}",
    "noise_source": f"source_text <> '' AND {noise('source_text')} > 0.3",
    "noise_target": f"target_text <> '' AND {noise('target_text')} > 0.3",
    "numbers": "mismatch > 1.0",
    "placeholders_missing": f"len(list_filter({PH('source_text')}, lambda x: NOT list_contains({PH('target_text')}, x))) > 0",
    "placeholders_extra": f"len(list_filter({PH('target_text')}, lambda x: NOT list_contains({PH('source_text')}, x))) > 0",
    "alignment": f"source_text <> '' AND target_text <> '' AND {RATIO} > 5.0",
    "script": SCRIPT,
}
ERRORS = ("empty_source", "empty_target", "no_source_lang", "no_target_lang", "same_lang", "same_text", "numbers")
FLAGGED = f"flags AS (SELECT *, {', '.join(f'({v}) AS f_{k}' for k, v in FLAGS.items())} FROM mism)"
CODES = lambda ks: "concat_ws(',', " + ", ".join(f"CASE WHEN f_{k} THEN '{k}' END" for k in ks) + ")"
WARNINGS = tuple(k for k in FLAGS if k not in ERRORS)
VALID = "NOT (" + " OR ".join(f"f_{k}" for k in ERRORS) + ")"
CLEAR = "NOT (" + " OR ".join(f"f_{k}" for k in WARNINGS) + ")"

NORM = lambda c: strip(collapse(c))
KEY = f"coalesce(source_lang, ''), coalesce(target_lang, ''), {NORM('source_text')}, {NORM('target_text')}"
KEY_CI = f"coalesce(source_lang, ''), coalesce(target_lang, ''), lower({NORM('source_text')}), lower({NORM('target_text')})"
WORDS = lambda c: count(c, r"[^\s\x0b\x1c-\x1f]+")
SIZES = ", ".join(f"{f}({e}) AS {side}_{u}_{n}" for side in ("source", "target") for u, e in (("chars", f"length({side}_text)"), ("words", WORDS(f"{side}_text"))) for n, f in (("sum", "sum"), ("min", "min"), ("max", "max"), ("avg", "avg")))
STATS = f"stats AS (SELECT count(*)::BIGINT AS total_units, count(*) FILTER (source_text <> '' AND target_text <> '')::BIGINT AS valid_units FROM units), sizes AS (SELECT {SIZES} FROM units WHERE source_text <> '' AND target_text <> '')"
STATS_COLUMNS = "total_units, valid_units, total_units - valid_units AS empty_pairs, " + ", ".join(
    f"coalesce({s}_{u}_{n}, 0)::{'DOUBLE' if n == 'avg' else 'BIGINT'} AS {s}_{u}_{n}" for s in ("source", "target") for u in ("chars", "words") for n in ("sum", "min", "max", "avg")
)
TOTAL_WORDS = "(coalesce(source_words_sum, 0) + coalesce(target_words_sum, 0))::DOUBLE"
CLASSES = f"""sides AS (SELECT ordinal, upper(coalesce(source_lang, '')) || '||' || {NORM('source_text')} AS x_s, upper(coalesce(target_lang, '')) || '||' || {NORM('target_text')} AS x_t FROM units),
reps AS (SELECT x_s, x_t, min(ordinal) AS ordinal FROM sides GROUP BY x_s, x_t)"""


def packed(limit: int) -> str:
    return f"""WITH RECURSIVE {UNITS_TURN},
n AS (SELECT *, length(source_text) + length(target_text) AS size, row_number() OVER (ORDER BY ordinal) AS k FROM units),
fold AS (SELECT k, ordinal AS block, size AS used FROM n WHERE k = 1 UNION ALL
  SELECT n.k, CASE WHEN used + size > {limit} THEN n.ordinal ELSE block END, CASE WHEN used + size > {limit} THEN size ELSE used + size END FROM fold JOIN n ON n.k = fold.k + 1)
SELECT block AS ordinal, min_by(tu_id, n.ordinal) AS tu_id, min_by(source_lang, n.ordinal) AS source_lang, min_by(target_lang, n.ordinal) AS target_lang, string_agg(source_text, chr(10) ORDER BY n.ordinal) AS source_text, string_agg(target_text, chr(10) ORDER BY n.ordinal) AS target_text
FROM fold JOIN n ON fold.k = n.k GROUP BY block"""


ASK = "'Translate the following text from ' || source_lang || ' to ' || target_lang || '.'"


def chat(kind: str, body: str, *turns: tuple[str, str]) -> str:
    return "[" + ", ".join(f"{{'{kind}': '{who}', '{body}': {what}}}" for who, what in turns) + "]"


def messages(kind: str, turns: str) -> str:
    """Chats are compared turn by turn."""
    role, body = ("from", "value") if kind == "conversations" else ("role", "content")
    return f"SELECT ordinal, k - 1 AS turn, c[k].\"{role}\" AS role, c[k].{body} AS content FROM (SELECT ordinal, {turns} AS c, unnest([1, 2, 3]) AS k FROM units)"


def split_size(k: int, ratios: tuple[float, float, float] = (0.9, 0.05, 0.05)) -> str:
    """Rows of split k of n, by the largest remainders."""
    e = [f"(n * {r}::DOUBLE)" for r in ratios]
    d = [f"floor({x})" for x in e]
    p = [f"({x} - {y})" for x, y in zip(e, d)]
    return f"({d[k]} + CASE WHEN " + " + ".join(f"({p[j]} > {p[k]}{f' OR {p[j]} = {p[k]}' if j < k else ''})::INT" for j in range(3) if j != k) + f" < n - {d[0]} - {d[1]} - {d[2]} THEN 1 ELSE 0 END)"


def split_sql(ratios: tuple[float, float, float], by: str) -> str:
    size = lambda k: split_size(k, ratios)
    return f"""WITH {UNITS_DOC}, r AS (SELECT *, row_number() OVER ({by} ORDER BY md5('42:' || ordinal::VARCHAR), ordinal) AS k, count(*) OVER ({by})::DOUBLE AS n FROM units)
SELECT ordinal, CASE WHEN k <= {size(0)} THEN 'train' WHEN k <= {size(0)} + {size(1)} THEN 'validation' ELSE 'test' END AS split FROM r"""


def draw(i: str, what: str) -> str:
    """The random number of formats.rejected()."""
    return f"('0x' || substr(md5('42:' || ordinal::VARCHAR || ':' || ({i})::VARCHAR || ':{what}'), 1, 8))::BIGINT"


_WORDS = "list_filter(regexp_split_to_array(target_text, '[\\s\\x0b\\x1c-\\x1f]+'), lambda w: w <> '')"


def rejected(mode: str) -> str:
    """dpo records with texts drawn at random."""
    if mode == "scramble":
        text = f"array_to_string(list_transform(list_sort(list_transform(range(1, len(ws) + 1), lambda i: {{'k': {draw('i - 1', 'place')}, 'i': i, 'w': ws[i]}})), lambda x: x.w), ' ')"
    elif mode == "noise":  # of the characters put at a place, the last stays
        put = f"list_transform(range(1, floor(length(target_text) * 0.1)::INT + 1), lambda i: {{'p': {draw('i', 'at')} % length(target_text) + 1, 'c': chr((33 + {draw('i', 'char')} % 94)::INT)}})"
        text = "CASE WHEN length(target_text) < 10 THEN target_text ELSE array_to_string(list_transform(range(1, length(target_text) + 1), lambda p: coalesce(list_last(list_filter(puts, lambda x: x.p = p)).c, substr(target_text, p, 1))), '') END"
        return f"{_turn}, w AS (SELECT *, {put} AS puts FROM units) SELECT ordinal, 0 AS side, {ASK} || chr(10) || source_text AS prompt, target_text AS chosen, {text} AS rejected FROM w"
    else:
        extra = f"list_transform(range(1, floor(len(ws) * 0.3)::INT + 1), lambda i: {{'p': {draw('i', 'before')} % (len(ws) + 1), 'own': 0, 'i': i, 'w': ws[{draw('i', 'word')} % len(ws) + 1]}})"
        own = "list_transform(range(1, len(ws) + 1), lambda i: {'p': i - 1, 'own': 1, 'i': i - 1, 'w': ws[i]})"
        text = f"CASE WHEN len(ws) < 2 THEN target_text WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(list_transform(list_sort(list_concat({extra}, {own})), lambda x: x.w), ' ') END"
    return f"{_turn}, w AS (SELECT *, {_WORDS} AS ws FROM units) SELECT ordinal, 0 AS side, {ASK} || chr(10) || source_text AS prompt, target_text AS chosen, {text} AS rejected FROM w"


def xml_text(e: str) -> str:
    """A text after XML: line ends are \n, forbidden characters gone, outer space too."""
    e = f"replace(replace({e}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return strip(sub(e, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))


#: Segments of the memories that plans/roundtrips.py writes; an empty one is none.
MEMORIES = f"""docs AS (SELECT *, coalesce(text, '') AS s, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents),
segs AS (SELECT k, doc_id, source, 0 AS i, upper(coalesce(lang, 'zz')) AS lang, {xml_text('s')} AS text FROM docs UNION ALL SELECT k, doc_id, source, 1, 'XX', {xml_text("translate(s, 'aeiou', 'eioua')")} FROM docs
  UNION ALL SELECT k, doc_id, source, 2, 'YY', {xml_text("translate(s, 'aeiou', 'uaeio')")} FROM docs),
lists AS (SELECT k, doc_id, source, coalesce(list({{'lang': lang, 'text': text}} ORDER BY i) FILTER (text <> ''), []) AS xs FROM segs GROUP BY ALL),
firsts AS (SELECT *, CASE WHEN list_contains(list_transform(xs, lambda x: x.lang), 'EN') THEN list_filter(xs, lambda x: x.lang = 'EN')[1] ELSE xs[1] END AS a FROM lists),
pairs AS (SELECT *, list_filter(xs, lambda x: x.lang <> a.lang)[1] AS b FROM firsts),
units AS (SELECT k AS ordinal, doc_id::VARCHAR AS tu_id, a.lang AS source_lang, b.lang AS target_lang, coalesce(a.text, '') AS source_text, coalesce(b.text, '') AS target_text, coalesce(source, '') AS meta_source, 'n' || doc_id AS notes FROM pairs)"""
TMX_UNIT = "ordinal, tu_id, source_lang, target_lang, source_text, target_text, meta_source, notes"


def counted(*named: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS name, ({what})::BIGINT AS n" for name, what in named)


ALL_VALUES = f"""words AS (SELECT ordinal, list_distinct(regexp_extract_all(lower(source_text), '[^\\s\\x0b\\x1c-\\x1f]+')) AS wa, list_distinct(regexp_extract_all(lower(target_text), '[^\\s\\x0b\\x1c-\\x1f]+')) AS wb FROM units),
given AS (SELECT *, {SCORE} AS score, len(list_intersect(wa, wb))::DOUBLE / greatest(len(wa), 1) AS common FROM flags JOIN words USING (ordinal))"""
PERCENT = lambda e: f"printf('%.1f%%', round_even({e} * 100, 1))"
ONLY = lambda a, b: f"array_to_string(list_sort(list_distinct(list_filter({PH(a)}, lambda x: NOT list_contains({PH(b)}, x)))), ', ')"
VALUES = {
    **{k: ("f_" + k, "NULL") for k in ("empty_source", "empty_target", "no_source_lang", "no_target_lang", "same_lang", "same_text")},
    "noise_source": ("f_noise_source", PERCENT(noise("source_text"))),
    "noise_target": ("f_noise_target", PERCENT(noise("target_text"))),
    "numbers": ("mismatch > 0.1", f"{PERCENT('mismatch')} || ' (src=[' || array_to_string(a[1:5], ', ') || '], tgt=[' || array_to_string(b[1:5], ', ') || '])'"),
    "placeholders_missing": ("f_placeholders_missing", ONLY("source_text", "target_text")),
    "placeholders_extra": ("f_placeholders_extra", ONLY("target_text", "source_text")),
    "alignment": ("f_alignment", f"printf('%.1f', round_even({RATIO}, 1))"),
    "similar_words": ("len(wa) > 0 AND len(wb) > 0 AND common < 0.5", PERCENT("common")),
    "script": ("f_script", f"'cyr=' || {CYR} || ', lat=' || {LAT}"),
    "quality": ("score < 60", "printf('%.1f', round_even(score, 1))"),
}
FOUND = lambda names: " UNION ALL ".join(f"SELECT ordinal, '{k}' AS code, v AS value, concat_ws(': ', {q(MESSAGES[k])}, v) AS message FROM (SELECT ordinal, {VALUES[k][1]} AS v FROM given WHERE {VALUES[k][0]})" for k in names)
FUZZY = f"""{CLASSES}, runs AS (SELECT ordinal, x_s, x_t, list_distinct(CASE WHEN length(x_s) < 3 THEN [x_s] ELSE list_transform(range(1, length(x_s) - 1), lambda i: substr(x_s, i, 3)) END) AS g_s,
  list_distinct(CASE WHEN length(x_t) < 3 THEN [x_t] ELSE list_transform(range(1, length(x_t) - 1), lambda i: substr(x_t, i, 3)) END) AS g_t FROM reps),
grams AS (SELECT ordinal, 's' AS side, unnest(g_s) AS g FROM runs UNION ALL SELECT ordinal, 't', unnest(g_t) FROM runs),
ids AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS id FROM (SELECT DISTINCT g FROM grams)),
sets AS (SELECT ordinal, bitstring_agg(id, 0, 262143) FILTER (side = 's') AS s, bitstring_agg(id, 0, 262143) FILTER (side = 't') AS t, count(*) FILTER (side = 's') AS n, count(*) FILTER (side = 't') AS m FROM grams JOIN ids USING (g) GROUP BY ordinal),
met AS (SELECT x.ordinal AS a, y.ordinal AS b, x.t AS ta, y.t AS tb, x.m AS ma, y.m AS mb, x.n + y.n AS n, bit_count(x.s & y.s)::DOUBLE AS shared FROM sets x JOIN sets y ON x.ordinal < y.ordinal
  AND least(x.n, y.n) >= 0.85 * greatest(x.n, y.n) AND least(x.m, y.m) >= 0.85 * greatest(x.m, y.m)),
one AS (SELECT a, b, shared / (n - shared) AS source_jaccard, bit_count(ta & tb)::DOUBLE AS t, ma + mb AS m FROM met WHERE shared / (n - shared) >= 0.85),
near AS (SELECT a, b, source_jaccard, t / (m - t) AS target_jaccard FROM one WHERE t / (m - t) >= 0.85)"""
#: Nodes in order; each takes the state so far, a list of those that stay.
GREEDY = """order_ AS (SELECT x, row_number() OVER (ORDER BY x) AS k, list_filter(list(y), lambda v: v IS NOT NULL) AS back FROM (SELECT b AS x, a AS y FROM near UNION ALL SELECT a, NULL FROM near) GROUP BY x),
walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS stays, []::BIGINT[] AS gone UNION ALL
  SELECT o.k, CASE WHEN len(list_intersect(o.back, stays)) = 0 THEN list_append(stays, o.x) ELSE stays END, CASE WHEN len(list_intersect(o.back, stays)) = 0 THEN gone ELSE list_append(gone, o.x) END FROM walk JOIN order_ o ON o.k = walk.k + 1)"""


def language_counts(e: str) -> str:
    pattern = lambda x: q(r"(?:^|[^\p{L}])(?:" + COMMON[x] + r")(?:$|[^\p{L}])")
    return "list_sort([" + ", ".join(f"{{'n': -len(regexp_extract_all(lower({e}), {pattern(x)})), 'lang': '{x}'}}" for x in sorted(COMMON)) + "])[1]"


UNIT = "ordinal, tu_id, source_lang, target_lang, source_text, target_text"
_doc, _turn, _page = f"WITH {UNITS_DOC}", f"WITH {UNITS_TURN}", f"WITH {UNITS_PAGE}"
_flagged = f"{_doc}, {NUMBERS}, {FLAGGED}"
_texts = lambda how: f"SELECT ordinal, {clean_text('source_text', **how)} AS source_text, {clean_text('target_text', **how)} AS target_text FROM units"

_standard = f"{_doc} SELECT tu_id AS id, source_lang, target_lang, source_text AS source, target_text AS target FROM units"
_detected = f"u AS (SELECT *, {language_counts('source_text')} AS best FROM units)"

ORACLES: dict[str, str] = {
    "read_tmx": f"WITH {MEMORIES} SELECT {TMX_UNIT} FROM units",
    "read_tmx_expanded": f"""WITH {MEMORIES}, each AS (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM lists WHERE len(xs) > 2), two AS (SELECT *, unnest(range(1, len(xs) + 1)) AS j FROM each)
SELECT k * 4096 + (i - 1) * (len(xs) - 1) + CASE WHEN j > i THEN j - 2 ELSE j - 1 END AS ordinal, doc_id::VARCHAR AS tu_id, xs[i].lang AS source_lang, xs[j].lang AS target_lang, xs[i].text AS source_text, xs[j].text AS target_text, coalesce(source, '') AS meta_source, 'n' || doc_id AS notes FROM two WHERE i <> j
UNION ALL SELECT ordinal * 4096, {TMX_UNIT[9:]} FROM units JOIN lists ON k = ordinal WHERE len(xs) <= 2""",
    "tmx_headers": "SELECT (row_number() OVER (ORDER BY f) - 1)::INT AS file_index, 'EN' AS source_lang, 't' AS creation_tool, NULL::VARCHAR AS creation_date, 'block' AS seg_type, 'v' AS prop_k FROM (SELECT DISTINCT doc_id // 64 AS f FROM documents)",
    "tmx_repairs": f"SELECT count(*)::BIGINT AS entries, 0::BIGINT AS broken, sum((doc_id % 7 = 0)::INT + 3 * {count("coalesce(text, '')", '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')})::BIGINT AS repaired FROM documents",
    **dict.fromkeys(("sink_jsonl", "sink_json", "sink_csv", "sink_tsv", "sink_parquet"), _standard),
    "sink_splits": f"""WITH {UNITS_TURN}, r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || ordinal::VARCHAR || ':0'), ordinal) AS k, count(*) OVER ()::DOUBLE AS n FROM units),
x AS (SELECT {ASK} AS instruction, source_text AS input, target_text AS output, CASE WHEN k <= {split_size(0, (0.8, 0.1, 0.1))} THEN 'train' WHEN k <= {split_size(0, (0.8, 0.1, 0.1))} + {split_size(1, (0.8, 0.1, 0.1))} THEN 'validation' ELSE 'test' END AS split FROM r)
SELECT *, count(*) OVER (PARTITION BY split)::BIGINT AS size FROM x""",
    "run_pipeline": f"WITH {MEMORIES}, {cleaned()}, uniq AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY ordinal) = 1), nums AS (SELECT *, regexp_extract_all(source_text, '\\d+') AS a, regexp_extract_all(target_text, '\\d+') AS b FROM uniq), {NUMBERS.partition(',' + chr(10))[2]}, {FLAGGED}, c AS (SELECT count(*) AS n FROM uniq), "
    + f"s AS (SELECT n, {split_size(0)} AS train, {split_size(1)} AS validation FROM (SELECT n::DOUBLE AS n FROM c)) "
    + counted(("input", "SELECT count(*) FROM units"), ("after_clean", "SELECT count(*) FROM kept"), ("after_dedupe", "SELECT n FROM c"), ("train", "SELECT train FROM s"), ("validation", "SELECT validation FROM s"), ("test", "SELECT n - train - validation FROM s"), ("valid", f"SELECT count(*) FROM flags WHERE {VALID}"), ("invalid", f"SELECT count(*) FROM flags WHERE NOT {VALID}"), ("duplicates_found", "SELECT count(*) - count(DISTINCT (source_lang, target_lang, source_text, target_text)) FROM uniq"), ("empty_pairs", "SELECT 0")),
    "merge_files": f"WITH {MEMORIES}, {cleaned()}, n AS (SELECT (SELECT count(*) FROM units) AS read, (SELECT count(*) FROM kept) AS clean, (SELECT count(*) FROM (SELECT 1 FROM kept GROUP BY {KEY})) AS uniq) "
    + counted(("input", "SELECT 2 * read FROM n"), ("after_clean", "SELECT 2 * clean FROM n"), ("after_dedupe", "SELECT uniq FROM n"), ("output", "SELECT 2 * uniq FROM n")),
    "unicode_nfc": f"{_doc} SELECT ordinal, nfc_normalize(source_text || ' é ẛ̣ ﬁ') AS source_text, nfc_normalize(target_text || ' é ẛ̣ ﬁ') AS target_text FROM units",
    "detect_language": f"{_doc}, {_detected} SELECT ordinal, CASE WHEN best.n <= -2 THEN best.lang END AS lang FROM u",
    "filter_detected_language": f"{_doc}, own AS (SELECT * REPLACE (source_lang AS target_lang) FROM units), {cleaned('own')}"
    + f", x AS (SELECT ordinal, source_lang, {language_counts('source_text')} AS a, {language_counts('target_text')} AS b FROM kept) SELECT ordinal FROM x WHERE (a.n > -2 OR a.lang = lower(source_lang)[:2]) AND (b.n > -2 OR b.lang = lower(source_lang)[:2])",
    "validation_values": f"{_flagged}, {ALL_VALUES} {FOUND(VALUES)}",
    "top_findings": f"{_flagged}, {ALL_VALUES}, found AS ({FOUND([k for k in VALUES if k not in ('numbers', 'similar_words', 'quality')])} UNION ALL {FOUND(['numbers']).replace('mismatch > 0.1', 'mismatch > 1.0')}) SELECT CASE WHEN code IN {ERRORS} THEN 'error' ELSE 'warning' END AS severity, message, count(*)::BIGINT AS n FROM found GROUP BY 1, 2 ORDER BY n DESC, severity, message LIMIT 15",
    "export_pairs": f"{_doc} SELECT ordinal, 0 AS side, 'Translate from ' || source_lang || ' to ' || target_lang || ': ' || source_text AS prompt, target_text AS completion FROM units WHERE upper(source_lang) || '-' || upper(target_lang) IN ('EN-BG', 'FR-XX')",
    "format_templates": f"{_turn} SELECT ordinal, 0 AS side, source_lang || '>' || target_lang || ': {{as is}}' AS instruction, 'see above' AS input, target_text AS output FROM units",
    **{f"dpo_{mode}": rejected(mode) for mode in ("scramble", "noise", "repetition")},
    "near_duplicate_pairs": f"{_doc}, {FUZZY} SELECT a, b, source_jaccard, target_jaccard FROM near",
    "dedupe_fuzzy": f"WITH RECURSIVE {UNITS_DOC}, {FUZZY}, {GREEDY}, last AS (SELECT gone FROM walk ORDER BY k DESC LIMIT 1) SELECT ordinal FROM reps WHERE NOT list_contains((SELECT gone FROM last), ordinal)",
    "clean_dedupe_pair_stats": f"{_doc}, {cleaned()}, firsts AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY ordinal) = 1) SELECT source_lang, target_lang, count(*)::BIGINT AS n FROM firsts GROUP BY 1, 2",
    "clean_units": f"{_doc}, {cleaned()} SELECT {UNIT} FROM kept",
    "clean_html_urls": f"{_page} {_texts({'urls': True})}",
    "clean_emails": f"{_doc} {_texts({'emails': True})}",
    "clean_preserve_placeholders": f"{_page} {_texts({'tags': 'keep', 'placeholders': False})}",
    "mask_pii": f"{_doc} {_texts({'punct': False, 'pii': True})}",
    "filter_language_pair": f"{_doc} SELECT {UNIT} FROM units WHERE upper(source_lang) || '-' || upper(target_lang) IN ('EN-BG', 'FR-XX')",
    "filter_untranslated": f"{_doc} SELECT ordinal FROM units WHERE NOT (lower(source_lang)[:2] <> lower(target_lang)[:2] AND lower({strip('source_text')}) = lower({strip('target_text')}))",
    "filter_length_words_ratio": f"{_doc} SELECT ordinal FROM units WHERE least(length(source_text), length(target_text)) >= 100 AND greatest(length(source_text), length(target_text)) <= 5000 AND least({WORDS('source_text')}, {WORDS('target_text')}) >= 30 AND greatest({WORDS('source_text')}, {WORDS('target_text')}) <= 600 AND {RATIO} <= 1.01",
    "valid_units": f"{_doc} SELECT ordinal FROM units WHERE source_text <> '' AND target_text <> '' AND source_lang <> '' AND target_lang <> ''",
    "list_languages": f"{_doc} SELECT DISTINCT unnest([source_lang, target_lang]) AS lang FROM units",
    "list_pairs": f"{_doc} SELECT DISTINCT source_lang, target_lang FROM units WHERE source_lang <> '' AND target_lang <> ''",
    "list_target_languages": f"{_doc} SELECT DISTINCT target_lang FROM units",
    "expand_multilingual": f"""WITH {ENTRIES}
SELECT entry * 4096 + (a.k - 1) * (a.n - 1) + CASE WHEN b.k > a.k THEN b.k - 2 ELSE b.k - 1 END AS ordinal, source AS tu_id, a.lang AS source_lang, b.lang AS target_lang, a.text AS source_text, b.text AS target_text FROM numbered a JOIN numbered b USING (source, entry) WHERE a.k <> b.k AND a.n > 2""",
    "first_pair": f"""WITH {ENTRIES}, o AS (SELECT *, CASE WHEN has_en AND lang = 'EN' THEN 0 ELSE k END AS p FROM numbered), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY p) AS x FROM o)
SELECT a.entry AS ordinal, a.source AS tu_id, a.lang AS source_lang, b.lang AS target_lang, a.text AS source_text, b.text AS target_text FROM r a JOIN r b ON a.source = b.source AND a.x = 1 AND b.x = 2""",
    "expand_multilingual_whole": f"""WITH {ENTRIES_BY_RANK}
SELECT entry * 4096 + (k - 1) * (n - 1) + CASE WHEN other > k THEN other - 2 ELSE other - 1 END AS ordinal, source AS tu_id, source_lang, target_lang, source_text, target_text FROM pairs WHERE n > 2
UNION ALL SELECT ordinal * 4096, tu_id, source_lang, target_lang, source_text, target_text FROM firsts WHERE n < 3""",
    "first_pair_whole": f"WITH {ENTRIES_BY_RANK} SELECT ordinal, tu_id, source_lang, target_lang, source_text, target_text FROM firsts",
    "validate_flags": f"{_flagged} SELECT ordinal, {VALID} AS is_valid, {CODES(ERRORS)} AS errors, {CODES(WARNINGS)} AS warnings FROM flags",
    "number_mismatch_ratio": f"{_doc}, {NUMBERS} SELECT ordinal, mismatch FROM mism",
    "quality_score": f"{_doc}, {NUMBERS} SELECT ordinal, {SCORE} AS score FROM mism",
    "quality_gate": f"{_flagged} SELECT ordinal FROM flags WHERE {VALID} AND {SCORE} >= 60",
    "validation_report": f"{_flagged} " + " UNION ALL ".join(f"SELECT '{'error' if k in ERRORS else 'warning'}' AS severity, '{k}' AS code, count(*)::BIGINT AS n FROM flags WHERE f_{k} HAVING count(*) > 0" for k in FLAGS),
    "validation_totals": f"{_flagged} SELECT count(*)::BIGINT AS total, count(*) FILTER ({VALID})::BIGINT AS valid, count(*) FILTER (NOT {VALID})::BIGINT AS invalid, count(*) FILTER ({VALID})::DOUBLE / count(*) * 100 AS valid_pct FROM flags",
    "filter_valid_strict": f"{_flagged} SELECT ordinal FROM flags WHERE {VALID} AND {CLEAR}",
    "similar_words": f"""{_doc}, w AS (SELECT ordinal, list_distinct(regexp_extract_all(lower(source_text), '[^\\s\\x0b\\x1c-\\x1f]+')) AS a, list_distinct(regexp_extract_all(lower(target_text), '[^\\s\\x0b\\x1c-\\x1f]+')) AS b FROM units)
SELECT ordinal FROM w WHERE len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b))::DOUBLE / len(a) < 0.5""",
    "dedupe_exact": f"WITH {UNITS_LINE} SELECT min(ordinal) AS ordinal FROM units GROUP BY {KEY}",
    "dedupe_exact_ci": f"WITH {UNITS_LINE} SELECT min(ordinal) AS ordinal FROM units GROUP BY {KEY_CI}",
    "merge_dedupe": f"""WITH {UNITS_DOC.replace('units AS', 'one AS')}, {UNITS_TURN.replace('units AS', 'two AS')},
units AS (SELECT {UNIT} FROM one UNION ALL SELECT ordinal + 281474976710656, tu_id, source_lang, target_lang, source_text, target_text FROM two UNION ALL SELECT ordinal + 562949953421312, tu_id, source_lang, target_lang, source_text, target_text FROM one)
SELECT min(ordinal) AS ordinal FROM units GROUP BY {KEY}""",
    "near_duplicate_classes": f"{_doc}, {CLASSES} SELECT s.ordinal, r.ordinal AS rep FROM sides s JOIN reps r USING (x_s, x_t)",
    "dataset_stats": f"{_doc}, {STATS} SELECT {STATS_COLUMNS} FROM stats, sizes",
    "stats_pairs": f"{_doc} SELECT source_lang, target_lang, count(*)::BIGINT AS n FROM units WHERE source_text <> '' AND target_text <> '' GROUP BY 1, 2",
    "top_pairs": f"{_doc} SELECT source_lang, target_lang, count(*)::BIGINT AS n FROM units WHERE source_text <> '' AND target_text <> '' GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10",
    "stats_languages": f"{_doc} SELECT side, lang, count(*)::BIGINT AS n FROM (SELECT unnest(['source', 'target']) AS side, unnest([source_lang, target_lang]) AS lang FROM units WHERE source_text <> '' AND target_text <> '') GROUP BY 1, 2",
    "duplicate_count": f"{_doc} SELECT (count(*) - count(DISTINCT (source_lang, target_lang, source_text, target_text)))::BIGINT AS duplicates_found FROM units WHERE source_text <> '' AND target_text <> ''",
    "token_estimates": f"{_doc}, {STATS} SELECT " + ", ".join(f"floor({TOTAL_WORDS} * {r}::DOUBLE)::BIGINT AS {k}_estimated_tokens" for k, r in (("llama3", 1.35), ("qwen", 1.25), ("gpt4", 1.3), ("mistral", 1.32))) + " FROM sizes",
    "readiness": f"{_doc}, {STATS} SELECT (valid_units >= 10 AND floor({TOTAL_WORDS} * 1.35::DOUBLE) >= 100) AS is_ready, CASE WHEN valid_units >= 10 AND floor({TOTAL_WORDS} * 1.35::DOUBLE) >= 100 THEN 'ГОТОВ ЗА FINE-TUNING' ELSE 'НЕДОСТАТЪЧНО ДАННИ' END AS dataset_status, valid_units AS total_valid_units, floor({TOTAL_WORDS} * 1.35::DOUBLE)::BIGINT AS total_llm_tokens_est, CASE WHEN valid_units < 10000 THEN 3 ELSE 1 END AS recommended_epochs FROM stats, sizes",
    "terminology": f"""{_turn}, w AS (SELECT list_distinct(regexp_extract_all(lower(source_text), {q(LETTER + '{3,}')})) AS s, list_distinct(regexp_extract_all(lower(target_text), {q(LETTER + '{3,}')})) AS t FROM units WHERE source_text <> '' AND target_text <> ''),
e AS (SELECT unnest(s) AS source_term, t FROM w), p AS (SELECT source_term, unnest(t) AS target_term FROM e)
SELECT source_term, target_term, count(*)::BIGINT AS frequency FROM p GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY frequency DESC, source_term, target_term LIMIT 50""",
    "concordance": f"{_doc} SELECT tu_id AS id, source_lang, target_lang, source_text, target_text FROM units WHERE source_text <> '' AND target_text <> '' AND (contains(lower(source_text), 'the in') OR contains(lower(target_text), 'the in')) ORDER BY ordinal LIMIT 50",
    "pack_context": packed(2048),
    "pack_context_wide": packed(8192),
    "preview_page": f"{_doc} SELECT ordinal, tu_id, source_lang, target_lang, source_text, target_text FROM units ORDER BY ordinal LIMIT 25 OFFSET 50",
    "preview_rows": f"{_doc} SELECT tu_id, source_lang, target_lang, substr(source_text, 1, 120) AS source_text, substr(target_text, 1, 120) AS target_text FROM units ORDER BY ordinal LIMIT 5",
    "format_standard": f"{_doc} SELECT ordinal, 0 AS side, tu_id AS id, source_lang, target_lang, source_text AS source, target_text AS target, source AS meta_source FROM units",
    "format_alpaca": f"{_turn} SELECT ordinal, 0 AS side, {ASK} AS instruction, source_text AS input, target_text AS output FROM units",
    "format_prompt_completion": f"{_turn} SELECT ordinal, 0 AS side, 'Translate from ' || source_lang || ' to ' || target_lang || ': ' || source_text AS prompt, target_text AS completion FROM units",
    "format_sharegpt": f"{_turn} " + messages("conversations", chat("from", "value", ("system", "'You are a professional translator. Translate text from ' || source_lang || ' to ' || target_lang || '.'"), ("human", "source_text"), ("gpt", "target_text"))),
    "format_chatml": f"{_turn} " + messages("messages", chat("role", "content", ("system", ASK), ("user", "source_text"), ("assistant", "target_text"))),
    "format_openai": f"{_turn} " + messages("messages", chat("role", "content", ("system", ASK), ("user", "source_text"), ("assistant", "target_text"))),
    "format_reasoning": f"{_turn} " + messages("messages", chat("role", "content", ("system", f"{ASK} || ' Show your reasoning.'"), ("user", "source_text"), ("assistant", "'Source text in ' || source_lang || ': ''' || source_text || '''. Context: formal translation task.' || chr(10) || chr(10) || 'Translation: ' || target_text"))),
    "bidirectional": f"{_turn} SELECT ordinal, 0 AS side, source_lang, target_lang, source_text AS source, target_text AS target FROM units UNION ALL SELECT ordinal, 1, target_lang, source_lang, target_text, source_text FROM units",
    "dpo_truncation": f"{_turn} SELECT ordinal, 0 AS side, {ASK} || chr(10) || source_text AS prompt, target_text AS chosen, substr(target_text, 1, floor(length(target_text) * 0.5)::INT) AS rejected FROM units",
    "dpo_copy_source": f"{_turn} SELECT ordinal, 0 AS side, {ASK} || chr(10) || source_text AS prompt, target_text AS chosen, source_text AS rejected FROM units",
    "dpo_empty": f"{_turn} SELECT ordinal, 0 AS side, {ASK} || chr(10) || source_text AS prompt, target_text AS chosen, '' AS rejected FROM units",
    "split_random": split_sql((0.9, 0.05, 0.05), ""),
    "split_stratified": split_sql((0.8, 0.1, 0.1), "PARTITION BY source_lang, target_lang"),
}
