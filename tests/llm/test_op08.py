import random
import re

import pytest

from bitloom.llm import op08_extract as op

LONG = "This is a long sentence, with words, and marks; it goes on and on. "


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""),
        ("   ", ""),
        ("<html><script>var x = '<p>no</p>';</script></html>", ""),
        ("plain text, no tags.", "plain text, no tags."),
        (f"<nav><a>Home</a></nav><article><h1>Title</h1><p><b>{LONG}<br><p>Be. Erin.</p><p>a &amp;lt; b&nbsp;&eacute;</p></article><footer>&copy; x</footer>", f"Title\n{LONG.strip()}\nBe. Erin.\na &lt; b é"),
        (f"<body><div class='ad'>{LONG * 3}</div><div id=content><p>{LONG}</p><p>{LONG}</p><ul><li>one<li>two</ul></div><div class='comments'><p>{LONG * 9}</p></div></body>", f"{LONG.strip()}\n{LONG.strip()}\none\ntwo"),
        (f"<header><h1>Site</h1></header><main><header><h1>Head</h1></header><p>{LONG}</p><form><p>{LONG}</p></form><aside>{LONG * 4}</aside><p>x\n  y</p></main>", f"Head\n{LONG.strip()}\nx y"),
        (f"<article><p>{LONG}<a href=x>{LONG}</a></p><p>ok<!-- no > --> then</p><style>p{{}}</style></article>", f"{LONG.strip()} {LONG.strip()}\nok then"),
        (f"<div><p title='a > b' data-x=\"'>\">{LONG}</p><p>1 < 2 and x<3</p></div><p class=cookie-notice>We use cookies. {LONG * 3}</p>", f"{LONG.strip()}\n1 < 2 and x<3"),
        (f"<article><p>{LONG}</p><p>{LONG}<!-- open", f"{LONG.strip()}\n{LONG.strip()}"),
        ("<article>a<p" + " x" * 50000, "a"),
        ("<article>a<p b=\"" + "'" * 50000, "a"),
        ("<div>" * 20000 + LONG + "</span>" * 20000 + f"<p>{LONG}", f"{LONG.strip()}\n{LONG.strip()}"),
        (f"<article>{'<p><i>' * 20000}{LONG}</article>", LONG.strip()),
    ],
)
def test_pages(page, want):
    assert op.extract(page) == want


def test_query(spark, tmp_path):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>"), (2, None, None), (None, "v", ""), (3, "w", "<p>" + LONG * 5000), (3, "w", "é")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = sorted((tuple(x) for x in op.query(spark, str(tmp_path)).collect()), key=str)
    texts = [LONG.strip(), "", "", (LONG * 5000).strip(), "é"]
    assert out == sorted(((p, u, t, len(t)) for (p, u, _), t in zip(rows, texts)), key=str)
    spark.createDataFrame([], "page_id long, url string, html string").write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    assert op.query(spark, str(tmp_path)).collect() == []


BODY = f"<p>{LONG * 3}</p>" * 4


@pytest.mark.parametrize("wrap", ["<div class=body>{}</div>", "<section>{}</section>", "<ul><li>{}</ul>", "<table><tr><td>{}</table>", "<div><pre>{}</pre></div>"])
@pytest.mark.parametrize("outer", ["article", "main", "div"])
def test_no_block_of_the_article_is_left_out(wrap, outer):
    held = BODY if "pre" not in wrap else LONG * 12
    got = op.extract(f"<body><{outer}><h1>Title</h1><p class=lead>A lead.</p>{wrap.format(held)}<p class=end>The end</p></{outer}><footer>x</footer>")
    assert got == "\n".join(["Title", "A lead.", *([(LONG * 3).strip()] * 4 if held == BODY else [(LONG * 12).strip()]), "The end"])


@pytest.mark.parametrize(
    "page",
    [
        "<div class='content has-sidebar'><article>{}</article></div>",
        "<div class='layout-with-sidebar'><article>{}</article><div class='sidebar widget-area'>x, y.</div></div>",
        "<div class='sidebar'><main>{}</main></div>",
        "<div class='page-header'><div class=nav><div>{}</div></div></div>",
        "<div data-id='search' title='a id=menu'><article>{}</article></div>",
        "<article>{}</article><div class='related-posts'><article><p>No, no.</p></article></div><ol class='comment-list comments'><article><p>No.</p></article></ol>",
    ],
)
def test_names_exclude_no_article(page):
    body = f"<h1>Title</h1>{BODY}"
    assert op.extract(page.format(body)) == "\n".join(["Title", *[(LONG * 3).strip()] * 4])


def test_names_in_the_article():
    inner = "<div class='entry-header'><h1>Title</h1></div><h2 id='search'>Search</h2><h2 id='search-algorithms'>Find</h2><section id='related-work'><p>Work.</p></section><p class='notice-of-meeting'>Meet.</p>"
    bad = "<div class='cookie-notice'>no</div><div id='comments'>no</div><div class='ad-slot'>no</div><p class='site-footer'>no</p><p role='navigation'>no</p>"
    assert op.extract(f"<article>{inner}{bad}{BODY}</article>") == "\n".join(["Title", "Search", "Find", "Work.", "Meet.", *[(LONG * 3).strip()] * 4])


@pytest.mark.parametrize(
    "page",
    [
        "<div class='layout has-sidebar'><nav><a>x</a></nav>{}</div>",
        "<div class='page no-sidebar'>{}<footer>(c) x</footer></div>",
        "<div class='header-fixed'>{}</div><div class=footer>All rights.</div>",
        "<div id='search'><form>Find <button>go</button></form>{}</div>",
        "<form action=x>{}</form><div class=menu><a>Home</a> <a>News</a></div>",
    ],
)
@pytest.mark.parametrize("tag", ["article", "div"])
def test_names_and_forms_around_most_text(page, tag):
    body = f"<{tag}><div class='article-header'><h1>Title</h1></div>{BODY}</{tag}>"
    assert op.extract(page.format(body)) == "\n".join(["Title", *[(LONG * 3).strip()] * 4])


def test_both_sections_stay():
    page = f"<div><section><h2>One</h2>{BODY * 5}</section><section><h2>Two</h2><p>{LONG * 3}</p><p>{LONG * 2}</p></section></div><ul><li><a>x</a><li><a>y</a></ul>"
    assert op.extract(page) == "\n".join(["One", *[(LONG * 3).strip()] * 20, "Two", (LONG * 3).strip(), (LONG * 2).strip()])


def unnamed(r):
    """A page without telling tags or names, and its article."""
    text = lambda n: " ".join(r.choice("one two three, four five. six seven; eight".split()) for _ in range(n)) + "."
    links = "".join(f"<div><a href=x>{text(r.randrange(1, 4))}</a></div>" for _ in range(8))
    article = [text(6), *(text(r.randrange(20, 120)) for _ in range(r.randrange(4, 12)))]
    parts = [f"<div>{links}</div>", f"<div class=k1>{r.choice(['Buy', 'Get'])} this now.</div>", f"<div class=k2><h1>{article[0]}</h1>{''.join(f'<p>{x}</p>' for x in article[1:])}</div>", f"<div><div>{links}</div></div>", "<div class=k3>All rights of this site.</div>"]
    return "<body>" + "".join(parts) + "</body>", "\n".join(article)


def test_ratios_decide_where_nothing_is_named(monkeypatch):
    r = random.Random(5)
    pages = [unnamed(r) for _ in range(60)]
    assert all(op.extract(page) == article for page, article in pages)
    assert not any(op.extract(page, 0.0) == article for page, article in pages)  # without the threshold
    monkeypatch.setattr(op, "ratios", lambda p: {p.path[k]: 1.0 for k, _, _ in p.blocks})
    assert not any(op.extract(page) == article for page, article in pages)  # without ratios


def test_threshold_decides_where_tags_tell():
    page = f"<nav><a>Home</a></nav><div class=ad>Buy now.</div><article><h1>Title</h1>{BODY}</article><footer>All rights.</footer>"
    assert op.extract(page) == "\n".join(["Title", *[(LONG * 3).strip()] * 4])
    assert op.extract(page, 0.0).split("\n")[0] == "Home"


def test_ratios_against_plain_python():
    r = random.Random(6)
    for _ in range(40):
        p = op.read(unnamed(r)[0].replace("<p>", "<p class=a>", r.randrange(4)))
        paths = [p.path[k] for k, _, _ in p.blocks]
        tags = {}
        for k in range(len(p.parent)):
            x, way = p.path[k], []
            while x > 0:
                way.append(x)
                x = p.above[x]
            tags[p.path[k]] = way[::-1]
        ratio = {}
        for x in set(paths):
            own = [(t, n) for (k, t, n) in p.blocks if p.path[k] == x]
            ratio[x] = (sum(max(0, len(t) - 2 * n) for t, n in own), sum(len(re.findall(r"[.,;:!?…](?=\s|$)", t)) for t, n in own if 2 * n < len(t)), len(own))
        most = max(c for c, _, _ in ratio.values()) or 1
        ratio = {x: 0.05 + 0.95 * (c / n) / (c / n + 120) * (m / n + 0.25) / (m / n + 1) * (c / most) ** 0.25 for x, (c, m, n) in ratio.items()}
        assert op.ratios(p) == pytest.approx(ratio)
        smooth = {}
        for i, x in enumerate(paths):
            total = weight = 0.0
            for j in range(max(0, i - 2), min(len(paths), i + 3)):
                a, b = tags[x], tags[paths[j]]
                common = next((n for n, (u, v) in enumerate(zip(a, b)) if u != v), min(len(a), len(b)))
                w = (4, 2, 1)[abs(i - j)] * (common / max(len(a), len(b))) ** 2
                total, weight = total + w * ratio[paths[j]], weight + w
            smooth.setdefault(x, []).append(total / weight)
        assert op.smoothed(p, op.ratios(p)) == pytest.approx({x: sum(v) / len(v) for x, v in smooth.items()})


def test_clashing_columns(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", 7, "t")] * 2
    out = op.main_text(spark.createDataFrame(rows, "page_id int, url string, html string, n_chars int, text string")).collect()
    assert [tuple(x) for x in out] == [(1, "u", LONG.strip(), len(LONG.strip()))] * 2
